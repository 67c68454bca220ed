"""Source divergence audit: how far each source's term frequencies of a language lie from every other source's.

A kept term is one count a source, most of them zero. Terms with the same sparse vector of (source, count) are one row
with a multiplicity, and every pair of sources in a vector is evaluated once for all of them. Pairs with a zero on one
side or both aren't evaluated a vector: with f0 = f(zero, zero),

    sum of f(p, q) = V f0 + sum of [f(p, 0) - f0] + sum of [f(0, q) - f0] + sum of [f(p, q) - f(p, 0) - f(0, q) + f0],

where the middle sums run over a source's distinct counts with their multiplicities, and the last over vectors that hold
both sources. So the work is the squares of the vectors' lengths, not of the number of sources. All of it is whole
numbers: shares p are counts' parts of SCALE, f(p, q) = floor((p - q)^2 / q). A share is at most SCALE + 1 and the shares
of one group sum to at most SCALE + V, so every sum stays under (SCALE + V)^2, inside a long up to two billion terms.

Null text, lang and source are ''. Terms are runs of letters A-Z, a-z and of characters beyond ASCII, A-Z lower-cased.
A row is a document: repeated rows count each. Texts of any length are cut into terms in slices. Empty tables give none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import chunks, staged

SCALE = 1_000_000_000
#: Documents of a language that must hold a term.
LEAST_DOCUMENTS = 3
#: Terms a group is reported with.
TOP_TERMS = 200
#: Bytes of text cut into terms at once; entries a task counts or sums before it hands them on, some at a time.
SLICE = 1 << 20
ENTRIES = 1 << 20
PAIRS = 1 << 20
ROWS = 1 << 15
#: Bytes of distinct terms that weigh as much as an entry.
ENTRY_BYTES = 32

_COUNTS = "lang string, source string, term string, n long, docs long"
#: Bytes of terms as they are, A-Z in lower case, all else a space.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SPACE = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def _slices(text: bytes) -> Iterator[bytes]:
    first = 0
    while first < len(text):
        end = min(first + SLICE, len(text))
        cut = _SPACE.search(text, end) if end < len(text) else None
        last = cut.start() if cut else (end if end == len(text) else len(text))
        yield text[first:last]
        first = last


def _of_texts(texts: pa.Array, group: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray, np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of the terms of a slice of texts, whose groups are numbered."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2].slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes().translate(_TERM_BYTES), np.uint8)
    offsets = offsets - offsets[0]
    inside = data != 32
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    # a text that begins with a term begins one, whatever the text before ends with
    ahead = offsets[:-1][np.diff(offsets) > 0]
    starts[ahead] = inside[ahead]
    place = np.flatnonzero(starts)
    bounds = np.concatenate([np.cumsum(inside, dtype=np.int32)[place] - 1, [np.count_nonzero(inside)]]).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])]).dictionary_encode()
    doc = np.searchsorted(offsets, place, "right") - 1
    key = (group[doc] * len(terms.dictionary) + terms.indices.to_numpy()) * len(texts) + doc
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    n, key = np.diff(np.append(first, len(key))), key[first] // len(texts)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    key, docs = key[first], np.diff(np.append(first, len(key)))
    # per key the occurrences: the runs between the first rows of two keys
    n = np.add.reduceat(n, first) if len(first) else n
    group, term = np.divmod(key, max(1, len(terms.dictionary)))
    return group, pa.DictionaryArray.from_arrays(pa.array(term, pa.int32()), terms.dictionary), n, docs


def _of_long_text(text: bytes, group: int) -> tuple[np.ndarray, pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The same for one text over SLICE, which is cut into terms a slice at a time."""
    found: Counter = Counter()
    for part in _slices(text):
        found.update(part.translate(_TERM_BYTES).split())
    terms = pa.DictionaryArray.from_arrays(pa.array(np.arange(len(found)), pa.int32()), pa.array(found, pa.binary()))
    return np.full(len(found), group, np.int64), terms, np.fromiter(found.values(), np.int64, len(found)), np.ones(len(found), np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of whole texts, summed by (lang, source) within the task.

    What waits is numbers: an entry holds those of its group and its term, and a term's bytes are held once a slice.
    """
    names: dict[tuple, int] = {}
    held: list[tuple[np.ndarray, pa.DictionaryArray, np.ndarray, np.ndarray]] = []

    def weight(group: np.ndarray, entries: pa.DictionaryArray, *_: np.ndarray) -> int:
        return len(group) + entries.dictionary.nbytes // ENTRY_BYTES

    def merge() -> None:
        chunked = pa.chunked_array([x[1] for x in held]).unify_dictionaries()
        terms = chunked.chunk(0).dictionary
        key = np.concatenate([x[0] * len(terms) + c.indices.to_numpy() for x, c in zip(held, chunked.chunks, strict=True)])
        n, docs = (np.concatenate([x[k] for x in held]) for k in (2, 3))
        held.clear()
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        group, term = np.divmod(key[first], len(terms))
        held.append((group, pa.DictionaryArray.from_arrays(pa.array(term, pa.int32()), terms), *(np.add.reduceat(x[order], first) for x in (n, docs))))

    def handed() -> Iterator[pa.RecordBatch]:
        ((group, entries, n, docs),) = held
        held.clear()
        langs, sources = (pa.array(c, pa.string()) for c in zip(*names, strict=True))
        terms = entries.dictionary.cast(pa.string())
        for at in range(0, len(group), ROWS):
            some = slice(at, at + ROWS)
            own = pa.array(group[some])
            columns = [langs.take(own), sources.take(own), terms.take(entries.indices[some]), pa.array(n[some]), pa.array(docs[some])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    waiting = 0
    for batch in batches:
        if held and len(names) > ENTRIES:
            merge()
            yield from handed()
        if not held:
            names.clear()
            waiting = 0
        lang, source = (batch.column(k).dictionary_encode() for k in (1, 2))
        both, group = np.unique(lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(), return_inverse=True)
        groups = [x.dictionary.take(pa.array(k)).to_pylist() for x, k in zip((lang, source), np.divmod(both, max(1, len(source.dictionary))), strict=True)]
        group = np.array([names.setdefault(g, len(names)) for g in zip(*groups, strict=True)], np.int64)[group]
        at = 0
        for texts in chunks(batch.column(0), SLICE):
            own, texts = group[at : at + len(texts)], texts.cast(pa.binary())
            at += len(texts)
            size = pc.sum(pc.binary_length(texts)).as_py()
            if not size:
                continue
            found = _of_long_text(texts[0].as_py(), own[0]) if len(texts) == 1 and size > SLICE else _of_texts(texts, own)
            if not len(found[0]):
                continue
            held.append(found)
            waiting += weight(*held[-1])
            if waiting > ENTRIES:
                merge()
                waiting = weight(*held[0])
                if waiting > ENTRIES // 2:
                    yield from handed()
                    waiting = 0
    if held:
        merge()
        yield from handed()


def term_counts(documents: DataFrame) -> DataFrame:
    """Occurrences n and documents docs of each term by lang and source; the rows lie by lang and term.

    Tasks sum their terms before they are dealt; a sum by Spark there would hold all of them again and merge few.
    """
    rows = documents.select(*[_text(c) for c in ("text", "lang", "source")])
    counts = rows.mapInArrow(_count, _COUNTS).repartition("lang", "term")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


def _share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE (count + 1) / total), in decimals, as counts of large corpora times SCALE exceed a long."""
    exact = (F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")).alias("exact")
    return F.lit(1) + F.call_function("div", exact, total.cast("decimal(20,0)"))


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _shared_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each ordered pair of sources that a vector holds: m (f(p, q) - f(p, 0) - f(0, q) + f0), summed within the task.

    Rows are vectors of one language each: lang, m, entries array<struct<source, p, p0>>, p0 the share of a zero.
    """
    names: dict[tuple, int] = {}
    keys, values, waiting = [], [], 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        key, total = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[first], np.add.reduceat(total[order], first)

    def rows(key: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        langs, sources = (pa.array(c, pa.string()) for c in zip(*names, strict=True))
        s, t = pa.array(key >> 31), pa.array(key & (1 << 31) - 1)
        return pa.RecordBatch.from_arrays([langs.take(s), sources.take(s), sources.take(t), pa.array(total)], names=["lang", "source", "item", "value"])

    for batch in batches:
        vectors, weight = batch.column("entries"), batch.column("m").to_numpy()
        offsets, entries = vectors.offsets.to_numpy(), vectors.values
        p, p0 = (entries.field(c).to_numpy() for c in ("p", "p0"))
        own = entries.field("source").dictionary_encode()
        lang = batch.column("lang").dictionary_encode()
        code = {k: np.array([names.setdefault((x, y), len(names)) for y in own.dictionary.to_pylist()], np.int64) for k, x in enumerate(lang.dictionary.to_pylist())}
        own, lang, sizes = own.indices.to_numpy(), lang.indices.to_numpy(), np.diff(offsets)
        # vectors of one language and length at once
        for of, k in np.unique(np.stack([lang, sizes]), axis=1).T:
            same = np.flatnonzero((lang == of) & (sizes == k))
            per = max(1, PAIRS // (k * k))
            for at in range(0, len(same), per):
                some = same[at : at + per]
                place = offsets[some][:, None] + np.arange(k)
                step = max(1, PAIRS // (len(some) * k))
                for first in range(0, k, step):
                    x, y = place[:, first : first + step, None], place[:, None, :]
                    a, a0, b, b0 = p[x], p0[x], p[y], p0[y]
                    value = weight[some][:, None, None] * ((a - b) ** 2 // b - (a - b0) ** 2 // b0 - (a0 - b) ** 2 // b + (a0 - b0) ** 2 // b0)
                    key = (code[of][own[x]] << 31) + code[of][own[y]]
                    apart = np.broadcast_to(x != y, value.shape)
                    keys.append(key[apart])
                    values.append(value[apart])
                    waiting += len(keys[-1])
                    if waiting > 2 * PAIRS:
                        held = summed()
                        keys, values, waiting = [held[0]], [held[1]], len(held[0])
                        if waiting > PAIRS:
                            yield rows(*held)
                            keys, values, waiting = [], [], 0
    if waiting:
        yield rows(*summed())


def divergence(documents: DataFrame, least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank; ``top_terms`` bounds the report of terms alone.

    Part ``pair``: an item is another source of the language, the value the summed divergence of the source from it.
    Part ``term``: an item is a term that the source holds more often than its language, the value its divergence.
    """
    vector = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector")
    kept = term_counts(documents).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), vector)
    kept = staged(kept.where(F.col("docs") >= least_documents).drop("docs"), "divergence-kept")
    vectors = kept.groupBy("lang", "vector").agg(F.count("*").alias("m"), F.first("n").alias("n"))
    vectors = staged(vectors.withColumn("id", F.monotonically_increasing_id()), "divergence-vectors")

    groups = documents.select(_text("lang"), _text("source")).distinct()
    base = staged(_groups(groups, vectors), "divergence-groups")
    found = vectors.select("lang", "id", "m", F.explode("vector").alias("x")).select("lang", "id", "m", F.col("x.source").alias("source"), F.col("x.n").alias("n"))
    entries = found.join(base, ["lang", "source"]).select("lang", "id", "m", "source", "n", _share(F.col("n"), F.col("size")).alias("p"), "p0")
    entries = staged(entries, "divergence-entries")
    vectors_with_shares = entries.groupBy("lang", "id", "m").agg(F.collect_list(F.struct("source", "p", "p0")).alias("entries"))
    both = vectors_with_shares.mapInArrow(_shared_pairs, "lang string, source string, item string, value long")

    other = base.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    f0 = _f(F.col("p0"), F.col("q0"))
    neither = base.join(other, "lang").where(F.col("source") != F.col("item")).select("lang", "source", "item", (F.col("terms") * f0).alias("value"))
    histogram = entries.groupBy("lang", "source", "n").agg(F.sum("m").alias("m"), F.first("p").alias("p"), F.first("p0").alias("p0"))
    one = histogram.join(other, "lang").where(F.col("source") != F.col("item")).groupBy("lang", "source", "item")
    one = one.agg(F.sum(F.col("m") * (_f(F.col("p"), F.col("q0")) - f0)).alias("there"), F.sum(F.col("m") * (_f(F.col("q0"), F.col("p")) - _f(F.col("q0"), F.col("p0")))).alias("back"))
    there, back = one.select("lang", "source", "item", F.col("there").alias("value")), one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value"))
    pairs = neither.union(there).union(back).union(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    spread = kept.select("lang", F.col("term").alias("item"), F.col("n").alias("all"), F.explode("vector").alias("x"))
    spread = spread.select("lang", "item", "all", F.col("x.source").alias("source"), F.col("x.n").alias("n")).join(base, ["lang", "source"])
    spread = spread.select("lang", "source", "item", _share(F.col("n"), F.col("size")).alias("p"), _share(F.col("all"), F.col("lang_size")).alias("q")).where("p > q")
    terms = spread.select("lang", "source", "item", _f(F.col("p"), F.col("q")).alias("value")).select("*", rank).where(F.col("rank") <= top_terms)
    out = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return out(pairs.select("*", rank), "pair").union(out(terms, "term"))


def _groups(groups: DataFrame, vectors: DataFrame) -> DataFrame:
    """Each group's size, its language's, the kept terms of its language (0: none) and the share p0 of a term that it lacks."""
    langs = vectors.groupBy("lang").agg(F.sum("m").alias("terms"), F.sum(F.col("m") * F.col("n")).alias("all"))
    totals = vectors.select("lang", "m", F.explode("vector").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum(F.col("m") * F.col("x.n")).alias("total"))
    found = groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["terms", "all", "total"])
    size = F.col("total") + F.col("terms")
    p0 = F.when(F.col("terms") > 0, _share(F.lit(0), size)).otherwise(1)
    return found.select("lang", "source", "terms", size.alias("size"), (F.col("all") + F.col("terms")).alias("lang_size"), p0.alias("p0"))


#: DuckDB form: every pair for every term, without vectors.
ORACLE_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), counts AS (
    SELECT id, lang, source, term, count(*) AS n FROM (SELECT id, lang, source, unnest(terms) AS term FROM docs) GROUP BY ALL
), kept AS (
    SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY ALL HAVING count(*) >= 3
), groups AS (SELECT DISTINCT lang, source FROM docs), held AS (
    SELECT lang, source, term, sum(n)::HUGEINT AS n FROM counts SEMI JOIN kept USING (lang, term) GROUP BY ALL
), sizes AS (
    SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS size FROM groups LEFT JOIN held USING (lang, source) GROUP BY ALL
), langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS size FROM kept GROUP BY lang), shares AS (
    SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n, 1 + 1000000000 * (coalesce(h.n, 0) + 1) // (g.size + l.v) AS p,
        1 + 1000000000 * (k.n + 1) // (l.size + l.v) AS q
    FROM sizes g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), rows AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE n > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM rows)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""
