"""Language identification by rank-order profiles.

A profile is the list of a text's (or a language's) most frequent character n-grams, most frequent first. The
distance of a text to a language is out-of-place: for each n-gram of the text's profile, how far its rank is from
its rank in the language's profile, or the profile length if it isn't there. The nearest language wins.

N-grams of one to three characters run over lower-cased letters; everything else is a blank, and blanks in a row
count once. An n-gram is its hash among 2^16 for each length, so counting a text is sorting integers. A long text is
counted in parts whose n-grams run across the cuts, so its counts are those of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from lexmill.llm.common import bounded_sample, fresh, split_remainder, staged, texts_of, with_least_text

UNDETERMINED = "und"
#: Length of a profile, and the longest n-gram.
PROFILE = 300
LONGEST = 3
#: Documents of each language that a profile is learned from, at most (those of least seeded hash).
SAMPLE_PER_LANGUAGE = 1_000
#: Characters counted at once.
PART = 1 << 20
#: Languages up to which a text is compared with all of them by one dense table (0.4 MB a language); beyond, by lists.
DENSE_LANGUAGES = 64

_SPACE = 1 << 16


def _letter_table() -> np.ndarray:
    """Code by code point: lower-cased letters their own point plus one, anything else 0."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = c + 1
    return out


_letters: list[np.ndarray] = []


def _codes(text: str, before: np.ndarray, last: bool) -> np.ndarray:
    """Letter codes with single blanks between words: the codes ``before``, then the text's, a blank at the end if ``last``.

    The two forms of a small sigma, which lower() chooses by what follows, count as one; all else is letter by letter.
    """
    if not _letters:
        _letters.append(_letter_table())
    points = np.frombuffer(text.lower().replace("ς", "σ").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = np.concatenate((before, _letters[0][points], np.zeros(int(last), dtype=np.uint32)))
    return codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]]


def _grams(codes: np.ndarray, known: int) -> np.ndarray:
    """The hashed n-grams of all lengths that end after the first ``known`` codes, blanks alone left out."""
    out = []
    with np.errstate(over="ignore"):
        mixed = codes.astype(np.uint32)
        for n in range(1, LONGEST + 1):
            if n > 1:
                mixed = mixed[:-1] * np.uint32(0x9E3779B1) + codes[n - 1 :]
            new = mixed[max(0, known - n + 1) :]
            hashed = ((new * np.uint32(0x85EBCA6B)) >> np.uint32(16)) + np.uint32((n - 1) * _SPACE)
            out.append(hashed[codes[known:] != 0] if n == 1 else hashed)
    return np.concatenate(out)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams in ascending order, their counts) of a whole text."""
    blank = np.zeros(1, dtype=np.uint32)
    if len(text) <= PART:
        return np.unique(_grams(_codes(text, blank, True), 1), return_counts=True)
    total, before = np.zeros(LONGEST * _SPACE, dtype=np.int64), blank
    for s in range(0, len(text), PART):
        codes = _codes(text[s : s + PART], before, s + PART >= len(text))
        total += np.bincount(_grams(codes, len(before)), minlength=len(total))
        before = codes[-(LONGEST - 1) :]
    found = np.flatnonzero(total)
    return found.astype(np.uint32), total[found]


def profile(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The PROFILE most frequent n-grams, ties by n-gram."""
    if len(counts) > PROFILE:
        least = np.partition(counts, len(counts) - PROFILE)[len(counts) - PROFILE]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))][:PROFILE]


class Profiles:
    """The languages' profiles; ``identify`` gives (language, score) of a text. 2 kB a language, and a table if they are few."""

    def __init__(self, ranked: dict[str, list[int]]):
        self.languages = sorted(ranked)
        grams = np.concatenate([np.zeros(0, dtype=np.int64), *[np.array(ranked[x], dtype=np.int64) for x in self.languages]])
        ranks = np.concatenate([np.zeros(0, dtype=np.int16), *[np.arange(len(ranked[x]), dtype=np.int16) for x in self.languages]])
        owners = np.repeat(np.arange(len(self.languages)), [len(ranked[x]) for x in self.languages]).astype(np.int32)
        order = np.argsort(grams, kind="stable")
        # by n-gram: which languages have it, at which rank
        self.owners, self.ranks = owners[order], ranks[order]
        self.ends = np.cumsum(np.bincount(grams, minlength=LONGEST * _SPACE)).astype(np.int64)
        self.table = None
        if len(ranked) <= DENSE_LANGUAGES:
            self.table = np.full((len(ranked), LONGEST * _SPACE), -1, dtype=np.int16)
            self.table[owners, grams] = ranks

    def distances(self, text: str) -> np.ndarray | None:
        """Out-of-place distance to each language, from 0 to 1; None if the text has no letter."""
        mine = profile(*gram_counts(text))
        if not len(mine):
            return None
        if self.table is not None:
            theirs = self.table[:, mine].astype(np.int64)
            places = np.abs(theirs - np.arange(len(mine)))
            return np.where(theirs < 0, PROFILE, np.minimum(places, PROFILE)).sum(axis=1) / (len(mine) * PROFILE)
        ends = self.ends[mine]
        sizes = ends - np.where(mine > 0, self.ends[mine.astype(np.int64) - 1], 0)
        at = np.repeat(ends - sizes, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        places = np.abs(self.ranks[at].astype(np.int64) - np.repeat(np.arange(len(mine)), sizes))
        saved = np.bincount(self.owners[at], weights=PROFILE - np.minimum(places, PROFILE), minlength=len(self.languages))
        return (len(mine) * PROFILE - saved) / (len(mine) * PROFILE)

    def identify(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return UNDETERMINED, 0.0
        far = self.distances(text)
        if far is None:
            return UNDETERMINED, 0.0
        best = int(np.argmin(far))
        return self.languages[best], float(1.0 - far[best])


def _sample_grams(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            grams, counts = gram_counts(text.as_py())
            if len(grams):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])


def learn(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Profiles:
    """Profiles of every non-null lang, from at most ``per_language`` documents of each, one text an id (equal rows count each).

    Only the ids are ranked; the sampled texts are counted where they are read, and the counts added up by
    (lang, n-gram). The driver gets PROFILE rows for each language.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where("lang is not null and doc_id is not null and text is not null")
    chosen = staged(bounded_sample(with_least_text(known, "doc_id", "lang"), "lang", per_language), "language-sample")
    texts = texts_of(known, chosen, "doc_id", "lang").select("lang", "text")
    counted = texts.mapInArrow(_sample_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    ranked: dict[str, list[int]] = {}
    for r in counted.withColumn("rank", rank).where(F.col("rank") <= PROFILE).orderBy("lang", "rank").collect():
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranked)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``docs`` (all columns) with the columns lang_pred and score, one row per row; the text alone decides.

    Null text, no letter, or no language learned: lang_pred ``und``, score 0. Score: one minus the distance. Columns of
    these names that ``docs`` has already stay, and the new ones get underscores (``common.fresh``).
    """
    names = [fresh(docs, n) for n in ("lang_pred", "score")]
    model = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        for b in batches:
            found = [model.value.identify(t.as_py()) for t in b.column(b.num_columns - 1)]
            best, scores = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(best, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names[:-1], *names])

    schema = StructType([*docs.schema.fields]).add(names[0], StringType()).add(names[1], DoubleType())
    return docs.withColumn(fresh(docs, "searched"), F.col("text").cast("string")).mapInArrow(run, schema)


def predicted_languages(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from the rows that aren't held out.

    Null doc_id: not held out, but not learned from. Repeated rows are repeated. Other columns are ignored;
    an empty table gives an empty result.
    """
    out = F.coalesce(split_remainder(F.col("doc_id"), folds) == held, F.lit(False))
    profiles = learn(docs.where(~out))
    return identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")
