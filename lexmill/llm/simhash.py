"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprint: 64 bits over the word 3-shingles of a text (ASCII lower case, XXH64 seed 42). Two fingerprints
link at three or fewer differing bits.

Search. A link of radius 3 meets halfway at a variant one flip from one side and one or two flips from the
other. Every fingerprint emits itself and its 64 one-flip variants; two at distance 1 or 2 meet there. At
distance 3 exactly one of the two has even parity, and of the three differing bits two lie in the same half
of the word; so fingerprints of even parity also emit the 992 two-flip variants with both flips in the same
half, and meet the one-flip variant of the other side. That is 65 or 1,057 variants, no matter how many
copies there are, and every link is found.

A variant's bucket holds ``near`` members (at most one flip away) and ``far`` members (two flips). Near
members are within 2 of each other and within 3 of every far member, so a bucket with a near member is
connected through it: its links are a star, never all pairs. Buckets are bounded by geometry (at most 2,081
distinct fingerprints), so no key is hot. Each collision is verified by its popcount before it counts.

Variants travel as packed arrays of 10 bytes a variant, grouped by a hash range of the variant; the ranges, the
tasks that emit them and the tasks that read them grow in number with the input, not in size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import discarded, staged

SEED = 42
RADIUS = 3
#: Fingerprints whose variants one map step holds at once (about 560 variants each).
FLUSH = 2048
#: Variants that one hash range should hold.
RANGE_VARIANTS = 1_500_000
LEAST_RANGES = 64
#: Distinct fingerprints that one task emits the variants of, and hash ranges that one task reads; beyond MOST_READERS
#: tasks each reads more ranges, one after another.
FINGERPRINTS_PER_TASK = 8192
RANGES_PER_TASK = 2
MOST_READERS = 50_000
#: Bytes of a text hashed at once; a longer text goes through in pieces.
PIECE = 1 << 20

_ONE = np.uint64(1)
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _flips() -> np.ndarray:
    """Masks by code: 0 none, 1 to 64 one flip, then the pairs within the low and the high half."""
    bits = [_ONE << np.uint64(i) for i in range(64)]
    pairs = [bits[h + i] | bits[h + j] for h in (0, 32) for i in range(32) for j in range(i + 1, 32)]
    return np.array([np.uint64(0), *bits, *pairs], dtype=np.uint64)


MASKS = _flips()
NEAR = 65


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    planes = hashes.view(np.uint8).reshape(-1, 8)
    if len(planes) < 1500:
        return np.unpackbits(planes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.concatenate([np.bincount(planes[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])


def _pieces(text: bytes):
    """The text cut at white space into pieces of about PIECE bytes."""
    start = 0
    while len(text) - start > PIECE:
        cut = start + PIECE
        while cut < len(text) and text[cut] not in b" \t\n\r\x0b\x0c":
            cut += 1
        yield text[start:cut]
        start = cut
    yield text[start:] if start else text


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint of a UTF-8 text as an unsigned integer; null or wordless: 0."""
    from xxhash import xxh64_intdigest

    counts, total, tail = np.zeros(64, dtype=np.int64), 0, []
    for piece in _pieces((text or b"").lower()):
        words = tail + piece.split()
        if len(words) >= 3:
            shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
            hashes = np.array([xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
            counts += _bit_counts(hashes)
            total += len(hashes)
        tail = words[-2:]
    if not total and tail:
        counts, total = _bit_counts(np.array([xxh64_intdigest(b" ".join(tail), SEED)], dtype="<u8")), 1
    return int((_ONE << np.nonzero(counts * 2 > total)[0].astype(np.uint64)).sum(dtype=np.uint64)) if total else 0


def _fingerprint_batches(batches):
    for b in batches:
        texts = b.column(1).cast(pa.binary())
        found = np.array([fingerprint(t.as_py()) for t in texts], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.int64())], ["doc_id", "text_key", "fp"])


def _text_key() -> Column:
    return F.xxhash64(F.lit(SEED), F.col("text").cast("string"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp): one row per document; fp is the fingerprint as a signed long, text_key a hash of the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _text_key().alias("text_key"))
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, text_key long, fp long")


def _spread(variants: np.ndarray, ranges: int) -> np.ndarray:
    """The hash range of each variant."""
    mixed = (variants ^ (variants >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    mixed = (mixed ^ (mixed >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return ((mixed >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _ball(fps: np.ndarray, ranges: int):
    """The packed variants of distinct fingerprints, one row for each hash range that gets any."""
    even = fps[np.bitwise_count(fps) % 2 == 0]
    variants = np.concatenate([(fps[:, None] ^ MASKS[None, :NEAR]).ravel(), (even[:, None] ^ MASKS[None, NEAR:]).ravel()])
    codes = np.concatenate([np.tile(np.arange(NEAR, dtype="<u2"), len(fps)), np.tile(np.arange(NEAR, len(MASKS), dtype="<u2"), len(even))])
    ids = _spread(variants, ranges)
    order = np.argsort(ids.astype(np.uint16) if ranges <= 1 << 16 else ids, kind="stable")
    variants, codes, ids = variants[order].astype("<u8"), codes[order], ids[order]
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    for s, e in zip(starts, [*starts[1:], len(ids)], strict=True):
        yield int(ids[s]), variants[s:e].tobytes(), codes[s:e].tobytes()


def _emit(ranges: int):
    def run(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for s in range(0, len(fps), FLUSH):
                ids, variants, codes = zip(*_ball(fps[s : s + FLUSH], ranges), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(variants, pa.binary()), pa.array(codes, pa.binary())], ["range_id", "variants", "codes"])

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for every node of the links that isn't the least itself."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if (root == before).all():
            break
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def links_of_range(variants: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the verified links among the fingerprints that meet in one hash range."""
    order = np.argsort(variants, kind="stable")
    variants, codes = variants[order], codes[order]
    same = variants[1:] == variants[:-1]
    shared = np.r_[same, False] | np.r_[False, same]
    variants, codes = variants[shared], codes[shared]
    if not len(variants):
        return variants, variants
    fps = variants ^ MASKS[codes]
    # within a bucket near members come first, the least fingerprint of them leading
    order = np.lexsort((fps, codes >= NEAR, variants))
    variants, codes, fps = variants[order], codes[order], fps[order]
    first = np.r_[True, variants[1:] != variants[:-1]]
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    linked = (codes[lead] < NEAR) & (fps != fps[lead])
    a, b = fps[linked], fps[lead][linked]
    pairs = np.unique(np.stack([a, b], axis=1), axis=0)
    pairs = pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= RADIUS]
    return _forest(pairs[:, 0], pairs[:, 1]) if len(pairs) else (pairs[:, 0], pairs[:, 1])


def _meet(table: pa.Table) -> pa.Table:
    variants = np.frombuffer(b"".join(table.column("variants").to_pylist()), dtype="<u8")
    codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), dtype="<u2")
    a, b = links_of_range(variants, codes)
    return pa.table({"a": pa.array(a.view(np.int64), pa.int64()), "b": pa.array(b.view(np.int64), pa.int64())})


def ball_links(fps: DataFrame, count: int) -> DataFrame:
    """(a, b): verified links between distinct fingerprints, a spanning forest of each hash range's links."""
    ranges = max(LEAST_RANGES, -(-count * 561 // RANGE_VARIANTS))
    emitted = fps.repartition(max(1, -(-count // FINGERPRINTS_PER_TASK))).mapInArrow(_emit(ranges), "range_id int, variants binary, codes binary")
    # dealt by the ranges' numbers, equally many to each task; grouping by range deals nothing again
    dealt = emitted.repartitionById(min(MOST_READERS, -(-ranges // RANGES_PER_TASK)), F.col("range_id"))
    return dealt.groupBy("range_id").applyInArrow(_meet, "a long, b long").distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, root): the least reachable node of each node that has a link, by alternating large and small stars.

    Minima are partial aggregates and the joins back are plain equi-joins that AQE can split, so a hub with
    very many neighbours stays spread. Every round is staged in the shared folder, and the round before removed. Rounds
    go on until nothing changes; each one more than halves the depth of the trees, so they grow as a logarithm.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, before = staged(edges, "edges"), None
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        old, edges = edges, staged(small, "edges")
        discarded(old)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged (doc_id, text_key, fp) of every row, and (fp, root) of every fingerprint."""
    rows = staged(fingerprints(docs), "fingerprints")
    distinct = staged(rows.select("fp").distinct(), "distinct-fingerprints")
    roots = connected(ball_links(distinct, distinct.count()))
    return rows, distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable through links).

    Every row of ``docs`` gives one row. Null or wordless text: fingerprint zero, linked like any other. A null
    doc_id gets its group's least id, null if the group has none. Repeated rows are repeated. Columns other
    than doc_id and text are ignored; an empty table gives an empty result.
    """
    rows, placed = _components(docs)
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).join(placed, "fp")
    component = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = least.join(component, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row (all columns) of each near-duplicate group: that of the least doc_id, null last, then by text.

    Repeated rows are copies too: one of them stays.
    """
    rows, placed = _components(docs)
    own = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")).join(placed, "fp")
    kept = staged(own.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_key").alias("kept_key")), "kept-documents")
    # the documents' own columns travel as one, so that no name of theirs can clash
    named = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), _text_key().alias("key"))
    out = named.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")), "left_semi")
    if not rows.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        out = out.dropDuplicates(["id", "key"])
    return out.select("row.*")
