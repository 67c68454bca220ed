"""Quality by compression: two zstandard dictionaries, one trained on good and one on bad labelled text.

A text is compressed in blocks with either dictionary; good text gets smaller with the good one. The difference
of the two sizes over the text's length is its evidence, and a logistic curve fitted on labelled texts that
trained neither dictionary makes it a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import bounded_sample, split_remainder, staged, texts_of, with_least_text

THRESHOLD = 0.3
BLOCK = 2048
DICTIONARY = 110_000
LEVEL = 3
#: Labelled rows of each class at most (those of least seeded hash): half train a dictionary, half the curve.
ROWS_PER_CLASS = 3_000
#: Blocks of one text that may train a dictionary, evenly spread over it.
BLOCKS_PER_TEXT = 8
#: The least block that trains a dictionary.
LEAST_BLOCK = 16


def blocks(data: bytes) -> list[bytes]:
    return [data[s : s + BLOCK] for s in range(0, len(data), BLOCK)]


class Compressors:
    """Compressed sizes with the good and the bad dictionary; made once in each worker."""

    def __init__(self, good: bytes, bad: bytes):
        def make(raw):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False).compress

        self.good, self.bad = make(good), make(bad)

    def evidence(self, data: bytes | None) -> float:
        """(bytes with the bad dictionary - bytes with the good one) / bytes of the text; empty: 0."""
        if not data:
            return 0.0
        parts = blocks(data)
        return (sum(len(self.bad(x)) for x in parts) - sum(len(self.good(x)) for x in parts)) / len(data)


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[float, float, float]:
    """(scale, slope, bias) of the weighted logistic curve 1 / (1 + exp(-(slope * x / scale + bias))), by Newton steps."""
    scale = float(x.std()) or 1.0
    a = np.stack([x / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    weight = weight / weight.sum() * len(x)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (weight * (p - y)) + ridge * w
        curve = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return scale, float(w[0]), float(w[1])


@dataclass
class Model:
    """The dictionaries and the curve; without both classes the score is ``base``, the good share."""

    good: bytes = b""
    bad: bytes = b""
    curve: tuple[float, float, float] = (1.0, 0.0, 0.0)
    base: float = 0.5

    def scorer(self):
        if not self.good:
            return lambda data: self.base
        compressors, (scale, slope, bias) = Compressors(self.good, self.bad), self.curve
        return lambda data: float(1 / (1 + np.exp(-np.clip(slope * compressors.evidence(data) / scale + bias, -30, 30))))


def _sampled_blocks(batches):
    for b in batches:
        for doc_id, good, text in zip(b.column(0), b.column(1), b.column(2).cast(pa.binary()), strict=True):
            found = blocks(text.as_py() or b"")
            step = max(1, -(-len(found) // BLOCKS_PER_TEXT))
            picked = [x for x in found[::step] if len(x) >= LEAST_BLOCK]
            if picked:
                yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()] * len(picked), pa.int64()), pa.array([good.as_py()] * len(picked), pa.int32()), pa.array(range(len(picked)), pa.int32()), pa.array(picked, pa.binary())], ["doc_id", "good", "k", "block"])


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, samples)) // 4)), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def learn(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality 0/1/null), both without held-out rows."""
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("good"))
    share = {r["good"]: r["n"] for r in marks.groupBy("good").agg(F.count("*").alias("n")).collect()}
    total = sum(share.values())
    base = share.get(1, 0) / total if total else 0.5
    if len(share) < 2:
        return Model(base=base)
    # the seeded hash that chooses the rows also deals them: every other one trains the curve
    chosen = bounded_sample(with_least_text(docs, "doc_id").join(marks, "doc_id"), "good", rows_per_class)
    chosen = staged(chosen.withColumn("curve", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(2)) == 1), "quality-sample")
    texts = staged(texts_of(docs, chosen, "doc_id"), "quality-texts")
    table = texts.where("not curve").select("doc_id", "good", "text").mapInArrow(_sampled_blocks, "doc_id long, good int, k int, block binary").distinct().toArrow().sort_by([("doc_id", "ascending"), ("k", "ascending")])
    samples: dict[int, list[bytes]] = {0: [], 1: []}
    for kind, block in zip(table.column("good").to_pylist(), table.column("block").to_pylist(), strict=True):
        samples[kind].append(block)
    if not samples[0] or not samples[1]:
        return Model(base=base)
    good, bad = _dictionary(samples[1]), _dictionary(samples[0])
    model = docs.sparkSession.sparkContext.broadcast((good, bad))

    def weigh(batches):
        found = Compressors(*model.value)
        for b in batches:
            x = [found.evidence(t.as_py()) for t in b.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.float64())], ["doc_id", "good", "x"])

    table = texts.where("curve").select("doc_id", "good", "text").mapInArrow(weigh, "doc_id long, good int, x double").distinct().toArrow().sort_by("doc_id")
    x, y = table.column("x").to_numpy(), table.column("good").to_numpy().astype(float)
    if len(set(y)) < 2:
        return Model(base=base)
    # each class counts as much as it does among all labelled rows
    weight = np.where(y == 1, share[1] / (y == 1).sum(), share[0] / (y == 0).sum())
    return Model(good, bad, fit_curve(x, y, weight), base)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for rows (doc_id, held_out, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = shared.value.scorer()
        for b in batches:
            scores = np.array([score(t.as_py()) for t in b.column(2).cast(pa.binary())], dtype=float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "held_out", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learned from the rows that aren't held out.

    Null or empty text: evidence 0. Null doc_id: not held out and not learned from. Repeated rows are repeated;
    repeated labels count once, 1 before 0. With labels of one class only the score is the good share, without
    any 0.5. Other columns are ignored; an empty table gives an empty result.
    """
    out = lambda rows: F.coalesce(split_remainder(rows["doc_id"], folds) == held, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("held_out", out(rows))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    model = learn(rows.where("not held_out"), marks.where(~out(marks)))
    return scored(rows, model)
