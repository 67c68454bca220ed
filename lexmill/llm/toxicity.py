"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; everything else is unlabelled, a mixture with an unknown part of toxic
text. The linear classifier minimises the non-negative risk estimate
``prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))`` with the logistic loss: positives correct the unlabelled
risk for the toxic documents hidden in it, and when the corrected part turns negative (overfitting) the step goes
the other way. A logistic curve over the fitted scores, on the labelled texts among the unlabelled, makes them
probabilities: it moves no text past another. Features are which words and word beginnings (4 and 5 letters) of a bounded vocabulary a text
holds; words are runs of letters, lower case.

The training texts' words stay on the executors: the driver gets a min-hash of each text to tell near copies by, the
vocabulary that distributed counts choose, and which of its words each text holds.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import bounded_sample, split_remainder, staged, texts_of, with_least_text
from lexmill.llm.quality import fit_curve

WORD = re.compile(r"[^\W\d_]+")
THRESHOLD = 0.3
#: Training rows of each kind at most (those of least seeded hash), and words of the vocabulary.
POSITIVES = 3_000
UNLABELLED = 9_000
VOCABULARY = 600
#: A word counts for the vocabulary from this many positives and this share of them on: a few copies of one
#: text don't suffice.
LEAST_POSITIVES = 3
LEAST_SHARE = 0.01
#: and from this contrast on, in standard errors.
LEAST_CONTRAST = 6.0
#: Characters searched for words at once.
PART = 1 << 20
#: Min-hash of a text: texts alike in all values of a band are near copies.
BANDS, BAND = 8, 4


def _features(found: set[str]) -> set[str]:
    return found | {w[:4] + "*" for w in found if len(w) > 4} | {w[:5] + "*" for w in found if len(w) > 5}


def words(text: str | None) -> set[str]:
    """The distinct words of a whole text and their beginnings (marked *)."""
    text = text or ""
    if len(text) <= PART:
        return _features(set(WORD.findall(text.lower())))
    found: set[str] = set()
    start = 0
    while start < len(text):
        stop = min(len(text), start + PART)
        while stop < len(text) and WORD.match(text[stop]):
            stop += 1
        found.update(WORD.findall(text[start:stop].lower()))
        start = stop
    return _features(found)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 40, rate: float = 0.1, decay: float = 1e-5, batch: int = 512, beta: float = 0.0, seed: int = 42) -> np.ndarray:
    """Weights (the last one the bias) of a linear model by Adam on the non-negative risk. Rows are 0/1 features."""
    rng = np.random.default_rng(seed)
    p = np.hstack([positive, np.ones((len(positive), 1), positive.dtype)])
    u = np.hstack([unlabelled, np.ones((len(unlabelled), 1), unlabelled.dtype)])
    w = np.zeros(p.shape[1])
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    gate = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(epochs):
        order_u, order_p = rng.permutation(len(u)), rng.permutation(len(p))
        for s in range(0, len(u), batch):
            xu = u[order_u[s : s + batch]]
            at = (np.arange(batch) + step * batch) % len(p)
            xp = p[order_p[at]]
            zp, zu = xp @ w, xu @ w
            # logistic loss of a score z: log(1 + exp(-z)) against +1, log(1 + exp(z)) against -1
            risk_negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            slope_negative = xu.T @ gate(zu) / len(xu) - prior * (xp.T @ gate(zp)) / len(xp)
            slope = -prior * (xp.T @ gate(-zp)) / len(xp) + slope_negative if risk_negative >= -beta else -slope_negative
            slope[:-1] += decay * w[:-1]
            step += 1
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


@dataclass
class Model:
    """word: weight, and the bias; without positives the score is the prior."""

    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        get = self.weights.get
        z = self.bias + sum(get(w) for w in sorted(words(text) & self.weights.keys()))
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def min_hash(found: set[str]) -> bytes:
    """BANDS hashes, each of BAND least values of seeded hashes of the words; empty without words."""
    if not found:
        return b""
    words = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in found], dtype=np.uint64)
    rng = np.random.default_rng(42)
    a, b = rng.integers(1, 1 << 31, BANDS * BAND, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 31, BANDS * BAND, dtype=np.uint64)
    least = np.full(BANDS * BAND, 4_294_967_290, dtype=np.uint64)
    for s in range(0, len(words), 4096):
        np.minimum(least, ((words[s : s + 4096, None] * a + b) % np.uint64(4_294_967_291)).min(axis=0), out=least)
    least = least.astype("<u4")
    return b"".join(zlib.crc32(row.tobytes()).to_bytes(4, "little") for row in least.reshape(BANDS, BAND))


def distinct(hashes: list[bytes]) -> list[int]:
    """The places of one text of each group of near copies, the first; a text without words stays."""
    seen: set[tuple] = set()
    kept = []
    for k, x in enumerate(hashes):
        bands = {(at, x[at : at + 4]) for at in range(0, len(x), 4)}
        if seen.isdisjoint(bands):
            kept.append(k)
        seen |= bands
    return kept


def vocabulary(rows: DataFrame, positives: int, unlabelled: int) -> list[str]:
    """The words whose document shares differ most between positives and unlabelled texts, in standard errors.

    ``rows`` (positive, words) has as many texts of either kind as given. At most VOCABULARY words.
    """
    counts = rows.select("positive", F.explode("words").alias("word")).groupBy("word").agg(F.count_if("positive").alias("a"), F.count_if(~F.col("positive")).alias("b"))
    mean = (F.col("a") + F.col("b")) / (positives + unlabelled)
    spread = F.sqrt(mean * (1 - mean) * (1 / positives + 1 / unlabelled))
    contrast = F.when(spread > 0, (F.col("a") / positives - F.col("b") / unlabelled) / spread).otherwise(0.0)
    able = counts.where(F.col("a") >= max(LEAST_POSITIVES, LEAST_SHARE * positives)).withColumn("contrast", contrast).where(F.col("contrast") >= LEAST_CONTRAST)
    return [r["word"] for r in able.orderBy(F.desc("contrast"), "word").limit(VOCABULARY).collect()]


def _word_rows(batches):
    for b in batches:
        found = [words(t.as_py()) for t in b.column(3)]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([min_hash(x) for x in found], pa.binary()), pa.array([sorted(x) for x in found], pa.list_(pa.string()))], [*b.schema.names[:3], "hash", "words"])


def _constant(share: float | None) -> Model:
    base = min(max(share if share is not None else 0.05, 1e-3), 1 - 1e-3)
    return Model({}, float(np.log(base / (1 - base))))


def learn(docs: DataFrame, toxic: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None) -> Model:
    """A model from ``docs`` (doc_id, text) and ``toxic`` (doc_id, toxic 0/1/null), both without held-out rows.

    Positives are rows marked 1; unlabelled are all rows of ``docs``, whatever their label. Near copies of a text count
    once. ``prior`` is the toxic share of the unlabelled texts; by default that of those labelled ones that are left
    without near copies, or of all labels if none is left.
    """
    marks = toxic.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = with_least_text(docs.where("doc_id is not null"), "doc_id").join(marks, "doc_id", "left")
    kinds = ids.withColumn("positive", F.explode(F.when(F.col("toxic") == 1, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    chosen = staged(bounded_sample(kinds, "positive", {True: positives, False: unlabelled}), "toxicity-sample")
    found = texts_of(docs, chosen, "doc_id").select("doc_id", "positive", "toxic", "text")
    rows = staged(found.mapInArrow(_word_rows, "doc_id long, positive boolean, toxic int, hash binary, words array<string>"), "toxicity-words")
    # at most POSITIVES + UNLABELLED rows of some 50 bytes
    table = rows.select("doc_id", "positive", "toxic", "hash").distinct().toArrow().sort_by([("positive", "ascending"), ("doc_id", "ascending"), ("hash", "ascending")]).to_pylist()
    texts = {kind: [r for r in table if r["positive"] == kind] for kind in (True, False)}
    texts = {kind: [x[k] for k in distinct([r["hash"] for r in x])] for kind, x in texts.items()}
    share = marks.agg(F.avg("toxic")).first()[0]
    if not texts[True] or not texts[False]:
        return _constant(prior if prior is not None else share)
    if prior is None:
        known = [r["toxic"] for r in texts[False] if r["toxic"] is not None]
        prior = float(np.mean(known)) if known else share
    prior = min(max(prior, 0.005), 0.9)
    # texts that share a doc_id and a hash are equal in words
    wanted = {(r["positive"], r["doc_id"], r["hash"]) for x in texts.values() for r in x}
    keep = docs.sparkSession.sparkContext.broadcast(wanted)

    def once(batches):
        for b in batches:
            held = [k in keep.value for k in zip(*(b.column(n).to_pylist() for n in ("positive", "doc_id", "hash")), strict=True)]
            yield b.filter(pa.array(held, pa.bool_()))

    rows = rows.mapInArrow(once, rows.schema).dropDuplicates(["positive", "doc_id", "hash"])
    names = vocabulary(rows, len(texts[True]), len(texts[False]))
    number = docs.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(names)})

    def held(batches):
        for b in batches:
            get = number.value.get
            bits = np.zeros((b.num_rows, len(number.value)), dtype=np.uint8)
            for r, x in enumerate(b.column("words").to_pylist()):
                bits[r, [k for k in map(get, x) if k is not None]] = 1
            packed = pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(n) for n in ("positive", "doc_id", "hash", "toxic")] + [packed], ["positive", "doc_id", "hash", "toxic", "bits"])

    table = rows.mapInArrow(held, "positive boolean, doc_id long, hash binary, toxic int, bits binary").toArrow().sort_by([("doc_id", "ascending"), ("hash", "ascending")])
    bits = np.stack([np.frombuffer(x, dtype=np.uint8) for x in table.column("bits").to_pylist()])
    features = np.unpackbits(bits, axis=1, count=len(names)).astype(np.float32) if names else np.zeros((len(bits), 0), dtype=np.float32)
    positive = table.column("positive").to_numpy(zero_copy_only=False)
    w = fit_nnpu(features[positive], features[~positive], prior)
    # the sign and order of the scores are the fit's; labelled texts among the unlabelled make probabilities of them
    marked = ~positive & table.column("toxic").is_valid().to_numpy(zero_copy_only=False)
    y = table.column("toxic").fill_null(0).to_numpy()[marked].astype(float)
    if 0 < y.sum() < len(y):
        scale, slope, bias = fit_curve(features[marked] @ w[:-1] + w[-1], y, np.ones(len(y)))
        if slope > 0:
            w *= slope / scale
            w[-1] += bias
    return Model({n: float(x) for n, x in zip(names, w, strict=False) if x}, float(w[-1]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for rows (doc_id, held_out, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            scores = np.array([shared.value.score(t.as_py()) for t in b.column(2)], dtype=float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "held_out", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learned from the rows that aren't held out.

    Null or empty text: no words, so the bias alone. Null doc_id: not held out and not learned from. Repeated rows
    are repeated; repeated labels count once, 1 before 0. Without labels the score is the prior. Other columns are
    ignored; an empty table gives an empty result.
    """
    out = lambda rows: F.coalesce(split_remainder(rows["doc_id"], folds) == held, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("held_out", out(rows))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    model = learn(rows.where("not held_out"), marks.where(~out(marks)))
    return scored(rows, model)
