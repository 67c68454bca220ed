"""Token counts as delta-maintained rollups.

A rollup holds additive totals (documents, tokens, bytes) by source, language and tokenizer version. A batch of
changes becomes signed deltas: an insert adds, a delete subtracts, a revised count subtracts the old one and
adds the new one. Only the deltas, one row per touched key, are stored with the batch; totals are their sum.

Commits are idempotent. A writer puts its deltas into a folder of its own and then names that folder in the batch's
marker, a small file that is renamed into place only if the batch has none: of several writers, or after a crash
half-way, exactly one folder counts. Whether a batch is committed is one look for its marker. ``compact`` folds the
committed deltas into one snapshot; the folders it folded go at the next compaction, so readers of the snapshot before
still find them, and what has to be listed is what came since. A snapshot counts once its own marker is there.
"""

from __future__ import annotations

import json
import re
import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import staged

KEYS = ("source", "lang", "tokenizer_version")
MEASURES = ("docs", "tokens", "bytes")


def _count(path: str):
    def run(batches):
        from lexmill.llm.tokenize import loaded

        of = loaded(path)
        for b in batches:
            tokens = np.concatenate([np.zeros(0, dtype=np.int64), *(n for _, n in of.batches(b.column(3)))])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], b.column(4), pa.array(tokens, pa.int64()), *b.columns[5:]], ["doc_id", "source", "lang", "bytes", "tokens", *b.schema.names[5:]])
        pa.default_memory_pool().release_unused()

    return run


def token_counts(docs: DataFrame, tokenizer: str, keyed: bool = False) -> DataFrame:
    """doc_id, source, lang, bytes, tokens of every whole text; null or empty text: 0. ``keyed``: and k, the text's md5."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    if keyed:
        rows = rows.withColumn("k", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return rows.mapInArrow(_count(tokenizer), "doc_id long, source string, lang string, bytes long, tokens long" + (", k string" if keyed else ""))


def _delta(sign: int, tokens: str, size: str) -> Column:
    return F.struct(F.lit(sign).cast("long").alias("docs"), (sign * F.coalesce(F.col(tokens), F.lit(0))).cast("long").alias("tokens"), (sign * F.coalesce(F.col(size), F.lit(0))).cast("long").alias("bytes"))


def signed(changes: DataFrame) -> DataFrame:
    """The signed deltas, one row per key, of changes (change, source, lang, tokenizer_version, tokens, bytes, old_tokens, old_bytes).

    change: ``insert``, ``delete`` (of the count in tokens and bytes) or ``revise``. Any other value, or null, is an
    error. A column ``times`` says how many equal changes a row stands for. A null key part is a key of its own; a null count is 0. Keys whose deltas cancel stay, with zeros.
    """
    revised = F.struct(F.lit(0).cast("long").alias("docs"), (F.coalesce("tokens", F.lit(0)) - F.coalesce("old_tokens", F.lit(0))).cast("long").alias("tokens"), (F.coalesce("bytes", F.lit(0)) - F.coalesce("old_bytes", F.lit(0))).cast("long").alias("bytes"))
    kind = F.when(F.col("change") == "insert", _delta(1, "tokens", "bytes")).when(F.col("change") == "delete", _delta(-1, "tokens", "bytes")).when(F.col("change") == "revise", revised)
    kind = kind.otherwise(F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("change", F.lit("null")))).cast("struct<docs:bigint,tokens:bigint,bytes:bigint>"))
    times = F.col("times") if "times" in changes.columns else F.lit(1)
    return changes.select(*KEYS, kind.alias("d"), times.alias("n")).groupBy(*KEYS).agg(*[F.sum(F.col(f"d.{m}") * F.col("n")).alias(m) for m in MEASURES])


class Rollup:
    """A rollup in a folder that driver and executors share, by any path that Spark can write.

    deltas/batch=<name>/<attempt>: written deltas. batches/<name>: the marker, which holds the attempt that counts.
    snapshots/<number>: totals, folded (the names of the batches it folded itself) and its marker.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs

    def _fs(self, path: str):
        at = self.hadoop.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _read(self, path: str) -> str | None:
        fs, at = self._fs(path)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _exists(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def _mark(self, path: str, content: str) -> bool:
        """The content under this path, whole, unless there is a file already; True if this call put it there."""
        own = f"{path}.{uuid.uuid4().hex}.new"
        fs, at = self._fs(own)
        stream = fs.create(at, True)
        stream.write(content.encode())
        stream.close()
        context = self.hadoop.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            # without the option to overwrite, a rename onto a file fails
            context.rename(at, self.hadoop.Path(path), self.spark.sparkContext._gateway.new_array(self.hadoop.Options.Rename, 0))
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            fs.delete(at, False)

    def committed(self, batch: str) -> bool:
        return self._read(f"{self.path}/batches/{batch}") is not None

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """True if the batch was added, False if it had been committed before, or another writer was first."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
            raise ValueError("a batch name has letters, digits, - and _ only")
        if self.committed(batch):
            return False
        attempt = uuid.uuid4().hex
        own = f"{self.path}/deltas/batch={batch}/{attempt}"
        deltas.select(*KEYS, *MEASURES).write.parquet(own)
        won = self._mark(f"{self.path}/batches/{batch}", attempt)
        if not won:
            fs, at = self._fs(own)
            fs.delete(at, True)
        return won

    def _snapshot(self) -> int:
        """The number of the latest whole snapshot, -1 without any."""
        numbers = [int(n) for n in self._names("snapshots") if self._read(f"{self.path}/snapshots/{n}/marker") is not None]
        return max(numbers, default=-1)

    def _folded(self, number: int) -> set[str]:
        return {r[0] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/snapshots/{number:08d}/folded").collect()} if number >= 0 else set()

    def _open(self, number: int) -> dict[str, str]:
        """Path of the deltas, by batch, of committed batches that no snapshot up to this one holds.

        A folder alone says nothing: a late writer may bring one back whose batch was folded long ago. The attempt that
        the marker names lies there until its batch is folded, and never again.
        """
        names = [n.removeprefix("batch=") for n in self._names("deltas")]
        attempts = {n: self._read(f"{self.path}/batches/{n}") for n in sorted(set(names) - self._folded(number))}
        paths = {n: f"{self.path}/deltas/batch={n}/{a}" for n, a in attempts.items() if a is not None}
        return {n: path for n, path in paths.items() if self._exists(path)}

    def _sum(self, number: int, paths: list[str]) -> DataFrame:
        schema = "source string, lang string, tokenizer_version string, docs long, tokens long, bytes long"
        paths = paths + ([f"{self.path}/snapshots/{number:08d}/totals"] if number >= 0 else [])
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version and the totals, without keys that no document is left in."""
        number = self._snapshot()
        return self._sum(number, list(self._open(number).values())).where("docs <> 0")

    def compact(self) -> int:
        """Folds what is committed into the next snapshot and gives its number. One compaction runs at a time."""
        last = self._snapshot()
        # gone before the next snapshot counts: that one no longer lists them
        for batch in sorted(self._folded(last)):
            fs, at = self._fs(f"{self.path}/deltas/batch={batch}")
            fs.delete(at, True)
        found = self._open(last)
        target = f"{self.path}/snapshots/{last + 1:08d}"
        self._sum(last, list(found.values())).write.mode("overwrite").parquet(f"{target}/totals")
        # named in the listing of folders, a name for each batch since the snapshot before
        names = F.from_json(F.lit(json.dumps(sorted(found))), "array<string>")
        self.spark.range(1).select(F.explode(names).alias("batch")).write.mode("overwrite").parquet(f"{target}/folded")
        self._mark(f"{target}/marker", "whole")
        return last + 1


def corpus_rollup(docs: DataFrame, tokenizer: str, version: str, path: str) -> DataFrame:
    """The totals of a corpus after three batches: every document in, repeated texts out, every count revised.

    ``load`` inserts all documents. ``repeats`` deletes each document whose text an earlier one (lower doc_id, null
    last) has; of rows equal in doc_id, source, lang and text one stays. ``ends`` revises the remaining counts by the id that ends each document. Each batch is sent twice.
    """
    counted = staged(token_counts(docs, tokenizer, keyed=True), "token-counts")
    # rows equal in all of these have the same counts, but for a null and an empty text, which both have none
    equal = counted.groupBy("doc_id", "source", "lang", "k").agg(F.first("tokens").alias("tokens"), F.first("bytes").alias("bytes"), F.count("*").alias("n"))
    first = counted.groupBy("k").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "source", "lang")).alias("kept")).select("kept.doc_id", "kept.source", "kept.lang", "k")
    # joined on all four, so that the copies of one text don't meet in one task
    same = [equal[c].eqNullSafe(first[c]) for c in ("doc_id", "source", "lang", "k")]
    equal = staged(equal.join(first.withColumn("found", F.lit(True)), same, "left").select(*[equal[c] for c in equal.columns], F.col("found").isNotNull().alias("stays")), "first-copies")
    stay = equal.where("stays").withColumn("times", F.lit(1))
    gone = equal.withColumn("times", F.col("n") - F.col("stays").cast("long")).where("times > 0")
    version_of = F.lit(version).alias("tokenizer_version")
    change = lambda rows, kind, more=0: rows.select(F.lit(kind).alias("change"), "source", "lang", version_of, (F.col("tokens") + more).alias("tokens"), "bytes", F.col("tokens").alias("old_tokens"), F.col("bytes").alias("old_bytes"), *[c for c in rows.columns if c == "times"])
    rollup = Rollup(docs.sparkSession, path)
    for name, rows in (("load", change(counted, "insert")), ("repeats", change(gone, "delete")), ("ends", change(stay, "revise", 1))):
        deltas = signed(rows)
        rollup.commit(name, deltas)
        rollup.commit(name, deltas)
    rollup.compact()
    return rollup.totals()
