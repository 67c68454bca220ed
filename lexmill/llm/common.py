"""What the training-data operators share: the shared folder, staged tables and the training splits."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Label values up to which a table of one row for each (about 50 bytes) is broadcast; beyond, the join shuffles.
BROADCAST_LABELS = 50_000
#: Buckets of the hash in which a sample's rows are ranked apart.
RANK_BUCKETS = 64

_own: dict[str, str] = {}
_folders: dict[str, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, from spark.checkpoint.dir. Unset: a temporary one in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="lexmill-")
    return _own[app]


def _remove(jvm, conf, path: str) -> None:
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


@atexit.register
def _clean() -> None:
    """Removes the staged tables of every application of this process, if its JVM still answers."""
    for path, (jvm, conf) in _folders.items():
        try:
            _remove(jvm, conf, path)
        except Exception as e:  # the JVM may be gone; then the folder stays
            print(f"left {path}: {type(e).__name__}")


def workspace(spark: SparkSession) -> str:
    """This application's own folder in the shared one; removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/lexmill/{spark.sparkContext.applicationId}"
    _folders.setdefault(path, (spark._jvm, spark._jsc.hadoopConfiguration()))
    return path


def staged(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Cuts the lineage: a lost executor costs no earlier stage. Reads stay prunable, unlike checkpoint(). The table
    stays until ``discarded`` or the end of the application.
    """
    spark = df.sparkSession
    path = f"{workspace(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexmill_path = path
    return out


def discarded(table: DataFrame) -> None:
    """Removes a staged table that nothing will read again."""
    spark = table.sparkSession
    _remove(spark._jvm, spark._jsc.hadoopConfiguration(), table._lexmill_path)


def fresh(df: DataFrame, name: str) -> str:
    """A name for a working column that ``df`` doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def chunks(column: pa.Array, size: int) -> Iterator[pa.Array]:
    """A string column's rows in slices of about ``size`` bytes, a longer row alone; nulls as empty strings."""
    column = column.cast(pa.string())
    column = pc.fill_null(column, "") if column.null_count else column
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, first = np.cumsum(sizes), 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(upto, upto[first] - sizes[first] + size, "right")))
        yield column.slice(first, last - first)
        first = last


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def split_remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo ``folds``: the documented hold-out rule."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def one_text_each(docs: DataFrame, chosen: DataFrame, *by: str) -> DataFrame:
    """The rows of ``chosen`` with one text of ``docs`` each, of those that agree in ``by`` the one of least md5.

    Partial aggregates hold one text a row of ``chosen``, so however many rows of ``docs`` share an id, neither a task
    nor the driver gets more texts than that.
    """
    texts = docs.select(*by, F.col("text").cast("string").alias("text")).join(chosen, [*by])
    return texts.groupBy(*chosen.columns).agg(F.min_by("text", F.md5(F.col("text").cast("binary"))).alias("text"))


def text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def with_least_text(docs: DataFrame, *by: str) -> DataFrame:
    """``by`` and h: the least hash of the texts that rows with these values have. No text is shuffled."""
    return docs.groupBy(*by).agg(F.min(text_hash()).alias("h"))


def texts_of(docs: DataFrame, chosen: DataFrame, *by: str) -> DataFrame:
    """The columns of ``chosen`` (``by``, h and others) with the texts of that hash; rows of ``docs`` that are equal in all give a row each."""
    texts = docs.select(*by, text_hash().alias("h"), F.col("text").cast("string").alias("text"))
    return texts.join(chosen, [*by, "h"])


def bounded_sample(rows: DataFrame, label: str, per_label: int | dict, seed: int = 42) -> DataFrame:
    """At most ``per_label`` rows of each value of ``label`` (or a number by value), those with the least seeded hash of doc_id.

    ``rows`` has doc_id, no column that starts with ``sample_`` and non-null labels. They are counted by label first, and
    only hashes under a bar that about twice as many rows pass are ranked, in RANK_BUCKETS ranges of the hash each on its
    own. Labels may be many: their counts are broadcast only up to BROADCAST_LABELS.
    """
    counts = staged(rows.groupBy(F.col(label).alias("sample_label")).agg(F.count("*").alias("sample_n")), "label-counts")
    few = counts.count() <= BROADCAST_LABELS
    most = F.element_at(F.create_map(*[F.lit(x) for pair in per_label.items() for x in pair]), F.col("sample_label")) if isinstance(per_label, dict) else F.lit(per_label)
    share = (F.xxhash64(F.lit(seed), F.col("doc_id")) / F.lit(2.0**64) + F.lit(0.5)) * F.col("sample_n") / (most * 2.0 + 100)
    near = rows.join(F.broadcast(counts) if few else counts, F.col(label) == F.col("sample_label")).withColumn("sample_share", share).where("sample_share < 1")
    near = near.withColumn("sample_bucket", F.floor(F.col("sample_share") * RANK_BUCKETS))
    by = ["sample_label", "sample_bucket"]
    before = F.sum("n").over(Window.partitionBy("sample_label").orderBy("sample_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = near.groupBy(*by).agg(F.count("*").alias("n")).select(*by, F.coalesce(before, F.lit(0)).alias("sample_before")).where(F.col("sample_before") < most)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("sample_share", "doc_id"))
    return near.withColumn("sample_rank", rank).join(starts, by).where(F.col("sample_rank") + F.col("sample_before") <= most).select(*rows.columns)
