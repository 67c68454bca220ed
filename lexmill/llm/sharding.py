"""K-d tree sharding: recursive splits at distributed weighted medians along the widest metadata dimension.

Every document is a point in a small integer space: length level, source and language (categories by a seeded
hash, as they have no order). A node splits along the dimension that is widest in it, relative to the whole
table, at the weighted quantile that gives both sides bytes in proportion to the leaves below them; a leaf holds
the target bytes. Ties in the dimension (a source with a third of all rows, thousands of equal lengths) are
broken by 24 hashed bits of doc_id and text, and rows that are equal in these too by 12 bits of their place in the
input, so a hot value, and a hot row, splits like any other.

Each median is exact on (value, tie, place): a histogram of the values (at most LEVELS a dimension), then one of
every 12 bits of what follows within the bin that holds the cut. All are partial aggregates over the staged
metadata, for all nodes of a level at once, and a level is one job: its cuts are joined back and the rows staged
with the nodes they fall into. Nothing comes to the driver but one row of totals, so the number of shards is free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import staged

#: Levels of a categorical dimension, and of a digit of the ties.
LEVELS = 4096
#: Nodes, or slot buckets, up to which their table (under 100 bytes a row) is broadcast; beyond, the joins shuffle.
BROADCAST_ROWS = 200_000
#: Rows of a shard that are numbered in one task.
BUCKET_ROWS = 50_000

_DIMS = ("length", "source", "lang")


def metadata(docs: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, size, text_crc32, tie, spread, node (0) and one column per dimension. size: UTF-8 bytes plus 16 (null: 16)."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")
    level = lambda name: F.when(F.col(name).isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(F.lit(seed), F.col(name).cast("string")), F.lit(LEVELS - 1)) + 1)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("size"),
        crc.alias("text_crc32"),
        F.floor(F.log2(size) * 128).cast("long").alias("length"),
        level("source").cast("long").alias("source"),
        level("lang").cast("long").alias("lang"),
        F.pmod(F.xxhash64(F.lit(seed + 2), F.monotonically_increasing_id()), F.lit(LEVELS)).alias("spread"),
        F.lit(0).alias("node"),
    ).withColumn("tie", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("text_crc32")), F.lit(LEVELS * LEVELS)))


def _value() -> Column:
    return F.element_at(F.array(*_DIMS), F.col("dim"))


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def _reached(sums: DataFrame, keys: list[str], digit: Column, more: list[Column]) -> DataFrame:
    """Of bins (node, digit, held, goal) the first of each node whose running bytes reach the goal; the goal less those before it."""
    run = Window.partitionBy("node").orderBy(digit)
    at = sums.withColumn("upto", F.sum("held").over(run)).where("upto >= goal").groupBy("node").agg(F.min(F.struct(digit.alias("digit"), "upto", "held", "goal", *keys)).alias("c"))
    return at.select("node", *[F.col(f"c.{k}").alias(k) for k in keys], F.col("c.held").alias("held"), (F.col("c.goal") - (F.col("c.upto") - F.col("c.held"))).alias("goal"), *more)


def _cuts(rows: DataFrame, whole: dict[str, int], nodes: int) -> DataFrame:
    """(node, dim, cut) of every node that has more than one leaf and any row; dim counts from 1."""
    active = rows.where("leaves > 1")
    bins = active.select("node", "leaves", "size", F.inline(F.array(*[F.struct(F.lit(k + 1).alias("dim"), F.col(d).alias("digit")) for k, d in enumerate(_DIMS)])))
    bins = bins.groupBy("node", "leaves", "dim", "digit").agg(F.sum("size").alias("held"))
    side = Window.partitionBy("node", "dim")
    scale = F.element_at(F.array(*[F.lit(float(whole[d])) for d in _DIMS]), F.col("dim"))
    bins = bins.select(
        "node", "dim", "digit", "held", F.sum("held").over(side.orderBy("digit")).alias("upto"),
        (F.sum("held").over(side) * F.floor(F.col("leaves") / 2) / F.col("leaves")).alias("goal"),
        ((F.min("digit").over(side) - F.max("digit").over(side)) / scale).alias("narrow"),
    )
    # the widest dimension first, of equals the first one, and in it the least value that reaches the goal
    found = bins.where("upto >= goal").groupBy("node").agg(F.min(F.struct("narrow", "dim", "digit", "upto", "held", "goal")).alias("c"))
    cell = found.select("node", F.col("c.dim").alias("dim"), F.col("c.digit").alias("d0"), (F.col("c.goal") - (F.col("c.upto") - F.col("c.held"))).alias("goal"))
    known, high, low = ["dim", "d0"], F.floor(F.col("tie") / LEVELS), F.col("tie") % LEVELS
    fixed = _value() == F.col("d0")
    for k, digit in enumerate((high, low, F.col("spread")), 1):
        at = active.join(_small(cell, nodes), "node").where(fixed)
        sums = at.groupBy("node", *known, "goal", digit.alias("digit")).agg(F.sum("size").alias("held"))
        cell = _reached(sums, known, F.col("digit"), [F.col("c.digit").alias(f"d{k}")])
        fixed = fixed & (digit == F.col(f"d{k}"))
        known.append(f"d{k}")
    # the last bin goes to the side that it leaves nearer to its goal
    key = _joined(F.col("d0"), F.col("d1") * LEVELS + F.col("d2"), F.col("d3"))
    return cell.select("node", "dim", (key - (F.col("goal") < F.col("held") / 2).cast("long")).alias("cut"))


def _joined(value: Column, tie: Column, spread: Column) -> Column:
    return (value * (LEVELS * LEVELS) + tie) * LEVELS + spread


def kd_leaves(points: DataFrame, shards: int, whole: dict[str, int]) -> DataFrame:
    """``points`` with node: the number, from left to right, of the leaf that each row falls into.

    A node is named by its first leaf and has ``leaves`` of them; the left child takes half of these, rounded down.
    """
    rows, nodes = points.withColumn("leaves", F.lit(shards)), 1
    while nodes < shards:
        cuts = _cuts(rows, whole, nodes)
        half = F.floor(F.col("leaves") / 2).cast("int")
        left = _joined(_value(), F.col("tie"), F.col("spread")) <= F.col("cut")
        child = lambda a, b, kept: F.when(F.col("cut").isNull(), kept).otherwise(F.when(left, a).otherwise(b)).cast("int")  # noqa: E731, B023
        split = rows.join(_small(cuts, nodes), "node", "left")
        named = {"node": child(F.col("node"), F.col("node") + half, F.col("node")), "leaves": child(half, F.col("leaves") - half, F.col("leaves"))}
        rows = staged(split.select(*[named[c].alias(c) if c in named else c for c in rows.columns]), "kd-level")
        nodes *= 2
    return rows


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per row of ``docs``.

    Give the number of shards, or the bytes that a shard should reach. The law is ``bytes``: sizes are near
    equal. Slots number a shard's rows from 0 without gaps. grown_shard is null under this law. Null text: size
    16, crc32 0. Null source, lang or doc_id: a value of its own. Repeated rows get a slot each. Other columns
    are ignored; an empty table gives an empty result; shards may be empty if there are fewer documents.
    """
    points = staged(metadata(docs), "kd-points")
    total = points.agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *[(F.max(d) - F.min(d)).alias(d) for d in _DIMS]).first()
    if shards is None:
        shards = max(1, -(-(total["bytes"] or 0) // target_bytes))
    rows = kd_leaves(points, shards, {d: max(1, total[d] or 0) for d in _DIMS})
    # equal doc_ids and texts share a tie, so they meet in one bucket, which then holds no more than their shard does
    counts = rows.groupBy("node").agg(F.ceil(F.count("*") / BUCKET_ROWS).alias("buckets"))
    rows = rows.join(_small(counts, shards), "node").withColumn("bucket", F.col("tie") % F.col("buckets"))
    run = Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("node", "bucket").agg(F.count("*").alias("n")).select("node", "bucket", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("start"))
    inner = F.row_number().over(Window.partitionBy("node", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    placed = rows.withColumn("inner", inner).join(_small(starts, shards + total["n"] // BUCKET_ROWS), ["node", "bucket"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("node").alias("shard"), (F.col("start") + F.col("inner")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
