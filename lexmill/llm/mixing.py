"""Mixing sources to target weights by capped water-filling, then seeded whole and fractional repetitions.

Targets. Every source asks for words in proportion to its weight; a source whose share is above ``max_epochs``
times its own size is clamped there and the excess goes to the others by weight, until none is above. That
fixpoint has a closed form once sources are ordered by the level at which they fill up, so it is a few running
sums over one row per source rather than a loop.

Repetitions. A target of 1.3 times the source means one whole copy of every document and a further 0.3 of the
source's words: documents in the order of a seeded hash of id and text until the sum is reached. The cut is found by
histograms of the hash (two digits of 12 bits, partial aggregates), so only the few hashes that share those 24 bits
with the cut are ever ordered, however large the source. Rows that are equal in id and text share a hash; they are
counted before they are ordered, and where the cut falls among them, so many of them are taken. The gap that is
left, less than one document, is closed by the document not yet taken whose size is nearest to it, if that comes
nearer than leaving it.

The words of a text are counted once; the plan names hashes, so applying it needs no sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import staged

WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to which their table (about 100 bytes a row) is broadcast; beyond, the joins shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _running(df: DataFrame, value: str, by: list[str], order: list[str], name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the rows before."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def water_fill(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    Sources by code point, null last, take the weights in turn. The windows hold one row per source.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") - 1) % len(weights) + 1)
    asked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_epochs)).withColumn("fills_at", F.col("cap") / F.col("weight"))
    asked = asked.withColumn("total", F.sum("source_size").over(everything) * float(share)).withColumn("all_weight", F.sum("weight").over(everything))
    asked = _running(_running(asked, "cap", [], ["fills_at", "rank"], "cap_before"), "weight", [], ["fills_at", "rank"], "weight_before")
    asked = asked.withColumn("full", F.col("cap_before") + F.col("fills_at") * (F.col("all_weight") - F.col("weight_before")) <= F.col("total"))
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * (left / open_weight))
    return asked.select("source", "source_size", target.alias("target"))


def _with_sources(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    named = sources.withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(named) if few else named, rows["source"].eqNullSafe(named["_source"]), "left").drop("_source")


def _cut(rows: DataFrame, digit: str, goal: str) -> DataFrame:
    """By source the digit in which the running sum of sizes reaches ``goal``, and what is left to take there."""
    sums = rows.groupBy("source", digit, goal).agg(F.sum("size").alias("held"))
    sums = _running(sums, "held", ["source"], [digit], "before")
    reached = F.col("before") + F.col("held") >= F.col(goal)
    return sums.where(reached).groupBy("source").agg(F.min_by(F.struct(digit, "before"), digit).alias("cut")).select("source", F.col(f"cut.{digit}").alias(f"{digit}_cut"), F.col("cut.before").alias(f"{digit}_before"))


def _key(seed: int) -> Column:
    """A seeded hash of doc_id and text as 32 hexadecimal digits; the order in which a fractional repetition takes rows.

    Null for a text without words: it adds nothing to a sum, so no fractional repetition takes it.
    """
    text = F.md5(F.col("text").cast("string").cast("binary"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text).cast("binary"))
    return F.when(F.col("text").cast("string").rlike(WORD), key)


def _digit(k: int) -> Column:
    return F.conv(F.substring("key", 3 * k + 1, 3), 16, 10).cast("int")


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 42) -> tuple[DataFrame, DataFrame, bool, bool]:
    """(rows, plan, few, loose): staged (doc_id, source, size, key) of the documents, and one staged row per source.

    The plan has the source's target, ``whole`` repetitions of all its documents, and which get one more: keys below
    ``edge``, the first ``edge_taken`` rows of the edge itself, and one row of the key ``fill``. few: the sources may
    be broadcast. loose: some row of an edge or a fill isn't taken although an equal one is.
    """
    rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), _key(seed).alias("key")), "mix-rows")
    digits = rows.select("source", "size", "key", _digit(0).alias("high"), _digit(1).alias("low")).where("key IS NOT NULL")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = staged(water_fill(sizes, weights, share, max_epochs), "mix-sources")
    few = sources.count() <= BROADCAST_SOURCES
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = sources.withColumn("whole", whole).withColumn("goal", F.col("target") - F.col("whole") * F.col("source_size"))
    first = staged(_with_sources(plan, _cut(_with_sources(digits, plan.select("source", "goal"), few), "high", "goal"), few).withColumn("rest", F.col("goal") - F.col("high_before")), "mix-cuts")
    at_cut = _with_sources(digits, first.select("source", "high_cut", "rest"), few).where("high = high_cut")
    second = staged(_with_sources(first, _cut(at_cut, "low", "rest"), few).withColumn("last", F.col("rest") - F.col("low_before")), "mix-cuts")
    close = _with_sources(digits, second.select("source", "high_cut", "low_cut", "last"), few).where("high = high_cut and low = low_cut")
    close = close.groupBy("source", "last", "key").agg(F.first("size").alias("size"), F.count("*").alias("n")).withColumn("held", F.col("size") * F.col("n"))
    close = _running(close, "held", ["source"], ["key"], "ahead").withColumn("room", F.col("last") - F.col("ahead")).where("room >= 0")
    fit = F.least("n", F.floor(F.col("room") / F.col("size")))
    close = close.withColumn("fit", fit - F.when(fit * F.col("size") > F.col("room"), 1).otherwise(0)).where("fit > 0")
    cut = close.groupBy("source").agg(F.max(F.struct("key", "fit", "n", (F.col("ahead") + F.col("fit") * F.col("size")).alias("upto"))).alias("cut"))
    prefix = F.concat(*[F.lpad(F.lower(F.hex(c)), 3, "0") for c in ("high_cut", "low_cut")])
    third = staged(
        _with_sources(second, cut, few).select(
            "source", "source_size", "target", "whole", F.coalesce("cut.key", prefix).alias("edge"), F.coalesce("cut.fit", F.lit(0)).alias("edge_taken"),
            F.coalesce("cut.n", F.lit(0)).alias("edge_rows"), (F.col("last") - F.coalesce("cut.upto", F.lit(0))).alias("gap"),
        ),
        "mix-cuts",
    )
    left = _with_sources(rows, third.select("source", "edge", "edge_taken", "edge_rows", "gap"), few).where("key > edge or (key = edge and edge_taken < edge_rows)")
    off = F.abs(F.col("size") - F.col("gap"))
    fill = left.where(off < F.col("gap")).groupBy("source").agg(F.min(F.struct(off.alias("off"), "key")).alias("best")).select("source", F.col("best.key").alias("fill"))
    fourth = staged(_with_sources(third, fill, few), "mix-cuts")
    equal = _with_sources(rows, fourth.select("source", "fill"), few).where("key = fill").groupBy("source").agg(F.count("*").alias("fill_rows"))
    on_edge = F.coalesce(F.col("fill") == F.col("edge"), F.lit(False))
    plan = staged(_with_sources(fourth, equal, few).withColumn("edge_taken", F.col("edge_taken") + on_edge.cast("long")).select("source", "source_size", "target", "whole", "edge", "edge_taken", "edge_rows", F.when(~on_edge, F.col("fill")).alias("fill"), "fill_rows"), "mix-plan")
    loose = not plan.where("edge_taken < edge_rows or (fill is not null and fill_rows > 1)").isEmpty()
    return rows, plan, few, loose


def _repeated(rows: DataFrame, plan: DataFrame, few: bool, loose: bool) -> DataFrame:
    """``rows`` (source, key and others) with source_size, target and times: how often the mix takes the row."""
    at = _with_sources(rows, plan, few)
    named = F.coalesce(F.col("key") == F.col("edge"), F.lit(False)) | F.coalesce(F.col("key") == F.col("fill"), F.lit(False))
    out = [*rows.columns, "source_size", "target"]
    times = lambda more: (F.col("whole") + more.cast("long")).alias("times")
    below = F.coalesce(F.col("key") < F.col("edge"), F.lit(False))
    if not loose:
        return at.select(*out, times(below | named))
    # equal rows are numbered within the partition that each lies in, and the partitions follow one another
    equal = staged(at.where(named).withColumn("part", F.spark_partition_id()), "mix-equal-rows")
    group = ["source", "key", "part"]
    counts = equal.groupBy(*group).agg(F.count("*").alias("n"))
    starts = _running(counts, "n", ["source", "key"], ["part"], "start").select(*[F.col(c).alias(f"of_{c}") for c in group], "start")
    inner = equal.withColumn("inner", F.row_number().over(Window.partitionBy(*group).orderBy("key")))
    numbered = inner.join(starts, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in group])
    allowed = F.when(F.col("key") == F.col("edge"), F.col("edge_taken")).otherwise(1)
    return at.where(~named).select(*out, times(below)).unionByName(numbered.select(*out, times(F.col("start") + F.col("inner") <= allowed)))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 42) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, times: one row per row of ``docs``.

    size: words of the text (null or empty: 0). taken: words the mix takes of the document, repeats counted;
    0, once, or as often as ``max_epochs`` allows. Null source: a source of its own, last in order. Null doc_id:
    hashed as its own value, with the text. Repeated rows count each, and each is taken or left on its own. An empty
    table gives an empty result; sources without words get target 0. Texts without words come with the whole repetitions
    of their source alone, never with the fractional one. Other columns are ignored. Reruns agree: nothing
    depends on the order of rows, but which of rows equal in id and text counts as the first.
    """
    rows, *plan = mix_plan(docs, weights, share, max_epochs, seed)
    return _repeated(rows, *plan).select("doc_id", "source", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "times")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` (all columns, whatever their names), each as often as the mix takes it."""
    _, *plan = mix_plan(docs, **how)
    rows = docs.select(F.struct("*").alias("row"), F.col("source").cast("string").alias("source"), _key(how.get("seed", 42)).alias("key"))
    times = _repeated(rows, *plan).where("times > 0")
    return times.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


#: The same rows in DuckDB: the fixpoint in closed form, and each source's documents ordered as a whole.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / weight AS fills_at, sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(weight) OVER () AS all_weight FROM w),
b AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before FROM r
      WINDOW o AS (ORDER BY fills_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap_before + fills_at * (all_weight - weight_before) <= total AS filled FROM b),
t AS (SELECT source, source_size, CASE WHEN filled THEN cap ELSE weight * ((total - coalesce(sum(CASE WHEN filled THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT filled THEN weight END) OVER ()) END AS target FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
n AS (SELECT d.*, row_number() OVER (PARTITION BY source, key) AS copy FROM d),
x AS (SELECT n.doc_id, n.source, n.size, n.key, n.copy, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS goal,
             coalesce(sum(n.size) OVER (PARTITION BY n.source ORDER BY n.key, n.copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM n JOIN p ON n.source IS NOT DISTINCT FROM p.source),
m AS (SELECT *, size > 0 AND ahead + size <= goal AS more FROM x),
g AS (SELECT source, any_value(goal) - coalesce(max(CASE WHEN more THEN ahead + size END), 0) AS gap FROM m GROUP BY source),
c AS (SELECT m.source, arg_min(struct_pack(key := key, copy := copy), struct_pack(o := abs(size - gap), key := key, copy := copy)) AS fill
      FROM m JOIN g ON m.source IS NOT DISTINCT FROM g.source WHERE NOT more AND abs(size - gap) < gap GROUP BY m.source),
y AS (SELECT m.*, whole + (more OR coalesce(m.key = c.fill.key AND m.copy = c.fill.copy, false))::BIGINT AS times
      FROM m LEFT JOIN c ON m.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, source, size, source_size, target, (times * size)::BIGINT AS taken, times FROM y
"""
