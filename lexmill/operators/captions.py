"""Titles and sources of images and tables: each object paired with the nearest fitting caption, each caption used once.

Captions, sources, objects and headings are the events of a document; all other blocks lie between them. A caption belongs
to the object that is the next event after it, if it fits it; where none is, to the object that is the event before it, if that
has no caption above. So no caption goes to two objects and no heading lies between. A source belongs to the last object
before it. One window over a document's few events; no block meets another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions import values as V

#: The label, number and title of a folded caption.
CAPTION = rf"^({'|'.join(V.CAPTION_LABELS)})\s+(\d+(?:\.\d+)*)\s*[-:.]?\s*(.*)$"

#: Texts that may fold to a caption: only white space and combining marks before one of the labels' first letters, or before a
#: letter that folding changes. No other text can, so no other is folded.
MAYBE_CAPTION = rf"^(?:{T.SPACE}|[\x{{300}}-\x{{36F}}])*(?:[{''.join(sorted({x for label in V.CAPTION_LABELS for x in (label[0], label[0].lower())}))}]|\P{{ASCII}})"


def _events(blocks: DataFrame) -> DataFrame:
    """doc_id, block_idx, event (caption, source, image, table, heading), text and for captions label, number."""
    said = F.when(F.col("block_type").isin("paragraph", "longQuote", "heading"), F.coalesce("text", F.lit("")))
    rows = blocks.withColumn("_folded", T.fold_upper(said))
    caption = F.col("_folded").rlike(CAPTION)
    event = F.when(F.col("block_type").isin("image", "table"), F.col("block_type")).when(caption, "caption").when(F.col("_folded").rlike(r"^FONTES?\s*:"), "source").when(F.col("block_type") == "heading", "heading")
    part = lambda k: F.when(caption, F.regexp_extract("_folded", CAPTION, k))
    return rows.select("doc_id", "block_idx", event.alias("event"), said.alias("text"), part(1).alias("label"), part(2).alias("number")).where("event IS NOT NULL")


def _fits(label: Column, event: Column) -> Column:
    """Whether a caption's label can name this kind of object."""
    return F.coalesce(label.isin(*V.ANY_LABELS) | ((label == V.TABLE_LABEL) == (event == "table")), F.lit(False)) & event.isin("image", "table")


def captioned(blocks: DataFrame) -> DataFrame:
    """doc_id, block_idx, object, caption, label, number, place (above, below or null), source: a row for each image or table.

    ``blocks``: doc_id, block_idx, block_type, text. Of several sources the first counts.
    """
    order = Window.partitionBy("doc_id").orderBy("block_idx")
    events = _events(blocks)
    # sources don't stand between a caption and its object
    core = events.where("event <> 'source'")
    for name, k in (("before", -1), ("after", 1), ("later", 2)):
        near = lambda c, k=k: F.lead(c, k).over(order) if k > 0 else F.lag(c, -k).over(order)
        core = core.withColumns({f"{name}_event": near("event"), f"{name}_label": near("label"), f"{name}_number": near("number"), f"{name}_text": near("text")})
    objects = core.where("event IN ('image', 'table')")
    above = (F.col("before_event") == "caption") & _fits(F.col("before_label"), F.col("event"))
    taken = _fits(F.col("after_label"), F.coalesce("later_event", F.lit("")))
    below = (F.col("after_event") == "caption") & _fits(F.col("after_label"), F.col("event")) & ~taken
    place = F.when(above, "above").when(below, "below")
    pick = lambda c: F.when(F.col("place") == "above", F.col(f"before_{c}")).when(F.col("place") == "below", F.col(f"after_{c}"))
    objects = objects.withColumn("place", place).select("doc_id", "block_idx", F.col("event").alias("object"), pick("text").alias("caption"), pick("label").alias("label"), pick("number").alias("number"), "place")
    # the last object or heading before a source tells whose it is
    owner = F.last(F.when(F.col("event").isin("image", "table", "heading"), F.struct("event", "block_idx")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    sources = events.withColumn("owner", owner).where("event = 'source' AND owner.event IN ('image', 'table')")
    first = sources.groupBy("doc_id", F.col("owner.block_idx").alias("block_idx")).agg(F.min_by("text", "block_idx").alias("source"))
    # as many sources as objects: merged, however few bytes the plan expects of composed texts
    return objects.join(first.hint("merge"), ["doc_id", "block_idx"], "left")


def caption_breaches(blocks: DataFrame) -> DataFrame:
    """doc_id, block_idx, rule: objects without title (40 images, 42 tables) or source (41, 43), in the rules' numbers."""
    rows = captioned(blocks)
    table = F.col("object") == "table"
    told = F.array_compact(F.array(F.when(F.col("caption").isNull(), F.when(table, 42).otherwise(40)), F.when(F.col("source").isNull(), F.when(table, 43).otherwise(41))))
    return rows.select("doc_id", "block_idx", F.explode(told).alias("rule"))
