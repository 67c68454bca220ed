"""Quotations and citations: what is quoted for each citation, how long it is, and how it is marked.

Quotes are scanned once from left to right with a stack: a straight quote closes the innermost one if that is straight and opens
another else; typographic quotes open and close by their shape, and a closing one that closes nothing is ignored. A span runs
from a quote opened at depth none to the one that empties the stack, however many sentences and inner quotes it holds; a quote
that is never closed is none. A citation takes the last span that ends in front of it, behind the citation before. Both are
arrays in a paragraph's row, so spans and citations meet without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions import values as V

#: (AUTHOR, 2010, p. 3) or Author (2010, p. 3).
CITATION = r"\(\p{Lu}[^()]*,\s*(?:19|20)\d{2}[^()]*\)|\p{Lu}\p{Ll}+(?: (?:e|et al\.) ?\p{L}*)? \((?:19|20)\d{2}[^()]*\)"
_SPANS = "array<struct<start:int,stop:int>>"


def quote_spans(text: Column) -> Column:
    """array<struct<start, stop>>: places (from 1) of the outer quotes' marks."""
    marks = F.regexp_extract_all(text, F.lit('["“”«»]'), F.lit(0))

    def step(s: Column, mark: Column) -> Column:
        at = F.position(mark, text, s["at"] + 1).cast("int")
        top = F.right(s["stack"], F.lit(1))
        closes = ((mark == '"') & (top == '"')) | ((mark == "”") & (top == "“")) | ((mark == "»") & (top == "«"))
        ignored = ~closes & mark.isin("”", "»")
        stack = F.when(closes, F.substring(s["stack"], F.lit(1), F.length(s["stack"]) - 1)).when(ignored, s["stack"]).otherwise(F.concat(s["stack"], mark))
        start = F.when((F.length(s["stack"]) == 0) & ~ignored & ~closes, at).otherwise(s["start"])
        done = closes & (F.length(s["stack"]) == 1)
        spans = F.when(done, F.concat(s["spans"], F.array(F.struct(s["start"].alias("start"), at.alias("stop"))))).otherwise(s["spans"])
        return F.struct(at.alias("at"), stack.alias("stack"), start.alias("start"), spans.cast(_SPANS).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("stack"), F.lit(0).alias("start"), F.array().cast(_SPANS).alias("spans"))
    return F.aggregate(marks, zero, step, lambda s: s["spans"])


def citation_spans(text: Column) -> Column:
    """array<struct<start, stop>>: places of the citations' first and last characters."""
    found = F.regexp_extract_all(text, F.lit(CITATION), F.lit(0))

    def step(spans: Column, x: Column) -> Column:
        behind = F.coalesce(F.try_element_at(spans, F.lit(-1))["stop"], F.lit(0))
        at = F.position(x, text, behind + 1).cast("int")
        return F.concat(spans, F.array(F.struct(at.alias("start"), (at + F.length(x) - 1).cast("int").alias("stop"))))

    return F.aggregate(found, F.array().cast(_SPANS), step)


def citations(blocks: DataFrame) -> DataFrame:
    """doc_id, block_idx, nth, start, citation, page, quote, length_class, mark, rule: a row for each citation of paragraphs and quotes.

    blocks: doc_id, block_idx, block_type, text. page: the page or place that it names, null without. quote: the words between the
    quotes, or of the block for a block quotation. mark: indent, quotes or none; length_class: long (over three lines), short,
    or null without a quotation. rule 27: a short direct quotation (it names a page) without quotes; 28: a block
    quotation in quotes.
    """
    rows = blocks.where(F.col("block_type").isin("paragraph", "longQuote") & F.col("text").rlike(CITATION))
    rows = rows.select("doc_id", "block_idx", "block_type", "text", quote_spans(F.col("text")).alias("quotes"), citation_spans(F.col("text")).alias("cited"))
    rows = rows.select("doc_id", "block_idx", "block_type", "text", "quotes", "cited", F.posexplode("cited").alias("nth", "c"))
    behind = F.when(F.col("nth") > 0, F.get(F.col("cited"), F.col("nth") - 1)["stop"]).otherwise(0)
    own = F.try_element_at(F.filter("quotes", lambda q: (q["stop"] < F.col("c")["start"]) & (q["start"] > behind)), F.lit(-1))
    cut = lambda start, stop: F.substring("text", start, stop - start + 1)
    rows = rows.withColumn("citation", cut(F.col("c.start"), F.col("c.stop"))).withColumn("quoted", own)
    block = F.col("block_type") == "longQuote"
    between = F.when(F.col("quoted").isNotNull(), cut(F.col("quoted.start") + 1, F.col("quoted.stop") - 1))
    rows = rows.withColumn("quote", F.when(block, T.trim(F.substring("text", F.lit(1), F.col("c.start") - 1))).otherwise(between))
    page = F.nullif(F.regexp_extract("citation", r"\bp\.\s*(\d+(?:-\d+)?)", 1), F.lit(""))
    mark = F.when(block, "indent").when(F.col("quoted").isNotNull(), "quotes").otherwise("none")
    size = F.when(F.col("quote").isNotNull(), F.when(F.length("quote") > V.THREE_LINES, "long").otherwise("short"))
    rule = F.when(block & F.col("quoted").isNotNull(), 28).when((mark == "none") & page.isNotNull(), 27)
    return rows.select("doc_id", "block_idx", "nth", F.col("c.start").alias("start"), "citation", page.alias("page"), "quote", size.alias("length_class"), mark.alias("mark"), rule.alias("rule"))
