"""Automatic numbers of paragraphs: what a multi-level list shows in front of each of its paragraphs.

A level counts its paragraphs since the last one of a lower level in the same list. That is a running count less its value at
the last reset, so all nine levels are running sums over one window, one sort by list and place. A level that was
passed over shows its start. Definitions (numbering.xml) are a small table a document, joined by list and level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import blocks as B

LEVELS = 9
_ROMAN = (("", "M", "MM", "MMM"), ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"), ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"))


def _got(x: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))


def definitions(parts: DataFrame) -> DataFrame:
    """doc_id, num_id, levels: by list, an array of nine struct<start, format, text>, null where a level isn't defined.

    parts: doc_id, numbering_xml. A list's own start overrides that of its definition.
    """
    xml = F.coalesce("numbering_xml", F.lit(""))
    tags = lambda x, tag: F.regexp_extract_all(x, F.lit(rf"(?s)<w:{tag}\b[^>]*>.*?</w:{tag}>"), F.lit(0))
    level = lambda x: F.struct(
        _got(x, r'^<w:lvl\b[^>]*\bw:ilvl="(\d+)"').cast("int").alias("ilvl"), F.coalesce(_got(x, r'<w:start\b[^>]*\bw:val="(\d+)"').cast("int"), F.lit(0)).alias("start"),
        F.coalesce(_got(x, r'<w:numFmt\b[^>]*\bw:val="(\w+)"'), F.lit("decimal")).alias("format"), T.decode_xml(F.coalesce(_got(x, r'<w:lvlText\b[^>]*\bw:val="([^"]*)"'), F.lit(""))).alias("text"),
    )
    kinds = parts.select("doc_id", F.explode(tags(xml, "abstractNum")).alias("x")).select("doc_id", _got(F.col("x"), r'^<w:abstractNum\b[^>]*\bw:abstractNumId="(\d+)"').alias("kind"), F.transform(tags(F.col("x"), "lvl"), level).alias("made"))
    override = lambda x: F.struct(_got(x, r'^<w:lvlOverride\b[^>]*\bw:ilvl="(\d+)"').cast("int").alias("ilvl"), _got(x, r'<w:startOverride\b[^>]*\bw:val="(\d+)"').cast("int").alias("start"))
    lists = parts.select("doc_id", F.explode(tags(xml, "num")).alias("x")).select("doc_id", _got(F.col("x"), r'^<w:num\b[^>]*\bw:numId="(\d+)"').cast("int").alias("num_id"), _got(F.col("x"), r'<w:abstractNumId\b[^>]*\bw:val="(\d+)"').alias("kind"), F.transform(tags(F.col("x"), "lvlOverride"), override).alias("own"))
    found = lists.join(kinds.hint("merge"), ["doc_id", "kind"])

    def of(k: int) -> Column:
        defined = F.get(F.filter("made", lambda m: m["ilvl"] == k), F.lit(0))
        start = F.get(F.filter("own", lambda o: (o["ilvl"] == k) & o["start"].isNotNull()), F.lit(0))["start"]
        return F.when(defined.isNotNull(), F.struct(F.coalesce(start, defined["start"]).alias("start"), defined["format"].alias("format"), defined["text"].alias("text")))

    return found.select("doc_id", "num_id", F.array(*[of(k) for k in range(LEVELS)]).alias("levels"))


def shown(value: Column, kind: Column) -> Column:
    """A counter in a list's format: decimal, letters (z, then aa) or Roman; other formats show decimal figures, none and bullets nothing."""
    letter = F.when(value > 0, F.repeat(F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (value - 1) % 26 + 1, F.lit(1)), (F.floor((value - 1) / 26) + 1).cast("int"))).otherwise("")
    roman = F.when(value.between(1, 3999), F.concat(*[F.get(F.array(*map(F.lit, figures)), (F.floor(value / 10 ** (3 - k)) % 10).cast("int")) for k, figures in enumerate(_ROMAN)])).otherwise(value.cast("string"))
    return (
        F.when(kind.isin("none", "bullet"), "")
        .when(kind == "lowerLetter", letter).when(kind == "upperLetter", F.upper(letter))
        .when(kind == "lowerRoman", F.lower(roman)).when(kind == "upperRoman", roman)
        .when(kind == "decimalZero", F.lpad(value.cast("string"), F.greatest(F.length(value.cast("string")), F.lit(2)), F.lit("0")))
        .otherwise(value.cast("string"))
    )


def numbered(parts: DataFrame) -> DataFrame:
    """doc_id, idx, num_id, ilvl, number, text, level of the paragraphs that are in a list.

    parts: doc_id, document_xml, numbering_xml. number: what the list shows, null if its level isn't defined. level: the heading
    level that number and text give together, as if the number were typed. List 0 is none. Tables' paragraphs aren't counted.
    """
    el = parts.select("doc_id", F.posexplode(B.body_elements(B.body_xml(F.col("document_xml")))).alias("idx", "xml")).where(~F.startswith("xml", F.lit("<w:tbl")))
    of = F.regexp_extract("xml", r"(?s)<w:numPr\b[^>]*>(.*?)</w:numPr>", 1)
    el = el.withColumn("num_id", _got(of, r'<w:numId\b[^>]*\bw:val="(\d+)"').cast("int")).where("num_id > 0")
    el = el.withColumn("ilvl", F.least(F.coalesce(_got(of, r'<w:ilvl\b[^>]*\bw:val="(\d+)"').cast("int"), F.lit(0)), F.lit(LEVELS - 1))).withColumn("text", T.clean_text(B.xml_raw_text(F.col("xml"))))
    upto = Window.partitionBy("doc_id", "num_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    el = el.select("doc_id", "idx", "num_id", "ilvl", "text", *[F.sum((F.col("ilvl") == k).cast("int")).over(upto).alias(f"_r{k}") for k in range(LEVELS)])
    since = lambda k: F.col(f"_r{k}") - F.coalesce(F.last(F.when(F.col("ilvl") < k, F.col(f"_r{k}")), ignorenulls=True).over(upto), F.lit(0))
    el = el.select("doc_id", "idx", "num_id", "ilvl", "text", F.array(*[since(k) for k in range(LEVELS)]).alias("counts"))
    # each document brings its lists, so they are merged, never broadcast
    el = el.join(definitions(parts).hint("merge"), ["doc_id", "num_id"], "left")
    asked = F.get(F.col("levels"), F.col("ilvl"))["text"]

    def place(k: int) -> Column:
        one = F.get(F.col("levels"), F.lit(k))
        return F.when(F.contains(asked, F.lit(f"%{k + 1}")), shown(one["start"] + F.greatest(F.get(F.col("counts"), F.lit(k)), F.lit(1)) - 1, one["format"]))

    el = el.withColumns({f"_n{k}": place(k) for k in range(LEVELS)})
    el = el.withColumn("number", T.let(F.struct("levels", "ilvl", *[f"_n{k}" for k in range(LEVELS)]), _filled))
    line = T.fold_upper(F.concat_ws(" ", F.regexp_replace("number", r"\.$", ""), "text"))
    return el.select("doc_id", "idx", "num_id", "ilvl", "number", "text", F.when(F.col("text") != "", B.heading_level(line, F.lit(""))).alias("level"))


def _filled(s: Column) -> Column:
    """The level's text with the places of all levels filled in."""
    out = F.get(s["levels"], s["ilvl"])["text"]
    for k in range(LEVELS):
        out = F.replace(out, F.lit(f"%{k + 1}"), F.coalesce(s[f"_n{k}"], F.lit("")))
    return out
