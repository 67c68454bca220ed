"""Blocks: the ordered pieces of a document, from plain text lines or from OOXML.

``blocks`` is one array column per document. Order is meaning here, and an array keeps it without a shuffle or a
single-key window; ``exploded`` gives the table (doc_id, block_idx, ...) where rows are wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions import values as V

BLOCK = "struct<block_type:string,level:int,text:string,raw_text:string,style_id:string,style_name:string,rows:array<array<string>>,rel_id:string,target:string,section:string>"


def block(kind: Column, **parts: Column) -> Column:
    """A block struct; parts that aren't given are null."""
    types = dict(p.split(":", 1) for p in BLOCK[7:-1].split(",") if ":" in p)
    parts["block_type"] = kind
    return F.struct(*[parts.get(name, F.lit(None)).cast(t).alias(name) for name, t in types.items()])


def is_text_heading(folded: Column) -> Column:
    return folded.rlike(r"^\d+(?:\.\d+)*\s+\S+") | T.heading_base(folded).isin(*V.TEXT_HEADINGS)


#: Lines that may fold to a heading: a number leads, or few ASCII letters after a first one that some heading has, or
#: letters that folding changes. No other line can, so no other is folded.
_MAYBE_HEADING = r"(?s)^(?:[0-9]|[rRaAiI].{0,10}$|(?=[rRaAiI]|\P{ASCII}).*\P{ASCII})"


def text_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with blocks: a heading or paragraph for each non-blank line. Null text: no blocks."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n"), T.trim_line), lambda x: x != "")

    def build(x: Column) -> Column:
        plain = block(F.lit("paragraph"), text=x, raw_text=x)
        level = lambda f: F.when(is_text_heading(f), F.when(f.rlike(r"^\d+\.\d+\s+"), 2).otherwise(1))
        folded = T.let(T.let(T.fold_line(x), level), lambda n: F.when(n.isNull(), plain).otherwise(block(F.lit("heading"), level=n, text=x, raw_text=x)))
        return F.when(x.rlike(_MAYBE_HEADING), folded).otherwise(plain)

    return docs.withColumn("blocks", F.transform(lines, build))


def block_text(b: Column) -> Column:
    """What a block says: its text, a table's cells, an image's mark, nothing for a page break."""
    return (
        F.when(b["block_type"] == "pageBreak", "")
        .when(b["block_type"] == "image", F.concat(F.lit("[Imagem detectada: "), F.coalesce(b["rel_id"], F.lit("sem relacao")), F.lit("]")))
        .when(b["block_type"] == "table", F.array_join(F.transform(b["rows"], lambda r: F.array_join(r, "\t")), "\n"))
        .otherwise(F.coalesce(b["text"], F.lit("")))
    )


def exploded(docs: DataFrame) -> DataFrame:
    """doc_id, block_idx and the block's columns."""
    return docs.select("doc_id", F.posexplode("blocks").alias("block_idx", "b")).select("doc_id", "block_idx", "b.*")


def heading_section(folded: Column) -> Column:
    """The section that a heading opens, null if it opens none."""
    base = T.heading_base(folded)
    return (
        F.when(base.isin(*V.POST_TEXTUAL_HEADINGS) | base.rlike(r"^(?:ANEXO|APENDICE)\s+[A-Z0-9]"), "post-textual")
        .when(base.isin(*V.TEXTUAL_HEADINGS) | folded.rlike(r"^\d+(?:\.\d+)*\s+\S+"), "textual")
        .when(base.isin(*V.PRE_TEXTUAL_HEADINGS), "pre-textual")
    )


def carry_sections(rows: DataFrame) -> DataFrame:
    """Block rows with the section each is in: that of the last heading that opened one, first ``pre-textual``."""
    w = Window.partitionBy("doc_id").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, 0)
    # folded once, in a column of its own
    opened = rows.withColumn("_folded", F.when(F.col("block_type") == "heading", T.fold_upper(F.col("text")))).withColumn("_opened", heading_section(F.col("_folded")))
    return opened.withColumn("section", F.coalesce(F.last("_opened", ignorenulls=True).over(w), F.lit("pre-textual"))).drop("_folded", "_opened")


def heading_level(folded_text: Column, folded_style: Column) -> Column:
    """The level of an OOXML paragraph as a heading by its style, then by its text; null if it is none."""
    by_style = F.regexp_extract(folded_style, r"\b(?:HEADING|TITULO|TTULO)\s*([1-9])\b", 1)
    ordered = [F.regexp_extract(folded_style, rf"\b{name}\s*([1-9])\b", 1) for name in ("HEADING", "TITULO", "TTULO")]
    number = F.regexp_extract(folded_text, r"^(\d+(?:\.\d+)*)\s+\S+", 1)
    base = T.heading_base(folded_text)
    style_level = F.coalesce(*[F.when(x != "", x.cast("int")) for x in ordered])
    text_level = F.when(number != "", F.size(F.split(number, r"\."))).when(base.isin(*V.PRE_TEXTUAL_HEADINGS, *V.UNNUMBERED_HEADINGS), 1)
    return F.when(by_style != "", style_level).otherwise(text_level)


def is_long_quote(xml: Column, folded_style: Column) -> Column:
    indent = F.regexp_extract(xml, r'<w:ind\b[^>]*w:left="(\d+)"', 1)
    return folded_style.rlike("CITACAO|QUOTE") | F.coalesce(F.when(indent != "", indent.cast("bigint")) >= V.LONG_QUOTE_INDENT, F.lit(False))


def _all(x: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(group))


def xml_raw_text(xml: Column) -> Column:
    """The text tokens of a piece of XML: text decoded, tabs as blanks, breaks as line feeds."""
    tokens = _all(xml, r"(?s)<w:t(?:\s[^>]*)?>.*?</w:t>|<w:tab\b[^>]*/>|<w:br\b[^>]*/>")
    one = lambda t: F.when(t.rlike("^<w:tab"), " ").when(t.rlike("^<w:br"), "\n").otherwise(T.decode_xml(F.regexp_extract(t, r"(?s)^<w:t(?:\s[^>]*)?>(.*?)</w:t>$", 1)))
    return F.array_join(F.transform(tokens, one), "")


#: An element of text that starts with a character that is neither white space nor markup. A tag that closes itself may be inside another.
_QUICK = r"<w:t(?:\s[^>]*)?(?<!/)>[!-%'-;=-~\x{A1}-\x{FF}][^<]*</w:t>"


def says_something(xml: Column, pattern: str = f"[^{T.WS}]") -> Column:
    """Whether the raw text of a value that costs nothing to name twice has a character of a kind, by default one that isn't white space."""
    return F.when(xml.rlike(_QUICK), True).otherwise(xml_raw_text(xml).rlike(pattern))


def relationships(xml: Column) -> Column:
    """Id to target of every relationship; a later one of the same id wins."""
    tags = _all(F.coalesce(xml, F.lit("")), r"<Relationship\b[^>]*>")
    pair = lambda t: F.struct(F.regexp_extract(t, r'\bId="([^"]+)"', 1).alias("k"), T.decode_xml(F.regexp_extract(t, r'\bTarget="([^"]+)"', 1)).alias("v"))
    return _as_map(F.filter(F.transform(tags, pair), lambda p: (p["k"] != "") & (p["v"] != "")))


def style_names(xml: Column) -> Column:
    styles = _all(F.coalesce(xml, F.lit("")), r"(?s)<w:style\b.*?</w:style>")
    pair = lambda s: F.struct(F.regexp_extract(s, r'\bw:styleId="([^"]+)"', 1).alias("k"), T.decode_xml(F.regexp_extract(s, r'<w:name\b[^>]*w:val="([^"]+)"', 1)).alias("v"))
    return _as_map(F.filter(F.transform(styles, pair), lambda p: (p["k"] != "") & (p["v"] != "")))


def _as_map(pairs: Column) -> Column:
    """Key and value pairs as a map; of equal keys the last one counts. Sorted, so that equal keys are neighbours."""
    placed = F.array_sort(F.transform(pairs, lambda p, k: F.struct(p["k"].alias("k"), (-k).alias("at"), p["v"].alias("v"))))
    first = lambda s: F.filter(s, lambda p, k: (k == 0) | (F.get(s, F.greatest(k - 1, F.lit(0)))["k"] != p["k"]))
    return F.map_from_entries(F.transform(T.let(placed, first), lambda p: F.struct(p["k"], p["v"])))


def image_ids(xml: Column, rels: Column) -> Column:
    """Relationship ids in a paragraph that lead to media, each once, in order."""
    ids = _all(xml, r'\br:(?:id|embed|link)="([^"]+)"', 1)
    return F.array_distinct(F.filter(ids, lambda i: F.coalesce(F.startswith(F.try_element_at(rels, i), F.lit("media/")), F.lit(False))))


def table_rows(xml: Column) -> Column:
    cells = lambda row: F.transform(_all(row, r"(?s)<w:tc\b.*?</w:tc>"), lambda c: T.clean_text(xml_raw_text(c)))
    return F.filter(F.transform(_all(xml, r"(?s)<w:tr\b.*?</w:tr>"), cells), lambda r: F.exists(r, lambda c: T.trim(c) != ""))


def is_on(xml: Column, tag: str, off: str) -> Column:
    """Whether a mark is there and not switched off."""
    return xml.rlike(rf"<w:{tag}\b") & ~xml.rlike(rf'(?i)<w:{tag}\b[^>]*\bw:val="(?:{off})"')


def body_xml(xml: Column) -> Column:
    """What the body element of a document part holds; the whole part without one."""
    end = "</w:body>"
    # the text is cut by places, as a lazy pattern would try its end at every character
    after = lambda tag: F.substring(xml, F.position(tag, xml) + F.length(tag), F.length(xml))
    inner = lambda rest: F.when(F.contains(rest, F.lit(end)), F.substring_index(rest, end, 1)).otherwise(xml)
    return T.let(F.regexp_extract(xml, r"<w:body\b[^>]*>", 0), lambda tag: F.when(tag == "", xml).otherwise(T.let(after(tag), inner)))


def body_elements(body: Column) -> Column:
    """The XML of its paragraphs and tables, in order."""
    return _all(body, r"(?s)<w:p\b.*?</w:p>|<w:tbl\b.*?</w:tbl>")


def docx_blocks(parts: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """doc_id, text, blocks, rels, has_numbering of (doc_id, document_xml, styles_xml, rels_xml, has_numbering).

    Elements become rows only to carry the section forward; the blocks of a document are collected in order. With ``marked``
    (doc_id, idx, marked: ``formatting.marked_paragraphs``) paragraphs and quotes keep their bold and italics as inline marks.
    """
    df = parts.withColumn("rels", relationships(F.col("rels_xml"))).withColumn("styles", style_names(F.col("styles_xml"))).withColumn("body", body_xml(F.col("document_xml")))
    keep = df.select("doc_id", "rels", "has_numbering")
    el = df.select("doc_id", "rels", "styles", F.posexplode(body_elements(F.col("body"))).alias("idx", "xml"))
    el = el.withColumn("is_table", F.startswith("xml", F.lit("<w:tbl"))).withColumn("raw_text", xml_raw_text(F.col("xml"))).withColumn("text", T.clean_text(F.col("raw_text")))
    style = F.regexp_extract("xml", r'<w:pStyle\b[^>]*w:val="([^"]+)"', 1)
    el = el.withColumn("style_id", F.when(style != "", style)).withColumn("style_name", F.try_element_at("styles", F.col("style_id")))
    el = el.withColumn("folded_style", T.fold_upper(F.concat(F.coalesce("style_id", F.lit("")), F.lit(" "), F.coalesce("style_name", F.lit(""))))).withColumn("folded", T.fold_upper(F.col("text")))
    el = el.withColumn("level", F.when(~F.col("is_table") & (F.col("text") != ""), heading_level(F.col("folded"), F.col("folded_style"))))
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    el = el.withColumn("section", F.coalesce(F.last(F.when(F.col("level").isNotNull(), heading_section(F.col("folded"))), ignorenulls=True).over(w), F.lit("pre-textual")))
    section = F.col("section")
    kind = F.when(F.col("level").isNotNull(), "heading").when(is_long_quote(F.col("xml"), F.col("folded_style")), "longQuote").otherwise("paragraph")
    none = F.array().cast(f"array<{BLOCK}>")
    shown = F.col("text")
    if marked is not None:
        el = el.join(marked.select("doc_id", "idx", "marked").hint("merge"), ["doc_id", "idx"], "left")
        shown = F.when(F.col("level").isNull(), F.coalesce(T.clean_text(F.col("marked")), shown)).otherwise(shown)
    said = F.when(F.col("text") != "", F.array(block(kind, level=F.col("level"), text=shown, raw_text=F.col("raw_text"), style_id=F.col("style_id"), style_name=F.col("style_name"), section=section))).otherwise(none)
    images = F.transform(image_ids(F.col("xml"), F.col("rels")), lambda i: block(F.lit("image"), rel_id=i, target=F.try_element_at(F.col("rels"), i), section=section))
    breaks = F.when(F.col("xml").rlike(r'<w:br\b[^>]*w:type="page"|<w:lastRenderedPageBreak\b'), F.array(block(F.lit("pageBreak")))).otherwise(none)
    rows = table_rows(F.col("xml"))
    tables = F.when(F.size(rows) > 0, F.array(block(F.lit("table"), rows=rows, section=section))).otherwise(none)
    el = el.select("doc_id", "idx", F.when(F.col("is_table"), tables).otherwise(F.concat(said, images, breaks)).alias("made"))
    ordered = F.array_sort(F.collect_list(F.struct("idx", "made")))
    grouped = el.groupBy("doc_id").agg(F.flatten(F.transform(ordered, lambda x: x["made"])).alias("blocks"))
    # a row for each document on both sides, whose bytes the plan can't know: merged, never broadcast
    out = keep.join(grouped.hint("merge"), "doc_id", "left").withColumn("blocks", F.coalesce("blocks", none))
    return out.withColumn("text", document_text(F.col("blocks")))


def document_text(blocks: Column) -> Column:
    """All blocks' texts but page breaks, a table's rows as lines."""
    return T.trim(F.array_join(F.transform(F.filter(blocks, lambda b: b["block_type"] != "pageBreak"), block_text), "\n"))


def image_assets(rels: DataFrame, media: DataFrame) -> DataFrame:
    """doc_id, rel_id, target, file_name, extension, mime_type, data: media that a relationship names or the file holds.

    rels (doc_id, rel_id, target) and media (doc_id, target, data) are joined in full; of several relationships to
    one target the least id counts. Bytes are only read if ``data`` is selected.
    """
    named = rels.where(F.startswith("target", F.lit("media/"))).groupBy("doc_id", "target").agg(F.min("rel_id").alias("rel_id"))
    name = F.element_at(F.split("target", "/"), -1)
    extension = F.lower(F.when(F.contains(F.col("file_name"), F.lit(".")), F.element_at(F.split("file_name", r"\."), -1)).otherwise(""))
    found = named.join(media, ["doc_id", "target"], "full").withColumn("file_name", name).withColumn("extension", extension)
    return found.select("doc_id", "rel_id", "target", "file_name", "extension", T.mime_type(F.col("extension")).alias("mime_type"), "data")


def first_images(blocks: DataFrame, assets: DataFrame) -> DataFrame:
    """doc_id and the target of its first image: the first that a paragraph refers to, else the least target."""
    referred = blocks.where("block_type = 'image'").join(assets.select("doc_id", "rel_id", F.col("target").alias("asset")), ["doc_id", "rel_id"]).groupBy("doc_id").agg(F.min_by("asset", "block_idx").alias("referred"))
    least = assets.groupBy("doc_id").agg(F.min("target").alias("least"))
    return least.join(referred, "doc_id", "left").select("doc_id", F.coalesce("referred", "least").alias("target"))
