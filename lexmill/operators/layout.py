"""Layout: editor text to typed blocks, sections to ordered layout rows, rows to a Word file.

Everything up to the layout row is DataFrame operations. ``render`` turns one document's rows into a DOCX with the
standard library's zip writer, one Python call per document.
"""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions import values as V
from lexmill.operators import references as R

_PREFIXES = (("heading2", "## "), ("heading3", "### "), ("heading1", "# "), ("longQuote", "> "))
#: Style: size in half-points, alignment, bold, line spacing in 1/240 lines, space before and after, left and
#: first-line indent in twips. Texts of a style in LITERAL hold no inline marks.
STYLES = {
    "cover": (24, "center", False, 240, 0, 240, 0, 0),
    "coverBold": (24, "center", True, 240, 0, 240, 0, 0),
    "logo": (24, "center", False, 240, 0, 240, 0, 0),
    "space": (24, "left", False, 240, 0, 0, 0, 0),
    "title": (24, "center", True, 360, 240, 240, 0, 0),
    "sectionTitle": (24, "center", True, 360, 240, 240, 0, 0),
    "heading1": (24, "left", True, 360, 240, 180, 0, 0),
    "heading2": (24, "left", True, 360, 180, 120, 0, 0),
    "heading3": (24, "left", True, 360, 120, 100, 0, 0),
    "paragraph": (24, "both", False, 360, 0, 120, 0, 850),
    "simple": (24, "both", False, 240, 0, 120, 0, 0),
    "nature": (24, "both", False, 240, 0, 180, 2268, 0),
    "longQuote": (22, "both", False, 240, 0, 120, 2268, 0),
    "reference": (24, "left", False, 240, 0, 120, 0, 0),
    "toc": (24, "left", False, 240, 0, 0, 0, 0),
    "note": (22, "center", False, 240, 120, 120, 0, 0),
    "pageBreak": (24, "left", False, 240, 0, 0, 0, 0),
}
LITERAL = ("cover", "coverBold", "title", "sectionTitle", "heading1", "heading2", "heading3", "note")
#: Level of a style's hidden entry in the table of contents.
LEVELS = {"sectionTitle": 1, "heading1": 1, "heading2": 2, "heading3": 3}
#: Page size and margins (top, right, bottom, left) in twips.
PAGE = (11906, 16838)
MARGINS = (1701, 1134, 1134, 1701)
_PAGE_BLOCK = "struct<type:string,text:string>"


def editor_line(x: Column) -> Column:
    """(type, text) of a trimmed editor line."""
    out = F.when(x.rlike(r"(?i)^\[REF\]\s+"), F.struct(F.lit("reference").alias("type"), F.regexp_replace(x, r"(?i)^\[REF\]\s+", "").alias("text")))
    chain = None
    for kind, mark in _PREFIXES:
        made = F.struct(F.lit(kind).alias("type"), F.regexp_replace(x, rf"^{mark.strip()}\s+", "").alias("text"))
        chain = F.when(F.startswith(x, F.lit(mark)), made) if chain is None else chain.when(F.startswith(x, F.lit(mark)), made)
    return chain.otherwise(F.coalesce(out, F.struct(F.lit("paragraph").alias("type"), x.alias("text"))))


def editor_array(x: Column) -> Column:
    lines = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"\r?\n"), T.trim), lambda l: l != "")  # noqa: E741
    return F.transform(lines, editor_line)


def editor_blocks(works: DataFrame, text: str = "editor_text") -> DataFrame:
    """doc_id, idx, type, text: the non-blank lines of the editor text."""
    return works.select("doc_id", F.posexplode(editor_array(F.col(text))).alias("idx", "b")).select("doc_id", "idx", "b.type", "b.text")


def paragraphs(x: Column) -> Column:
    """The trimmed non-blank lines of a field."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), "\n+"), T.trim), lambda l: l != "")  # noqa: E741


def _headings(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: b["type"].isin("heading1", "heading2"))


def body_blocks(works: DataFrame) -> DataFrame:
    """``works`` with body: the editor's blocks, led by the introduction and closed by the conclusion fields if it lacks them."""
    own = F.filter(editor_array(F.col("editor_text")), lambda b: b["type"] != "reference")
    titled = lambda title, field: F.concat(F.array(F.struct(F.lit("heading1").alias("type"), F.lit(title).alias("text"))), F.transform(paragraphs(F.col(field)), lambda p: F.struct(F.lit("paragraph").alias("type"), p.alias("text"))))
    none = F.array().cast(f"array<{_PAGE_BLOCK}>")
    df = works.withColumn("_own", own)
    opened = F.exists(_headings(F.col("_own")), lambda b: F.contains(T.fold_upper(b["text"]), F.lit("INTRODUCAO")))
    closed = F.exists(_headings(F.col("_own")), lambda b: T.heading_base(T.fold_upper(b["text"])).isin(*V.CONCLUSION_HEADINGS))
    lead = F.when((F.coalesce("introducao", F.lit("")) != "") & ~opened, titled("1 INTRODUÇÃO", "introducao")).otherwise(none)
    tail = F.when((F.coalesce("conclusao", F.lit("")) != "") & ~closed, titled("CONCLUSÃO", "conclusao")).otherwise(none)
    return df.withColumn("body", F.concat(lead, F.col("_own").cast(f"array<{_PAGE_BLOCK}>"), tail)).drop("_own")


def all_references(works: DataFrame) -> DataFrame:
    """``works`` with all_refs: the field's references, then those marked in the editor; repeats stay."""
    marked = F.transform(F.filter(editor_array(F.col("editor_text")), lambda b: b["type"] == "reference"), lambda b: b["text"])
    return works.withColumn("all_refs", F.concat(paragraphs(F.col("referencias")), marked))


def with_summary(works: DataFrame) -> DataFrame:
    """``works`` (body, all_refs) with has_summary: there is anything to list."""
    headed = F.exists("body", lambda b: F.startswith(b["type"], F.lit("heading")))
    return works.withColumn("has_summary", headed | (F.size("all_refs") > 0) | (F.coalesce("apendices", F.lit("")) != "") | (F.coalesce("anexos", F.lit("")) != ""))


def start_page() -> Column:
    """The number of the first textual page, from the optional pages before it."""
    one = lambda c: c.cast("int")
    impact = F.coalesce("work_type", F.lit("")).isin(*V.IMPACT_TYPES)
    optional = [T.has_value(F.col(k)) for k in ("dedicatoria", "agradecimentos", "epigrafe")] + [T.has_value(F.col(k)) | impact for k in ("indicadoresImpacto", "impactIndicators")]
    out = F.lit(4) + one(F.col("has_summary"))
    for c in optional:
        out = out + one(c)
    return out


def _row(part: str, style: str, text: Column | str = "", before: int | None = None) -> Column:
    text = text if isinstance(text, Column) else F.lit(text)
    return F.struct(F.lit(part).alias("part"), F.lit(style).alias("style"), F.lit(before).cast("long").alias("before"), text.alias("text"))


def _front(as_of_year: int, logo: bool) -> Column:
    """Cover, title page, the pages before the text, and the table of contents."""
    row = lambda style, text="", before=None: _row("front", style, text, before)
    none = F.array().cast("array<struct<part:string,style:string,before:bigint,text:string>>")
    own = lambda k: F.coalesce(F.col(k), F.lit(""))
    text = lambda k, default="": F.coalesce(F.nullif(F.col(k), F.lit("")), F.lit(default))
    given = lambda k, rows: F.when(own(k) != "", rows).otherwise(none)
    simple = lambda x: F.transform(paragraphs(x), lambda p: row("simple", p))
    page = lambda title: F.array(row("pageBreak"), row("sectionTitle", F.upper(F.lit(title))))
    optional = lambda title, x: F.when(T.has_value(x), F.concat(page(title), simple(x))).otherwise(none)
    impact = F.coalesce("work_type", F.lit("")).isin(*V.IMPACT_TYPES)
    forced = lambda k, place: F.when(own(k) != "", own(k)).when(impact, place).otherwise("")
    named = F.array(row("coverBold", F.upper(text("title", V.DEFAULT_TITLE))))
    subtitle = given("subtitle", F.array(row("coverBold", F.upper(own("subtitle")))))
    where = F.array(row("cover", text("location", V.DEFAULT_LOCATION)), row("cover", text("year", str(as_of_year))))
    author = row("cover", text("author", V.DEFAULT_AUTHOR))
    details = [given(k, simple(F.concat(F.lit(label), own(k)))) for k, label in (("course", "Curso: "), ("program", "Programa: "), ("advisor", "Orientador(a): "), ("coadvisor", "Coorientador(a): "))]
    words = lambda k, label: given(k, F.array(row("simple", F.concat(F.lit(label), own(k)))))
    whole = lambda title, k: F.concat(page(title), F.array(row("simple", text(k, " "))))
    return F.concat(
        F.array(row("logo") if logo else row("coverBold", V.INSTITUTION), row("space", before=1200), author, row("space", before=1800)), named, subtitle, F.array(row("space", before=2200)), where,
        F.array(row("pageBreak"), author, row("space", before=1500)), named, subtitle, F.array(row("space", before=900), row("nature", text("workNature", V.DEFAULT_NATURE))), *details, F.array(row("space", before=1500)), where,
        page("Ficha catalográfica"), F.array(row("simple", V.CATALOGUE_CARD)),
        optional("Dedicatória", own("dedicatoria")), optional("Agradecimentos", own("agradecimentos")), optional("Epígrafe", own("epigrafe")),
        whole("Resumo", "resumo"), words("palavrasChave", "Palavras-chave: "),
        whole("Abstract", "abstractText"), words("keywords", "Keywords: "),
        optional("Indicadores de impacto", forced("indicadoresImpacto", V.IMPACT_PLACE)), optional("Impact indicators", forced("impactIndicators", V.IMPACT_PLACE_ENGLISH)),
        F.when(F.col("has_summary"), F.array(row("pageBreak"), row("title", F.upper(F.lit("Sumário"))), row("toc", "TOC \\f \\h \\z"), row("note", V.SUMMARY_NOTE))).otherwise(none),
    )


def _text() -> Column:
    """The body's blocks, a new page before every main heading but a first one, then references, annexes and appendices."""
    row = lambda style, text="": _row("body", style, text)
    none = F.array().cast("array<struct<part:string,style:string,before:bigint,text:string>>")
    styled = lambda b: F.struct(F.lit("body").alias("part"), b["type"].alias("style"), F.lit(None).cast("long").alias("before"), F.when(b["type"] == "heading1", F.upper(b["text"])).otherwise(b["text"]).alias("text"))
    blocks = F.flatten(F.transform("body", lambda b, k: F.when((b["type"] == "heading1") & (k > 0), F.array(row("pageBreak"), styled(b))).otherwise(F.array(styled(b)))))
    page = lambda title: F.array(row("pageBreak"), row("sectionTitle", F.upper(F.lit(title))))
    closing = lambda title, k: F.when(F.coalesce(F.col(k), F.lit("")) != "", F.concat(page(title), F.transform(paragraphs(F.col(k)), lambda p: row("simple", p)))).otherwise(none)
    return F.concat(blocks, page("Referências"), F.transform("all_refs", lambda r: row("reference", r)), closing("Anexos", "anexos"), closing("Apêndices", "apendices"))


def layout_rows(works: DataFrame, as_of_year: int, logo: bool = False) -> DataFrame:
    """doc_id, start_page, seq, part (front or body), style, before, text: every paragraph of the final document, in order.

    before: the space that a blank line leaves, else null and the style's. With ``logo`` the cover starts with the place of
    an image, else with the institution's name.
    """
    df = with_summary(all_references(body_blocks(works)))
    rows = F.concat(_front(as_of_year, logo), _text())
    return df.select("doc_id", start_page().alias("start_page"), F.posexplode(rows).alias("seq", "r")).select("doc_id", "start_page", "seq", "r.*")


def _line_runs(x: Column) -> Column:
    """Runs of a text whose marks end with their line; line feeds are runs of their own."""
    plain = lambda t: F.array(F.struct(t.alias("text"), F.lit(None).cast("boolean").alias("bold"), F.lit(None).cast("boolean").alias("italics")))
    lines = F.transform(F.split(x, "\n"), lambda line, k: F.when(k > 0, F.concat(plain(F.lit("\n")), R.marked_runs(line))).otherwise(R.marked_runs(line)))
    return F.when(F.contains(x, F.lit("*")), F.flatten(lines)).otherwise(plain(x))


def layout_runs(rows: DataFrame) -> DataFrame:
    """Layout rows with runs: references normalized, other text by its inline marks, titles as they are."""
    refs = R.normalized(rows.withColumn("reference", F.when(F.col("style") == "reference", F.col("text"))).withColumnRenamed("text", "own"), "reference")
    whole = F.array(F.struct(F.col("own").alias("text"), F.lit(None).cast("boolean").alias("bold"), F.lit(None).cast("boolean").alias("italics")))
    runs = F.when(F.col("style") == "reference", F.col("runs")).when(F.col("style").isin("pageBreak", "space", "logo", "toc"), F.array().cast(f"array<{R.RUN}>")).when(F.col("style").isin(*LITERAL), whole).otherwise(_line_runs(F.col("own")))
    return refs.withColumn("runs", runs).select(*[F.col("own").alias("text") if c == "text" else F.col(c) for c in rows.columns], "runs")


_LOOK = '<w:rFonts w:ascii="Times New Roman" w:hAnsi="Times New Roman"/>'
_COLOR = '<w:color w:val="000000"/>'
_TEXT = '<w:t xml:space="preserve">'


def _xml(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = x.replace(a, b)
    return x


def _field(instruction: str, hidden: bool = False, size: int | None = None) -> str:
    look = f'{_LOOK}{_COLOR}<w:sz w:val="{size}"/>' if size else ""
    props = "<w:rPr><w:vanish/></w:rPr>" if hidden else f"<w:rPr>{look}</w:rPr>" if look else ""
    char = lambda kind: f'<w:r>{props}<w:fldChar w:fldCharType="{kind}"/></w:r>'
    return char("begin") + f'<w:r>{props}<w:instrText xml:space="preserve"> {instruction} </w:instrText></w:r>' + char("separate") + char("end")


def _around(made: str, *inner: Column) -> Column:
    """A text with columns in the places that ``made`` marks by line feeds."""
    pieces = made.split("\n")
    return F.concat(F.lit(pieces[0]), *[x for c, piece in zip(inner, pieces[1:], strict=True) for x in (c, F.lit(piece))])


def _of_style(value) -> Column:
    """What ``value`` makes of the style's numbers; a style that isn't known looks like a paragraph."""
    table = F.create_map(*[F.lit(x) for name, look in STYLES.items() for x in (name, value(*look))])
    return F.coalesce(F.try_element_at(table, F.col("style")), F.lit(value(*STYLES["paragraph"])))


def _run_xml(r: Column) -> Column:
    marks = F.concat(F.when(F.coalesce(r["bold"], F.lit(False)) | F.col("_bold"), "<w:b/>").otherwise(""), F.when(F.coalesce(r["italics"], F.lit(False)) | (F.col("style") == "note"), "<w:i/>").otherwise(""))
    lines = F.replace(T.escape_xml(r["text"]), F.lit("\n"), F.lit(f"</w:t><w:br/>{_TEXT}"))
    return _around(f"<w:r><w:rPr>{_LOOK}\n{_COLOR}\n{_TEXT}\n</w:t></w:r>", marks, F.col("_size"), lines)


def paragraph_xml(rows: DataFrame, image: str = "") -> DataFrame:
    """Layout rows with runs as opening, entry and rest, the three pieces of each row's paragraph.

    The entry is a heading's hidden one for the table of contents, which counts after the page of contents; no row has a heading style.
    """
    sized = lambda size, align, bold, line, above, after, left, first: f'<w:sz w:val="{size}"/></w:rPr>'
    spaced = lambda size, align, bold, line, above, after, left, first: f'" w:line="{line}" w:lineRule="auto" w:after="{after}"/><w:ind w:left="{left}" w:firstLine="{first}"/><w:jc w:val="{align}"/></w:pPr>'
    df = rows.withColumns({"_size": _of_style(sized), "_bold": _of_style(lambda *look: look[2])}).withColumn("_said", F.when(F.col("style").isin(*LEVELS), T.trim(F.col("text"))))
    above = F.coalesce(F.col("before").cast("string"), _of_style(lambda *look: str(look[4])))
    body = F.when(F.col("style") == "toc", _around(_field("\n"), F.col("text"))).when(F.col("style") == "logo", image).otherwise(F.array_join(F.transform("runs", _run_xml), ""))
    levels = F.create_map(*[F.lit(x) for name, level in LEVELS.items() for x in (name, str(level))])
    entry = F.when(F.col("_said") != "", _around(_field("TC &quot;\n&quot; \\l \n", hidden=True), T.escape_xml(F.col("_said")), F.try_element_at(levels, F.col("style")))).otherwise("")
    page = F.col("style") == "pageBreak"
    opening = F.when(page, '<w:p><w:r><w:br w:type="page"/></w:r></w:p>').otherwise(_around('<w:p><w:pPr><w:spacing w:before="\n\n', above, _of_style(spaced)))
    return df.select(*rows.columns, opening.alias("opening"), entry.alias("entry"), F.when(page, "").otherwise(F.concat(body, F.lit("</w:p>"))).alias("rest"))


#: Size of the logo in pixels, and English metric units of a pixel.
LOGO_SIZE = (170, 62)
_PIXEL = 9525


def _image(width: int, height: int) -> str:
    """A run that shows the image of relationship rId3."""
    size = f'cx="{width * _PIXEL}" cy="{height * _PIXEL}"'
    drawn = "http://schemas.openxmlformats.org/drawingml/2006"
    shape = f'<pic:pic xmlns:pic="{drawn}/picture"><pic:nvPicPr><pic:cNvPr id="1" name="logo"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="rId3"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext {size}/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic>'
    return f'<w:r><w:drawing><wp:inline xmlns:wp="{drawn}/wordprocessingDrawing"><wp:extent {size}/><wp:docPr id="1" name="logo" descr="{V.INSTITUTION}"/><a:graphic xmlns:a="{drawn}/main"><a:graphicData uri="{drawn}/picture">{shape}</a:graphicData></a:graphic></wp:inline></w:drawing></w:r>'


#: Properties of a file, and the size of its page numbers in half points.
CREATOR = "Lexmill"
UNTITLED = "Trabalho acadêmico"
DESCRIPTION = "Documento acadêmico gerado conforme as regras do manual."
NUMBER_SIZE = 22

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_DECL = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_CORE = 'xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"'
_CORE_TYPE = "application/vnd.openxmlformats-package.core-properties+xml"
_CORE_REL = "http://schemas.openxmlformats.org/package/2006/relationships/metadata/core-properties"
_WORD = "application/vnd.openxmlformats-officedocument.wordprocessingml"


def _section(start: int | None) -> str:
    top, right, bottom, left = MARGINS
    header = '<w:headerReference w:type="default" r:id="rId1"/>' if start else ""
    number = f'<w:pgNumType w:start="{start}"/>' if start else ""
    return f'<w:sectPr>{header}<w:pgSz w:w="{PAGE[0]}" w:h="{PAGE[1]}"/><w:pgMar w:top="{top}" w:right="{right}" w:bottom="{bottom}" w:left="{left}" w:header="1134" w:footer="1134"/>{number}</w:sectPr>'


def docx_bytes(front: str, body: str, start: int, logo: bytes | None = None, title: str | None = None, creator: str = CREATOR) -> bytes:
    """A Word file of paragraphs: an unnumbered front section and a body section numbered from ``start``.

    ``logo`` is a PNG or JPEG file for the place that ``layout_rows`` left for it. ``title`` and ``creator`` are properties of
    the file; without a title the default one stands there.
    """
    document = f"{_DECL}<w:document {_NS}><w:body>{front}<w:p><w:pPr>{_section(None)}</w:pPr></w:p>{body}{_section(start)}</w:body></w:document>"
    files = {
        "[Content_Types].xml": f'{_DECL}<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{_WORD}.document.main+xml"/><Override PartName="/word/header1.xml" ContentType="{_WORD}.header+xml"/><Override PartName="/word/settings.xml" ContentType="{_WORD}.settings+xml"/><Override PartName="/docProps/core.xml" ContentType="{_CORE_TYPE}"/></Types>',
        "_rels/.rels": f'{_DECL}<Relationships xmlns="{_RELS}"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="word/document.xml"/><Relationship Id="rId2" Type="{_CORE_REL}" Target="docProps/core.xml"/></Relationships>',
        "word/document.xml": document,
        "word/_rels/document.xml.rels": f'{_DECL}<Relationships xmlns="{_RELS}"><Relationship Id="rId1" Type="{_OFFICE}/header" Target="header1.xml"/><Relationship Id="rId2" Type="{_OFFICE}/settings" Target="settings.xml"/></Relationships>',
        "word/header1.xml": f'{_DECL}<w:hdr {_NS}><w:p><w:pPr><w:jc w:val="right"/></w:pPr>{_field("PAGE", size=NUMBER_SIZE)}</w:p></w:hdr>',
        "docProps/core.xml": f'{_DECL}<cp:coreProperties {_CORE}><dc:title>{_xml(title or UNTITLED)}</dc:title><dc:creator>{_xml(creator)}</dc:creator><dc:description>{DESCRIPTION}</dc:description></cp:coreProperties>',
        "word/settings.xml": f'{_DECL}<w:settings {_NS}><w:updateFields w:val="true"/></w:settings>',
    }
    files = {name: data.encode() for name, data in files.items()}
    if logo:
        kind = "png" if logo.startswith(b"\x89PNG") else "jpeg"
        files[f"word/media/logo.{kind}"] = logo
        for name, end, more in (("[Content_Types].xml", b"</Types>", f'<Default Extension="{kind}" ContentType="image/{kind}"/>'), ("word/_rels/document.xml.rels", b"</Relationships>", f'<Relationship Id="rId3" Type="{_OFFICE}/image" Target="media/logo.{kind}"/>')):
            files[name] = files[name].replace(end, more.encode() + end)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            # a fixed time keeps equal rows equal bytes
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def render(rows: DataFrame, logo: bytes | None = None, logo_size: tuple[int, int] = LOGO_SIZE, titles: DataFrame | None = None, creator: str = CREATOR) -> DataFrame:
    """doc_id, docx: one Word file per document of layout rows with runs; ``titles`` (doc_id, title) name the files inside.

    Paragraphs are columns; Python gets two texts a document and writes its archive.
    """
    made = paragraph_xml(rows, _image(*logo_size) if logo else "")
    packed = F.array_sort(F.collect_list(F.struct("seq", "part", "opening", "entry", "rest")))
    # headings up to the page of contents have no entry there
    docs = made.groupBy("doc_id").agg(F.max("start_page").alias("start_page"), F.min(F.when(F.col("style") == "note", F.col("seq"))).alias("noted"), packed.alias("rows"))
    # titles are as many as documents, however few bytes the plan expects of them: merged, never gathered at the driver
    docs = docs.withColumn("title", F.lit(None).cast("string")) if titles is None else docs.join(titles.select("doc_id", "title").hint("merge"), "doc_id", "left")
    paragraph = lambda r: F.concat(r["opening"], F.when(r["seq"] > F.col("noted"), r["entry"]).otherwise(""), r["rest"])
    of = lambda front: F.array_join(F.transform(F.filter("rows", lambda r: (r["part"] == "front") == front), paragraph), "")

    def write(batches):
        for b in batches:
            made = [docx_bytes(front, body, int(start), logo, title, creator) for front, body, start, title in zip(b["front"], b["body"], b["start_page"], b["title"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "docx": made})

    return docs.select("doc_id", "start_page", "title", of(F.lit(True)).alias("front"), of(F.lit(False)).alias("body")).mapInPandas(write, "doc_id long, docx binary")
