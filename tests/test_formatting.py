"""Style chains and marks of hand-made Word parts."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import values as V
from lexmill.operators import blocks as B
from lexmill.operators import fields as D
from lexmill.operators import formatting as FM
from lexmill.operators import layout as L
from lexmill.sources import readers


def sheet(*styles, defaults=""):
    return f"<w:styles>{defaults}{''.join(styles)}</w:styles>"


def style(name, up=None, p="", r="", kind="paragraph", default=False):
    based = f'<w:basedOn w:val="{up}"/>' if up else ""
    first = ' w:default="1"' if default else ""
    return f'<w:style w:type="{kind}"{first} w:styleId="{name}"><w:name w:val="{name} &amp; co"/>{based}<w:pPr>{p}</w:pPr><w:rPr>{r}</w:rPr></w:style>'


def files(spark, *rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, document_xml string, styles_xml string")


def document(*paragraphs):
    return f"<w:document><w:body>{''.join(paragraphs)}</w:body></w:document>"


def paragraph(*runs, p=""):
    return f"<w:p><w:pPr>{p}</w:pPr>{''.join(f'<w:r><w:rPr>{r}</w:rPr><w:t>{t}</w:t></w:r>' for r, t in runs)}</w:p>"


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 150])
def test_chains_of_any_length(spark, n):
    """Each style sets one mark of its own at the top and passes all others down."""
    styles = [style(f"s{k}", f"s{k + 1}" if k + 1 < n else None, r=f'<w:sz w:val="{10 + k}"/>' if k in (n - 1, n // 2) else "") for k in range(n)]
    found = {r.style_id: r.marks for r in FM.effective_styles(files(spark, (document(), sheet(*styles)))).collect() if r.style_id}
    assert [found[f"s{k}"].size for k in range(n)] == [10 + (n // 2 if k <= n // 2 else n - 1) for k in range(n)]


def test_circles_end(spark):
    styles = [style("a", "b", r='<w:sz w:val="30"/>'), style("b", "c", r="<w:i/>"), style("c", "a", r='<w:sz w:val="40"/><w:b/>'), style("d", "d", r="<w:u/>"), style("e", "c")]
    found = {r.style_id: r.marks for r in FM.effective_styles(files(spark, (document(), sheet(*styles)))).collect() if r.style_id}
    assert [(found[k].size, found[k].bold, found[k].italic) for k in "abc"] == [(30, True, True), (40, True, True), (40, True, True)]
    assert found["d"].underline and found["d"].size is None and (found["e"].size, found["e"].italic) == (40, True)


def test_nearest_mark_counts(spark):
    defaults = '<w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="18"/><w:rFonts w:ascii="A &amp; B"/></w:rPr></w:rPrDefault></w:docDefaults>'
    styles = sheet(style("Base", p='<w:jc w:val="both"/>', r='<w:sz w:val="30"/><w:b/>', default=True), style("Sub", "Base", r='<w:b w:val="0"/>'), style("Mark", r="<w:i/>", kind="character"), defaults=defaults)
    xml = document(
        paragraph(("", "plain"), ('<w:b/><w:sz w:val="20"/>', "direct"), ('<w:rStyle w:val="Mark"/>', "named"), p='<w:pStyle w:val="Sub"/>'),
        paragraph(("", "unknown style"), p='<w:pStyle w:val="None"/><w:jc w:val="center"/>'),
        paragraph(("", "no style")),
    )
    given = files(spark, (xml, styles))
    runs = [(r.text, r.start, r.size, r.bold, r.italic, r.font) for r in FM.run_formats(FM.paragraphs(given), given).orderBy("idx", "run_idx").collect()]
    assert runs == [
        ("plain", 0, 30, False, False, "A & B"), ("direct", 5, 20, True, False, "A & B"), ("named", 11, 30, False, True, "A & B"),
        ("unknown style", 0, 30, True, False, "A & B"), ("no style", 0, 30, True, False, "A & B"),
    ]
    rows = FM.paragraph_formats(given).orderBy("idx").collect()
    assert [(r.style_id, r.style_name, r.align, r.bold) for r in rows] == [("Sub", "Sub & co", "both", False), ("Base", "Base & co", "center", True), ("Base", "Base & co", "both", True)]


def test_parts_that_lack_or_are_empty(spark):
    """Without a sheet the format's own values count; nothing fails on nulls, empty parts, sections without margins."""
    given = files(spark, (document(paragraph(("", "x"))), None), (document(), ""), (None, None), ("", sheet(style("a", default=True), style("b", default=True))), (document(paragraph(("", "y")), "<w:sectPr/>", "<w:sectPr></w:sectPr>"), sheet()))
    rows = {r.doc_id: r for r in FM.paragraph_formats(given).collect()}
    assert set(rows) == {0, 4} and rows[0].fonts == ["Times New Roman"] and rows[0].sizes == [20] and rows[0].style_id is None
    assert {(r.doc_id, r.rule) for r in FM.breaches(FM.paragraph_formats(given)).collect()} == {(d, n) for d in (0, 4) for n in (32, 49)}
    assert [(r.doc_id, r.section, r.found) for r in FM.margin_breaches(given).collect()] == [(4, 0, "0,0,0,0")]
    standard = FM.effective_styles(given).where("style_id IS NULL and default_id IS NOT NULL").collect()
    assert [r.default_id for r in standard] == ["a"]


def test_marks_of_runs(spark):
    """Neighbours join, bold goes before italic, blanks stay outside, an asterisk or a bold style leaves no mark."""
    xml = document(
        paragraph(("<w:b/>", "um "), ('<w:b/><w:sz w:val="20"/>', " dois "), ("", "resto"), ("<w:i/><w:b/>", "x"), ("<w:i/>", "y"), ("<w:b/>", "2*3"), ("<w:b/>", " ")),
        paragraph(("", "forte"), ('<w:b w:val="0"/><w:i/>', "claro"), p='<w:pStyle w:val="Strong"/>'),
    )
    rows = FM.marked_paragraphs(files(spark, (xml, sheet(style("Strong", r="<w:b/>"))))).orderBy("idx").collect()
    assert [r.marked for r in rows] == ["**um  dois** resto**x***y*2*3 ", "forte*claro*"]


def test_marks_survive_import_edit_and_export(spark):
    """Word to blocks, to the editor's text, to layout rows, to Word: the same words are bold and italic."""
    xml = document(paragraph(("", "1 INTRODUÇÃO")), paragraph(("", "Antes "), ("<w:b/>", "forte"), ("", " e "), ("<w:i/>", "fino"), ("", " depois.")), paragraph(("<w:b/>", "tudo")))
    parts = files(spark, (xml, sheet())).select("*", F.lit("").alias("rels_xml"), F.lit(False).alias("has_numbering"))
    blocks = B.docx_blocks(parts, FM.marked_paragraphs(parts))
    assert [b.text for b in blocks.first().blocks] == ["1 INTRODUÇÃO", "Antes **forte** e *fino* depois.", "**tudo**"]
    editor = D.annotated(blocks).select("doc_id", D.editor_text(F.col("marks")).alias("editor_text"))
    assert "**forte**" in editor.first().editor_text
    works = editor.select("doc_id", "editor_text", F.lit("tese").alias("work_type"), *[F.lit("").alias(k) for k in V.FIELD_KEYS])
    made = L.render(L.layout_runs(L.layout_rows(works, 2026))).select("doc_id", F.lit("docx").alias("kind"), F.lit("x").alias("path"), F.col("docx").alias("content"))
    again = readers.docx_parts(made)
    runs = FM.run_formats(FM.paragraphs(again), again).where("text IN ('forte', 'fino', 'tudo', 'Antes ')").collect()
    assert {(r.text, r.bold, r.italic) for r in runs} == {("forte", True, False), ("fino", False, True), ("tudo", True, False), ("Antes ", False, False)}
    assert readers.docx_documents(made, marks=True).first().text.count("**forte**") == 1
