import io
import zipfile

from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import blocks as B
from lexmill.operators import fields as D
from lexmill.operators import layout as L
from lexmill.operators import merge as M
from lexmill.operators import validation as W
from lexmill.sources import packages, readers, writers

WORK = """Autor:
Maria da Silva
Título: Estudo do cerrado
Lavras - MG
2021
Tese apresentada à Universidade X, Programa de Pós-Graduação em Ecologia, para obtenção do título de doutor
Orientador
João Souza
APÊNDICES
RESUMO
Linha um.
Palavras-chave: solo; rio.
ABSTRACT
Line one.
Keywords: soil.
1 INTRODUÇÃO
Texto.
1.1.1 Sub
Mais texto
2 MÉTODOS
M
CONCLUSÃO
Fim.
REFERÊNCIAS
PEREIRA, Ana. Solos do cerrado: manejo. Recife: Editora Sol, 2010.
ANEXO A
anexo
APÊNDICE A
apêndice"""


def _fields(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return D.detect_fields(B.text_blocks(docs), 2026)


def test_text_functions(spark):
    row = spark.range(1).select(
        T.fold_upper(F.lit(" Ção – ß  é̀ ø")).alias("upper"), T.fold_lower(F.lit("ÁÉ Ü")).alias("lower"), T.decode_xml(F.lit("a &#233; &#x1F600; &amp;lt;")).alias("xml"),
        T.strip_trailing_data(F.lit("Obra. 2018. 90 p.")).alias("title"), T.cm_to_twip(F.lit(3.0)).alias("twip"), T.safe_file_name(F.lit("Ação & Cia")).alias("name"),
        T.clean_text(F.lit("a  \n  b\t\tc ")).alias("kept"), T.is_year(F.lit(" 1999 ")).alias("year"), T.mime_type(F.lit("JPG")).alias("mime"), T.strip_block_marker(F.lit("[ref] x")).alias("plain"),
        T.mark_lines(F.lit("a\n# b"), 1, 1, "> ").alias("marked"),
    ).first()
    assert row.asDict() == {"upper": "CAO - SS E Ø", "lower": "ae u", "xml": "a é 😀 &lt;", "title": "Obra", "twip": 1701, "name": "acao-cia.docx", "kept": "a\nb c", "year": True, "mime": "image/jpeg", "plain": "x", "marked": "a\n> b"}


def test_fields_of_a_text(spark):
    r = _fields(spark, WORK).first()
    expected = {
        "work_type": "tese", "author": "Maria da Silva", "title": "Estudo do cerrado", "location": "Lavras - MG", "year": "2021", "advisor": "João Souza", "program": "Ecologia",
        "resumo": "Linha um.", "palavrasChave": "solo; rio.", "abstractText": "Line one.", "keywords": "soil.", "introducao": "Texto.\n1.1.1 Sub\nMais texto", "conclusao": "Fim.",
        "referencias": "PEREIRA, Ana. Solos do cerrado: manejo. Recife: Editora Sol, 2010.", "anexos": "anexo", "apendices": "apêndice", "dedicatoria": "",
    }
    assert {k: r[k] for k in expected} == expected
    assert r.confidence["author"] == "alta" and r.confidence["year"] == "alta" and r.confidence["advisor"] == "media" and r.confidence["epigrafe"] == "nao-identificado"
    assert r.editor_text.startswith("# 1 INTRODUÇÃO\n\nTexto.\n\n# 1.1.1 Sub")


def test_empty_and_null_texts(spark):
    for text in (None, "", "  \n "):
        r = _fields(spark, text).first()
        assert r.author == "" and r.year == "2026" and r.confidence["year"] == "baixa"


def test_appendix_in_contents_is_not_one(spark):
    r = _fields(spark, "SUMÁRIO\nAPÊNDICES\n1 INTRODUÇÃO\nx\nREFERÊNCIAS\nUma obra").first()
    assert r.apendices == "" and r.referencias == "Uma obra"


def test_sections_carry_forward_whatever_the_partitioning(spark):
    docs = spark.createDataFrame([(1, WORK)], "doc_id long, text string")
    rows = B.exploded(B.text_blocks(docs)).repartition(7)
    found = [r.section for r in B.carry_sections(rows).orderBy("block_idx").collect()]
    assert found[0] == "pre-textual" and found[8] == "post-textual" and found[15] == "textual" and found[-1] == "post-textual"


def test_validation_order_and_blocking(spark):
    issues = W.work_issues(_fields(spark, "só um texto"))
    rows = W.with_messages(issues).orderBy("ordinal").collect()
    assert [r.code for r in rows] == ["work-type-required", "title-required", "resumo-required", "references-required", "intro-required", "abstract-recommended"]
    assert all(r.message for r in rows)
    assert W.blocking(issues).first().blocking


def test_quotes_and_captions(spark):
    long = "palavra " * 60 + "(SILVA, 2010)"
    rows = spark.createDataFrame([(long,), ("> " + long,), ("![x](y)",), ("![x](y) Figura 1",)], "t string")
    found = rows.select(W.unmarked_long_quote(F.col("t")), W.image_without_caption(F.col("t"))).collect()
    assert [tuple(r) for r in found] == [(True, False), (False, False), (False, True), (False, False)]


def test_merge_and_edit(spark):
    now = _fields(spark, "Autor: Ana Souza")
    new = _fields(spark, WORK)
    merged = M.import_merge(now, new)
    r = merged.first()
    # the first text has no year or title of its own but for the label line that its cover begins with
    old, other = now.first(), new.first()
    assert r.author == "Ana Souza" and r.title == (old.title or other.title) and r.resumo == "Linha um." and r.work_type == "tese"
    assert r.confidence["author"] == other.confidence["author"] and r.confidence["epigrafe"] == "nao-identificado"
    edited = M.manual_edits(merged, spark.createDataFrame([(1, "epigrafe", "verso")], "doc_id long, field string, value string")).first()
    assert edited.epigrafe == "verso" and edited.confidence["epigrafe"] == "baixa"


def test_editor_lines(spark):
    works = spark.createDataFrame([(1, "# A\n## B\n### C\n\n> D\n[REF] E\nF")], "doc_id long, editor_text string")
    assert [(r.type, r.text) for r in L.editor_blocks(works).orderBy("idx").collect()] == [("heading1", "A"), ("heading2", "B"), ("heading3", "C"), ("longQuote", "D"), ("reference", "E"), ("paragraph", "F")]


def test_start_page(spark):
    def page(**fields):
        base = dict.fromkeys(("dedicatoria", "agradecimentos", "epigrafe", "indicadoresImpacto", "impactIndicators", "work_type"), "") | fields
        return spark.createDataFrame([base]).withColumn("has_summary", F.lit(True)).select(L.start_page()).first()[0]

    assert page(work_type="artigo") == 5
    assert page(work_type="dissertacao") == 7


def test_rendered_file_reads_back(spark, tmp_path):
    files = writers.rendered(_fields(spark, WORK), 2026)
    row = files.first()
    with zipfile.ZipFile(io.BytesIO(row.docx)) as z:
        xml = z.read("word/document.xml").decode()
    assert "TC &quot;1 INTRODUÇÃO&quot; \\l 1" in xml and "TOC \\f \\h \\z" in xml and 'w:left="1701"' in xml and "Heading1" not in xml
    assert "TC &quot;REFERÊNCIAS&quot; \\l 1" in xml and "TC &quot;RESUMO" not in xml and "ESTUDO DO CERRADO" in xml and "Orientador(a): João Souza" in xml
    assert 'w:before="2200"' in xml and xml.count('w:br w:type="page"') >= 8 and 'w:before="240" w:line="360" w:lineRule="auto" w:after="180"' in xml
    (tmp_path / "a.docx").write_bytes(row.docx)
    (tmp_path / "b.docx").write_bytes(b"not a zip")
    (tmp_path / "c.pdf").write_bytes(b"x")
    (tmp_path / "d.md").write_text(WORK)
    found = readers.files(spark, f"file://{tmp_path}")
    assert sorted(r.reason for r in readers.rejected(found).collect()) == ["unreadable archive: BadZipFile", "unsupported format"]
    texts = {r.kind: r.text for r in readers.documents(found).collect()}
    assert texts["md"] == WORK and "Solos do cerrado: manejo" in texts["docx"]


def test_files_are_written_and_named(spark, tmp_path):
    """As a table and one by one; the page number's look, title and description stand in each file."""
    works = _fields(spark, WORK)
    files = writers.rendered(works, 2026).cache()
    writers.write_table(files, f"file://{tmp_path}/table")
    assert [tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/table").collect()] == [tuple(r) for r in files.collect()]
    assert writers.write_files(files, f"file://{tmp_path}/single/") == files.count() == 1
    row = files.first()
    data = (tmp_path / "single" / f"{row.doc_id}-{row.file_name}").read_bytes()
    assert data == bytes(row.docx)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        header, core, types = (z.read(n).decode() for n in ("word/header1.xml", "docProps/core.xml", "[Content_Types].xml"))
    assert header.count('<w:sz w:val="22"/>') == 4 and 'w:ascii="Times New Roman"' in header and 'w:val="right"' in header and "core-properties" in types
    assert f"<dc:title>{works.first().title}</dc:title>" in core and f"<dc:creator>{L.CREATOR}</dc:creator>" in core and "<dc:description>" in core


def test_media_are_kept_once_by_content(spark):
    """Equal bytes are one part; relationships to other things, media without one and odd names stay."""
    rels = '<Relationships><Relationship Id="a" Target="media/1.PNG"/><Relationship Id="b" Target="media/2.png"/><Relationship Id="s" Target="styles.xml"/><Relationship Id="gone" Target="media/9.png"/><Relationship Id="q&amp;" Target="media/x"/></Relationships>'
    parts = spark.createDataFrame([(1, "<w:document/>", None, rels, None), (2, "<w:document/>", "<w:styles/>", None, "<w:numbering/>")], "doc_id long, document_xml string, styles_xml string, rels_xml string, numbering_xml string")
    media = spark.createDataFrame([(1, "media/1.PNG", b"same"), (1, "media/2.png", b"same"), (1, "media/x", b"odd"), (1, "media/free.gif", b"")], "doc_id long, target string, data binary")
    made = packages.packed(packages.readdressed(parts, media)).select("doc_id", F.lit("docx").alias("kind"), F.lit("p").alias("path"), F.col("docx").alias("content"))
    read = readers.docx_parts(made)
    assert {r.doc_id: (r.error, r.has_numbering, len(r.media)) for r in read.collect()} == {1: (None, False, 3), 2: (None, True, 0)}
    led = {(r.rel_id, bytes(r.data)) for r in packages.links(read, readers.docx_media(made)).collect()}
    assert led == {("a", b"same"), ("b", b"same"), ("q&amp;", b"odd"), (None, b"")}
    assert 'Target="styles.xml"' in read.where("doc_id = 1").first().rels_xml
    assert packages.package("<a/>", None, None, None, []) == packages.package("<a/>", None, None, None, [])


def test_word_parts(spark):
    xml = (
        '<w:body><w:p><w:pPr><w:pStyle w:val="T1"/></w:pPr><w:r><w:t>Obra</w:t></w:r></w:p>'
        '<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r><w:r><w:drawing r:embed="r1"/></w:r><w:r><w:br w:type="page"/></w:r></w:p>'
        '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body>'
    )
    styles = '<w:style w:styleId="T1"><w:name w:val="Heading 2"/></w:style>'
    rels = '<Relationship Id="r1" Target="old.png"/><Relationship Id="r1" Target="media/a.png"/>'
    parts = spark.createDataFrame([(1, xml, styles, rels, False)], "doc_id long, document_xml string, styles_xml string, rels_xml string, has_numbering boolean")
    r = B.docx_blocks(parts).first()
    assert [(b.block_type, b.level, b.text) for b in r.blocks] == [("heading", 2, "Obra"), ("paragraph", None, "a b"), ("image", None, None), ("pageBreak", None, None), ("table", None, None)]
    assert r.text == "Obra\na b\n[Imagem detectada: r1]\nx"


def test_file_stream(spark, tmp_path):
    from lexmill.streaming.files import field_stream, reference_stream, text_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(WORK)
    texts = text_stream(spark, f"file://{tmp_path}/in")
    for name, frame in (("fields", field_stream(texts, 2026)), ("refs", reference_stream(texts, 2026))):
        frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("fields").first().author == "Maria da Silva"
    assert spark.table("refs").first().ref_type == "livro"


def test_parsed_texts_of_a_rendered_file(spark):
    """The layout's order: name of the institution, cover, title page, pages before the text, body, references."""
    rows = [(r.style, r.text) for r in L.layout_rows(_fields(spark, WORK), 2026).orderBy("seq").collect()]
    assert rows[0] == ("coverBold", "UNIVERSIDADE FEDERAL DE LAVRAS") and rows[4] == ("coverBold", "ESTUDO DO CERRADO")
    titles = [t for s, t in rows if s in ("sectionTitle", "title", "heading1")]
    assert titles[:5] == ["FICHA CATALOGRÁFICA", "RESUMO", "ABSTRACT", "INDICADORES DE IMPACTO", "IMPACT INDICATORS"] and titles[5:7] == ["SUMÁRIO", "1 INTRODUÇÃO"] and titles[-3:] == ["REFERÊNCIAS", "ANEXOS", "APÊNDICES"]
    at = rows.index(("heading1", "1 INTRODUÇÃO"))
    assert rows[at - 1][0] == "note" and all(rows[k - 1][0] == "pageBreak" for k, r in enumerate(rows) if r[0] in ("heading1", "sectionTitle") and k > at)


def test_logo_stands_on_the_cover(spark):
    logo = b"\x89PNG\r\n\x1a\nnot really"
    row = writers.rendered(_fields(spark, WORK), 2026, logo).first()
    with zipfile.ZipFile(io.BytesIO(row.docx)) as z:
        assert z.read("word/media/logo.png") == logo and "image/png" in z.read("[Content_Types].xml").decode()
        xml = z.read("word/document.xml").decode()
    assert 'r:embed="rId3"' in xml and "UNIVERSIDADE FEDERAL DE LAVRAS</w:t>" not in xml


def test_damaged_archives_are_rejected(spark):
    """Whatever bytes of a Word file change, reading it gives parts or an error."""
    import random

    row = writers.rendered(_fields(spark, WORK), 2026).first()
    rng, seen = random.Random(3), set()
    for _ in range(400):
        data = bytearray(row.docx)
        for _ in range(3):
            data[rng.randrange(len(data))] ^= 1 << rng.randrange(8)
        seen.add(readers.unzip(bytes(data))["error"])
    assert any(e and "error" in e for e in seen)


def test_only_lines_that_fold_to_headings_are_folded(spark):
    texts = ["resumo", " Resumo ", "rESUMO E MAIS", "INTRODUÇÃO", "Introduc\u0327a\u0303o", "anexos", "Âpêndices", "ABSTRACT", "1 x", "1.1 y", "1.1.1 z", "12", "Referências", "a", "Ⅰ RESUMO", "\u0301RESUMO", "– RESUMO", "Zebra", "- ANEXOS"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.blocks[0].block_type == "heading" for r in B.text_blocks(rows).collect()}
    expected = {r.doc_id: r.h for r in rows.select("doc_id", B.is_text_heading(T.fold_upper(F.col("text"))).alias("h")).collect()}
    assert found == expected and sum(expected.values()) >= 9


def test_selections(spark):
    row = spark.createDataFrame([("# a\n\nb *c*\nd",)], "x string").select(
        T.mark_lines(F.col("x"), 0, 2, "> ").alias("quoted"), T.clear_lines(F.col("x"), 0, 2).alias("cleared"), T.wrap_selection(F.col("x"), F.lit(2), F.lit(3), "**").alias("bold"), T.wrap_selection(F.col("x"), F.lit(0), F.lit(0), "*").alias("none"),
        F.struct(*T.selected_lines(F.col("x"), F.lit(4), F.lit(6))).alias("lines"),
    ).first()
    assert (row.quoted, row.cleared, row.bold, row.none, tuple(row.lines)) == ("> a\n\n> b *c*\nd", "a\n\nb c\nd", "# **a**\n\nb *c*\nd", "**# a\n\nb *c*\nd", (1, 2))
