"""What keeps tasks small and the driver empty as tables grow, read off plans and partitions."""

from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import blocks as B
from lexmill.operators import formatting as FM
from lexmill.operators import layout as L
from lexmill.operators import pages as P
from lexmill.plans import catalog, inputs
from lexmill.sources import readers

SF = "/root/testdata/sf0.1"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_composed_texts_are_dealt_by_documents(spark):
    """15,000 documents of a table of one row group are eight tasks, each with its share of all."""
    rows = inputs.spark_frame(spark, SF, inputs.WORKS).groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) == 8 and sum(r["count"] for r in rows) == 15_000 and max(r["count"] for r in rows) < 2_500


def test_white_space_is_the_same_set(spark):
    """The quick class holds the characters that the plain one holds, no others."""
    chars = spark.range(0x10000).where("id NOT BETWEEN 55296 AND 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    assert chars.where(F.col("c").rlike(f"^[{T.WS}]$") != F.col("c").rlike(f"^{T.SPACE}$")).count() == 0
    assert chars.where(F.col("c").rlike(f"^{T.SPACE}$")).count() > 20


def test_pages_take_one_sort_and_lists_one_shuffle(spark):
    rows = spark.createDataFrame([(1, 4, 0, "front", "title", None, "A"), (1, 4, 1, "body", "simple", None, "Figura 1 - B")], "doc_id long, start_page int, seq int, part string, style string, before long, text string")
    paged = plan(P.paged(rows))
    assert paged.count("Exchange") == 1 and paged.count("Sort [") == 1
    lists = plan(P.with_lists(rows))
    assert lists.count("Exchange") == 1 and "Join" not in lists


def test_captions_are_folded_whatever_their_first_letters(spark):
    """The quick look at a text lets every caption through: accents, combining marks, white space and letters that fold."""
    said = ["Figura 1 - A", "\u00a0 gra\u0301fico 2: B", "GRÁFICO 2", "\u0301Tabela 3 - C", "\ufb01gura 4", "Órgão 5", "xFigura 6", "", "Texto"]
    rows = [(1, 4, k, "body", "simple", None, x) for k, x in enumerate(said)] + [(1, 4, 50, "front", "title", None, "S")]
    found = P.with_lists(spark.createDataFrame(rows, "doc_id long, start_page int, seq int, part string, style string, before long, text string"))
    entries = [r.text.split("\t")[0] for r in found.where("style = 'toc'").orderBy("seq").collect()]
    assert entries == [said[0], said[1], said[2], said[4], said[3]]


def test_sheets_are_not_sorted(spark):
    """Distinct sheets are held in a hash table; no task sorts the sheets of all its files."""
    files = spark.createDataFrame([(1, "<w:document/>", "<w:styles/>"), (2, "<w:document/>", None)], "doc_id long, document_xml string, styles_xml string")
    made = plan(FM.effective_styles(files))
    assert "SortAggregate" not in made and "Sort [" not in made


def test_files_are_rendered_once_and_never_broadcast(spark):
    """Properties come from one pass over the files, and titles are joined without gathering them at the driver."""
    made = plan(catalog.rendered_properties(spark, "/root/testdata/sf0.001"))
    assert "Broadcast" not in made and made.count("MapInPandas") == 2


def test_runs_meet_paragraphs_without_broadcast(spark):
    files = inputs.spark_frame(spark, "/root/testdata/sf0.001", inputs.STYLED_FILES)
    looks = plan(FM.paragraph_formats(files))
    assert "SortMergeJoin [doc_id" in looks and "BroadcastHashJoin [doc_id" not in looks
    for name in ("captions", "list_numbers", "package_roundtrip", "docx_text"):
        assert "Broadcast" not in plan(catalog.queries()[name](spark, "/root/testdata/sf0.001")), name


def test_quick_line_forms_are_the_plain_ones(spark):
    """Lines that skip trimming, cleaning and folding have the same forms as by the full functions."""
    said = ["", " ", "a  b", " a", "a ", "a\n", "é - b", "a b", " ", "é", "ab – c", "1.2 Dados", "12", ":x", "2", "ßÿ­", "x\u0085", "a\tb", "́", "TÍTULO", "a\x1eb", "ﬁm", "9:"]
    chars = spark.range(0x10000).where("id NOT BETWEEN 55296 AND 57343").select(F.concat(F.lit("a"), F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32"), F.lit("b")).alias("x"))
    x, rows = F.col("x"), spark.createDataFrame([(s,) for s in said], "x string").union(chars)
    form = T.line_forms(x)
    wrong = (form["text"] != T.trim(x)) | (form["line"] != T.clean(T.trim(x))) | (form["norm"] != T.fold_upper(x)) | (T.trim_line(x) != T.trim(x)) | (T.fold_line(x) != T.fold_upper(x)) | (T.line_base(T.fold_upper(x)) != T.heading_base(T.fold_upper(x)))
    assert rows.where(wrong).count() == 0
    texts = spark.createDataFrame([("\n".join(said),), ("",), ("A\r\ń\n b  c\n",)], "x string")
    assert texts.where(T.fold_upper_text(x) != T.fold_upper(x)).count() == 0


def test_fields_of_two_values_are_made_once(spark):
    """Year, abstracts and their keywords come from one search each, and no cover line without a year is searched for links."""
    made = catalog.detected_fields(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert made.count("palavras[- ]chave") <= 2 and made.count("^keywords") <= 2 and made.count("cita[c") == 1


def test_marked_runs_stay_in_their_row(spark):
    """Files meet their sheets once, never as the side that is broadcast; their runs are neither joined nor grouped."""
    files = inputs.spark_frame(spark, "/root/testdata/sf0.001", inputs.STYLED_FILES)
    made = plan(FM.marked_paragraphs(files))
    assert made.count("Join [sheet") == 1 and "BuildLeft" not in made and "Join [doc_id" not in made and "hashpartitioning(doc_id" not in made
    assert "BuildLeft" not in plan(FM.run_formats(FM.paragraphs(files), files))


def test_runs_without_marks_look_like_their_paragraph(spark):
    """A style named by a run counts, with or without other marks; a run that sets none has none."""
    xml = '<w:document><w:body><w:p><w:r><w:t>a </w:t></w:r><w:r><w:rPr><w:rStyle w:val="F"/></w:rPr><w:t>b</w:t></w:r><w:r><w:rPr><w:i/></w:rPr><w:t> c </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>*</w:t></w:r></w:p><w:p/></w:body></w:document>'
    sheet = '<w:styles><w:style w:type="character" w:styleId="F"><w:rPr><w:b/></w:rPr></w:style></w:styles>'
    rows = FM.marked_paragraphs(spark.createDataFrame([(1, xml, sheet), (2, xml, None)], "doc_id long, document_xml string, styles_xml string")).orderBy("doc_id", "idx").collect()
    assert [(r["doc_id"], r["idx"], r["marked"]) for r in rows] == [(1, 0, "a **b** *c* *"), (2, 0, "a b *c* *")]


def test_rendered_files_are_made_once_and_dealt_by_documents(spark):
    """Both readers find the same rendered files, and no join deals all files by the one style sheet that they share."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(kept, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        made = plan(catalog.rendered_formats(spark, SF))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert made.count("MapInPandas write") == 1 and made.count("ReusedExchange") >= 1
    assert "BroadcastHashJoin [sheet" in made and "SortMergeJoin [sheet" not in made and "Join [doc_id" not in made.split("MapInPandas write")[0]


def test_looks_are_those_of_paragraph_formats(spark):
    """Runs read in their paragraph's row, with or without sheets at hand: the same rows as by joins."""
    odd = '<w:document><w:body><w:p><w:t>no run</w:t></w:p><w:p><w:r><w:t> </w:t></w:r></w:p><w:p><w:r><w:tab/></w:r><w:r><w:rPr><w:rStyle w:val="F"/></w:rPr><w:t xml:space="preserve">&#65;</w:t></w:r></w:p><w:p><w:r><w:rPr><w:sz w:val="9"/></w:rPr><w:t>é</w:t></w:r><w:r><w:rPr><w:sz w:val="8"/></w:rPr><w:t></w:t></w:r></w:p></w:body></w:document>'
    sheet = '<w:styles><w:style w:type="character" w:styleId="F"><w:rPr><w:sz w:val="30"/></w:rPr></w:style></w:styles>'
    files = inputs.spark_frame(spark, "/root/testdata/sf0.001", inputs.STYLED_FILES).select("doc_id", "document_xml", "styles_xml")
    files = files.unionByName(spark.createDataFrame([(-1, odd, sheet), (-2, odd, None)], "doc_id long, document_xml string, styles_xml string"))
    looks = FM.paragraph_looks(files)
    wanted = FM.paragraph_formats(files).select(*looks.columns)
    assert looks.exceptAll(wanted).count() == 0 and wanted.exceptAll(looks).count() == 0
    given = FM.paragraph_looks(files, files.select("styles_xml").distinct())
    assert given.exceptAll(looks).count() == 0 and looks.exceptAll(given).count() == 0
    assert [(r["idx"], r["fonts"], r["sizes"]) for r in looks.where("doc_id = -1").orderBy("idx").collect()] == [(0, None, None), (2, ["Times New Roman"], [20, 30]), (3, ["Times New Roman"], [9])]


def test_quick_looks_at_xml_are_the_plain_ones(spark):
    """Bodies cut by places and texts told by their first character are those of the patterns."""
    said = ["", "x", "<w:body>a</w:body>", '<w:body x="1">a<w:body>b</w:body>c</w:body>', "</w:body><w:body>é\n</w:body>", "<w:body></w:body>z", "<w:body/>x</w:body>", "<w:bodyx>a</w:body>", "<w:body>a", "<w:body>a</w:body><w:body>b</w:body>"]
    said += [f"<w:t{tag}>{t}</w:t>" for tag in ("", ' xml:space="preserve"', "/", " x/", "ab", " <w:t") for t in ("", "a", " ", " ", "é", "&#32;", "&#65;", "&amp;", " b", " ")]
    said += ["<w:tab <w:t x/>v</w:t>", "<w:tab/>", "<w:br/>", "<w:t>a", "<w:t> <w:t>v</w:t>", "<w:t><w:t/>v</w:t>", "<w:tab <w:t>v</w:t>"]
    rows, x = spark.createDataFrame([(s,) for s in said] + [(None,)], "x string"), F.col("x")
    body = r"(?s)<w:body\b[^>]*>(.*?)</w:body>"
    plain = F.when(x.rlike(body), F.regexp_extract(x, body, 1)).otherwise(x)
    raw = B.xml_raw_text(x)
    wrong = ~B.body_xml(x).eqNullSafe(plain) | (B.says_something(x) != (T.clean_text(raw) != "")) | (B.says_something(x, "(?s).") != (raw != ""))
    assert rows.where(wrong).collect() == []


def test_entries_follow_the_page_of_contents(spark):
    """Marks, escapes, line feeds and spaces of layout rows are written as they were by Python."""
    runs = "array<struct<text:string,bold:boolean,italics:boolean>>"
    rows = [(0, "front", "heading1", 7, " A ", [(" A ", None, None)]), (1, "front", "note", None, "n", [("n", None, None)]), (2, "body", "heading2", None, ' <B> & "c" ', [("<B>", False, True), ("\n", None, None)]), (3, "body", "other", None, "d", [("d", True, None)]), (4, "body", "heading3", None, " ", []), (5, "body", "pageBreak", None, "", []), (6, "body", "toc", None, "TOC", [])]
    frame = spark.createDataFrame([(1, 5, *r) for r in rows], f"doc_id long, start_page int, seq int, part string, style string, before long, text string, runs {runs}")
    files = L.render(frame).select("doc_id", F.lit("docx").alias("kind"), F.lit("p").alias("path"), F.col("docx").alias("content"))
    xml = readers.docx_parts(files).first()["document_xml"]
    front, body = xml.split("<w:p><w:pPr><w:sectPr>")
    assert 'w:before="7" w:line="360"' in front and " TC " not in front and '<w:i/><w:color w:val="000000"/><w:sz w:val="22"/></w:rPr><w:t xml:space="preserve">n</w:t>' in front
    assert body.count(" TC &quot;") == 1 and ' TC &quot;&lt;B&gt; &amp; &quot;c&quot;&quot; \\l 2 </w:instrText>' in body
    assert '<w:b/><w:i/><w:color w:val="000000"/><w:sz w:val="24"/></w:rPr><w:t xml:space="preserve">&lt;B&gt;</w:t>' in body and '<w:t xml:space="preserve"></w:t><w:br/><w:t xml:space="preserve"></w:t>' in body
    assert 'w:firstLine="850"' in body and body.count('<w:p><w:r><w:br w:type="page"/></w:r></w:p>') == 1 and '<w:instrText xml:space="preserve"> TOC </w:instrText>' in body
    assert readers.docx_sheets(files).collect() == [("",)]
