"""Every document query by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions import values as V
from lexmill.operators import blocks as B
from lexmill.operators import captions as C
from lexmill.operators import fields as D
from lexmill.operators import formatting as FM
from lexmill.operators import layout as L
from lexmill.operators import merge as M
from lexmill.operators import models as RM
from lexmill.operators import numbering as N
from lexmill.operators import pages as P
from lexmill.operators import quotations as Q
from lexmill.operators import references as R
from lexmill.operators import summary as SM
from lexmill.operators import validation as W
from lexmill.plans import inputs
from lexmill.plans.oracle import ORACLE
from lexmill.sources import packages as K
from lexmill.sources import readers

YEAR = 2026


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _refs(spark, sf_dir):
    return R.normalized(inputs.spark_frame(spark, sf_dir, inputs.REFERENCES))


def _works(spark, sf_dir):
    return inputs.spark_frame(spark, sf_dir, inputs.WORKS)


def _marks(spark, sf_dir):
    df = D.annotated(B.text_blocks(_works(spark, sf_dir)))
    return df.withColumn("lines", F.filter("marks", lambda m: m["text"] != "")).withColumn("cover", D.cover_lines(F.col("marks")))


def _records(spark, sf_dir):
    return inputs.spark_frame(spark, sf_dir, inputs.RECORDS)


def _word_blocks(spark, sf_dir):
    return B.docx_blocks(inputs.spark_frame(spark, sf_dir, inputs.WORD_FILES))


# text functions on whole documents


def fold_upper(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.md5(T.fold_upper(F.col("text")).cast("binary")).alias("folded"))


def fold_lower(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.md5(T.fold_lower(F.col("text")).cast("binary")).alias("folded"))


def clean_values(spark, sf_dir):
    text = F.col("text")
    return _documents(spark, sf_dir).select("doc_id", F.md5(T.clean(text).cast("binary")).alias("cleaned"), F.md5(T.clean_text(text).cast("binary")).alias("kept_lines"), F.md5(T.join_lines(F.split(text, "\n")).cast("binary")).alias("joined"), F.md5(T.escape_xml(text).cast("binary")).alias("escaped"), T.has_value(text).alias("filled"))


def inline_markup(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.md5(T.strip_inline_markup(F.col("text")).cast("binary")).alias("plain"), F.md5(T.strip_block_marker(F.col("text")).cast("binary")).alias("unmarked"))


def lines_split(spark, sf_dir):
    return B.exploded(B.text_blocks(_documents(spark, sf_dir))).select("doc_id", F.col("block_idx").cast("long").alias("block_idx"), "block_type", F.col("level").cast("long").alias("level"), "text")


def long_paragraphs(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", W.unmarked_long_quote(F.col("text")).alias("long_quote"), W.image_without_caption(F.col("text")).alias("no_caption"), W.holds_secret(F.col("text")).alias("secret"))


# bibliography


def ref_split(spark, sf_dir):
    return R.split_references(_records(spark, sf_dir), "referencias").select("doc_id", F.col("ref_idx").cast("long").alias("ref_idx"), "original")


def ref_type(spark, sf_dir):
    return _refs(spark, sf_dir).select("doc_id", "ref_key", "ref_type", "confidence")


def ref_highlight(spark, sf_dir):
    return _refs(spark, sf_dir).select("doc_id", "ref_key", "text", "highlight")


def ref_warnings(spark, sf_dir):
    return _refs(spark, sf_dir).select("ref_key", F.explode_outer("warnings").alias("warning")).where("warning is not null")


def ref_runs(spark, sf_dir):
    return _refs(spark, sf_dir).select("ref_key", F.posexplode_outer("runs").alias("run_idx", "r")).where("r is not null").select("ref_key", F.col("run_idx").cast("long").alias("run_idx"), F.col("r.text").alias("text"), F.coalesce("r.bold", F.lit(False)).alias("bold"), F.coalesce("r.italics", F.lit(False)).alias("italics"))


def ref_issue_counts(spark, sf_dir):
    return R.issue_counts(_refs(spark, sf_dir)).select("doc_id", "code", "n")


def ref_models(spark, sf_dir):
    rows = RM.modelled(inputs.spark_frame(spark, sf_dir, inputs.MODEL_REFERENCES))
    return _longs(rows.drop("original").withColumn("model_warnings", F.array_join(F.array_sort("model_warnings"), " ")), "score", "lead")


# fields


def _field(make):
    return lambda spark, sf_dir: _marks(spark, sf_dir).select("doc_id", *make())


def _resumo():
    text, words = D.resumo(F.col("marks"))
    return text.alias("resumo"), words.alias("keywords")


def _abstract():
    text, words = D.abstract(F.col("marks"))
    return text.alias("abstract"), words.alias("keywords")


def _cover_year():
    year, sure = D.cover_year(F.col("cover"), YEAR)
    return year.alias("year"), sure.alias("confidence")


def _cover_author():
    author = D.cover_author(F.col("cover"))
    return author.alias("author"), F.when(author == "", 0).otherwise(D.occurrences(F.col("lines"), author)).cast("long").alias("times")


def section_carry(spark, sf_dir):
    rows = B.carry_sections(B.exploded(B.text_blocks(_works(spark, sf_dir))))
    return rows.select("doc_id", F.col("block_idx").cast("long").alias("block_idx"), "section")


def _long(found):
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("value"), F.element_at("confidence", F.lit(k)).alias("confidence")) for k in V.FIELD_KEYS])
    return found.select("doc_id", F.inline(pairs))


def detected_fields(spark, sf_dir):
    """Every field of the texts, with its confidence, in long form."""
    return _long(D.detect_fields(B.text_blocks(_works(spark, sf_dir)), YEAR))


def docx_fields(spark, sf_dir):
    """Every field of the Word files, in long form: page breaks end covers, tables and images are in sections."""
    return _long(D.detect_fields(_word_blocks(spark, sf_dir), YEAR))


# validation, merge


def work_issues(spark, sf_dir):
    return W.work_issues(_records(spark, sf_dir)).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "severity", "code", "n")


def blocking_works(spark, sf_dir):
    return W.blocking(W.work_issues(_records(spark, sf_dir)))


def issue_messages(spark, sf_dir):
    return W.with_messages(W.work_issues(_records(spark, sf_dir))).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "code", "message")


def _full_records(spark, sf_dir):
    """Records with every field, empty where the input has none."""
    records = _records(spark, sf_dir)
    return records.select("*", *[F.lit("").alias(k) for k in V.FIELD_KEYS if k not in records.columns])


def _known(cond):
    """The same confidence for every field."""
    return F.create_map(*[x for k in V.FIELD_KEYS for x in (F.lit(k), F.when(cond, "alta").otherwise("nao-identificado"))])


def import_merge(spark, sf_dir):
    """All fields of all records merged with a second version of each, gaps on either side, in long form."""
    records, key = _full_records(spark, sf_dir), F.col("doc_id")
    now = records.withColumns({"title": F.when(key % 3 == 0, "").otherwise(F.col("title")), "author": F.when(key % 3 == 1, "").otherwise(F.col("author")), "confidence": _known(key % 2 == 0)})
    new = records.withColumns({"title": F.concat(F.lit("novo "), "title"), "author": F.lit("Novo Autor"), "advisor": F.lit("Nova Orientadora"), "resumo": F.lit(""), "work_type": F.lit("tese"), "confidence": _known(key % 5 == 0)})
    merged = M.import_merge(now, new)
    return _long(merged).unionByName(merged.select("doc_id", F.lit("work_type").alias("field"), F.col("work_type").alias("value"), F.lit("-").alias("confidence")))


def manual_edits(spark, sf_dir):
    """Every record with one field edited."""
    records = _full_records(spark, sf_dir).withColumn("confidence", _known(F.col("doc_id") % 2 == 0))
    field = F.element_at(F.array(F.lit("epigrafe"), F.lit("title"), F.lit("advisor")), (F.col("doc_id") % 3 + 1).cast("int"))
    edits = records.select("doc_id", field.alias("field"), F.concat(F.lit("editado "), F.col("doc_id")).alias("value"))
    return _long(M.manual_edits(records, edits))


def editor_seed(spark, sf_dir):
    """What the editor starts with, of own, imported, introduction and title texts, each of which some records lack."""
    key = F.col("doc_id")
    texts = _records(spark, sf_dir).withColumns({"editor": F.when(key % 3 == 0, "").when(key % 3 == 1, " \n").otherwise(F.col("editor_text")), "imported": F.when(key % 2 == 0, "").otherwise(F.concat(F.lit("importado "), key))})
    return texts.select("doc_id", M.editor_seed("editor", "imported", "introducao", "title").alias("editor_text"))


def selection_edits(spark, sf_dir):
    """A selection in each editor text quoted, cleared of marks and put in bold."""
    x, start = F.col("editor_text"), (F.col("doc_id") % 7).cast("int")
    rows = _records(spark, sf_dir).select("doc_id", "editor_text", start.alias("start"), (start + F.col("doc_id") % 40).cast("int").alias("end"))
    first, last = T.selected_lines(x, F.col("start"), F.col("end"))
    rows = rows.withColumns({"first": first, "last": last})
    at = F.col("first"), F.col("last")
    return rows.select("doc_id", T.mark_lines(x, *at, "> ").alias("quoted"), T.clear_lines(x, *at).alias("cleared"), T.wrap_selection(x, F.col("start"), F.col("end"), "**").alias("bold"))


# files


def file_kinds(spark, sf_dir):
    """The documents as files of four kinds: text and Markdown are read, a Word file that is none and other kinds rejected."""
    name = F.concat(F.lit("in/"), F.col("doc_id"), F.element_at(F.array(*[F.lit(x) for x in (".txt", ".MD", ".docx", ".pdf")]), (F.col("doc_id") % 4 + 1).cast("int")))
    found = _documents(spark, sf_dir).select("doc_id", name.alias("path"), F.col("text").cast("binary").alias("content"))
    found = found.withColumn("kind", F.lower(F.substring_index("path", ".", -1)))
    read = readers.text_documents(found).select("doc_id", "kind", F.lit("text").alias("outcome"), F.size("blocks").cast("long").alias("n_blocks"))
    rejected = readers.rejected(found).select("doc_id", F.lower(F.substring_index("path", ".", -1)).alias("kind"), F.col("reason").alias("outcome"), F.lit(None).cast("long").alias("n_blocks"))
    return read.unionByName(rejected)


# layout


def editor_blocks(spark, sf_dir):
    return L.editor_blocks(_records(spark, sf_dir)).select("doc_id", F.col("idx").cast("long").alias("idx"), "type", "text")


def body_blocks(spark, sf_dir):
    made = L.body_blocks(_records(spark, sf_dir)).select("doc_id", F.posexplode("body").alias("idx", "b"))
    return made.select("doc_id", F.col("idx").cast("long").alias("idx"), "b.type", "b.text")


def ref_union(spark, sf_dir):
    return L.all_references(_records(spark, sf_dir)).select("doc_id", F.posexplode("all_refs").alias("idx", "reference")).withColumn("idx", F.col("idx").cast("long"))


def start_page(spark, sf_dir):
    works = L.with_summary(L.all_references(L.body_blocks(_records(spark, sf_dir))))
    return works.select("doc_id", "has_summary", L.start_page().cast("long").alias("start_page"))


def safe_file_name(spark, sf_dir):
    return _records(spark, sf_dir).select("doc_id", T.safe_file_name(F.col("title")).alias("file_name"))


def layout_rows(spark, sf_dir):
    return L.layout_rows(_full_records(spark, sf_dir), YEAR).withColumns({"seq": F.col("seq").cast("long"), "start_page": F.col("start_page").cast("long")})


def _rendered(spark, sf_dir):
    """Every record as a Word file."""
    records = _full_records(spark, sf_dir)
    files = L.render(L.layout_runs(layout_rows(spark, sf_dir)), titles=records.select("doc_id", "title"))
    return files.select("doc_id", F.lit("docx").alias("kind"), F.lit("made").alias("path"), F.col("docx").alias("content"))


def rendered_formats(spark, sf_dir):
    """How the paragraphs of every record's Word file look, read back."""
    # files are dealt before they are read, so that both readers find the ones that are rendered once; Python hides how its rows are
    # dealt, and files much alike pack to so few bytes that tasks cut by bytes would hold too many
    files = _as_files(_rendered(spark, sf_dir).select("doc_id", F.col("content").alias("docx")).repartition(inputs.tasks(spark, sf_dir, "customer"), "doc_id"))
    rows = FM.paragraph_looks(readers.docx_parts(files).where("error IS NULL"), readers.docx_sheets(files))
    joined = [F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("fonts", "sizes")]
    marks = ("indent", "first_line", "above", "after", "line")
    return _longs(rows.select("doc_id", "idx", *marks, "align", *joined), "idx", *marks)


def rendered_properties(spark, sf_dir):
    """Title, page numbers and sections of every record's Word file, read back."""
    parts = readers.docx_properties(_rendered(spark, sf_dir))
    got = lambda c, pattern: F.regexp_extract(c, pattern, 1)
    return parts.select(
        "doc_id", got("document_xml", r'<w:pgNumType w:start="(\d+)"').cast("long").alias("start_page"), T.decode_xml(got("core_xml", "(?s)<dc:title>(.*?)</dc:title>")).alias("title"),
        got("header_xml", r'<w:rFonts w:ascii="([^"]+)"').alias("number_font"), got("header_xml", r'<w:sz w:val="(\d+)"').cast("long").alias("number_size"), got("header_xml", r'<w:jc w:val="(\w+)"').alias("number_align"),
        F.regexp_count("document_xml", F.lit("<w:sectPr>")).cast("long").alias("sections"),
    )


def rendered_files(spark, sf_dir):
    """Every record as a Word file, read back: its paragraphs, page breaks, entries for the contents, and a digest of its text."""
    files = _rendered(spark, sf_dir)
    xml = F.col("document_xml")
    count = lambda pattern: F.regexp_count(xml, F.lit(pattern)).cast("long")
    said = F.array_join(F.regexp_extract_all(xml, F.lit('<w:t xml:space="preserve">([^<]*)</w:t>'), F.lit(1)), "")
    parts = readers.docx_parts(files)
    return parts.select("doc_id", count("<w:p>").alias("paragraphs"), count('<w:br w:type="page"/>').alias("page_breaks"), count(" TC &quot;").alias("entries"), F.md5(T.decode_xml(said).cast("binary")).alias("said"))


# Word files


def docx_blocks(spark, sf_dir):
    rows = B.exploded(_word_blocks(spark, sf_dir))
    said = B.block_text(F.struct("block_type", "text", "rows", "rel_id"))
    return rows.select("doc_id", F.col("block_idx").cast("long").alias("block_idx"), "block_type", F.col("level").cast("long").alias("level"), said.alias("text"), F.coalesce("section", F.lit("-")).alias("section"))


def docx_text(spark, sf_dir):
    return _word_blocks(spark, sf_dir).select("doc_id", "text", "has_numbering")


def image_asset_merge(spark, sf_dir):
    files = inputs.spark_frame(spark, sf_dir, inputs.WORD_FILES)
    rels = files.select("doc_id", F.explode(B.relationships(F.col("rels_xml"))).alias("rel_id", "target"))
    media = files.select("doc_id", F.explode(F.array(F.lit("media/a.png"), F.lit("media/c.webp"))).alias("target"), F.lit(None).cast("binary").alias("data"))
    return B.image_assets(rels, media).select("doc_id", "rel_id", "target", "file_name", "extension", "mime_type")


def first_images(spark, sf_dir):
    return B.first_images(B.exploded(_word_blocks(spark, sf_dir)), image_asset_merge(spark, sf_dir))


def summary_findings(spark, sf_dir):
    return SM.summary_findings(B.text_blocks(inputs.spark_frame(spark, sf_dir, inputs.SUMMARY_WORKS)))


def _caption_blocks(spark, sf_dir):
    return B.exploded(B.docx_blocks(inputs.spark_frame(spark, sf_dir, inputs.CAPTION_FILES)))


def captions(spark, sf_dir):
    return _longs(C.captioned(_caption_blocks(spark, sf_dir)), "block_idx")


def caption_breaches(spark, sf_dir):
    return _longs(C.caption_breaches(_caption_blocks(spark, sf_dir)), "block_idx", "rule")


def list_numbers(spark, sf_dir):
    rows = N.numbered(inputs.spark_frame(spark, sf_dir, inputs.NUMBERED_FILES))
    return _longs(rows.withColumnRenamed("number", "shown"), "idx", "num_id", "ilvl", "level")


def citations(spark, sf_dir):
    return _longs(Q.citations(inputs.spark_frame(spark, sf_dir, inputs.CITED_BLOCKS)), "block_idx", "nth", "start", "rule")


# packages


def _packages(spark, sf_dir):
    """Word files with media, as bytes; every other one with numbering."""
    parts = inputs.spark_frame(spark, sf_dir, inputs.CAPTION_FILES)
    media = inputs.spark_frame(spark, sf_dir, inputs.PACKAGE_MEDIA).groupBy("doc_id").agg(F.collect_list(F.struct("target", F.col("said").cast("binary").alias("data"))).alias("media"))
    numbering = F.when(F.col("doc_id") % 2 == 0, "<w:numbering/>")
    return _as_files(K.packed(parts.withColumn("numbering_xml", numbering).join(media.hint("merge"), "doc_id")))


def _as_files(made):
    return made.select("doc_id", F.lit("docx").alias("kind"), F.lit("made").alias("path"), F.col("docx").alias("content"))


def package_media(spark, sf_dir):
    """The media of every Word file, by the bytes that are in it, and whether it has numbering."""
    files = _packages(spark, sf_dir)
    parts = readers.docx_parts(files)
    rels = parts.select("doc_id", F.explode(B.relationships(F.col("rels_xml"))).alias("rel_id", "target"))
    found = B.image_assets(rels, readers.docx_media(files)).join(parts.select("doc_id", "has_numbering").hint("merge"), "doc_id")
    return found.select("doc_id", "rel_id", "target", "mime_type", F.length("data").cast("long").alias("n_bytes"), F.md5("data").alias("digest"), "has_numbering")


def package_roundtrip(spark, sf_dir):
    """Every Word file read, written with media by content, and read again: what each relationship leads to, and the tables' cells."""
    files = _packages(spark, sf_dir)
    parts = readers.docx_parts(files).drop("media").withColumn("numbering_xml", F.lit(None).cast("string"))
    again = _as_files(K.packed(K.readdressed(parts, readers.docx_media(files))))
    read = readers.docx_parts(again)
    media = K.links(read, readers.docx_media(again))
    cells = F.array_join(F.flatten(F.flatten(F.transform(F.filter(B.body_elements(B.body_xml(F.col("document_xml"))), lambda x: F.startswith(x, F.lit("<w:tbl"))), B.table_rows))), "|")
    held = read.select("doc_id", cells.alias("cells"), F.size("media").cast("long").alias("n_parts"))
    return media.join(held.hint("merge"), "doc_id").select("doc_id", "rel_id", F.md5("data").alias("digest"), "cells", "n_parts")


def imported_marks(spark, sf_dir):
    """The marks that Word runs leave in the editor's text, and the runs that the editor's text then gives."""
    rows = FM.marked_paragraphs(_styled(spark, sf_dir))
    again = F.transform(F.filter(R.merge_runs(R.marked_runs(F.col("marked"))), lambda r: F.coalesce(r["bold"], F.lit(False)) | F.coalesce(r["italics"], F.lit(False))), lambda r: r["text"])
    return _longs(rows.select("doc_id", "idx", "marked", F.array_join(again, "|").alias("marks_read")), "idx")


# pages


def _long_layout(spark, sf_dir):
    """Layout rows whose paragraphs fill pages, with titles of tables in place of quotes."""
    rows = layout_rows(spark, sf_dir)
    quote, plain = F.col("style") == "longQuote", (F.col("style") == "paragraph") & ~F.col("text").startswith("Figura")
    text = F.when(quote, F.concat(F.lit("Tabela "), F.col("doc_id"), F.lit(" - Valores"))).when(plain, F.repeat(F.concat(F.col("text"), F.lit(" ")), (F.col("doc_id") % 97 + 1).cast("int"))).otherwise(F.col("text"))
    return rows.withColumn("text", text).withColumn("style", F.when(quote, "paragraph").otherwise(F.col("style")))


def page_rows(spark, sf_dir):
    return P.paged(_long_layout(spark, sf_dir)).select("doc_id", "seq", "part", "style", "page")


def contents_pages(spark, sf_dir):
    return _longs(P.contents(P.paged(_long_layout(spark, sf_dir))), "level")


def illustration_lists(spark, sf_dir):
    return P.with_lists(_long_layout(spark, sf_dir)).select("doc_id", "seq", "start_page", "style", F.md5("text").alias("said"), "page")


# form


def _styled(spark, sf_dir):
    return inputs.spark_frame(spark, sf_dir, inputs.STYLED_FILES)


def _longs(df, *names):
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def style_sheets(spark, sf_dir):
    rows = FM.effective_styles(_styled(spark, sf_dir)).where("style_id IS NOT NULL").select("sheet", "style_id", "style_name", "marks.*")
    return _longs(rows, "indent", "first_line", "line", "size")


def run_formats(spark, sf_dir):
    files = _styled(spark, sf_dir)
    return _longs(FM.run_formats(FM.paragraphs(files), files), "idx", "run_idx", "start", "size")


def paragraph_formats(spark, sf_dir):
    rows = FM.paragraph_formats(_styled(spark, sf_dir))
    joined = [F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("fonts", "sizes", "colors")]
    return _longs(rows.select("doc_id", "idx", "style_id", "kind", "part", "indent", "first_line", "line", "line_rule", "align", "page_before", "bold", *joined), "idx", "indent", "first_line", "line")


def format_breaches(spark, sf_dir):
    files = _styled(spark, sf_dir)
    return _longs(FM.breaches(FM.paragraph_formats(files)).unionByName(FM.margin_breaches(files).withColumnRenamed("section", "idx")), "idx", "rule")


def queries() -> dict:
    plain = (
        fold_upper, fold_lower, clean_values, inline_markup, lines_split, long_paragraphs, ref_split, ref_type, ref_highlight, ref_warnings, ref_runs,
        ref_issue_counts, section_carry, detected_fields, docx_fields, work_issues, blocking_works, issue_messages, import_merge, manual_edits, editor_seed,
        selection_edits, file_kinds, first_images, editor_blocks, body_blocks, ref_union, start_page,
        safe_file_name, layout_rows, rendered_files, docx_blocks, docx_text, image_asset_merge,
        ref_models, summary_findings, captions, caption_breaches, imported_marks, list_numbers, citations, package_media, package_roundtrip, rendered_formats, rendered_properties, page_rows, contents_pages, illustration_lists, style_sheets, run_formats, paragraph_formats, format_breaches,
    )
    marks = F.col
    by_field = {
        "section_span_resumo": _resumo,
        "section_span_abstract": _abstract,
        "section_span_intro": lambda: (D.introduction(marks("marks")).alias("introduction"),),
        "section_span_conclusion": lambda: (D.conclusion(marks("marks")).alias("conclusion"),),
        "section_span_refs": lambda: (D.references(marks("marks")).alias("reference_list"),),
        "annex_after_refs": lambda: (D.annexes(marks("marks")).alias("annexes"), D.appendices(marks("marks")).alias("appendices")),
        "editor_seed_text": lambda: (D.editor_text(marks("marks")).alias("editor_text"),),
        "cover_year": _cover_year,
        "cover_author": _cover_author,
        "cover_title": lambda: (D.cover_title(marks("cover"), D.cover_author(marks("cover"))).alias("title"),),
        "label_lookup": lambda: tuple(D.label_value(marks("text"), k).alias(k) for k in V.LABELS),
        "next_line_label": lambda: (D.following_label(marks("lines"), ("ORIENTADOR", "ORIENTADORA")).alias("advisor"),),
        "work_type": lambda: (D.work_type(T.fold_upper(marks("text"))).alias("work_type"),),
    }
    return {f.__name__: f for f in plain} | {name: _field(make) for name, make in by_field.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in ORACLE.items() if name in queries()}
