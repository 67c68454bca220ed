"""Fields of an academic document, found in its blocks.

Per document everything is a higher-order function over one array of annotated blocks (``annotated``): sections are
ranges between a start and the first stop after it, cover values are first matches. No shuffle, whatever the
number of sections.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions import values as V
from lexmill.operators.blocks import block_text

_NEVER = 1 << 30


def annotated(docs: DataFrame) -> DataFrame:
    """``docs`` (blocks) with ``marks``: for each block its place, type, level, text, and the cleaned and folded forms of the text."""
    said = F.transform(F.transform("blocks", block_text), T.line_forms)
    full = lambda b, k, f: F.struct(k.alias("i"), b["block_type"].alias("type"), b["level"].alias("level"), b["text"].alias("own"), *[f[c].alias(c) for c in ("text", "line", "norm")], T.line_base(f["norm"]).alias("base"))
    return docs.withColumn("marks", T.let(said, lambda forms: F.transform("blocks", lambda b, k: full(b, k, F.get(forms, k)))))


def is_references(m: Column) -> Column:
    return m["base"] == "REFERENCIAS"


def is_annex(m: Column) -> Column:
    return (m["base"] == "ANEXOS") | (F.startswith(m["base"], F.lit("ANEXO")) & m["base"].rlike(r"^ANEXO\s+[A-Z0-9]"))


def is_appendix(m: Column) -> Column:
    return (m["base"] == "APENDICES") | (F.startswith(m["base"], F.lit("APENDICE")) & m["base"].rlike(r"^APENDICE\s+[A-Z0-9]"))


def is_introduction(m: Column) -> Column:
    return m["base"] == "INTRODUCAO"


def is_primary(m: Column) -> Column:
    # a line that leads with a number differs from its base; no other is tried
    return ((m["type"] == "heading") & (m["level"] <= 1)) | ((m["norm"] != m["base"]) & m["norm"].rlike(r"^\d+\s+\S+")) | m["base"].isin(*V.UNNUMBERED_HEADINGS)


def first(marks: Column, test) -> Column:
    """The place of the first mark that passes, null if none does."""
    return F.try_element_at(F.filter(marks, test), F.lit(1))["i"]


def span(marks: Column, start: Column, stop) -> Column:
    """The text after ``start`` up to the first mark that stops it; empty without a start."""
    inside = lambda after, end: F.array_join(F.transform(F.filter(after, lambda m: (m["i"] < end) & (m["text"] != "")), lambda m: m["line"]), "\n")
    said = lambda at: T.let(F.filter(marks, lambda m: m["i"] > at), lambda after: T.let(F.coalesce(first(after, stop), F.lit(_NEVER)), lambda end: inside(after, end)))
    return T.let(start, lambda at: F.when(at.isNull(), "").otherwise(said(at)))


def label_value(text: Column, key: str) -> Column:
    """The value after a field's label at the start of a line; an empty one takes the next non-blank line."""
    return T.clean(F.regexp_extract(text, rf"(?imu)^\s*(?:{V.LABELS[key]})\s*[:\-]\s*(.+)$", 1))


def work_type(folded: Column) -> Column:
    return F.when(folded.rlike(r"\bTESE\b"), "tese").when(folded.rlike(r"\bDISSERTACAO\b"), "dissertacao").when(folded.rlike(r"\bMONOGRAFIA\b|\bTCC\b"), "monografia").when(folded.rlike(r"\bARTIGO\b"), "artigo").otherwise("")


def cover_lines(marks: Column) -> Column:
    """Text lines before the first page break, or of the first blocks; images left out."""
    shown = lambda m, end: (m["i"] < end) & (m["text"] != "") & ~F.startswith(m["text"], F.lit("[Imagem detectada"))
    inside = lambda end: F.filter(marks, lambda m: shown(m, end))
    return T.let(F.coalesce(first(marks, lambda m: m["type"] == "pageBreak"), F.lit(V.COVER_BLOCKS)), lambda end: F.transform(inside(end), lambda m, k: F.struct(k.alias("i"), m["text"].alias("text"), m["norm"].alias("norm"))))


def is_author_name(x: Column, folded: Column) -> Column:
    terms = "|".join(rf"\Q{t}\E" for t in V.INSTITUTIONAL_TERMS)
    words = F.size(F.filter(F.split(T.clean(x), " "), lambda w: w != ""))
    # the cheap tests go first; a year has digits
    usual = ~T.is_generic_cover_line(folded) & F.contains(folded, F.lit(" ")) & ~x.rlike(r"[:;]|\d") & ~T.is_location(folded) & words.between(2, 8) & ~folded.rlike(V.NOT_AN_AUTHOR) & ~F.upper(x).rlike(terms)
    return (folded == V.AUTHOR_PLACEHOLDER) | usual


def cover_year(cover: Column, as_of_year: int) -> tuple[Column, Column]:
    """(year, confidence): a labelled year, else the last one outside references and links, else ``as_of_year``."""
    out = _cover_year(cover, as_of_year)
    return out["year"], out["sure"]


def _cover_year(cover: Column, as_of_year: int) -> Column:
    """struct<year, sure> of ``cover_year``. Few lines hold a year; no other is looked at closely."""
    labelled = lambda dated: F.filter(F.transform(dated, lambda c: F.regexp_extract(c["text"], r"(?i)^\s*ano\s*[:\-]\s*((?:19|20)\d{2})\s*$", 1)), lambda y: y != "")
    safe = lambda dated: F.filter(dated, lambda c: ~c["text"].rlike(rf"(?iu){T.AB}{V.UNSAFE_YEAR}{T.AB}"))
    years = lambda c: F.transform(F.regexp_extract_all(c["text"], F.lit(rf"{T.AB}((?:19|20)\d{{2}}){T.AB}"), F.lit(1)), lambda y: F.struct(y.alias("year"), (T.trim(c["text"]) == y).alias("whole")))
    found = lambda dated: F.struct(F.try_element_at(labelled(dated), F.lit(1)).alias("label"), F.try_element_at(F.flatten(F.transform(safe(dated), years)), F.lit(-1)).alias("last"))
    judged = lambda f: F.struct(F.coalesce(f["label"], f["last"]["year"], F.lit(str(as_of_year))).alias("year"), F.when(f["label"].isNotNull() | f["last"]["whole"], "alta").when(f["last"].isNotNull(), "media").otherwise("baixa").alias("sure"))
    return T.let(F.filter(cover, lambda c: c["text"].rlike(r"(?:19|20)\d{2}")), lambda dated: T.let(found(dated), judged))


def occurrences(lines: Column, value: Column) -> Column:
    """How many annotated lines equal the value when folded."""
    return T.let(T.fold_upper(value), lambda folded: F.size(F.filter(lines, lambda m: m["norm"] == folded)))


def cover_author(cover: Column) -> Column:
    # once a name is found, no later line is tested
    seen = F.aggregate(cover, F.lit(None).cast("string"), lambda name, c: F.when(name.isNotNull(), name).when(is_author_name(c["text"], c["norm"]), c["text"]))
    return F.coalesce(seen, F.lit(""))


def cover_title(cover: Column, author: Column) -> Column:
    """The cover's lines after the author's up to a place or year, generic ones left out."""
    place = lambda folded: F.coalesce(F.when(folded != "", F.try_element_at(F.filter(cover, lambda c: c["norm"] == folded), F.lit(1))["i"]), F.lit(-1))
    ends = lambda after: F.coalesce(first(after, lambda c: T.is_location(c["norm"]) | T.is_year(c["text"])), F.lit(_NEVER))
    inside = lambda after, end: F.filter(after, lambda c: (c["i"] < end) & ~T.is_generic_cover_line(c["norm"]))
    said = lambda after: T.let(ends(after), lambda end: T.clean(F.array_join(F.transform(inside(after, end), lambda c: c["text"]), " ")))
    return T.let(T.fold_upper(author), lambda folded: T.let(place(folded), lambda at: T.let(F.filter(cover, lambda c: c["i"] > at), said)))


def following_label(lines: Column, labels: tuple[str, ...]) -> Column:
    """The value of the first line that is one of the labels: after its colon, or the next line unless a label too."""
    inline = lambda m: reduce(or_, [F.startswith(m["norm"], F.lit(f"{x}:")) for x in labels])
    numbered = F.transform(lines, lambda m, k: F.struct(m["text"].alias("text"), m["norm"].alias("norm"), F.try_element_at(lines, k + 2)["text"].alias("next"), F.try_element_at(lines, k + 2)["base"].alias("next_base")))
    hit = F.try_element_at(F.filter(numbered, lambda m: inline(m) | (m["norm"].isin(*labels) & m["next"].isNotNull() & ~m["next_base"].isin(*labels))), F.lit(1))
    value = lambda h: F.when(inline(h), F.substring(h["text"], F.position(F.lit(":"), h["text"]) + 1, F.length(h["text"]))).otherwise(h["next"])
    return F.coalesce(T.clean(T.let(hit, value)), F.lit(""))


def _keyword_section(marks: Column, heading: str, keyword: str, lead: str, stop) -> Column:
    """struct<text, words> of a section that a keyword line closes. ``stop`` gets a mark and its place in the section; ``lead``
    is what a keyword line folds to at its start, so no other is tried."""
    words = lambda m: F.when(F.startswith(m["norm"], F.lit(lead)), F.regexp_extract(m["text"], keyword, 1)).otherwise("")
    inside = lambda at: F.filter(marks, lambda m: (m["i"] > at) & (m["text"] != ""))
    placed = lambda at: F.transform(inside(at), lambda m, k: F.struct(k.alias("i"), m["line"].alias("line"), words(m).alias("words"), ((words(m) != "") | stop(m, k)).alias("ends")))
    end = lambda p: F.try_element_at(F.filter(p, lambda x: x["ends"]), F.lit(1))
    kept = lambda p, e: F.filter(p, lambda x: x["i"] < F.coalesce(e["i"], F.lit(_NEVER)))
    closed = lambda p: T.let(end(p), lambda e: F.struct(F.array_join(F.transform(kept(p, e), lambda x: x["line"]), "\n").alias("text"), F.coalesce(T.clean(e["words"]), F.lit("")).alias("words")))
    return T.let(first(marks, lambda m: m["base"] == heading), lambda at: F.when(at.isNull(), F.struct(F.lit("").alias("text"), F.lit("").alias("words"))).otherwise(T.let(placed(at), closed)))


def _resumo(marks: Column) -> Column:
    return _keyword_section(marks, "RESUMO", r"(?i)^palavras[- ]chave\s*[:\-]\s*(.+)$", "PALAVRAS", lambda m, k: m["base"].isin("ABSTRACT", "SUMARIO") | (is_primary(m) & (k > 0)))


def _abstract(marks: Column) -> Column:
    return _keyword_section(marks, "ABSTRACT", r"(?i)^keywords\s*[:\-]\s*(.+)$", "KEYWORDS", lambda m, k: m["base"].isin("INDICADORES DE IMPACTO", "IMPACT INDICATORS", "SUMARIO", "INTRODUCAO"))


def resumo(marks: Column) -> tuple[Column, Column]:
    out = _resumo(marks)
    return out["text"], out["words"]


def abstract(marks: Column) -> tuple[Column, Column]:
    out = _abstract(marks)
    return out["text"], out["words"]


def introduction(marks: Column) -> Column:
    return span(marks, first(marks, is_introduction), lambda m: (F.startswith(m["norm"], F.lit("2")) & m["norm"].rlike(r"^2\s+\S+")) | is_references(m) | is_annex(m) | is_appendix(m))


def conclusion(marks: Column) -> Column:
    return span(marks, first(marks, lambda m: m["base"].isin(*V.CONCLUSION_HEADINGS)), is_references)


def references(marks: Column) -> Column:
    return span(marks, first(marks, is_references), lambda m: is_annex(m) | is_appendix(m))


def annexes(marks: Column) -> Column:
    return T.let(first(marks, is_references), lambda at: span(marks, first(marks, lambda m: (m["i"] > at) & is_annex(m)), is_appendix))


def appendices(marks: Column) -> Column:
    return T.let(first(marks, is_references), lambda at: span(marks, first(marks, lambda m: (m["i"] > at) & is_appendix(m)), is_annex))


def pre_textual(marks: Column, heading: str) -> Column:
    return span(marks, first(marks, lambda m: m["base"] == heading), lambda m: (m["type"] != "pageBreak") & is_primary(m) & (m["base"] != heading))


def editor_text(marks: Column) -> Column:
    """The body as marked lines: from the introduction to references, annexes or appendices."""
    line = lambda m: F.when(m["type"] == "heading", F.concat(F.when(m["level"] <= 1, "# ").otherwise("## "), m["own"])).when(m["type"] == "longQuote", F.concat(F.lit("> "), m["own"])).otherwise(m["text"])
    ends = lambda after: F.coalesce(first(after, lambda m: is_references(m) | is_annex(m) | is_appendix(m)), F.lit(_NEVER))
    inside = lambda after, end: F.filter(after, lambda m: (m["i"] < end) & (m["type"] != "pageBreak") & (m["text"] != ""))
    said = lambda after: T.let(ends(after), lambda end: T.trim(F.array_join(F.transform(inside(after, end), line), "\n\n")))
    return T.let(first(marks, is_introduction), lambda at: F.when(at.isNull(), "").otherwise(T.let(F.filter(marks, lambda m: m["i"] >= at), said)))


def detect_fields(docs: DataFrame, as_of_year: int) -> DataFrame:
    """doc_id, work_type, the 25 fields, confidence (map) and editor_text of (doc_id, text, blocks).

    Missing fields are empty strings. ``as_of_year`` is the year of works that name none.
    """
    df = annotated(docs).withColumn("lines", F.filter("marks", lambda m: m["text"] != "")).withColumn("cover", cover_lines(F.col("marks")))
    text = F.coalesce(F.nullif(F.col("text"), F.lit("")), F.array_join(F.transform("lines", lambda m: m["text"]), "\n"))
    df = df.withColumn("_text", text)
    df = df.withColumns({f"_label_{k}": label_value(F.col("_text"), k) for k in V.LABELS})
    label, marks, lines, cover = (lambda k: F.nullif(F.col(f"_label_{k}"), F.lit(""))), F.col("marks"), F.col("lines"), F.col("cover")
    df = df.withColumn("author", F.coalesce(label("author"), cover_author(cover)))
    df = df.withColumn("title", F.coalesce(label("title"), cover_title(cover, F.col("author"))))
    said = lambda m: (F.contains(m["norm"], F.lit("UNIVERSIDADE")) | F.contains(m["norm"], F.lit("TITULO"))) & m["text"].rlike(rf"(?iu){V.WORK_NATURE}")
    nature = F.coalesce(F.try_element_at(F.filter(lines, said), F.lit(1))["text"], F.lit(""))
    df = df.withColumn("workNature", nature)
    # columns of their own, as each is made once and read twice
    df = df.withColumns({"_year": _cover_year(cover, as_of_year), "_resumo": _resumo(marks), "_abstract": _abstract(marks)})
    year, year_sure, (short, words), (english, keywords) = F.col("_year.year"), F.col("_year.sure"), *[(F.col(f"{c}.text"), F.col(f"{c}.words")) for c in ("_resumo", "_abstract")]
    images = F.size(F.filter("blocks", lambda b: b["block_type"] == "image"))
    program = T.trim(F.regexp_extract("workNature", r"(?iu)programa de p[óo]s-gradua[cç][aã]o em ([^,]+)", 1))
    values = {
        "author": F.col("author"),
        "title": F.col("title"),
        "subtitle": F.col("_label_subtitle"),
        "workNature": F.col("workNature"),
        "course": F.col("_label_course"),
        "program": F.coalesce(label("program"), program),
        "advisor": F.coalesce(label("advisor"), following_label(lines, ("ORIENTADOR", "ORIENTADORA"))),
        "coadvisor": F.coalesce(label("coadvisor"), following_label(lines, ("COORIENTADOR", "COORIENTADORA"))),
        "location": F.coalesce(label("location"), F.try_element_at(F.filter(cover, lambda c: T.is_location(c["norm"])), F.lit(1))["text"], F.lit("")),
        "year": year,
        "resumo": short,
        "palavrasChave": words,
        "abstractText": english,
        "keywords": keywords,
        "introducao": introduction(marks),
        "conclusao": conclusion(marks),
        "referencias": references(marks),
        "anexos": annexes(marks),
        "apendices": appendices(marks),
        "dedicatoria": F.lit(""),
        "agradecimentos": pre_textual(marks, "AGRADECIMENTOS"),
        "epigrafe": F.lit(""),
        "indicadoresImpacto": pre_textual(marks, "INDICADORES DE IMPACTO"),
        "impactIndicators": pre_textual(marks, "IMPACT INDICATORS"),
        "imageWarnings": F.when(images > 0, F.concat(images.cast("string"), F.lit(" imagem(ns) no original; revise posição e legenda."))).otherwise(""),
    }
    repeated = lambda value: F.when(occurrences(lines, value) > 1, "alta").otherwise("media")
    sure = {
        "author": F.when(label("author").isNotNull(), "alta").otherwise(repeated(F.col("author"))),
        "title": F.when(label("title").isNotNull(), "alta").otherwise(repeated(F.col("title"))),
        "year": year_sure,
        **{k: F.lit("alta") for k in ("subtitle", "course", "resumo", "abstractText", "introducao", "referencias")},
        **{k: F.when(label(k).isNotNull(), "alta").otherwise("media") for k in ("program", "location")},
    }
    df = df.select("doc_id", work_type(T.fold_upper_text(F.col("_text"))).alias("work_type"), *[values[k].alias(k) for k in V.FIELD_KEYS], *[sure.get(k, F.lit("media")).alias(f"_sure_{k}") for k in V.FIELD_KEYS], editor_text(marks).alias("editor_text"))
    confidence = F.create_map(*[x for k in V.FIELD_KEYS for x in (F.lit(k), F.when(F.col(k) == "", "nao-identificado").otherwise(F.col(f"_sure_{k}")))])
    return df.select("doc_id", "work_type", *V.FIELD_KEYS, confidence.alias("confidence"), "editor_text")
