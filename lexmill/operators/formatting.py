"""Effective formatting of Word text: what a run or paragraph looks like once direct marks, styles and defaults are resolved.

A mark counts from the nearest place that sets it: the run, its character style, the paragraph, its style, and for
either style what it is based on, and so on up, then the document's defaults, then the format's. A style sheet is
resolved once for all files that share it, by pointer jumping: in every round each style takes what it lacks from the
style it points to, and then points to where that one did, so a chain of n styles takes log2(n) rounds, inside one
row. A style in a circle takes each style of the circle once, itself first. The sheets' styles then are a table, joined by
sheet and style id. A style that the sheet lacks is its default style; of styles with one id the last counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions import values as V
from lexmill.operators import blocks as B
from lexmill.operators import references as R

#: Marks of paragraphs and of runs, and what the format takes where nothing sets them. Lengths are twips (line: 240ths
#: of a line if its rule is auto), sizes half points.
PARAGRAPH = {"indent": ("int", 0), "first_line": ("int", 0), "above": ("int", 0), "after": ("int", 0), "line": ("int", 240), "line_rule": ("string", "auto"), "align": ("string", "left"), "page_before": ("boolean", False)}
RUN = {"font": ("string", "Times New Roman"), "size": ("int", 20), "bold": ("boolean", False), "italic": ("boolean", False), "underline": ("boolean", False), "color": ("string", "auto")}
MARKS = PARAGRAPH | RUN


def _first(x: Column, pattern: str) -> Column:
    """The first group, null without a match."""
    return F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))


def _number(x: Column, pattern: str) -> Column:
    return _first(x, pattern).try_cast("int")


def _switch(x: Column, tag: str) -> Column:
    """A mark that is on or off, null where it isn't set."""
    return F.when(x.rlike(rf"<w:{tag}\b"), B.is_on(x, tag, "none|false|0|off" if tag == "u" else "false|0|off"))


def _part(x: Column, tag: str) -> Column:
    return F.regexp_extract(x, rf"(?s)<w:{tag}\b[^>]*(?<!/)>(.*?)</w:{tag}>", 1)


def _paragraph_part(xml: Column) -> Column:
    return F.regexp_replace(_part(xml, "pPr"), r"(?s)<w:rPr\b.*?</w:rPr>", "")


def paragraph_marks(xml: Column, part: Column | None = None) -> dict[str, Column]:
    """The marks that the w:pPr of an element's XML sets itself; ``part``: ``_paragraph_part`` of it, if it is had."""
    p = _paragraph_part(xml) if part is None else part
    hanging = -_number(p, r'<w:ind\b[^>]*\bw:hanging="(\d+)"')
    return {
        "indent": _number(p, r'<w:ind\b[^>]*\bw:(?:left|start)="(-?\d+)"'),
        "first_line": F.coalesce(hanging, _number(p, r'<w:ind\b[^>]*\bw:firstLine="(\d+)"')),
        "above": _number(p, r'<w:spacing\b[^>]*\bw:before="(\d+)"'),
        "after": _number(p, r'<w:spacing\b[^>]*\bw:after="(\d+)"'),
        "line": _number(p, r'<w:spacing\b[^>]*\bw:line="(\d+)"'),
        "line_rule": _first(p, r'<w:spacing\b[^>]*\bw:lineRule="(\w+)"'),
        "align": _first(p, r'<w:jc\b[^>]*\bw:val="(\w+)"'),
        "page_before": _switch(p, "pageBreakBefore"),
    }


def _run_part(xml: Column) -> Column:
    return _part(F.regexp_replace(xml, r"(?s)<w:pPr\b.*?</w:pPr>", ""), "rPr")


def run_marks(xml: Column, part: Column | None = None) -> dict[str, Column]:
    """The marks that the w:rPr of an element's XML sets itself, one inside a w:pPr left out; ``part``: ``_run_part`` of it, if it is had."""
    r = _run_part(xml) if part is None else part
    return {
        "font": T.decode_xml(_first(r, r'<w:rFonts\b[^>]*\bw:(?:ascii|hAnsi)="([^"]+)"')),
        "size": _number(r, r'<w:sz\b[^>]*\bw:val="(\d+)"'),
        "bold": _switch(r, "b"),
        "italic": _switch(r, "i"),
        "underline": _switch(r, "u"),
        "color": F.upper(_first(r, r'<w:color\b[^>]*\bw:val="(\w+)"')),
    }


def _struct(marks: dict[str, Column]) -> Column:
    return F.struct(*[marks[m].cast(kind).alias(m) for m, (kind, _) in MARKS.items()])


def _resolved(styles: Column) -> Column:
    """The styles (id, name, default, up, marks) with all that they inherit; ``up`` is a place in the array, from 1, or null."""

    def jump(s: Column, all_: Column) -> Column:
        above = F.get(all_, s["up"] - 1)
        marks = F.struct(*[F.coalesce(s["marks"][m], above["marks"][m]).alias(m) for m in MARKS])
        return F.struct(s["id"].alias("id"), s["name"].alias("name"), s["default"].alias("default"), above["up"].alias("up"), marks.alias("marks"))

    rounds = F.ceil(F.log2(F.greatest(F.size(styles), F.lit(2)))).cast("int")
    return F.aggregate(F.sequence(F.lit(1), rounds), styles, lambda done, _: F.transform(done, lambda s: jump(s, done)))


def effective_styles(files: DataFrame) -> DataFrame:
    """sheet, style_id, style_name, marks of every style of every distinct style sheet; null marks are set nowhere.

    sheet: the digest of styles_xml. Each sheet has a row with a null style_id, for paragraphs without a style that it knows:
    default_id (of several default styles the least), its name and marks, and in ``base`` the document defaults.
    """
    # distinct holds each sheet once in a hash table; a first sheet by digest would sort the sheets of all files
    sheets = files.select(_sheet().alias("xml")).distinct().withColumn("sheet", F.md5(F.col("xml").cast("binary")))
    tags = F.regexp_extract_all(F.col("xml"), F.lit(r"(?s)<w:style\b.*?</w:style>"), F.lit(0))
    head = lambda s: F.regexp_extract(s, r"^<w:style\b[^>]*>", 0)

    def style(s: Column) -> Column:
        return F.struct(
            _first(head(s), r'\bw:styleId="([^"]+)"').alias("id"),
            T.decode_xml(_first(s, r'<w:name\b[^>]*\bw:val="([^"]+)"')).alias("name"),
            (head(s).rlike(r'\bw:default="(?:1|true|on)"') & head(s).rlike(r'\bw:type="paragraph"')).alias("default"),
            _first(s, r'<w:basedOn\b[^>]*\bw:val="([^"]+)"').alias("based_on"),
            _struct(paragraph_marks(s) | run_marks(s)).alias("marks"),
        )

    df = sheets.withColumn("made", F.filter(F.transform(tags, style), lambda s: s["id"].isNotNull()))
    df = df.withColumn("ids", F.transform("made", lambda s: s["id"]))
    # of styles with one id the last counts, as place and as parent
    last = lambda x: F.size("ids") + 1 - F.nullif(F.array_position(F.reverse("ids"), x), F.lit(0)).cast("int")
    placed = F.transform("made", lambda s: F.struct(s["id"].alias("id"), s["name"].alias("name"), s["default"].alias("default"), last(s["based_on"]).alias("up"), s["marks"].alias("marks")))
    df = df.withColumn("placed", placed).withColumn("resolved", F.filter(_resolved(F.col("placed")), lambda s, k: last(s["id"]) == k + 1))
    defaults = _part(F.col("xml"), "docDefaults")
    df = df.withColumn("base", _struct(paragraph_marks(_part(defaults, "pPrDefault")) | run_marks(_part(defaults, "rPrDefault"))))
    df = df.withColumn("standard", F.get(F.array_sort(F.filter("resolved", lambda s: s["default"])), F.lit(0)))
    rows = F.transform("resolved", lambda s: F.struct(s["id"].alias("style_id"), F.lit(None).cast("string").alias("default_id"), s["name"].alias("style_name"), s["marks"].alias("marks"), F.lit(None).cast(df.schema["base"].dataType).alias("base")))
    none = F.struct(F.lit(None).cast("string").alias("style_id"), F.col("standard.id").alias("default_id"), F.col("standard.name").alias("style_name"), F.col("standard.marks").alias("marks"), F.col("base").alias("base"))
    return df.select("sheet", F.explode(F.concat(F.array(none), rows)).alias("s")).select("sheet", "s.*")


def _sheet() -> Column:
    return F.coalesce(F.col("styles_xml"), F.lit(""))


def _sheets(files: DataFrame) -> DataFrame:
    """s (digest), standard (default_id, default_name, default_marks, base) and known (style id to name and marks): a row for each distinct sheet."""
    styles = effective_styles(files)
    standard = F.struct("default_id", F.col("style_name").alias("default_name"), F.col("marks").alias("default_marks"), "base")
    entry = F.struct("style_id", F.struct("style_name", "marks").alias("style"))
    made = styles.groupBy(F.col("sheet").alias("s")).agg(F.first(F.when(F.col("style_id").isNull(), standard), ignorenulls=True).alias("standard"), F.collect_list(F.when(F.col("style_id").isNotNull(), entry)).alias("entries"))
    return made.select("s", "standard", F.map_from_entries("entries").alias("known"))


def _elements(files: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """doc_id, sheet, standard, known (``_sheets``), idx (place among the body's elements), xml of the paragraphs outside tables.

    Files meet their sheet before they are taken apart, once for all styles that are asked for. Every file has a sheet: the
    outer join says so to the plan, which so can never gather the files at the driver. ``sheets`` (styles_xml) holds the sheets
    of all files where they are few, as of files that one sink wrote: these are broadcast, since a shuffle by sheet would put all files into one task.
    """
    body = F.filter(F.transform(B.body_elements(B.body_xml(F.col("document_xml"))), lambda x, k: F.struct(k.alias("idx"), x.alias("xml"))), lambda e: ~F.startswith(e["xml"], F.lit("<w:tbl")))
    rows = files.select("doc_id", F.md5(_sheet().cast("binary")).alias("sheet"), body.alias("elements"))
    known = _sheets(files) if sheets is None else _sheets(sheets).hint("broadcast")
    met = rows.join(known, F.col("sheet") == F.col("s"), "left").drop("s")
    return met.select("doc_id", "sheet", "standard", "known", F.inline("elements"))


def paragraphs(files: DataFrame) -> DataFrame:
    """doc_id, sheet, idx, text, folded, style_id, style_name, level, is_quote, runs, the paragraph's marks, in ``under`` what runs inherit, and
    in ``known`` the sheet's styles by id.

    files: doc_id, document_xml, styles_xml. style_id is the style that counts, null where the sheet has no default one.
    """
    el = _elements(files).withColumn("asked", _first(F.col("xml"), r'<w:pStyle\b[^>]*\bw:val="([^"]+)"'))
    el = el.withColumn("found", F.try_element_at("known", F.col("asked"))).withColumn("base", F.col("standard.base"))
    known = F.col("found").isNotNull()
    el = el.withColumn("style_id", F.when(known, F.col("asked")).otherwise(F.col("standard.default_id"))).withColumn("style_name", F.when(known, F.col("found.style_name")).otherwise(F.col("standard.default_name")))
    el = el.withColumn("of", F.when(known, F.col("found.marks")).otherwise(F.col("standard.default_marks")))
    el = el.withColumn("raw", B.xml_raw_text(F.col("xml"))).withColumn("text", T.clean_text(F.col("raw")))
    el = el.withColumn("folded_style", T.fold_upper(F.concat_ws(" ", F.coalesce("asked", "style_id", F.lit("")), F.coalesce("style_name", F.lit(""))))).withColumn("folded", T.fold_upper(F.col("text")))
    marks = paragraph_marks(F.col("xml"))
    shown = [F.coalesce(marks[m].cast(kind), F.col("of")[m], F.col("base")[m], F.lit(plain)).alias(m) for m, (kind, plain) in PARAGRAPH.items()]
    under = F.struct(*[F.coalesce(F.col("of")[m], F.col("base")[m], F.lit(plain)).alias(m) for m, (_, plain) in RUN.items()])
    runs = F.regexp_extract_all(F.regexp_replace("xml", r"(?s)<w:pPr\b.*?</w:pPr>", ""), F.lit(r"(?s)<w:r\b.*?</w:r>"), F.lit(0))
    level = F.when(F.col("text") != "", B.heading_level(F.col("folded"), F.col("folded_style")))
    quote = B.is_long_quote(F.col("xml"), F.col("folded_style")) | _long_cited(F.col("text"))
    return el.select("doc_id", "sheet", "idx", "text", "folded", "style_id", "style_name", level.alias("level"), quote.alias("is_quote"), runs.alias("runs"), *shown, under.alias("under"), "known")


def _long_cited(text: Column) -> Column:
    """A paragraph long enough to be set off, with a citation in it."""
    return (F.length(T.trim(text)) > V.LONG_QUOTE_CHARS) & text.rlike(V.CITED)


def run_formats(found: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id, idx, run_idx, start, text and marks of every run with text; ``found``: ``paragraphs`` of ``files``.

    start: characters of the paragraph's runs before it.
    """
    rows = found.select("doc_id", "idx", "under", "known", F.posexplode("runs").alias("run_idx", "xml")).withColumn("text", B.xml_raw_text(F.col("xml"))).where("text <> ''")
    rows = rows.withColumn("char_style", _first(F.col("xml"), r'<w:rStyle\b[^>]*\bw:val="([^"]+)"'))
    rows = rows.withColumn("of", F.try_element_at("known", F.col("char_style"))["marks"])
    marks = run_marks(F.col("xml"))
    shown = [F.coalesce(marks[m].cast(kind), F.col("of")[m], F.col("under")[m]).alias(m) for m, (kind, _) in RUN.items()]
    before = F.sum(F.length("text")).over(Window.partitionBy("doc_id", "idx").orderBy("run_idx").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("doc_id", "idx", "run_idx", F.coalesce(before, F.lit(0)).cast("int").alias("start"), "text", *shown)


def paragraph_formats(files: DataFrame) -> DataFrame:
    """A row for each paragraph with text: doc_id, idx, text, style, kind, part, its marks, and fonts, sizes, colors (each once, in order), bold (all of it).

    kind: heading, longQuote or paragraph. part: the heading that the paragraph stands under, folded; its own for a heading.
    """
    found = paragraphs(files).where("text <> ''")
    looks = run_formats(found, files).groupBy("doc_id", "idx").agg(*[F.array_sort(F.collect_set(m)).alias(f"{m}s") for m in ("font", "size", "color")], F.every("bold").alias("bold"))
    kind = F.when(F.col("level").isNotNull(), "heading").when(F.col("is_quote"), "longQuote").otherwise("paragraph")
    up_to = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    part = F.last(F.when(F.col("level").isNotNull(), T.heading_base(F.col("folded"))), ignorenulls=True).over(up_to)
    rows = found.select("doc_id", "idx", "text", "style_id", "style_name", "level", kind.alias("kind"), F.coalesce(part, F.lit("")).alias("part"), *PARAGRAPH)
    # both sides have a row for each paragraph: neither is small, whatever the plan makes of composed texts
    return rows.join(looks.hint("merge"), ["doc_id", "idx"], "left")


def paragraph_looks(files: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """doc_id, idx, its marks, and fonts, sizes of each paragraph with text, as ``paragraph_formats`` has them.

    No kinds and no bold of the whole: so its runs stay in the paragraph's row, neither joined nor grouped, and no text is made that nobody
    asks for. ``sheets``: styles_xml of all files if these are few (``_elements``), else read from them.
    """
    el = _elements(files, sheets).withColumns({"asked": _first(F.col("xml"), r'<w:pStyle\b[^>]*\bw:val="([^"]+)"'), "base": F.col("standard.base")})
    el = el.withColumn("found", F.try_element_at("known", F.col("asked")))
    el = el.withColumn("of", F.when(F.col("found").isNotNull(), F.col("found.marks")).otherwise(F.col("standard.default_marks")))
    # a paragraph's text is trimmed and no more, so it is empty if all is white space
    el = el.where(B.says_something(F.col("xml"))).withColumn("set", _paragraph_part(F.col("xml")))
    marks = paragraph_marks(F.col("xml"), F.col("set"))
    shown = [F.coalesce(marks[m].cast(kind), F.col("of")[m], F.col("base")[m], F.lit(plain)).alias(m) for m, (kind, plain) in PARAGRAPH.items()]
    runs = F.filter(F.regexp_extract_all(F.regexp_replace("xml", r"(?s)<w:pPr\b.*?</w:pPr>", ""), F.lit(r"(?s)<w:r\b.*?</w:r>"), F.lit(0)), lambda x: B.says_something(x, "(?s)."))

    def look(xml: Column, part: Column) -> Column:
        set_ = run_marks(xml, part)
        of = F.when(F.contains(xml, F.lit("<w:rStyle")), F.try_element_at("known", _first(xml, r'<w:rStyle\b[^>]*\bw:val="([^"]+)"'))["marks"])
        return F.struct(*[F.coalesce(set_[m].cast(RUN[m][0]), of[m], F.col("of")[m], F.col("base")[m], F.lit(RUN[m][1])).alias(m) for m in ("font", "size")])

    rows = el.withColumn("looks", F.array_distinct(F.transform(runs, lambda x: T.let(_run_part(x), lambda part: look(x, part)))))
    each = lambda m: F.when(F.size("looks") > 0, F.array_sort(F.array_distinct(F.col("looks")[m]))).alias(f"{m}s")
    return rows.select("doc_id", "idx", *shown, each("font"), each("size"))


#: The parts that are set in single spacing.
SINGLE_SPACED = ("RESUMO", "ABSTRACT", "REFERENCIAS")


def breaches(rows: DataFrame) -> DataFrame:
    """doc_id, idx, rule, found: what paragraphs (``paragraph_formats``) have against the rules of form, in their numbers."""
    heading, quote, single = F.col("kind") == "heading", F.col("kind") == "longQuote", F.col("part").isin(*SINGLE_SPACED)
    body = (F.col("kind") == "paragraph") & ~single
    spacing = F.when(F.col("line_rule") == "auto", F.col("line")).otherwise(-F.col("line"))
    other = lambda values, able: F.array_join(F.filter(F.coalesce(values, F.array()), lambda v: ~able(v)).cast("array<string>"), " ")
    fonts = other(F.col("fonts"), lambda v: F.lower(v).isin(*[f.lower() for f in V.SERIF_FONTS]))
    sizes = lambda right: other(F.col("sizes"), lambda v: v == right)
    colors = other(F.col("colors"), lambda v: F.upper(v).isin("AUTO", "000000"))
    text = lambda c: c.cast("string")
    told = [
        (29, quote & (F.col("indent") < V.LONG_QUOTE_INDENT), text(F.col("indent"))),
        (30, quote & (sizes(V.QUOTE_SIZE) != ""), sizes(V.QUOTE_SIZE)),
        (31, quote & (spacing != V.SINGLE_LINE), text(spacing)),
        (32, body & (spacing != V.BODY_LINE), text(spacing)),
        (33, (F.col("kind") == "paragraph") & single & (spacing != V.SINGLE_LINE), text(spacing)),
        (35, heading & ~F.coalesce("bold", F.lit(False)), F.lit("false")),
        (36, heading & (F.col("level") == 1) & ~F.col("page_before") & (F.col("idx") > 0), F.lit("false")),
        (46, colors != "", colors),
        (48, fonts != "", fonts),
        (49, ~quote & (sizes(V.BODY_SIZE) != ""), sizes(V.BODY_SIZE)),
    ]
    made = F.array_compact(F.array(*[F.when(broken, F.struct(F.lit(n).alias("rule"), what.alias("found"))) for n, broken, what in told]))
    return rows.select("doc_id", "idx", F.inline(made))


def margin_breaches(files: DataFrame) -> DataFrame:
    """doc_id, section (from 0), rule 47, found: sections of a document whose margins aren't the prescribed ones, as top,left,bottom,right in twips."""
    sections = F.regexp_extract_all(F.coalesce("document_xml", F.lit("")), F.lit(r"(?s)<w:sectPr\b.*?</w:sectPr>"), F.lit(0))
    rows = files.select("doc_id", F.posexplode(sections).alias("section", "xml"))
    page = F.regexp_extract("xml", r"<w:pgMar\b[^>]*>", 0)
    sides = [F.coalesce(_number(page, rf'\bw:{side}="(-?\d+)"'), F.lit(0)) for side in V.MARGINS]
    wrong = [F.abs(s - right) > V.MARGIN_SLACK for s, right in zip(sides, V.MARGINS.values(), strict=True)]
    some = wrong[0]
    for w in wrong[1:]:
        some = some | w
    return rows.where(some).select("doc_id", "section", F.lit(47).alias("rule"), F.concat_ws(",", *[s.cast("string") for s in sides]).alias("found"))


def marked_paragraphs(files: DataFrame) -> DataFrame:
    """doc_id, idx, runs, marked: each paragraph's runs as imported, and its text with ``**bold**`` and ``*italic*`` marks for the editor.

    A run is bold or italic where that differs from its paragraph's style, so a bold heading style makes no marks; bold goes
    before italic, as the marks can't say both. Neighbours that are marked alike are one run, white space at a marked run's ends stands
    outside its marks, and a run that holds an asterisk stays unmarked, as marks couldn't be told from it.
    """
    found = paragraphs(files).where("text <> ''")

    def read(xml: Column, text: Column) -> Column:
        """A run as the editor has it, by its marks and those of its style and paragraph."""
        marks, of = run_marks(xml), F.try_element_at("known", _first(xml, r'<w:rStyle\b[^>]*\bw:val="([^"]+)"'))["marks"]
        set_ = lambda m: F.coalesce(marks[m], of[m], F.col("under")[m]) & ~F.col("under")[m]
        plain = F.struct(text.alias("text"), F.lit(None).cast("boolean").alias("bold"), F.lit(None).cast("boolean").alias("italics"))
        marked = lambda is_: F.struct(text.alias("text"), F.when(is_["b"], True).when(is_["i"], False).alias("bold"), F.when(is_["b"], False).when(is_["i"], True).alias("italics"))
        # a run that sets no mark and names no style looks like its paragraph
        able = ~F.contains(text, F.lit("*")) & (T.trim(text) != "") & (F.contains(xml, F.lit("<w:rPr")) | F.contains(xml, F.lit("<w:rStyle")))
        return F.when(able, T.let(F.struct(set_("bold").alias("b"), set_("italic").alias("i")), lambda m: marked(F.struct(m["b"].alias("b"), (m["i"] & ~m["b"]).alias("i"))))).otherwise(plain)

    # a paragraph's runs stay in its row: neither joined nor grouped
    said = F.filter(F.transform("runs", lambda x: F.struct(x.alias("xml"), B.xml_raw_text(x).alias("text"))), lambda r: r["text"] != "")
    rows = found.select("doc_id", "idx", F.transform(said, lambda r: read(r["xml"], r["text"])).alias("made"))
    merged = rows.where(F.size("made") > 0).select("doc_id", "idx", R.merge_runs(F.col("made")).alias("runs"))

    def written(r: Column) -> Column:
        mark = F.when(F.coalesce(r["bold"], F.lit(False)), "**").when(F.coalesce(r["italics"], F.lit(False)), "*").otherwise("")
        lead, tail = F.regexp_extract(r["text"], rf"(?s)^({T.SPACE}*)", 1), F.regexp_extract(r["text"], rf"(?s)({T.SPACE}*)$", 1)
        return F.when(mark == "", r["text"]).otherwise(F.concat(lead, mark, T.trim(r["text"]), mark, tail))

    return merged.select("doc_id", "idx", "runs", F.array_join(F.transform("runs", written), "").alias("marked"))
