"""Bibliography: split, classify, highlight and validate reference strings.

Everything is a chain of projections over one reference string: no shuffle, no UDF. A reference is split at a dot and a
space; the first split that fits wins, which a lazy pattern finds in one pass. Each step is a column of its own, so what
a query doesn't ask for is pruned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions import values as V

RUN = "struct<text:string,bold:boolean,italics:boolean>"


def split_references(works: DataFrame, text: str = "references_text") -> DataFrame:
    """doc_id, ref_idx (from 0), original: the non-blank lines of a reference list."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n+"), T.clean), lambda x: x != "")
    return works.select("doc_id", F.posexplode(lines).alias("ref_idx", "original"))


def is_legislation(folded: Column) -> Column:
    return folded.rlike(V.LEGISLATION_START) | folded.rlike(V.LEGISLATION_WORDS)


def _run(text: Column, bold: Column, italics: Column) -> Column:
    return F.struct(text.alias("text"), bold.cast("boolean").alias("bold"), italics.cast("boolean").alias("italics"))


def _split_et_al(run: Column) -> Column:
    parts = F.regexp_extract_all(run["text"], F.lit(r"(?is)(et\s+al\.|(?:(?!et\s+al\.).)+)"), F.lit(1))
    return F.transform(parts, lambda p: _run(p, run["bold"], F.when(p.rlike(r"(?i)^et\s+al\.$"), F.lit(True)).otherwise(run["italics"])))


def merge_runs(runs: Column) -> Column:
    """Neighbours with equal marks as one run; empty runs go."""

    def step(done: Column, run: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        same = (F.size(done) > 0) & last["bold"].eqNullSafe(run["bold"]) & last["italics"].eqNullSafe(run["italics"])
        grown = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(_run(F.concat(last["text"], run["text"]), run["bold"], run["italics"])))
        return F.when(same, grown).otherwise(F.concat(done, F.array(run)))

    return F.aggregate(F.filter(runs, lambda r: F.length(r["text"]) > 0), F.array().cast(f"array<{RUN}>"), step)


def marked_runs(x: Column) -> Column:
    """Runs of a line with ``**bold**`` and ``*italic*`` marks; unmarked runs have null marks."""
    tokens = F.regexp_extract_all(x, F.lit(r"(?s)(\*\*[^*]+\*\*|\*[^*]+\*|[^*]+|\*)"), F.lit(1))
    bold, italic = (lambda t: t.rlike(r"(?s)^\*\*[^*]+\*\*$")), (lambda t: t.rlike(r"(?s)^\*[^*]+\*$"))

    def run(t: Column) -> Column:
        inner = F.when(bold(t), F.substring(t, F.lit(3), F.length(t) - 4)).when(italic(t), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
        return _run(inner, F.when(bold(t), True).when(italic(t), False), F.when(bold(t), False).when(italic(t), True))

    return F.transform(tokens, run)


def with_et_al(runs: Column) -> Column:
    return merge_runs(F.flatten(F.transform(runs, _split_et_al)))


def highlighted_runs(text: Column, highlight: Column) -> Column:
    """The text with the first occurrence of the highlight (any case) in bold, and et al. in italics."""
    none, size = F.lit(None), F.length(highlight)
    cut = lambda at: F.array(_run(F.substring(text, F.lit(1), at - 1), none, none), _run(F.substring(text, at, size), F.lit(True), none), _run(F.substring(text, at + size, F.length(text)), none, none))
    runs = T.let(F.coalesce(F.position(F.lower(highlight), F.lower(text)), F.lit(0)), lambda at: F.when(at > 0, cut(at)).otherwise(F.array(_run(text, none, none))))
    return with_et_al(runs)


#: What follows the author: the text after the first sentence break past the first comma that no "et al." follows.
_AFTER_AUTHOR = r"(?s)^\p{Lu}[^,]*[^,\s]\s*,.*?\. (?!(?i:et\s+al\.))(.{4,})$"
#: A periodical: the words before the first comma of a sentence that goes on with volume, number or pages.
_PERIODICAL = r"(?s)^.*?\. (?=.*,\s*[vnpVNP]\.)(\p{Lu}[^,]{2,}[^,\s])\s*,"
#: A book's title: what stands before place, publisher and year.
_BOOK = rf"(?s)^(.{{3,}}?\S)\s*\. (?={V.PUBLICATION.removeprefix('^')})"


def _part(x: Column, pattern: str) -> Column:
    """The first group of a match, null without one."""
    return F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))


def _academic(rest: Column, folded: Column) -> Column:
    """A thesis' title: what stands before the kind of work, null if it is too short."""
    ahead = F.length(F.regexp_extract(folded, rf"(?s)^(.*?){V.ACADEMIC_MARK}", 1))
    title = T.strip_trailing_data(F.substring(rest, F.lit(1), ahead))
    return F.when(folded.rlike(V.ACADEMIC_MARK), F.regexp_extract(title, r"(?s)^(.{4,})$", 1))


def _kind() -> Column:
    """The reference type, the first that fits in fixed order."""
    folded = F.col("_folded")
    return (
        F.when(F.col("_text") == "", "desconhecido")
        .when(is_legislation(folded), "legislacao")
        .when(F.col("_rest").isNull(), "desconhecido")
        .when(F.col("_article").isNotNull(), "artigo")
        .when(F.col("_academic").isNotNull() | folded.rlike(V.ACADEMIC_WORDS), "tese-dissertacao")
        .when(folded.rlike(V.INSTITUTION_START), "documento-institucional")
        .when(folded.rlike(V.ELECTRONIC), "site")
        .when(F.col("_book").isNotNull(), "livro")
        .otherwise("desconhecido")
    )


def _title() -> Column:
    """The title that the kind of work calls for."""
    kind = F.col("_kind")
    return F.when(kind == "artigo", F.col("_article")).when(kind == "tese-dissertacao", F.col("_academic")).when(kind.isin("documento-institucional", "site", "livro"), F.col("_book"))


def _warnings() -> Column:
    text, folded, kind, found = F.col("_text"), F.col("_folded"), F.col("_kind"), F.col("_found")
    unsure = F.when(kind == "legislacao", "normative-kept").when(kind == "desconhecido", "title-not-found").when((kind == "tese-dissertacao") & found.isNull(), "academic-kept").when((kind == "documento-institucional") & found.isNull(), "institutional-kept")
    told = F.array(
        F.when(F.length(text) < V.SHORT_REFERENCE, "short"),
        F.when(~T.has_year(text), "no-year"),
        F.when(folded.rlike("(https?://|disponivel em:)") & ~folded.rlike("acesso em:"), "no-access-date"),
        unsure,
        F.when(F.coalesce(F.col("_manual"), found).isNull(), "no-highlight"),
    )
    return F.when(text == "", F.array(F.lit("empty"))).otherwise(F.array_compact(told))


def normalized(refs: DataFrame, original: str = "original") -> DataFrame:
    """``refs`` with text, ref_type, highlight, confidence, runs and warnings (codes, in fixed order).

    A null reference counts as empty: type desconhecido, confidence baixa, the one warning ``empty``. ``refs`` has no
    columns that start with an underscore.
    """
    text, manual, kind, found, empty = F.col("_text"), F.col("_manual"), F.col("_kind"), F.col("_found"), F.col("_text") == ""
    starred = F.contains(F.col("_clean"), F.lit("*"))
    bold = F.try_element_at(F.filter("_marked", lambda r: r["bold"].isNotNull() & (T.trim(r["text"]) != "")), F.lit(1))["text"]
    steps = [
        ("_clean", T.clean(F.coalesce(F.col(original), F.lit("")))),
        # most references hold no mark, and then they are their text
        ("_marked", F.when(starred, marked_runs(F.col("_clean")))),
        ("_text", F.when(starred, T.clean(F.array_join(F.transform("_marked", lambda r: r["text"]), ""))).otherwise(F.col("_clean"))),
        ("_manual", F.when(starred, T.trim(bold))),
        ("_folded", T.fold_lower(text)),
        ("_rest", _part(text, _AFTER_AUTHOR)),
        ("_article", _part(F.col("_rest"), _PERIODICAL)),
        ("_rest_folded", T.fold_lower(F.col("_rest"))),
        ("_academic", F.nullif(_academic(F.col("_rest"), F.col("_rest_folded")), F.lit(""))),
        ("_book", _part(F.col("_rest"), _BOOK)),
        ("_kind", _kind()),
        ("_found", _title()),
    ]
    df = refs
    for name, column in steps:
        df = df.withColumn(name, column)
    sure = F.when(empty, "baixa").when(manual.isNotNull(), "alta").when((kind != "site") & found.isNotNull(), "media").otherwise("baixa")
    runs = F.when(empty, F.array().cast(f"array<{RUN}>")).when(manual.isNotNull(), with_et_al(F.col("_marked"))).otherwise(highlighted_runs(text, found))
    parts = {"text": text, "ref_type": kind, "highlight": F.coalesce(manual, found), "confidence": sure, "runs": runs, "warnings": _warnings()}
    return df.select(*[c for c in refs.columns if c not in parts], *[c.alias(k) for k, c in parts.items()])


def _issue_conditions() -> list[tuple[str, Column]]:
    """Issue codes of a reference list, in order, with the condition on one reference."""
    text = F.col("text")
    return [
        ("reference-too-short", F.length(text) < V.SHORT_REFERENCE),
        ("reference-year-missing", ~T.has_year(text)),
        ("reference-access-missing", text.rlike("(?iu)(https?://|dispon[ií]vel em:)") & ~text.rlike("(?i)acesso em:")),
        ("reference-highlight-missing", F.col("highlight").isNull() & (F.col("ref_type") != "legislacao")),
        ("reference-normative-preserved", F.col("highlight").isNull() & (F.col("ref_type") == "legislacao")),
    ]


def issue_counts(refs: DataFrame) -> DataFrame:
    """doc_id, ordinal, code, n: how many normalized references of a document raise each issue; none, no row."""
    codes = _issue_conditions()
    counts = refs.groupBy("doc_id").agg(*[F.count_if(c).alias(f"_{k}") for k, (_, c) in enumerate(codes)])
    rows = F.array(*[F.struct(F.lit(k).alias("ordinal"), F.lit(code).alias("code"), F.col(f"_{k}").alias("n")) for k, (code, _) in enumerate(codes)])
    return counts.select("doc_id", F.inline(rows)).where("n > 0")
