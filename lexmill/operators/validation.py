"""Validation of work records: an ordered list of issues per record, errors and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions import values as V
from lexmill.operators import references as R

#: Every code with its severity, in the order in which issues are listed.
CODES = (
    ("work-type-required", "error"),
    ("title-required", "error"),
    ("author-required", "error"),
    ("author-institutional", "error"),
    ("advisor-required", "warning"),
    ("resumo-required", "warning"),
    ("references-required", "warning"),
    ("reference-too-short", "warning"),
    ("reference-year-missing", "warning"),
    ("reference-access-missing", "warning"),
    ("reference-highlight-missing", "warning"),
    ("reference-normative-preserved", "warning"),
    ("intro-required", "warning"),
    ("abstract-recommended", "warning"),
    ("image-caption-warning", "warning"),
    ("long-quote-warning", "warning"),
    ("imported-image-warning", "warning"),
    ("annex-image-partial", "warning"),
    ("appendix-image-partial", "warning"),
)
#: What to tell the user, by code; {n} is the number of references.
MESSAGES = {
    "work-type-required": "Escolha o tipo do trabalho.",
    "title-required": "Preencha o título.",
    "author-required": "Preencha o autor.",
    "author-institutional": "O autor parece ser uma instituição ou um lugar; confira.",
    "advisor-required": "Este tipo de trabalho pede um orientador.",
    "resumo-required": "Falta o resumo.",
    "references-required": "Faltam as referências.",
    "reference-too-short": "{n} referência(s) curta(s) demais para conferir.",
    "reference-year-missing": "{n} referência(s) sem ano.",
    "reference-access-missing": "{n} referência(s) on-line sem data de acesso. Confira antes de entregar.",
    "reference-highlight-missing": "{n} referência(s) sem título em destaque. Confira antes de entregar.",
    "reference-normative-preserved": "{n} norma(s) mantida(s) sem destaque, o que pode estar certo; confira.",
    "intro-required": "Falta a introdução.",
    "abstract-recommended": "Falta o abstract, se for exigido.",
    "image-caption-warning": "Há imagem sem legenda provável.",
    "long-quote-warning": "Há citação longa sem marca de citação.",
    "imported-image-warning": "Confira as imagens importadas.",
    "annex-image-partial": "Confira as imagens dos anexos.",
    "appendix-image-partial": "Confira as imagens dos apêndices.",
}
_MARK = r"(?i)\[Imagem detectada:"


def advisor_required(work_type: Column) -> Column:
    return work_type.isin(*V.ADVISED_TYPES)


def is_institutional_author(author: Column) -> Column:
    return T.fold_upper_keep_dashes(author).rlike(V.INSTITUTIONAL_AUTHOR)


def image_without_caption(x: Column) -> Column:
    marker = x.rlike(rf"(?i)!\[[^\]]*\]\(|<img{T.AB}|{T.AB}imagem{T.AB}|\[Imagem detectada:")
    return marker & ~x.rlike(rf"(?i){T.AB}(figura|imagem)\s+\d+|{T.AB}legenda{T.AB}")


def unmarked_long_quote(x: Column) -> Column:
    cited = lambda p: p.rlike(V.CITED)
    return F.exists(F.transform(F.split(x, r"\n{2,}"), T.trim), lambda p: (F.length(p) > V.LONG_QUOTE_CHARS) & cited(p) & ~F.startswith(p, F.lit(">")))


def own_conditions() -> dict[str, Column]:
    """Each code that depends on one record alone, with its condition; null fields count as empty."""
    text = lambda k: F.coalesce(F.col(k), F.lit(""))
    missing = lambda k: ~T.has_value(F.col(k))
    return {
        "work-type-required": missing("work_type"),
        "title-required": missing("title"),
        "author-required": missing("author"),
        "author-institutional": ~missing("author") & is_institutional_author(text("author")),
        "advisor-required": advisor_required(text("work_type")) & missing("advisor"),
        "resumo-required": missing("resumo"),
        "references-required": missing("referencias"),
        "intro-required": missing("introducao"),
        "abstract-recommended": missing("abstractText"),
        "image-caption-warning": image_without_caption(text("editor_text")),
        "long-quote-warning": unmarked_long_quote(text("editor_text")),
        "imported-image-warning": ~missing("imageWarnings"),
        "annex-image-partial": text("anexos").rlike(_MARK),
        "appendix-image-partial": text("apendices").rlike(_MARK),
    }


def work_issues(works: DataFrame) -> DataFrame:
    """doc_id, ordinal, severity, code, n: the issues of every record, in order within a record.

    n is the number of references for reference codes, else null.
    """
    place = {code: k for k, (code, _) in enumerate(CODES)}
    own = F.array(*[F.when(c, F.struct(F.lit(place[k]).alias("ordinal"), F.lit(k).alias("code"))) for k, c in own_conditions().items()])
    issues = works.select("doc_id", F.inline(F.filter(own, lambda x: x.isNotNull()))).withColumn("n", F.lit(None).cast("long"))
    refs = R.issue_counts(R.normalized(R.split_references(works, "referencias")))
    places = F.create_map(*[x for code, k in place.items() for x in (F.lit(code), F.lit(k))])
    counted = refs.select("doc_id", F.element_at(places, F.col("code")).alias("ordinal"), "code", "n")
    severity = F.create_map(*[F.lit(x) for pair in CODES for x in pair])
    return issues.unionByName(counted).select("doc_id", "ordinal", F.element_at(severity, F.col("code")).alias("severity"), "code", "n")


def with_messages(issues: DataFrame) -> DataFrame:
    messages = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    return issues.withColumn("message", F.replace(F.element_at(messages, F.col("code")), F.lit("{n}"), F.coalesce(F.col("n").cast("string"), F.lit(""))))


def blocking(issues: DataFrame) -> DataFrame:
    """doc_id, blocking, errors, warnings of every record that has an issue."""
    return issues.groupBy("doc_id").agg(F.bool_or(F.col("severity") == "error").alias("blocking"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def holds_secret(x: Column) -> Column:
    """A text that seems to hold an API key, a token or a private key."""
    return x.rlike(r"sk-[A-Za-z0-9]{20,}|(?i)api[_-]?key\s*[:=]\s*[\"'][^\"']{12,}|-----BEGIN [A-Z ]*PRIVATE KEY-----")
