"""Reference models: what kind of source a bibliographic reference describes, and its fields.

No pattern wins by being first. Every cue that a text holds adds its weight, for or against, to each model; the model of
most weight is taken if it has enough, and how far it leads says how sure that is. Fields are read the same way: of a field's
alternatives that match, the one of most weight in that model counts. Models, cues and alternatives are fixed values
(``functions.values``). Nothing is made up: a text that no model fits keeps its words and gets a warning, and a field
that its model calls for but the text lacks gives a warning of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions import values as V

UNKNOWN = "desconhecido"


def _weighed(model: Column, text: Column, alternatives: tuple) -> Column:
    """The value of the alternative of most weight, of equal ones the first; null if none matches."""
    told = []
    for k, (weight, pattern, models) in enumerate(alternatives):
        value = F.nullif(T.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))
        able = value.isNotNull() & (model.isin(*models) if models else F.lit(True))
        told.append(F.when(able, F.struct(F.lit(weight).alias("weight"), F.lit(-k).alias("order"), value.alias("value"))))
    return F.array_max(F.array(*told))["value"]


def _ranked(cues: Column) -> Column:
    """The two models of most weight, of equal ones the first in order: array<struct<score, order, model>>."""
    place = {cue: k for k, cue in enumerate(V.MODEL_CUES)}
    scores = []
    for k, (model, weights) in enumerate(V.MODEL_WEIGHTS.items()):
        total = sum((F.get(cues, F.lit(place[cue])) * weight for cue, weight in weights.items()), F.lit(0))
        scores.append(F.struct(total.alias("score"), F.lit(-k).alias("order"), F.lit(model).alias("model")))
    return F.slice(F.sort_array(F.array(*scores), asc=False), 1, 2)


def modelled(refs: DataFrame, original: str = "original") -> DataFrame:
    """``refs`` with text, model, score, lead (over the next model), the fields, and model_warnings.

    A null reference counts as empty: model desconhecido, score 0. ``refs`` has no columns that start with an underscore.
    """
    df = refs.withColumn("_text", T.clean(F.regexp_replace(F.coalesce(F.col(original), F.lit("")), r"\*", ""))).withColumn("_folded", T.fold_lower(F.col("_text")))
    # dozens of patterns make more generated code than one method may hold; inside a lambda they are evaluated as they are
    df = df.withColumn("_cues", T.let(F.col("_folded"), lambda x: F.array(*[x.rlike(pattern).cast("int") for pattern in V.MODEL_CUES.values()])))
    df = df.withColumn("_ranked", T.let(F.col("_cues"), _ranked))
    best, next_ = F.col("_ranked")[0], F.col("_ranked")[1]
    known = best["score"] >= V.LEAST_MODEL_SCORE
    df = df.withColumn("_model", F.when(known, best["model"]).otherwise(UNKNOWN)).withColumn("_author", T.let(F.struct("_model", "_text"), lambda x: _weighed(x["_model"], x["_text"], V.MODEL_FIELDS["author"])))
    rest = T.trim(F.regexp_replace(F.substring("_text", F.coalesce(F.length("_author"), F.lit(0)) + 1, F.length("_text")), r"^\.", ""))
    df = df.withColumn("_rest", rest)
    others = [(field, alternatives) for field, alternatives in V.MODEL_FIELDS.items() if field != "author"]
    df = df.withColumn("_fields", T.let(F.struct("_model", "_rest"), lambda x: F.struct(*[_weighed(x["_model"], x["_rest"], alternatives).alias(field) for field, alternatives in others])))
    value = lambda field: F.col("_author") if field == "author" else F.col("_fields")[field]
    missing = [F.when(F.col("_model").isin(*[m for m, fields in V.MODEL_NEEDS.items() if field in fields]) & value(field).isNull(), F.lit(f"missing-{field}")) for field in V.MODEL_FIELDS]
    warnings = F.array_compact(F.array(F.when(~known, F.lit("model-unknown")), F.when(known & (best["score"] == next_["score"]), F.lit("model-unsure")), *missing))
    out = {"text": F.col("_text"), "model": F.col("_model"), "score": F.greatest(best["score"], F.lit(0)), "lead": best["score"] - next_["score"]}
    out |= {field: value(field) for field in V.MODEL_FIELDS} | {"model_warnings": warnings}
    return df.select(*[c for c in refs.columns if c not in out], *[c.alias(k) for k, c in out.items()])
