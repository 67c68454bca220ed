"""Merging imported fields into records that a user already edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions import values as V

UNKNOWN = "nao-identificado"


def import_merge(current: DataFrame, imported: DataFrame, keys: tuple[str, ...] = ("work_type", *V.FIELD_KEYS)) -> DataFrame:
    """Field by field the current value, or the imported one where it is empty; full join on doc_id.

    An identified imported confidence replaces the current one even where the current value stays.
    """
    a, b = current.alias("a"), imported.alias("b")
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    fields = [F.when(empty(f"a.{k}") != "", F.col(f"a.{k}")).otherwise(empty(f"b.{k}")).alias(k) for k in keys]
    unknown = lambda m, k: F.coalesce(F.try_element_at(F.col(m), F.lit(k)), F.lit(UNKNOWN))
    pairs = [x for k in keys if k != "work_type" for x in (F.lit(k), F.when(unknown("b.confidence", k) != UNKNOWN, unknown("b.confidence", k)).otherwise(unknown("a.confidence", k)))]
    return a.join(b, "doc_id", "full").select("doc_id", *fields, F.create_map(*pairs).alias("confidence"))


def manual_edits(records: DataFrame, edits: DataFrame, keys: tuple[str, ...] = V.FIELD_KEYS) -> DataFrame:
    """Records with edits (doc_id, field, value) applied; an edited field of unknown confidence becomes baixa.

    Edits are applied as a left join on one map per document; of several to a field the greatest value counts.
    """
    latest = edits.groupBy("doc_id", "field").agg(F.max("value").alias("value"))
    by_doc = latest.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_edits"))
    df = records.join(by_doc, "doc_id", "left")
    value = lambda k: F.try_element_at("_edits", F.lit(k))
    level = lambda k, v: F.when(F.map_contains_key(F.coalesce("_edits", F.create_map().cast("map<string,string>")), k) & (v == UNKNOWN), "baixa").otherwise(v)
    rest = [c for c in records.columns if c not in (*keys, "doc_id", "confidence")]
    return df.select("doc_id", *rest, *[F.coalesce(value(k), F.col(k)).alias(k) for k in keys if k in records.columns], F.transform_values("confidence", level).alias("confidence"))


def editor_seed(editor: str = "editor", imported: str = "editor_text", introduction: str = "introducao", text: str = "text"):
    """What the editor starts with: its own text if not blank, else the first non-empty of the imported ones."""
    filled = lambda c: F.when(T.has_value(F.col(c)), F.col(c))
    return F.coalesce(filled(editor), *[F.nullif(F.col(c), F.lit("")) for c in (imported, introduction, text)], F.lit(""))
