"""The same transforms over a growing folder: new text files become field rows as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.blocks import text_blocks
from lexmill.operators.fields import detect_fields
from lexmill.operators.references import normalized, split_references


def text_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """doc_id, path, text of whole text files, each once."""
    found = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return found.select(F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def field_stream(texts: DataFrame, as_of_year: int) -> DataFrame:
    """Fields of each arriving document; stateless, so it runs in append mode."""
    return detect_fields(text_blocks(texts), as_of_year)


def reference_stream(texts: DataFrame, as_of_year: int) -> DataFrame:
    """The normalized references of each arriving document."""
    return normalized(split_references(field_stream(texts, as_of_year), "referencias"))
