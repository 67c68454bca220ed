"""The training-data pipeline: languages, near-duplicates, benchmark leaks, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bitplane, decontaminate, language, mixing, simhash
from lexmill.llm.common import benchmark, discarded, documents, staged
from lexmill.llm.queries import vocabulary

#: Least closeness (one minus the out-of-place distance) to any learned language; clean text is far above.
LEAST_LANGUAGE_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or close to no learned language, go."""
    found = language.identify(docs, language.learn(docs))
    lang, score = found.columns[-2:]
    return found.where((F.col(lang) != language.UNDETERMINED) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.decontaminated(docs, benchmark(spark, sf_dir))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, repeats as rows of their own."""
    return mixing.mixed(docs)


def token_id_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids in bit-plane shards; what was written, read back."""
    return bitplane.encode_and_read(docs, vocabulary())


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_id_output", token_id_output),
]

#: Byte-pair ids and trained models aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's table goes once the next one is written."""
    docs, table = documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if table is not None:
            discarded(table)
        table = docs
    return docs
