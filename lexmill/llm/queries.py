"""The training-data queries by name, each a function of (spark, sf_dir), and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from lexmill.llm import bitplane, chat, decontaminate, divergence, language, media, mixing, quality, repair, rollups, sharding, simhash, toxicity
from lexmill.llm.common import benchmark, conversations, documents, labels, workspace


def vocabulary() -> str:
    """The public byte-level BPE vocabulary, installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_latent_decontamination(spark, sf_dir):
    return decontaminate.contaminated(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op2_kd_tree_shards(spark, sf_dir):
    return sharding.kd_shards(documents(spark, sf_dir), 40)


def op3_token_rollups(spark, sf_dir):
    return rollups.corpus_rollup(documents(spark, sf_dir), vocabulary(), "byte_bpe_50k", f"{workspace(spark)}/rollup-{uuid.uuid4().hex}")


def op4_mpeg_audio(spark, sf_dir):
    return media.text_media(documents(spark, sf_dir))


def op5_rank_order_language(spark, sf_dir):
    return language.predicted_languages(documents(spark, sf_dir))


def op6_nnpu_toxicity(spark, sf_dir):
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_bit_planes(spark, sf_dir):
    return bitplane.encode_and_read(documents(spark, sf_dir), vocabulary())


def op8_simhash_ball(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir))


def op9_compression_quality(spark, sf_dir):
    return quality.quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op10_water_filling(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir))


def op11_prefix_targets(spark, sf_dir):
    return chat.chat_digests(conversations(spark, sf_dir))


def op12_source_divergence(spark, sf_dir):
    return divergence.divergence(documents(spark, sf_dir))


def op13_structure_repair(spark, sf_dir):
    return repair.repairs(conversations(spark, sf_dir))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op10_water_filling": mixing.ORACLE_SQL, "op11_prefix_targets": chat.ORACLE_SQL, "op12_source_divergence": divergence.ORACLE_SQL}
