"""Registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from liftlab.llm import (exact, maxent, mixing, neighbours, packing, preference, quality,
                         sharding, simhash, spotsigs, turntrie, warc, whitening)


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the top of the repository; the operators work without it
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_spot_signatures": spotsigs.query,
        "op2_maxent_scoring": maxent.query,
        "op3_simhash_trie_join": simhash.query,
        "op4_best_fit_packing": packing.query,
        "op5_warc_segments": warc.query,
        "op6_hilbert_sharding": sharding.query,
        "op7_preference_pairs": preference.query,
        "op8_ftrl_quality": quality.query,
        "op9_curriculum_mixing": mixing.query,
        "op10_rotated_bits": neighbours.query,
        "op11_weighted_whitening": whitening.query,
        "op12_double_array_trie": turntrie.query,
        "op13_extendible_hash_dedup": exact.query,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_warc_segments": warc.oracle(),
        "op7_preference_pairs": preference.oracle(),
        "op9_curriculum_mixing": mixing.oracle(),
        "op12_double_array_trie": turntrie.oracle(),
        "op13_extendible_hash_dedup": exact.oracle(),
    }
