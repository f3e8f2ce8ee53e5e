"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ripplegraph.llm import chat, fingerprints, hard_negatives, licenses, line_dedup, manifest, mixing, ngram_join, packing, quality, secrets, sharding, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        mixing.op1_cube_mixing,
        packing.op2_length_buckets,
        toxicity.op3_counterfactual_toxicity,
        sharding.op4_hash_tree_sharding,
        fingerprints.op5_scaled_sketches,
        quality.op6_risk_controlled_rules,
        ngram_join.op7_ngram_jaccard_join,
        line_dedup.op8_levelled_line_runs,
        licenses.op9_rare_token_licenses,
        chat.op10_hmm_transcripts,
        secrets.op11_zstd_novelty_secrets,
        manifest.op12_merkle_recursive_climb,
        hard_negatives.op13_str_rtree_negatives,
    )
}

ORACLE_SQL: dict[str, str] = {"op8_levelled_line_runs": line_dedup.OP8_SQL}
