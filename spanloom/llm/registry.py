"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from . import embedding_graph, minhash, packing, pii_crf, quality_knn, ring_sharding, sentencepieces, spotsigs, token_counts, toxicity_zstd


def queries() -> dict[str, Callable]:
    return {
        "op1_pii_crf": pii_crf.query,
        "op2_quality_knn": quality_knn.query,
        "op3_sentencepieces": sentencepieces.query,
        "op4_toxicity_zstd": toxicity_zstd.query,
        "op5_spotsigs": spotsigs.query,
        "op6_embedding_graph": embedding_graph.query,
        "op7_ring_sharding": ring_sharding.query,
        "op8_token_counts": token_counts.query,
        "op9_best_fit_packing": packing.query,
        "op10_minhash_groups": minhash.query,
    }


def oracle_sql() -> dict[str, str]:
    return {}
