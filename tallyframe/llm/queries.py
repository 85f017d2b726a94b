"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import annforest, decontam, licenses, mixing, omh, pii, quality, sharding, tokenfile, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_golden_ratio_mix": mixing.op1_golden_ratio_mix,
    "op2_positional_index": decontam.op2_positional_index,
    "op3_weak_label_quality": quality.op3_weak_label_quality,
    "op4_elias_fano_ids": tokenfile.op4_elias_fano_ids,
    "op5_projection_forest": annforest.op5_projection_forest,
    "op6_boosted_personal_data": pii.op6_boosted_personal_data,
    "op7_rendezvous_shards": sharding.op7_rendezvous_shards,
    "op8_toxicity_chain": toxicity.op8_toxicity_chain,
    "op9_order_minhash": omh.op9_order_minhash,
    "op10_license_dice": licenses.op10_license_dice,
}

SQL: dict[str, str] = {"op2_positional_index": decontam.OP2_SQL}
