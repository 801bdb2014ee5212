"""Queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from cashtrail.llm import (
    divergence,
    hard_negatives,
    host_rules,
    imatch,
    maxscore,
    mixing_lm,
    ngram_join,
    packing,
    piece_tokens,
    preference,
    quality_model,
    sanitise,
    secret_scan,
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    found = [
        piece_tokens.op1_piece_tokens,
        preference.op2_preference,
        quality_model.op3_quality_model,
        secret_scan.op4_secret_scan,
        sanitise.op5_sanitise,
        maxscore.op6_maxscore,
        ngram_join.op7_ngram_join,
        mixing_lm.op8_mixing_lm,
        host_rules.op9_host_rules,
        packing.op10_packing,
        hard_negatives.op11_hard_negatives,
        imatch.op12_imatch,
        divergence.op13_divergence,
    ]
    return {q.__name__: q for q in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {
        "op2_preference": preference.OP2_SQL,
        "op6_maxscore": maxscore.OP6_SQL,
        "op9_host_rules": host_rules.OP9_SQL,
        "op11_hard_negatives": hard_negatives.OP11_SQL,
        "op13_divergence": divergence.OP13_SQL,
    }
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
