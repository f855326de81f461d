"""The named queries on training text, and DuckDB SQL for those that SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from matchlens.llm import (
    decontamination,
    divergence,
    html,
    lines,
    packing,
    quality,
    quantize,
    records,
    sharding,
    simhash,
    substrings,
    syncmers,
    topk,
)

_QUERIES = (
    lines.op1_line_dedup,
    packing.op2_best_fit_packing,
    sharding.op3_sharding,
    substrings.op4_suffix_dedup,
    decontamination.op5_decontamination,
    simhash.op6_simhash,
    syncmers.op7_syncmers,
    html.op8_html_text,
    records.op9_binary_records,
    quality.op10_quality,
    topk.op11_segment_topk,
    quantize.op12_walsh_codes,
    divergence.op13_divergence,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES} | {"pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    return {
        "op1_line_dedup": lines.ORACLE,
        "op4_suffix_dedup": substrings.ORACLE,
        "op5_decontamination": decontamination.ORACLE,
        "op11_segment_topk": topk.ORACLE,
        "op12_walsh_codes": quantize.ORACLE,
        "op13_divergence": divergence.ORACLE,
    }
