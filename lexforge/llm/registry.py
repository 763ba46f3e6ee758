"""The operators' queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexforge.llm import bpe, packing, pii, quality, secrets, simhash, sitetree, suffix, topk, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_quality": quality.op2_quality,
        "op3_pii": pii.op3_pii,
        "op4_html": sitetree.op4_html,
        "op5_secrets": secrets.op5_secrets,
        "op6_bpe": bpe.op6_bpe,
        "op7_packing": packing.op7_packing,
        "op8_warc": warc.op8_warc,
        "op9_suffix": suffix.op9_suffix,
        "op10_topk": topk.op10_topk,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_quality": quality.sql(), "op10_topk": topk.sql()}
