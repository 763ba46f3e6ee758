"""A corpus from documents to packed training windows in five stages.

1. quality rules: boilerplate lines of a host go, and documents that lose most of their text by it;
2. SimHash near-dedup: of each group of near duplicates the document of the least doc_id stays;
3. suffix-array dedup: passages of 50 words and more stay in their first document only;
4. secret scans: secret values in credential context are masked;
5. packing: what is left is cut into windows of tokens.

Every stage takes all rows the one before kept and returns the columns of documents, except the
last, which returns windows. Between stages the table is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexforge.llm import packing, quality, secrets, simhash, suffix
from lexforge.llm.common import documents, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_frequent_lines(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.drop_repeats(docs)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask_secrets(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.windows(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("secret scans", secret_masking),
    ("packing", pack_windows),
]

#: Fingerprints, suffix sorting and the two dynamic programs are no SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
