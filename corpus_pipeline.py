"""Raw documents to training tokens: quality rules, near-duplicates, benchmark passages, personal data, token ids.

Each stage reads what the one before kept, as Parquet.  All stages but the
last return the columns of their input; the last returns token ids per
document.  The stages take and keep null texts and further columns as the
operators define them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covercost.llm import byte_bpe, decontamination, minhash_dedup, pii, quality_rules
from covercost.llm.base import stage, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the fixed or adaptive quality rules reject (3)."""
    packed = docs.select("doc_id", "lang", "source", "text", F.struct(*docs.columns).alias("_row"))
    return quality_rules.judge(spark, packed, carry=("_row",)).where("kept").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (7)."""
    return minhash_dedup.one_of_each(spark, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage (10)."""
    return decontamination.without_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts (4)."""
    return pii.redact(spark, docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the decoded bytes (9)."""
    return byte_bpe.encode_decode(spark, docs, ids=True)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("pii", redact),
    ("byte_bpe", tokenize),
]
#: SQL can't express the stages from the third on; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(spark, step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
