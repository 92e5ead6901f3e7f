"""A training corpus from ``documents``: quality rules, near-duplicates, secrets, mixing, BPE encoding.

All stages take columns of any further names and give them back as they were, whatever a stage calls its own. An empty
table stays empty. Each stage's docstring says what becomes of nulls, empty and very long texts, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from codelake.llm.bpe import encoded
from codelake.llm.common import forget, materialize, table
from codelake.llm.minhash import near_duplicates
from codelake.llm.mixing import mixed_documents
from codelake.llm.quality import good_documents
from codelake.llm.secrets import redacted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null and empty texts too (under 50 words). Texts are judged whole, each row by itself; a null id is a row like others."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (5 words, 0.8): that with the smallest id; one of rows that repeat both id and text, the first by a hash of the row. Rows without an id or without words are in no group and stay."""
    gone = near_duplicates(docs, width=5, percent=80).where(~F.col("kept")).select(F.col("doc_id").alias("id")).distinct()
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("hash"), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias("tie"), row)
    rows = own.join(gone, "id", "left_anti").withColumn("n", F.row_number().over(W.partitionBy("id", "hash").orderBy("tie"))).where("n = 1")
    return rows.select("row.*").unionByName(docs.where("doc_id is null"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced in the texts, and n_chars counted anew; null and empty texts stay as they are, every row stays."""
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix takes them; those without words go. A null source is one of its own. Of rows with one id, size and source, the order of a hash of their texts says which the mix takes."""
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded, for every row; null and empty texts have no ids."""
    return encoded(docs)


STAGES = [("quality", quality), ("near_duplicates", deduplicated), ("secrets", secrets), ("mixing", mixing), ("encoding", encoding)]
#: Learned rules, hashing of near-duplicates and BPE are beyond SQL; a brute-force version stands in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
