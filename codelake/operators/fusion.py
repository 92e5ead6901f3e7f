"""Reciprocal-rank fusion of a vector list and a keyword list.

Both lists are top-k results, so ranking them needs one task; what they were ranked from never does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

K = 60
KEYS = ("file_path", "start_line", "end_line")


def ranked(hits: DataFrame, *order: Column) -> DataFrame:
    """``hits`` (a top-k list) with their 1-based rank."""
    return hits.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def fuse(semantic: DataFrame, keyword: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, score (2 / 61 is 1), first, keyword_only. Of equal keys the worst rank counts on the vector side and all add up on the keyword side."""
    s = semantic.groupBy(*keys).agg((1 / (K + F.max("rank"))).alias("s"), F.min("rank").alias("s_first"))
    w = keyword.groupBy(*keys).agg(F.sum(1 / (K + F.col("rank"))).alias("w"), F.min("rank").alias("w_first"))
    both = s.join(w, list(keys), "full_outer")
    total = (F.coalesce("s", F.lit(0.0)) + F.coalesce("w", F.lit(0.0))) / (2 / (K + 1))
    return both.select(*keys, F.round(total, 10).alias("score"), F.coalesce("s_first", "w_first").alias("first"), F.col("s").isNull().alias("keyword_only"))


def ordered(fused: DataFrame) -> list[Column]:
    """The order of a fused list: score, then vector hits in their order, then keyword hits in theirs."""
    return [F.desc("score"), F.col("keyword_only"), F.col("first"), *(F.col(k) for k in fused.columns if k in KEYS)]


def page(fused: DataFrame, k: int, offset: int = 0) -> DataFrame:
    """Ranks offset .. offset + k - 1 (from 0) of the fused list."""
    best = fused.orderBy(*ordered(fused)).limit(k + offset)
    return best.withColumn("rank", F.row_number().over(W.orderBy(*ordered(fused))) - 1).where(F.col("rank") >= offset)
