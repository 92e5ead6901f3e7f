"""Exact cosine search: one pass over the vectors, a literal query, a top-k that keeps k rows in each task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n)))[0]


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def top(vectors: DataFrame, query: list[float], k: int, where: Column | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, score of the k nearest among the rows that ``where`` keeps, ties to the smaller key."""
    rows = vectors if where is None else vectors.where(where)
    scored = rows.select(F.col(key), F.round(cosine(F.col(vector), literal(query)), 6).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)
