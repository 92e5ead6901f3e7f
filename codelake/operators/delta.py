"""Differences between a stored and a current state, and copy-on-write changes of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def snapshot_diff(stored: DataFrame, current: DataFrame, key: str = "path", mark: str = "sha256") -> DataFrame:
    """key, status: new, modified, deleted or unchanged."""
    s = stored.select(key, F.col(mark).alias("_old"), F.lit(True).alias("_s"))
    c = current.select(key, F.col(mark).alias("_new"), F.lit(True).alias("_c"))
    status = F.when(F.col("_s").isNull(), "new").when(F.col("_c").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("modified")
    return s.join(c, key, "full_outer").select(key, status.alias("status"))


def unfinished(files: DataFrame, chunks: DataFrame, key: str = "path") -> DataFrame:
    """Files that should have chunks and have none stored: work to resume."""
    return files.where("chunk_count > 0").join(chunks, key, "left_anti")


def without(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``table`` less the rows with one of the keys."""
    return table.join(keys, key, "left_anti")


def upserted(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of the keys in ``new`` replaced."""
    return without(table, new.select(key).distinct(), key).unionByName(new, allowMissingColumns=True)


def with_new_ids(new: DataFrame, top_id: int | None, order: list[str], name: str = "chunk_id") -> DataFrame:
    """Dense ids after the largest one (from 0 in an empty table), in a fixed order: by a hash bucket of the first column, then the columns.

    Each of 4,096 buckets numbers its own rows after the counts of those before, so that no task sees them all.
    """
    first = -1 if top_id is None else top_id
    rows = new.withColumn("_part", F.coalesce(F.substring(F.md5(F.col(order[0]).cast("string")), 1, 3), F.lit("")))
    rows = rows.withColumn("_at", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return rows.join(F.broadcast(before), "_part").withColumn(name, (F.lit(first) + F.col("_before") + F.col("_at")).cast("long")).drop("_part", "_at", "_before")


def statistics(status: DataFrame) -> DataFrame:
    """One row: files_processed, files_skipped, files_deleted."""
    n = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    return status.agg(n("new", "modified", "resumed").alias("files_processed"), n("unchanged", "failed").alias("files_skipped"), n("deleted").alias("files_deleted"))
