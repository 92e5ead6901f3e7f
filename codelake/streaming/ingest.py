"""Keeping tables of changed texts current from a stream of files or rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import bm25, delta
from ..sources.store import Store


def merge_batch(store: Store, batch: DataFrame, key: str = "path", text: str = "text", order: str = "ts") -> None:
    """One micro-batch: of a key's rows the last by ``order`` counts (the larger text of equal ones); a null text deletes the key.

    Unchanged texts are left out, others replace their rows and postings; a batch that comes twice changes nothing. The
    store's other tables stay as they are.
    """
    if order not in batch.columns:
        raise ValueError(f"rows of one key need an order: no column {order}")
    new = batch.groupBy(key).agg(F.max_by(F.struct(F.col(text).alias("t")), F.struct(F.col(order).alias("at"), F.col(text).alias("t")))["t"].alias(text))
    new = new.withColumn("sha256", F.sha2(text, 256))
    old, posts = store.table("texts"), store.table("text_postings")
    if old is not None:
        new = new.join(old.select(key, F.col("sha256").alias("_old")), key, "left").where(~F.col("sha256").eqNullSafe(F.col("_old"))).drop("_old")
    new = new.persist()
    there = new.where(F.col(text).isNotNull())
    made = bm25.postings(bm25.token_counts(there, key, text)).withColumnRenamed("doc_id", key)
    if old is not None:
        there = delta.without(old, new.select(key), key).unionByName(there)
        made = made if posts is None else delta.without(posts, new.select(key), key).unionByName(made)
    store.commit({"texts": there, "text_postings": made})
    new.unpersist()


def ingest(stream: DataFrame, store: Store, checkpoint: str, key: str = "path", text: str = "text", order: str = "ts") -> StreamingQuery:
    """Merges every micro-batch of ``stream`` into the store; available input is worked off, then the query ends."""
    return stream.writeStream.foreachBatch(lambda batch, _: merge_batch(store, batch, key, text, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and hour of a stream (or a table) with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
