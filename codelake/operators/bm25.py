"""Keyword ranking over postings.

Texts are tokenized once: raw words are counted for each document before an identifier is split, so that a word costs its
split once, and with documents dealt out by id both counts need no further shuffle. Postings are stored by token; queries
then read them. A query's tokens are literals, so no side of the corpus is broadcast.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import RAW_BREAK, code_tokens, expanded

K1, B, EPSILON = 1.5, 0.75, 0.25


def token_counts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, token, tf; and one row with a null token for each document, so that those without tokens are there too."""
    dealt = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).repartition("doc_id")
    raw = dealt.select("doc_id", F.explode(F.concat(F.split(F.coalesce("text", F.lit("")), RAW_BREAK), F.array(F.lit("")))).alias("raw"))
    counted = raw.where((F.length("raw") >= 2) | (F.col("raw") == "")).groupBy("doc_id", "raw").agg(F.count("*").alias("times"))
    split = F.when(F.col("raw") == "", F.array(F.lit(None).cast("string"))).otherwise(expanded(F.col("raw")))
    tokens = counted.select("doc_id", F.explode(split).alias("token"), "times")
    return tokens.groupBy("doc_id", "token").agg(F.sum(F.when(F.col("token").isNull(), 0).otherwise(F.col("times"))).alias("tf"))


def postings(tokens: DataFrame) -> DataFrame:
    """token, doc_id, tf."""
    return tokens.where("token is not null").select("token", "doc_id", "tf")


def doc_lengths(tokens: DataFrame) -> DataFrame:
    """doc_id, dl for every document."""
    return tokens.groupBy("doc_id").agg(F.sum("tf").alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: n, avgdl."""
    return lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def idf_table(posts: DataFrame, stats: DataFrame) -> DataFrame:
    """token, df, idf; a negative idf is replaced by EPSILON times the mean over the vocabulary."""
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    per = posts.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats)).select("token", "df", raw.alias("raw"))
    # equal ones are counted first: a sum of as many terms as tokens loses digits, others in each run
    alike = per.groupBy("raw").agg(F.count("*").alias("times"))
    floor = F.broadcast(alike.agg((F.sum(F.col("raw") * F.col("times")) / F.sum("times") * EPSILON).alias("floor")))
    return per.crossJoin(floor).select("token", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


def query_tokens(spark: SparkSession, query: str) -> dict[str, int]:
    """The query's tokens, and how often each comes: a few, on the driver, as they become literals."""
    found = spark.range(1).select(F.explode(code_tokens(F.lit(query))).alias("token")).collect()
    return dict(sorted(Counter(r.token for r in found).items()))


def scores(posts: DataFrame, lengths: DataFrame, query: dict[str, int], idf: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """doc_id, score for the documents that share a token with the query; empty for a blank query or corpus.

    The tokens are a filter on the scans of postings and of a stored ``idf`` table, and then literals; only matching
    postings meet the document lengths.
    """
    if not query:
        return posts.where("false").select("doc_id", F.lit(0.0).alias("score"))
    stats = corpus_stats(lengths) if stats is None else stats
    asked = F.col("token").isin(*query)
    times = F.create_map(*(F.lit(x) for kv in query.items() for x in kv))[F.col("token")]
    weights = (idf_table(posts, stats) if idf is None else idf).where(asked).select("token", "idf")
    part = times * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hits = posts.where(asked).join(F.broadcast(weights), "token").join(lengths, "doc_id").crossJoin(F.broadcast(stats))
    return hits.groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def top(scored: DataFrame, lengths: DataFrame, k: int) -> DataFrame:
    """The k best of all documents, ties to the larger id; then those that share a token.

    Documents without a shared token score 0, so they push out hits only where those score below 0 or tie at 0: the k best
    hits above 0 are looked at first, and the others, which need all lengths, only where they are too few.
    """
    order = [F.desc("score"), F.desc("doc_id")]
    best = scored.where("score > 0").orderBy(*order).limit(k)
    rest = scored.where("score <= 0")
    none = lengths.select("doc_id").join(scored.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(0.0).alias("score"), F.lit(False).alias("hit"))
    low = rest.select("doc_id", "score", F.lit(True).alias("hit"))
    if rest.isEmpty():
        return best.orderBy(*order)
    filled = best.select("doc_id", "score", F.lit(True).alias("hit")).unionByName(low).unionByName(none.orderBy(*order).limit(k))
    return filled.orderBy(*order).limit(k).where("hit or score > 0").select("doc_id", "score")
