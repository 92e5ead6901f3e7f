"""Language of pages by Bayesian fusion of four kinds of evidence.

Text: a naive Bayes model over hashed byte trigrams, trained on at most MAX_TRAIN labelled documents (by a hash of the id),
whose log-likelihood is divided by TEMPER, as trigrams of one text aren't independent. Markup: the declared language of the
document element, weighed by how often that declaration goes with each language in the corpus. Address: priors of the host,
smoothed towards its address suffix, which is smoothed towards the corpus. All those counts are grouped aggregations over
the whole table; a row's own vote is taken out of its host's and suffix's counts.

Defined cases: null or empty text, address or markup: that evidence is left out. A row without any evidence gets the corpus
prior. Ties go to the language that sorts first. Repeated rows are rows of their own; an empty table gives an empty result;
other columns are ignored. The driver holds the model: BUCKETS numbers for each
language of the labelled sample, so for MAX_TRAIN languages at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize

MAX_TRAIN, BUCKETS, TEMPER = 4_000, 1 << 14, 8.0
#: Rows of one host, suffix or declaration that meet in a task.
ROWS_A_TASK = 200_000
#: Weight of what a level of the priors is smoothed towards, in rows.
HOST_WEIGHT, SUFFIX_WEIGHT, MARKUP_WEIGHT = 5.0, 20.0, 5.0
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)"
DECLARED = r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})"
#: What isn't running text of a page.
ASIDE = r"(?is)<(script|style|nav|header|footer|aside)\b.*?</\1\s*>"
MARKS = r"(?s)<!--.*?-->|<[^>]*>|&[a-zA-Z#0-9]+;"


def trigrams(text: bytes) -> np.ndarray:
    """Bucket of each byte trigram of the lower-cased (A-Z) text."""
    b = np.frombuffer(text.lower(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(18)).astype(np.int64)


def train(labelled: DataFrame, max_train: int = MAX_TRAIN) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log-probabilities of buckets, from rows (doc_id, text, lang)."""
    keyed = labelled.where("lang is not null and text is not null").withColumn("digest", F.xxhash64("text"))
    some = keyed.select(F.col("doc_id").alias("i"), F.col("lang").alias("l"), F.col("digest").alias("d"))  # without texts: they would all meet in one task
    some = some.orderBy(F.xxhash64("i"), "i", "d", "l").limit(max_train).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("lang") == F.col("l")) & (F.col("digest") == F.col("d"))
    rows = keyed.join(F.broadcast(some), same, "left_semi").dropDuplicates(["doc_id", "lang", "digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                counts[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])], ["lang", "bucket", "n"])

    counted = rows.select("lang", "text").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = counted.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n")).collect()
    langs = sorted(r.lang for r in packed)
    table = np.ones((len(langs), BUCKETS)) * 0.5
    for r in packed:
        table[langs.index(r.lang), r.b] += r.n
    return langs, np.log(table / table.sum(1, keepdims=True))


def evidence(pages: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """``pages`` (id columns, text, url, markup) with likelihoods (log, tempered, one for each language), the texts gone."""
    ids = [c for c in pages.columns if c != "text"]
    table = np.ascontiguousarray(model.T / TEMPER).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text")).cast(pa.binary())
            out = np.zeros((batch.num_rows, table.shape[1]))
            for i in range(batch.num_rows):
                at = trigrams(texts[i].as_py() or b"")
                if len(at):
                    out[i] = np.bincount(at, minlength=BUCKETS) @ table if len(at) > BUCKETS else table[at].sum(0, dtype=np.float64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in ids), lists], [*ids, "likelihoods"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != "text")
    return pages.mapInArrow(run, f"{schema}, likelihoods array<double>")


def softmax(a: Column) -> Column:
    up = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(up, lambda x: x / F.aggregate(up, F.lit(0.0), lambda s, y: s + y))


def looked_up(rows: DataFrame, table: DataFrame, key: str, row_id: Column) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row for each ``key``, with n: how many rows have it), null where there is none.

    A key of over ROWS_A_TASK rows is dealt to as many tasks as it needs: its row of ``table`` is repeated, and rows go to
    one of them by a hash. Only those keys are broadcast: one for every ROWS_A_TASK rows, at most. Rows without a key are
    dealt out as well.
    """
    parts = F.ceil(F.col("n") / ROWS_A_TASK).cast("int")
    hot = table.where(F.col("n") > ROWS_A_TASK).select(F.col(key).alias("_hot"), parts.alias("_parts"))
    spread = table.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    rows = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    deal = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(row_id), F.lit(1 << 20))).otherwise(F.pmod(F.xxhash64(row_id), F.coalesce("_parts", F.lit(1))))
    return rows.withColumn("_part", deal.cast("int")).join(spread, [key, "_part"], "left").drop("_hot", "_parts", "_part")


def fuse(rows: DataFrame, langs: list[str]) -> DataFrame:
    """``rows`` (host, suffix, declared, likelihoods and others) with text_language, language and confidence."""
    n = len(langs)
    names = F.array(*map(F.lit, langs))
    first = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    seen = F.exists("likelihoods", lambda x: x != 0)
    rows = materialize(rows.withColumn("vote", F.when(seen, softmax(F.col("likelihoods")))), "evidence")
    total = lambda by, name: rows.where("vote is not null").groupBy(*by).agg(F.array(*(F.sum(F.col("vote")[i]) for i in range(n))).alias(name), F.count("*").alias("n"))
    hosts = materialize(total(["host"], "of_host").where("host is not null"), "hosts")
    suffixes = materialize(total(["suffix"], "of_suffix").where("suffix is not null"), "suffixes")
    declared = materialize(total(["declared"], "of_declared").where("declared is not null"), "declared")
    whole = total([], "v").first()
    whole = np.array([float(x or 0.0) for x in whole.v]) if whole and whole.v else np.zeros(n)
    corpus = (whole + 1) / (whole.sum() + n)
    base = F.array(*(F.lit(float(x)) for x in corpus))
    own = F.coalesce("vote", F.array_repeat(F.lit(0.0), n))
    none = F.array_repeat(F.lit(0.0), n)

    def level(counts: str, above: Column, weight: float) -> Column:
        """Counts without the row's own vote, smoothed towards ``above``."""
        c = F.when(F.col(counts).isNull(), none).otherwise(F.zip_with(F.col(counts), own, lambda x, y: F.greatest(x - y, F.lit(0.0))))
        size = F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
        return F.zip_with(c, above, lambda x, p: (x + weight * p) / (size + weight))

    row_id = F.struct(*(F.col(c) for c in ("page_id", "doc_id") if c in rows.columns), "likelihoods")
    for table, by in ((suffixes, "suffix"), (declared, "declared"), (hosts, "host")):
        rows = looked_up(rows, table, by, row_id)
    rows = rows.withColumn("prior", level("of_suffix", base, SUFFIX_WEIGHT)).withColumn("prior", level("of_host", F.col("prior"), HOST_WEIGHT))
    # P(declaration | language) up to a factor that all languages share: P(language | declaration) / P(language)
    rows = rows.withColumn("markup", F.when(F.col("of_declared").isNotNull(), F.zip_with(level("of_declared", base, MARKUP_WEIGHT), base, lambda x, p: x / p)).otherwise(F.array_repeat(F.lit(1.0), n)))
    score = F.zip_with(F.zip_with("prior", "markup", lambda p, m: F.log(p) + F.log(m)), F.coalesce("likelihoods", none), lambda a, b: a + b)
    rows = rows.withColumn("after", softmax(score))
    return rows.withColumn("text_language", F.when(F.col("vote").isNotNull(), first(F.col("vote")))).withColumn("language", first(F.col("after"))).withColumn("confidence", F.array_max("after"))


def page_rows(pages: DataFrame) -> DataFrame:
    """page_id, host, suffix, declared, text of raw pages."""
    host = F.lower(F.regexp_extract("url", HOST, 1))
    html = F.col("html").cast("string")
    declared = F.lower(F.regexp_extract(html, DECLARED, 1))
    text = F.regexp_replace(F.regexp_replace(html, ASIDE, " "), MARKS, " ")
    blank = lambda c: F.when(c != "", c)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), blank(host).alias("host"), blank(F.regexp_extract(host, r"\.([^.]+)$", 1)).alias("suffix"), blank(declared).alias("declared"), text.alias("text"))


def languages(pages: DataFrame, documents: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """Every page (page_id) and every document (doc_id; its source stands for the host) with language, confidence, text_language and the evidence's names."""
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    langs, model = train(own, max_train)
    nil = F.lit(None).cast("string")
    if not langs:
        langs, model = ["und"], np.zeros((1, BUCKETS))
    rows = page_rows(pages).withColumn("doc_id", F.lit(None).cast("long"))
    rows = rows.unionByName(own.select(F.lit(None).cast("long").alias("page_id"), F.col("source").alias("host"), nil.alias("suffix"), nil.alias("declared"), "text", "doc_id"))
    return fuse(evidence(rows, langs, model), langs).select("page_id", "doc_id", "host", "suffix", "declared", "text_language", "language", F.round("confidence", 6).alias("confidence"))
