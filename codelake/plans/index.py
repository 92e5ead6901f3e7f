"""From a repository to tables: files, symbols, chunks, postings, vectors; only changed files are parsed again."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import parsing, text as T
from ..functions.embedding import Embedder, embedded
from ..functions.files import MAX_CHUNK_CHARS, MAX_SYMBOL_BYTES, SHADERS
from ..operators import bm25, delta
from ..sources import files as source
from ..sources.store import Store

CHUNK = "text string, file_path string, start_line int, end_line int, chunk_type string, language string, symbol_name string, symbol_kind string, metadata struct<header_lines:int,window:int,heading_level:int,file_type:string>"
SYMBOL = "name string, kind string, file_path string, start_line int, end_line int, language string, parent int, depth int, doc string, seq long"


@dataclass(frozen=True)
class Stats:
    files_processed: int
    chunks_created: int
    files_skipped: int
    files_deleted: int
    elapsed_seconds: float


def extract_symbols(files: DataFrame, seconds: float = parsing.SECONDS) -> DataFrame:
    """SYMBOL rows of code files of at most MAX_SYMBOL_BYTES; ``seq`` keeps the order in a file. A file that takes longer than ``seconds`` has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, language, text in zip(frame["path"], frame["language"], frame["text"]):
                try:
                    with parsing.limited(seconds):
                        found = parsing.symbols(text, language)
                except (SyntaxError, ValueError, RecursionError, TimeoutError):
                    continue
                line = parsing.line_finder(text)
                depth: list[int] = []
                for i, s in enumerate(found):
                    depth.append(depth[s.parent] + 1 if s.parent >= 0 else 0)
                    rows.append((s.name, s.kind, path, line(s.start), line(max(s.start, s.end - 1)), parsing.grammar(language), s.parent, depth[i], s.doc, i))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in SYMBOL.split(", ")])

    code = files.where((F.col("file_class") == "code") & (F.octet_length("text") <= MAX_SYMBOL_BYTES))
    return code.select("path", "language", "text").mapInPandas(run, SYMBOL)


def code_chunks(files: DataFrame, width: int, seconds: float = parsing.SECONDS) -> DataFrame:
    """Chunks of code files; those too large or too slow to parse become windows."""
    fields = "text string, start_line int, end_line int, symbol_name string, symbol_kind string, header_lines int, window int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, language, text in zip(frame["path"], frame["language"], frame["text"]):
                small = len(text) * 4 <= MAX_SYMBOL_BYTES or len(text.encode()) <= MAX_SYMBOL_BYTES
                try:
                    with parsing.limited(seconds):
                        found = parsing.code_chunks(text, language if small else "large", width)
                except TimeoutError:
                    found = parsing.code_chunks(text, "large", width)
                rows += [(path, language, *c.values()) for c in found]
            out = pd.DataFrame(rows, columns=["file_path", "language", *(f.split()[0] for f in fields.split(", "))])
            yield out.astype({"window": "Int32", "header_lines": "Int32"})

    rows = files.where("file_class = 'code'").select("path", "language", "text").mapInPandas(run, f"file_path string, language string, {fields}")
    return _chunk(rows, "code", F.col("language"), header_lines=F.col("header_lines"), window=F.col("window"))


def _chunk(rows: DataFrame, kind: str, language, **meta) -> DataFrame:
    types = {"header_lines": "int", "window": "int", "heading_level": "int", "file_type": "string"}
    made = F.struct(*(meta.get(k, F.lit(None)).cast(t).alias(k) for k, t in types.items()))
    own = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("symbol_name", "symbol_kind")]
    return rows.select("text", "file_path", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), F.lit(kind).alias("chunk_type"), language.cast("string").alias("language"), *own, made.alias("metadata"))


def _windowed(rows: DataFrame, width: int) -> DataFrame:
    """Rows whose text is too long become windows, numbered; others stay whole, with a null number."""
    long = T.count_words(F.col("text")) > width
    parts = F.when(long, T.word_windows(F.col("text"), width)).otherwise(F.array("text"))
    rows = rows.select("*", long.alias("_long"), F.posexplode(parts).alias("_at", "_t"))
    return rows.withColumn("text", F.col("_t")).withColumn("window", F.when(F.col("_long"), F.col("_at"))).drop("_long", "_t", "_at")


def doc_chunks(files: DataFrame, width: int) -> DataFrame:
    docs = files.where("file_class = 'doc'").select(F.col("path").alias("file_path"), "text")
    rows = _windowed(T.heading_sections(docs, "file_path", "text"), width)
    return _chunk(rows, "doc", F.lit(None), window=F.col("window"), heading_level=F.when(F.col("heading_level") > 0, F.col("heading_level")))


def config_chunks(files: DataFrame, width: int) -> DataFrame:
    rows = files.where("file_class = 'config' and trim(text) <> ''").select(F.col("path").alias("file_path"), "text", "language", F.lit(1).alias("start_line"), F.greatest(F.lit(1), F.size(T.lines(F.col("text")))).alias("end_line"))
    return _chunk(_windowed(rows, width), "config", F.lit(None), window=F.col("window"), file_type=F.col("language"))


def chunked(files: DataFrame, width: int = 4096) -> DataFrame:
    """Chunks of all files, without ids."""
    return code_chunks(files, width).unionByName(doc_chunks(files, width)).unionByName(config_chunks(files, width))


def inserted(chunks: DataFrame) -> DataFrame:
    """Chunks as they are stored: texts of at most MAX_CHUNK_CHARS characters."""
    return chunks.withColumn("text", F.substring("text", 1, MAX_CHUNK_CHARS))


def build(spark: SparkSession, repo: str, store: Store, embedder: Embedder | None = None, width: int | None = None, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None, custom: Sequence[str] | None = None) -> Stats:
    """Brings the store to the repository's state. Arguments left out are those of the run before, which the store keeps."""
    old = store.config()
    kept = lambda value, name, default: list(old.get(name, default)) if value is None else list(value)
    config = {"repo": repo, "include": kept(include, "include", ()), "exclude": kept(exclude, "exclude", ()), "custom": kept(custom, "custom", SHADERS[:3]), "width": width or int(old.get("width", 4096))}
    listed = source.listing(spark, repo, config["include"], config["exclude"], config["custom"])
    return build_from(source.decoded(source.contents(listed, repo)), store, embedder, config)


def build_from(files: DataFrame, store: Store, embedder: Embedder | None = None, config: dict | None = None) -> Stats:
    """The same from a table of files (path, size, language, file_class, sha256, text, status).

    Unchanged files keep their rows, changed and unfinished ones are made anew; those with an error now keep what is stored
    of them. Postings, lengths and vectors of kept chunks are carried over; only new chunks are tokenized and embedded.
    """
    began, config = time.time(), config or store.config()
    width = int(config.get("width", 4096))
    files = files.persist()
    old = {name: store.table(name) for name in ("files", "symbols", "chunks", "vectors", "postings", "lengths")}
    good = files.where("status = 'ok'")
    if old["files"] is None or old["chunks"] is None:
        status = good.select("path", F.lit("new").alias("status"))
    else:
        status = delta.snapshot_diff(old["files"], good)
        failed = files.where("status <> 'ok'").select("path", F.lit(True).alias("failed"))
        resumed = delta.unfinished(old["files"], old["chunks"].select(F.col("file_path").alias("path")).distinct()).select("path", F.lit(True).alias("again"))
        status = status.join(resumed, "path", "left").join(failed, "path", "left")
        again = F.col("again") & (F.col("status") == "unchanged")
        status = status.select("path", F.when(F.col("failed") & (F.col("status") == "deleted"), "failed").when(again, "resumed").otherwise(F.col("status")).alias("status"))
    status = status.persist()
    changed = good.join(status.where("status in ('new', 'modified', 'resumed')"), "path", "left_semi").persist()
    top_id = None if old["chunks"] is None else old["chunks"].agg(F.max("chunk_id").alias("m")).first().m
    new_chunks = delta.with_new_ids(chunked(changed, width).withColumn("seq", F.xxhash64("text")), top_id, ["file_path", "start_line", "end_line", "seq"]).drop("seq").persist()
    counts = new_chunks.groupBy(F.col("file_path").alias("path")).agg(F.count("*").cast("int").alias("chunk_count"))
    new_files = changed.join(counts, "path", "left").select("path", "sha256", "language", "size", "file_class", "text", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))
    new_tokens = bm25.token_counts(new_chunks, "chunk_id", "text").persist()
    vectors = new_chunks.select("chunk_id", "file_path", "chunk_type", "language", embedded(F.col("text"), embedder).alias("embedding"))
    new = {"files": new_files, "symbols": extract_symbols(changed), "chunks": inserted(new_chunks), "vectors": vectors, "postings": bm25.postings(new_tokens), "lengths": bm25.doc_lengths(new_tokens)}
    gone = status.where("status in ('deleted', 'modified', 'resumed')").select("path")
    tables = {}
    if old["chunks"] is not None:  # a postings table that is missing or broken is made again from the chunks
        gone_ids = old["chunks"].join(gone.withColumnRenamed("path", "file_path"), "file_path", "left_semi").select(F.col("chunk_id").alias("doc_id"))
        if old["postings"] is None or old["lengths"] is None:
            again = bm25.token_counts(old["chunks"], "chunk_id", "text")
            old["postings"], old["lengths"] = bm25.postings(again), bm25.doc_lengths(again)
    for name, made in new.items():
        if old[name] is None or old["chunks"] is None:
            tables[name] = made
        elif name in ("postings", "lengths"):
            tables[name] = delta.without(old[name], gone_ids, "doc_id").unionByName(made)
        else:
            key = "path" if name == "files" else "file_path"
            tables[name] = delta.without(old[name], gone.select(F.col("path").alias(key)), key).unionByName(made, allowMissingColumns=True)
    tables["idf"] = bm25.idf_table(tables["postings"], bm25.corpus_stats(tables["lengths"])).repartitionByRange("token").sortWithinPartitions("token")
    tables["stats"] = bm25.corpus_stats(tables["lengths"])
    tables["postings"] = tables["postings"].repartitionByRange("token").sortWithinPartitions("token")  # sorted, for scans that skip
    tables["symbols"] = tables["symbols"].withColumn("name_lc", F.lower("name")).sortWithinPartitions("name_lc")
    n = delta.statistics(status).first()
    made = new_chunks.count()
    store.commit(tables, config)
    for df in (files, status, changed, new_chunks, new_tokens):
        df.unpersist()
    return Stats(n.files_processed, made, n.files_skipped, n.files_deleted, time.time() - began)
