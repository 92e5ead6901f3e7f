"""The query surface: seven calls over one or several stores. Results are DataFrames; render() turns small ones into text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import files as P, text as T
from ..functions.embedding import Embedder, HashingEmbedder
from ..operators import bm25, fusion, knn, references as R, symbols as S
from ..sources import external
from ..sources.store import Store, find_indices
from .index import CHUNK, SYMBOL

OVERFETCH, OVERFETCH_FILTERED, PER_SIDE, TREE_LINES = 2, 10, 2, 200
KEYS = ["file_path", "start_line", "end_line"]


#: Tables of an index, for those that a store has not.
SCHEMAS = {
    "files": "path string, sha256 string, language string, size long, file_class string, text string, chunk_count int",
    "symbols": f"{SYMBOL}, name_lc string", "chunks": f"{CHUNK}, chunk_id long",
    "vectors": "chunk_id long, file_path string, chunk_type string, language string, embedding array<float>",
    "postings": "token string, doc_id long, tf long", "lengths": "doc_id long, dl long", "idf": "token string, df long, idf double", "stats": "n long, avgdl double",
}


class Index:
    """One store with its tables; a missing table is empty, keyword tables are made from the chunks."""

    def __init__(self, spark: SparkSession, prefix: str, path: str, database: str | None = None):
        self.spark, self.prefix, self.path, self.store = spark, prefix, path, Store(spark, path)
        self.config = self.store.config()
        self.repo = self.config.get("repo", path)
        self.database = database or next(iter(external.find_databases(self.repo)), None)

    def external(self, symbol: str) -> dict[str, DataFrame]:
        return external.load(self.spark, self.database, symbol)

    def _made(self, name: str) -> DataFrame | None:
        chunks = self.store.table("chunks")
        if chunks is None or name not in ("postings", "lengths", "idf", "stats"):
            return None
        tokens = bm25.token_counts(chunks, "chunk_id", "text")
        posts, lengths = bm25.postings(tokens), bm25.doc_lengths(tokens)
        stats = bm25.corpus_stats(lengths)
        return {"postings": posts, "lengths": lengths, "stats": stats}.get(name) or bm25.idf_table(posts, stats)

    def table(self, name: str) -> DataFrame:
        found = self.store.table(name)
        found = self._made(name) if found is None else found
        found = self.spark.createDataFrame([], SCHEMAS[name]) if found is None else found
        return found.withColumn("index_name", F.lit(self.prefix))


class Catalog:
    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None, indices: list[Index] | None = None):
        self.spark, self.embedder = spark, embedder or HashingEmbedder()
        self.indices = [Index(spark, prefix, path) for prefix, path in find_indices(root)] if indices is None else indices

    def _of(self, index_name: str | None) -> list[Index]:
        """The named index; all of them without a name; the only one whatever the name."""
        if index_name is None or len(self.indices) == 1:
            return self.indices
        found = [i for i in self.indices if i.prefix == index_name]
        if not found:
            raise ValueError(f"no index {index_name}; there are {[i.prefix for i in self.indices]}")
        return found

    def _one(self, index_name: str | None) -> Index:
        """The index to search: ranks of several can't be compared, so one has to be named where there are several."""
        found = self._of(index_name)
        if len(found) != 1:
            raise ValueError(f"name one index of {[i.prefix for i in self.indices]}")
        return found[0]

    def table(self, name: str, index_name: str | None = None) -> DataFrame:
        none = self.spark.createDataFrame([], SCHEMAS[name]).withColumn("index_name", F.lit(""))
        return reduce(DataFrame.unionByName, (i.table(name) for i in self._of(index_name))) if self.indices else none

    def _resolve(self, file_path: str) -> tuple[Index, str] | None:
        path = file_path.replace("\\", "/")
        for i in self.indices:
            if i.prefix == "":
                return i, path
            if path.startswith(i.prefix + "/"):
                return i, path[len(i.prefix) + 1 :]
        for i in self.indices:
            if not i.table("files").where(F.col("path") == path).isEmpty():
                return i, path
        return None

    # 1
    def read_code(self, file_path: str, start_line: int, end_line: int, context_lines: int = 0) -> DataFrame:
        """One row: path, start, end, total, code (numbered lines); none for a file that isn't indexed."""
        found = self._resolve(file_path)
        if found is None:
            return self.table("files").where("false").select("path")
        first = max(1, start_line - context_lines)
        rows = found[0].table("files").where(F.col("path") == found[1])
        total = F.size(T.lines(F.col("text")))
        return rows.select("path", F.lit(first).alias("start_line"), F.least(total, F.lit(end_line + context_lines)).alias("end_line"), total.alias("total_lines"), F.array_join(T.line_range(F.col("text"), first, end_line + context_lines), "\n").alias("code"))

    # 2
    def list_indices(self) -> DataFrame:
        counts = self.table("files").groupBy("index_name").agg(F.count("*").alias("files"))
        known = self.spark.createDataFrame([(i.prefix, i.config.get("repo", i.path), self.embedder.name) for i in self.indices], "index_name string, repo string, model string")
        return known.join(counts, "index_name", "left").fillna(0, ["files"]).orderBy("index_name")

    def semantic(self, query: str, top_k: int = 10, language: str | None = None, chunk_type: str | None = None, index_name: str | None = None) -> DataFrame:
        """chunk_id, score, rank of the nearest chunks of that language and type."""
        where = reduce(Column.__and__, [F.col(c) == v for c, v in (("chunk_type", chunk_type), ("language", language)) if v], F.lit(True))
        near = knn.top(self._one(index_name).table("vectors"), [float(x) for x in self.embedder.query(query)], top_k, where, "chunk_id")
        return fusion.ranked(near, F.desc("score"), F.col("chunk_id"))

    def keyword(self, query: str, top_k: int = 10, index_name: str | None = None) -> DataFrame:
        """chunk_id, score, rank of the chunks that match best, of whatever type."""
        index = self._one(index_name)
        lengths = index.table("lengths").drop("index_name")
        scored = bm25.scores(index.table("postings").drop("index_name"), lengths, bm25.query_tokens(self.spark, query), index.table("idf"), index.table("stats").drop("index_name"))
        return fusion.ranked(bm25.top(scored, lengths, top_k).withColumnRenamed("doc_id", "chunk_id"), F.desc("score"), F.desc("chunk_id"))

    def _fused(self, index: Index, query: str, depth: int, language: str | None, chunk_type: str) -> DataFrame:
        chunks, side = index.table("chunks"), depth * PER_SIDE
        spans = chunks.select("chunk_id", *KEYS, "language", "chunk_type")
        near = self.semantic(query, side, language, chunk_type, index.prefix).join(spans, "chunk_id")
        words = self.keyword(query, side, index.prefix).drop("rank").join(spans, "chunk_id")
        words = words.where(F.col("language") == language) if language else words
        words = fusion.ranked(words, F.desc("score"), F.desc("chunk_id"))
        fused = fusion.page(fusion.fuse(near, words), depth)
        best = near.select(*KEYS, "chunk_id", F.lit(0).alias("side"), "rank").unionByName(words.select(*KEYS, "chunk_id", F.lit(1).alias("side"), "rank"))
        # the shown text: on the vector side the last of equal keys, else the first of the keyword side
        best = best.groupBy(*KEYS).agg(F.coalesce(F.max_by("chunk_id", F.when(F.col("side") == 0, F.col("rank"))), F.min_by("chunk_id", F.when(F.col("side") == 1, F.col("rank")))).alias("chunk_id"))
        shown = fused.join(best, KEYS).join(chunks.drop(*KEYS), "chunk_id")
        return shown.where(F.col("chunk_type") == chunk_type)

    def hybrid(self, query: str, want: int, language: str | None = None, index_name: str | None = None, exclude_paths: list[str] | None = None, chunk_type: str = "code") -> DataFrame:
        """The ``want`` best chunks of both lists together, with rank (from 1), after the path filter."""
        index, out = self._one(index_name), P.excluded_paths(exclude_paths)
        hits = self._fused(index, query, want * (OVERFETCH_FILTERED if out else OVERFETCH), language, chunk_type)
        hits = hits.where(~P.path_has_any(F.col("file_path"), out)) if out else hits
        best = hits.withColumnRenamed("rank", "_first").drop("first")
        order = [F.desc("score"), F.col("_first")]
        return fusion.ranked(best.orderBy(*order).limit(want), *order)

    def _search(self, query: str, top_k: int, offset: int, language: str | None, index_name: str | None, exclude_paths: list[str] | None, chunk_type: str) -> DataFrame:
        index = self._one(index_name)
        best = self.hybrid(query, top_k + offset, language, index_name, exclude_paths, chunk_type).where(F.col("rank") > offset)
        full, each = R.snippet_limits(F.lit(top_k), F.col("rank") - 1 - offset)
        header = F.coalesce(F.col("metadata.header_lines"), F.lit(0))
        view = R.snippet(F.col("text"), F.col("start_line"), F.col("end_line"), header, F.col("chunk_type"), full)
        long = (F.col("chunk_type") == "code") & (F.size(T.lines(F.col("text"))) - header > full)
        inside = S.within_chunks(best.where(long).select("chunk_id", *KEYS), index.table("symbols").select("file_path", "start_line", "end_line", "kind", "name", "seq"))
        inside = inside.groupBy("c.chunk_id").agg(F.array_sort(F.collect_list(F.struct("s.start_line", "s.seq", "s.end_line", "s.kind", "s.name"))).alias("inside"))
        best = best.join(inside, "chunk_id", "left")
        view = F.when(F.col("inside").isNull(), view).otherwise(R.previews(F.col("text"), F.col("start_line"), header, F.col("inside"), each))
        return best.select((F.col("rank") - 1).alias("rank"), P.qualified(F.col("index_name"), F.col("file_path")).alias("path"), "start_line", "end_line", "language", "symbol_name", "symbol_kind", F.round("score", 4).alias("score"), view.alias("snippet")).orderBy("rank")

    # 3, 4
    def search_code(self, query: str, top_k: int = 8, offset: int = 0, language: str | None = None, index_name: str | None = None, exclude_paths: list[str] | None = None) -> DataFrame:
        return self._search(query, top_k, offset, language, index_name, exclude_paths, "code")

    def search_docs(self, query: str, top_k: int = 8, offset: int = 0, index_name: str | None = None, exclude_paths: list[str] | None = None) -> DataFrame:
        return self._search(query, top_k, offset, None, index_name, exclude_paths, "doc")

    # 5
    def get_file_symbols(self, file_path: str) -> DataFrame:
        found = self._resolve(file_path)
        rows = self.table("symbols").where("false") if found is None else found[0].table("symbols").where(F.col("file_path") == found[1])
        return rows.select("name", "kind", "start_line", "end_line", "language", "seq").orderBy("seq")

    # 6
    def get_repo_structure(self, depth: int = 3, path: str = "", index_name: str | None = None) -> DataFrame:
        """What a listing shows, in its order, with language and number of chunks of files."""
        files = self.table("files", index_name).withColumn("path", P.qualified(F.col("index_name"), F.col("path")))
        files = files.where(F.col("path").startswith(path.rstrip("/") + "/")) if path else files
        inner = files.withColumn("path", F.expr(f"substring(path, {len(path.rstrip('/')) + 2 if path else 1})"))
        full = F.when(F.col("parent") == "", F.col("name")).otherwise(F.concat_ws("/", "parent", "name"))
        nodes = R.tree(inner.select("path"), depth)
        nodes = nodes.withColumn("order", R.depth_first(nodes)).withColumn("path", full)
        return nodes.join(inner.select("path", "language", "chunk_count"), "path", "left").orderBy("order").limit(TREE_LINES).drop("order")

    # 7
    def _found(self, symbol: str, exact_match: bool, index_name: str | None) -> DataFrame:
        """Symbols in the order in which they are found: index by index, what the external database has or else the catalog's, exact names first."""
        out = []
        for n, i in enumerate(self._of(index_name)):
            e = i.external(symbol)
            outer = S.external_symbols(e["code_items"], e["files"], e["code_item_kinds"], symbol)
            outer = outer.withColumn("at", F.row_number().over(W.orderBy("file", "start_line", "id")))  # at most 50 rows
            outer = P.with_stored_case(outer, i.table("files"), i.repo).select(F.lit(i.prefix).alias("index_name"), "name", "kind", "file", F.col("start_line").cast("int"), F.col("end_line").cast("int"), P.reference_language(F.col("file")).alias("language"), "at")
            own = S.lookup(i.table("symbols"), symbol, exact_match, order=("file_path", "seq"))
            own = own.withColumn("at", F.row_number().over(W.orderBy(F.desc("is_exact"), "file_path", "seq")))  # at most 200 rows
            own = own.select("index_name", "name", "kind", F.col("file_path").alias("file"), "start_line", "end_line", "language", "at")
            out.append(S.tiered(outer, own).withColumn("at", F.struct(F.lit(n).alias("index"), F.col("at"))))
        return reduce(DataFrame.unionByName, out)

    def get_symbol_info(self, symbol: str, mode: str = "grouped", max_results: int = 20, exact_match: bool = True, include_code: bool = False, include_references: bool = False, max_refs: int = 30, index_name: str | None = None) -> DataFrame:
        """all and declaration: a row for each symbol; grouped: a row for each merged range of a file, files in the order found.

        ``code``: the lines shown, where asked for; ``hidden``: symbols of the range below them. ``references``: array of
        (path, line, text), where asked for, of the (first) symbol, outside its own lines.
        """
        rows = self._found(symbol, exact_match, index_name)
        if mode == "grouped":
            rows = S.described(rows, "index_name", "file", "language")
            first = F.min("first_at").over(W.partitionBy("index_name", "file"))
            rows = rows.withColumn("first", first).orderBy("first", "start_line").limit(max_results)
            order = ["first", "start_line"]
        else:
            rows = S.declarations(rows) if mode == "declaration" else rows
            rows, order = rows.orderBy("at").limit(max_results).withColumn("shown_end", F.col("end_line")), ["at"]
        files = self.table("files", index_name)
        if include_code:
            texts = files.select("index_name", F.col("path").alias("file"), F.col("text").alias("_text"))
            ls = T.lines(F.col("_text"))
            code = F.array_join(F.slice(ls, F.col("start_line"), F.greatest(F.lit(0), F.least(F.col("shown_end"), F.size(ls)) - F.col("start_line") + 1)), "\n")
            rows = rows.join(texts, ["index_name", "file"], "left").withColumn("code", code).drop("_text")
        if include_references:
            rows = rows.join(self._references(rows, files, max_refs), ["index_name", "file", "start_line", "name"], "left")
        return rows.orderBy(*order).drop("first", "first_at", "at")

    def _references(self, rows: DataFrame, files: DataFrame, most: int) -> DataFrame:
        """index_name, file, start_line, name, references of symbols: a few rows (what a call shows), so that every file meets all of them in one pass."""
        asked = rows.select("index_name", "file", "start_line", "end_line", "name", "language").distinct()
        texts = files.where((P.reference_language(F.col("path")) != "") & (F.octet_length("text") <= P.MAX_REFERENCE_BYTES)).select(F.col("index_name").alias("_index"), "path", "text")
        hits = texts.join(F.broadcast(asked), (F.col("_index") == F.col("index_name")) & F.contains("text", F.col("name")))
        lines = hits.select("index_name", "file", "start_line", "end_line", "name", "language", "path", F.posexplode(T.lines(F.col("text"))).alias("_at", "line_text")).withColumn("line", F.col("_at") + 1)
        lines = lines.where(F.contains("line_text", F.col("name")) & ~((F.col("path") == F.col("file")) & F.col("line").between(F.col("start_line"), F.col("end_line"))))
        other = (P.reference_language(F.col("path")) != F.coalesce("language", F.lit(""))).cast("int")
        turn = W.partitionBy("index_name", "file", "start_line", "name").orderBy(other, "path", "line")
        best = lines.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= most)
        listed = F.array_sort(F.collect_list(F.struct("turn", "path", "line", F.col("line_text").alias("text"))))
        out = best.groupBy("index_name", "file", "start_line", "name").agg(listed.alias("r"))
        return out.select("index_name", "file", "start_line", "name", F.transform("r", lambda x: F.struct(x.path.alias("path"), x.line.alias("line"), x.text.alias("text"))).alias("references"))

    # what a store knows of a file
    def file_info(self, file_path: str, index_name: str | None = None) -> DataFrame:
        """index_name, path, sha256 (its fingerprint), language, size, chunk_count; no row for a file that isn't indexed."""
        return self.table("files", index_name).where(F.col("path") == file_path).select("index_name", "path", "sha256", "language", "size", "chunk_count")

    def all_files(self, index_name: str | None = None) -> DataFrame:
        return self.table("files", index_name).select("index_name", "path").orderBy("index_name", "path")

    def chunks_of(self, file_path: str, index_name: str | None = None) -> DataFrame:
        """The chunks of a file by id, with what their vectors' table says."""
        return self.table("chunks", index_name).where(F.col("file_path") == file_path).orderBy("chunk_id")

    def inheritance(self, symbol: str, index_name: str | None = None) -> DataFrame:
        """index_name, relation (base or derived), name, file of what an external database knows."""
        out = []
        for i in self._of(index_name):
            e = i.external(symbol)
            base = S.base_classes(e["base_class_parents"], e["code_items"], symbol).select(F.lit(i.prefix).alias("index_name"), F.lit("base").alias("relation"), F.col("base").alias("name"), F.lit(None).cast("string").alias("file"))
            derived = S.derived_classes(e["base_class_parents"], e["code_items"], e["files"], symbol).select(F.lit(i.prefix).alias("index_name"), F.lit("derived").alias("relation"), "name", "file")
            out += [base, derived]
        return reduce(DataFrame.unionByName, out)

    def references(self, symbol: str, language: str, definition: tuple[str, int, int] | None = None, max_refs: int = 30, index_name: str | None = None) -> DataFrame:
        """Lines of code files that hold the symbol, outside its definition."""
        files = self.table("files", index_name).where(P.reference_language(F.col("path")) != "")
        refs = R.reference_lines(files, symbol)
        refs = R.outside_definition(refs, *definition) if definition else refs
        return R.ranked_references(refs, P.reference_language(F.col("path")), language, max_refs)


def render(rows: DataFrame) -> str:
    """A few rows as text: a separator, the values in one line, the last column below it."""
    out = []
    for r in rows.collect():
        values = [f"{v}" for v in r if v is not None]
        out.append("---\n" + "  ".join(values[:-1]) + "\n" + values[-1] if values else "---")
    return "\n".join(out)
