"""Registered queries of the parser, chunks, file reading, stores and the catalog.

The source code is made from ``part``: every row becomes a file in one of eleven languages, with its key in the names, so
that what the parser has to find is known from the table and SQL can say it.
"""

from __future__ import annotations

import os
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import embedding as M, files as P, text as T
from .operators import bm25, delta, symbols as S
from .plans import index as I
from .plans.api import Catalog, Index
from .queries import WORDS_SQL, read, register
from .sources import files as source
from .sources.store import Store, shared_dir
from .streaming.ingest import merge_batch, windowed_counts

#: Language: extension, text, symbols (name, kind, first line, last line, depth, doc). {k} is the row's key.
SOURCES: dict[str, tuple[str, str, list[tuple[str, str, int, int, int, str]]]] = {
    "python": (
        "py",
        'import os\n\n# box number {k}\n# second line\nclass Box{k}(object):\n    """Holds {k}."""\n\n    def size(self):\n        def inner():\n            return {k}\n        return inner()\n\n\nasync def load{k}(path):\n    """Loads."""\n    return path\n',
        [("Box{k}", "class", 5, 11, 0, "# box number {k}\n# second line"), ("size", "method", 8, 11, 1, ""), ("inner", "function", 9, 10, 2, ""), ("load{k}", "function", 14, 16, 0, "Loads.")],
    ),
    "cpp": (
        "cpp",
        "#include <x.h>\nclass Fwd{k};\n// holds {k}\nclass Box{k} : public Base {\n public:\n  int size() { return {k}; }\n};\nstruct Pt{k} { int x; };\nint Box{k}::area{k}(int a) {\n  if (a) { return 1; }\n  return 0;\n}\nbool operator==(const Pt{k}& a, const Pt{k}& b) { return true; }\n",
        [("Box{k}", "class", 4, 7, 0, "// holds {k}"), ("size", "method", 6, 6, 1, ""), ("Pt{k}", "class", 8, 8, 0, ""), ("area{k}", "function", 9, 12, 0, ""), ("operator==", "function", 13, 13, 0, "")],
    ),
    "c": (
        "c",
        "/* {k} */\nstruct P{k} { int x; };\nenum E{k} { A{k}, B{k} };\nint f{k}(void) {\n  for (;;) { return {k}; }\n}\n",
        [("P{k}", "struct", 2, 2, 0, "/* {k} */"), ("E{k}", "enum", 3, 3, 0, ""), ("f{k}", "function", 4, 6, 0, "")],
    ),
    "java": (
        "java",
        "package p;\npublic class Box{k} {\n  private int x = {k};\n  public int size() { return x; }\n}\ninterface Shape{k} { void draw(); }\n",
        [("Box{k}", "class", 2, 5, 0, ""), ("size", "method", 4, 4, 1, ""), ("Shape{k}", "interface", 6, 6, 0, ""), ("draw", "method", 6, 6, 1, "")],
    ),
    "csharp": (
        "cs",
        "namespace N{k} {\n  public class Box {\n    public Box() { }\n    public int Size { get; set; }\n    int Area() { return {k}; }\n  }\n}\n",
        [("N{k}", "namespace", 1, 7, 0, ""), ("Box", "class", 2, 6, 1, ""), ("Box", "constructor", 3, 3, 2, ""), ("Size", "property", 4, 4, 2, ""), ("Area", "method", 5, 5, 2, "")],
    ),
    "javascript": (
        "js",
        "// adds {k}\nfunction add{k}(a) {\n  return a;\n}\nclass Box{k} {\n  size() { return {k}; }\n}\n",
        [("add{k}", "function", 2, 4, 0, "// adds {k}"), ("Box{k}", "class", 5, 7, 0, ""), ("size", "method", 6, 6, 1, "")],
    ),
    "typescript": (
        "ts",
        "interface Shape{k} {\n  area: number;\n}\nfunction make{k}(): number {\n  return {k};\n}\n",
        [("Shape{k}", "interface", 1, 3, 0, ""), ("make{k}", "function", 4, 6, 0, "")],
    ),
    "lua": (
        "lua",
        "-- about f\nlocal function f{k}(x)\n  if x then return 1 end\n  return {k}\nend\nfunction M.g{k}() end\n",
        [("f{k}", "function", 2, 5, 0, "-- about f"), ("M.g{k}", "function", 6, 6, 0, "")],
    ),
    "rust": (
        "rs",
        "struct S{k} { a: i32 }\nimpl S{k} {\n    fn get(&self) -> i32 { {k} }\n}\nfn main{k}() { }\n",
        [("S{k}", "struct", 1, 1, 0, ""), ("S{k}", "impl", 2, 4, 0, ""), ("get", "method", 3, 3, 1, ""), ("main{k}", "function", 5, 5, 0, "")],
    ),
    "go": (
        "go",
        "package p\n\n// T holds {k}\ntype T{k} struct {\n\ta int\n}\n\nfunc (t *T{k}) Get() int { return {k} }\n\nfunc make{k}() { }\n",
        [("T{k}", "type", 4, 6, 0, "// T holds {k}"), ("Get", "method", 8, 8, 0, ""), ("make{k}", "function", 10, 10, 0, "")],
    ),
    "glsl": ("glsl", "void shade{k}() { float x = {k}.0; } // { no brace\n", [("shade{k}", "function", 1, 1, 0, "")]),
}
LANGUAGES = list(SOURCES)
#: Grammar of a language where that is another one.
GRAMMAR = {"glsl": "c"}


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def filled(x: str) -> str:
    """SQL of a text with {k} as the row's key."""
    return f"replace({quoted(x)}, '{{k}}', p_partkey::varchar)"


FILE_SQL = "'src/' || (p_partkey % 40) || '/f' || p_partkey || '.' || " + f"list_extract({[SOURCES[x][0] for x in LANGUAGES]}, (p_partkey % {len(LANGUAGES)} + 1)::int)"
TEXT_SQL = "case p_partkey % " + f"{len(LANGUAGES)} " + " ".join(f"when {i} then {filled(SOURCES[x][1])}" for i, x in enumerate(LANGUAGES)) + " end"


def of_rows(rows: list[tuple[int, tuple]], names: str) -> str:
    """Known rows of every language as SQL: (number of the language, SQL values)."""
    return "(" + " union all ".join(f"select p_partkey, {', '.join(f'{v} as {n.strip()}' for v, n in zip(values, names.split(',')))} from part where p_partkey % {len(LANGUAGES)} = {i}" for i, values in rows) + ")"


SYMBOL_ROWS = [(i, (filled(n), quoted(kind), str(a), str(b), str(d), filled(doc), quoted(GRAMMAR.get(x, x)), str(at))) for i, x in enumerate(LANGUAGES) for at, (n, kind, a, b, d, doc) in enumerate(SOURCES[x][2])]
SYMBOLS_SQL = of_rows(SYMBOL_ROWS, "name, kind, start_line, end_line, depth, doc, language, seq")


def chunk_text(language: str, a: int, b: int, doc: str) -> str:
    """What a chunk of these lines holds: its comment, then the lines up to the closing brace or end."""
    body = "\n".join(SOURCES[language][1].split("\n")[a - 1 : b])
    body = body.split(" // {")[0]  # what stands behind the brace is no part of it
    return (f"# {doc}\n" if doc else "") + (body.removesuffix(";") if language in ("cpp", "c") else body)


CHUNK_ROWS = [(i, (filled(n), quoted(kind), str(a), str(b), str(doc.count("\n") + 1 if doc else 0), filled(chunk_text(x, a, b, doc)))) for i, x in enumerate(LANGUAGES) for n, kind, a, b, d, doc in SOURCES[x][2] if d == 0]
CHUNKS_SQL = of_rows(CHUNK_ROWS, "symbol_name, symbol_kind, start_line, end_line, header_lines, text")


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as files of source code: path, size, language, file_class, sha256, text, status."""
    at = F.col("p_partkey") % len(LANGUAGES)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    key = F.col("p_partkey").cast("string")
    text = F.replace(pick([SOURCES[x][1] for x in LANGUAGES]), F.lit("{k}"), key)
    path = F.concat(F.lit("src/"), (F.col("p_partkey") % 40).cast("string"), F.lit("/f"), key, F.lit("."), pick([SOURCES[x][0] for x in LANGUAGES]))
    rows = read(spark, sf_dir, "part").select("p_partkey", path.alias("path"), text.alias("text"))
    rows = rows.withColumn("language", P.language(F.col("path"), ["glsl"])).withColumn("file_class", P.file_class(F.col("language"), ["glsl"]))
    return rows.select("path", F.octet_length("text").cast("long").alias("size"), "language", "file_class", F.sha2("text", 256).alias("sha256"), "text", F.lit("ok").alias("status"))


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark as Markdown files."""
    rows = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("docs/b"), F.col("item_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("# Item\n"), F.col("text")).alias("text"))
    return rows.select("path", F.octet_length("text").cast("long").alias("size"), F.lit("markdown").alias("language"), F.lit("doc").alias("file_class"), F.sha2("text", 256).alias("sha256"), "text", F.lit("ok").alias("status"))


@lru_cache(maxsize=4)
def _built(application: str, sf_dir: str) -> str:
    spark = SparkSession.getActiveSession()
    path = f"{shared_dir(spark)}/index-{application}-{os.path.basename(sf_dir.rstrip('/'))}"
    store = Store(spark, path)
    if store.version == 0:
        I.build_from(code_files(spark, sf_dir).unionByName(doc_files(spark, sf_dir)), store, config={"repo": "/r", "width": 4096})
    return path


def catalog(spark: SparkSession, sf_dir: str, *prefixes: str) -> Catalog:
    """A catalog over an index of all of part's and benchmark's files, made once in a session."""
    path = _built(spark.sparkContext.applicationId, sf_dir)
    return Catalog(spark, "", indices=[Index(spark, p, path) for p in prefixes or ("",)])


# Parser and chunks --------------------------------------------------------------------------------------------------------
FILES = f"files as (select p_partkey, {FILE_SQL} as path, {TEXT_SQL} as text from part)"
FILE_OF = "join files using (p_partkey)"


@register(f"with {FILES} select path as file_path, name, kind, start_line, end_line, depth, doc, s.language, seq::bigint as seq from {SYMBOLS_SQL} s {FILE_OF}")
def parse_symbols(spark, sf_dir):
    rows = I.extract_symbols(code_files(spark, sf_dir))
    return rows.select("file_path", "name", "kind", "start_line", "end_line", "depth", "doc", "language", "seq")


@register(f"with {FILES}, s as (select *, path as file_path from {SYMBOLS_SQL} {FILE_OF}) select c.file_path, c.seq::bigint as seq, max(p.seq) as parent from s c left join s p on p.file_path = c.file_path and p.seq < c.seq and p.depth = c.depth - 1 and p.start_line <= c.start_line and p.end_line >= c.end_line group by 1, 2")
def parse_tree(spark, sf_dir):
    """The nearest enclosing symbol of each."""
    rows = I.extract_symbols(code_files(spark, sf_dir))
    return rows.select("file_path", "seq", F.when(F.col("parent") >= 0, F.col("parent")).alias("parent"))


@register(f"with {FILES} select kind, s.language, count(*)::bigint as n, (count(*) filter (depth > 0))::bigint as inner_ones from {SYMBOLS_SQL} s group by 1, 2")
def parse_kinds(spark, sf_dir):
    rows = I.extract_symbols(code_files(spark, sf_dir))
    return rows.groupBy("kind", "language").agg(F.count("*").alias("n"), F.count(F.when(F.col("depth") > 0, 1)).alias("inner_ones"))


@register(f"with {FILES} select path as file_path, symbol_name, symbol_kind, start_line, end_line, nullif(header_lines, 0) as header_lines, md5(c.text) as digest from {CHUNKS_SQL} c {FILE_OF}")
def code_chunks(spark, sf_dir):
    rows = I.code_chunks(code_files(spark, sf_dir), 4096)
    return rows.select("file_path", "symbol_name", "symbol_kind", "start_line", "end_line", F.expr("nullif(metadata.header_lines, 0)").alias("header_lines"), F.md5("text").alias("digest"))


@register("select 'f' || p_partkey || '.py' as file_path, 'm' || i as symbol_name, (2 + 2 * i)::int as start_line, (3 + 2 * i)::int as end_line, 1 as header_lines, md5('class Big' || p_partkey || ':' || chr(10) || 'def m' || i || '(self):' || chr(10) || '        return [' || repeat('1, ', 20) || ']') as digest from (select p_partkey, unnest(range(0, (p_partkey % 5)::int + 1)) as i from part where p_partkey % 5 > 0)")
def code_chunks_recursive(spark, sf_dir):
    """Classes too long for a chunk: one for each method, under the class's first line."""
    method = F.transform(F.sequence(F.lit(0), (F.col("p_partkey") % 5).cast("int")), lambda i: F.concat(F.lit("    def m"), i.cast("string"), F.lit("(self):\n        return ["), F.repeat(F.lit("1, "), F.lit(20)), F.lit("]\n")))
    key = F.col("p_partkey").cast("string")
    files = read(spark, sf_dir, "part").where("p_partkey % 5 > 0").select(F.concat(F.lit("f"), key, F.lit(".py")).alias("path"), F.lit("python").alias("language"), F.lit("code").alias("file_class"), F.concat(F.lit("class Big"), key, F.lit(":\n"), F.array_join(method, "")).alias("text"))
    rows = I.code_chunks(files, 30)
    return rows.select("file_path", "symbol_name", "start_line", "end_line", F.col("metadata.header_lines").alias("header_lines"), F.md5("text").alias("digest"))


@register(f"with w as (select doc_id, text, {WORDS_SQL} as w, length(text) - length(replace(text, chr(10), '')) + case when text like '%' || chr(10) then 0 else 1 end as n_lines from documents where text is not null and trim(regexp_replace(text, '\\s', ' ', 'g')) <> ''), n as (select *, len(w) as n from w), s as (select *, unnest(range(0, case when n <= 64 then 1 else ceil((n - 64) / 58.0)::int + 1 end)) as i from n) select doc_id || '.py' as file_path, 1 as start_line, n_lines::int as end_line, case when n > 64 then i::int end as win, md5(case when n <= 64 then text else array_to_string(list_slice(w, i * 58 + 1, i * 58 + 64), ' ') end) as digest from s")
def code_windows(spark, sf_dir):
    """Prose under a code file's name: what can't be parsed, or is too large to be, becomes windows over the whole file."""
    docs = read(spark, sf_dir, "documents").where("text is not null")
    files = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.lit("unknown").alias("language"), F.lit("code").alias("file_class"), "text")
    return I.code_chunks(files, 64).select("file_path", "start_line", "end_line", F.col("metadata.window").alias("win"), F.md5("text").alias("digest"))


@register("select (select count(*) from part)::bigint as small_files, 0::bigint as of_large, (select count(*) from part)::bigint as large_chunks")
def symbol_size_guard(spark, sf_dir):
    """Files over a million bytes have no symbols, and their chunks are windows; the same files without the filling have some."""
    small = code_files(spark, sf_dir)
    few = small.limit(3).withColumn("text", F.concat("text", F.repeat(F.lit(" "), F.lit(P.MAX_SYMBOL_BYTES))))
    n = I.extract_symbols(small).agg(F.count_distinct("file_path").alias("small_files"))
    of_large = I.extract_symbols(few).agg(F.count("*").alias("of_large"))
    return n.crossJoin(of_large).crossJoin(small.agg(F.count("*").alias("large_chunks")))


@register("with t as (select doc_id, text, length(text) as n, ceil(length(text) / 5.0)::int as tokens from documents), s as (select *, unnest(range(0, case when tokens = 0 then 0 else greatest(0, ceil((tokens - 50) / 45.0))::int + 1 end)) as i from t), x as (select doc_id, i, substr(text, i * 225 + 1, 250) as piece from s) select doc_id, md5(string_agg(piece, '|' order by i)) as digest, count(*)::int as windows from x where trim(regexp_replace(piece, '\\s', ' ', 'g')) <> '' group by doc_id")
def offset_windows(spark, sf_dir):
    """Windows over a tokenizer's offsets; here each token has five characters."""
    docs = read(spark, sf_dir, "documents").where("length(text) > 0")
    n = F.ceil(F.length("text") / 5).cast("int")
    offsets = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * 5).alias("start"), F.least(i * 5 + 5, F.length("text")).alias("end")))
    rows = docs.where(F.trim(F.regexp_replace("text", r"\s", " ")) != "").select("doc_id", T.offset_windows(F.col("text"), offsets, 50).alias("w"))
    return rows.select("doc_id", F.md5(F.array_join("w", "|")).alias("digest"), F.size("w").alias("windows"))


# Files --------------------------------------------------------------------------------------------------------------------
@register("with f as (select doc_id, case doc_id % 4 when 0 then text || chr(13) || chr(10) || 'x' when 1 then text else text end as t, doc_id % 4 as m from documents) select doc_id, case when m = 2 then 'binary' when m = 3 then 'error' else 'ok' end as status, case when m = 3 then null when m = 1 then md5('caf' || chr(233)) when m = 0 then md5(replace(t, chr(13) || chr(10), chr(10))) end as digest from f where m <> 2 union all select doc_id, 'binary', null from f where m = 2")
def decode_and_binary(spark, sf_dir):
    """Bytes of four kinds: UTF-8 with other line ends, Latin-1, binary (left out), unreadable."""
    docs = read(spark, sf_dir, "documents")
    m = F.col("doc_id") % 4
    content = F.when(m == 0, F.encode(F.concat("text", F.lit("\r\nx")), "UTF-8")).when(m == 1, F.unhex(F.lit("636166E9"))).when(m == 2, F.unhex(F.lit("610062")))
    files = docs.select("doc_id", content.alias("content"))
    rows = source.decoded(source.without_binary(files)).select("doc_id", "status", F.md5("text").alias("digest"))
    return rows.unionByName(docs.select("doc_id").join(rows, "doc_id", "left_anti").select("doc_id", F.lit("binary").alias("status"), F.lit(None).cast("string").alias("digest")))


@register("select page_id, octet_length(encode(html)) as size from (select page_id, html, case page_id % 3 when 0 then 'code' when 1 then 'doc' else 'config' end as file_class, page_id % 3 as m from pages) where file_class = 'code' or octet_length(encode(html)) * 600 <= 2097152")
def size_filter(spark, sf_dir):
    """Files over two MiB go, but for code (sizes are 600 times those of the pages)."""
    rows = read(spark, sf_dir, "pages").select("page_id", F.octet_length("html").cast("long").alias("size"), F.element_at(F.array(*map(F.lit, ("code", "doc", "config"))), (F.col("page_id") % 3 + 1).cast("int")).alias("file_class"))
    kept = source.sized(rows.withColumn("size", F.col("size") * 600))
    return kept.select("page_id", F.expr("size div 600").alias("size"))


@register("select page_id from pages where not contains(lower(url), 'test')")
def exclude_default(spark, sf_dir):
    """Without a list, paths that hold "test" are left out."""
    return read(spark, sf_dir, "pages").where(~P.path_has_any(F.col("url"), P.excluded_paths(None))).select("page_id")


@register("select page_id, case lower(regexp_extract(ext, '([^.]+)$', 1)) when 'py' then 'python' when 'js' then 'javascript' when 'jsx' then 'jsx' when 'hpp' then 'cpp' when 'inl' then '' else '' end as language from (select page_id, list_extract(['a.py', 'b.JS', 'c.jsx', 'd.hpp', 'e.inl', 'Makefile'], (page_id % 6 + 1)::int) as ext from pages)")
def reference_language(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("a.py", "b.JS", "c.jsx", "d.hpp", "e.inl", "Makefile"))), (F.col("page_id") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", P.reference_language(name).alias("language"))


@register("select p_partkey, case when p_partkey % 3 = 0 then 'Src/F' || p_partkey || '.H' when p_partkey % 3 = 1 then 'SRC/G' || p_partkey || '.H' else 'D:/OUT/' || p_partkey end as file from part")
def external_path_case(spark, sf_dir):
    """Paths of an external database: as stored, whatever the case; relative where not stored; else with slashes."""
    key = F.col("p_partkey").cast("string")
    parts = read(spark, sf_dir, "part")
    m = F.col("p_partkey") % 3
    found = parts.select("p_partkey", F.when(m == 0, F.concat(F.lit("C:\\REPO\\SRC\\F"), key, F.lit(".h"))).when(m == 1, F.concat(F.lit("C:\\REPO\\SRC\\G"), key, F.lit(".H"))).otherwise(F.concat(F.lit("D:\\OUT\\"), key)).alias("file"))
    stored = parts.select(F.concat(F.lit("Src/F"), key, F.lit(".H")).alias("path"))
    return P.with_stored_case(found, stored, "c:/Repo").select("p_partkey", "file")


# Stores and vectors -------------------------------------------------------------------------------------------------------
@register("select doc_id as chunk_id, least(length(text) * 40, 65535)::int as n_chars from documents")
def insert_truncation(spark, sf_dir):
    """Stored chunk texts have at most 65,535 characters (texts are repeated 40 times here)."""
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.repeat("text", F.lit(40)).alias("text"))
    return I.inserted(rows).select("chunk_id", F.length("text").alias("n_chars"))


@register("select item_id as doc_id, (case when length(trim(text)) > 0 then 1.0 else 0.0 end)::double as norm, 256 as dim from benchmark")
def embed_passages(spark, sf_dir):
    """Vectors of the default embedder have unit length."""
    rows = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), M.embedded(F.col("text")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return rows.select("doc_id", F.round(norm, 4).alias("norm"), F.size("v").alias("dim"))


@register("select p_partkey, case p_partkey % 3 when 0 then p_name when 1 then 'Instruct: Given a natural language query, retrieve relevant code snippets and documentation' || chr(10) || 'Query:' || p_name else 'Represent this sentence for searching relevant passages: ' || p_name end as asked from part")
def query_prefix(spark, sf_dir):
    """What is embedded of a query: by the kind of model."""
    models = ("minishlab/potion-code-16M", "Qwen/Qwen3-Embedding-0.6B", "BAAI/bge-small-en-v1.5")
    part = read(spark, sf_dir, "part")
    asked = F.when(F.col("p_partkey") % 3 == 0, M.asked(F.col("p_name"), models[0])).when(F.col("p_partkey") % 3 == 1, M.asked(F.col("p_name"), models[1])).otherwise(M.asked(F.col("p_name"), models[2]))
    return part.select("p_partkey", asked.alias("asked"))


@register("select l_linenumber as n, greatest(1, least(128, floor(8 * 0.4 * 1024 / (case when l_linenumber > 3 then 32.0 else 2.0 end * greatest(1.0, pow(l_quantity * 40 / 512.0, 2))))))::int as size, l_quantity::double as q from (select distinct l_linenumber, l_quantity from lineitem)")
def embed_batch_sizes(spark, sf_dir):
    """Texts a batch may have, by the longest one, with 8 GB free."""
    rows = read(spark, sf_dir, "lineitem").select("l_linenumber", "l_quantity").distinct()
    dim = F.when(F.col("l_linenumber") > 3, F.lit(1024)).otherwise(F.lit(384))
    return rows.select(F.col("l_linenumber").alias("n"), M.batch_size(F.col("l_quantity") * 40, dim, 8.0).alias("size"), F.col("l_quantity").cast("double").alias("q"))


TOKENS_OF = "list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda t: t = 'licensed')"


@register(f"select doc_id, len({TOKENS_OF})::bigint as tf from documents where doc_id % 3 <> 0 and len({TOKENS_OF}) > 0")
def postings_remove_and_add(spark, sf_dir):
    """Postings of two halves put together, less a third of the documents: one token's rows."""
    docs = read(spark, sf_dir, "documents")
    made = lambda where: bm25.postings(bm25.token_counts(docs.where(where), "doc_id", "text"))
    posts = made("doc_id % 2 = 0").unionByName(made("doc_id % 2 = 1"))
    return delta.without(posts, docs.where("doc_id % 3 = 0").select("doc_id"), "doc_id").where("token = 'licensed'").select("doc_id", "tf")


@register("select doc_id::varchar as path, sha256(text || case when doc_id % 5 = 0 then '!' else '' end) as sha256 from documents where doc_id % 7 <> 0")
def stream_merge(spark, sf_dir):
    """Two micro-batches: all documents; then a fifth changed, and a seventh deleted."""
    docs = read(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), "doc_id", "text")
    store = Store(spark, f"{shared_dir(spark)}/stream-{os.urandom(6).hex()}")
    merge_batch(store, docs.select("path", "text", F.lit(1).alias("ts")))
    text = F.when(F.col("doc_id") % 7 != 0, F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    merge_batch(store, docs.select("path", text.alias("text"), F.lit(2).alias("ts")))
    return store.table("texts").select("path", "sha256")


@register("select date_trunc('hour', ts) as start, event_type, count(*)::bigint as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_windows(spark, sf_dir):
    return windowed_counts(read(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


# The catalog over an index of all files of part and benchmark ---------------------------------------------------------------
@register("select '' as index_name, '/r' as repo, 'hashing-256' as model, (select count(*) from part) + (select count(*) from benchmark) as files")
def catalog_list_indices(spark, sf_dir):
    return catalog(spark, sf_dir).list_indices()


KEY = 14
OF_KEY = f"where p_partkey = {KEY}"


@register(f"with {FILES}, l as (select path, string_split(text, chr(10)) as l from files {OF_KEY}) select path, 2 as start_line, least(5, len(l) - 1)::int as end_line, (len(l) - 1)::int as total_lines, array_to_string(list_transform(list_slice(l, 2, least(5, len(l) - 1)), lambda x, i: (1 + i) || ': ' || x), chr(10)) as code from l")
def catalog_read_code(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return c.read_code(path_of(spark, sf_dir), 3, 4, context_lines=1)


def path_of(spark: SparkSession, sf_dir: str) -> str:
    """The file of one part."""
    number = KEY % len(LANGUAGES)
    return f"src/{KEY % 40}/f{KEY}.{SOURCES[LANGUAGES[number]][0]}"


@register(f"select name, kind, start_line, end_line, language, seq::bigint as seq from {SYMBOLS_SQL} {OF_KEY}")
def catalog_file_symbols(spark, sf_dir):
    return catalog(spark, sf_dir).get_file_symbols(path_of(spark, sf_dir))


@register(f"with {FILES} select '' as index_name, name, kind, path as file, start_line, end_line, s.language from {SYMBOLS_SQL} s {FILE_OF} where lower(name) = 'size' order by path, seq limit 60")
def catalog_symbol_all(spark, sf_dir):
    return catalog(spark, sf_dir).get_symbol_info("SIZE", mode="all", max_results=60).drop("shown_end")


@register(f"with {FILES} select '' as index_name, name, kind, path as file, start_line, end_line, s.language from {SYMBOLS_SQL} s {FILE_OF} where contains(lower(name), 'box1') and kind in {S.DECLARATIONS} order by lower(name) = 'box1' desc, path, seq limit 25")
def catalog_symbol_declaration(spark, sf_dir):
    """Names that hold the text as well, exact ones first (no more than 200 are looked at)."""
    return catalog(spark, sf_dir).get_symbol_info("box1", mode="declaration", exact_match=False, max_results=25).drop("shown_end")


@register(f"with {FILES}, s as (select path as file, f.text, s.language, name, kind, start_line, end_line from {SYMBOLS_SQL} s {FILE_OF.replace('using', 'f using')} where name = 'Box') select '' as index_name, file, s.language, 2 as start_line, 6 as end_line, 6 as shown_end, 2::bigint as n_symbols, 'class Box (L2–6)  constructor Box (L3–3)' as symbols, '' as hidden, 'Box' as name, array_to_string(list_slice(string_split(any_value(text), chr(10)), 2, 6), chr(10)) as code from s group by file, s.language order by file limit 20")
def catalog_symbol_grouped(spark, sf_dir):
    """Overlapping symbols of a file as one range, with their list and the code."""
    return catalog(spark, sf_dir).get_symbol_info("box", include_code=True)


AREA = KEY - KEY % 11 + 1
AREA_PATH = f"src/{AREA % 40}/f{AREA}.cpp"


@register(f"with {FILES}, hits as (select f.path, u.line, u.t from (select path, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as line from files) u join files f using (path) where contains(u.t, 'area{AREA}') and not (path = '{AREA_PATH}' and u.line between 9 and 12)) select '' as index_name, 'area{AREA}' as name, 'function' as kind, '{AREA_PATH}' as file, 9 as start_line, 12 as end_line, 'cpp' as language, (select least(30, count(*)) from hits)::bigint as n_references")
def catalog_symbol_references(spark, sf_dir):
    """A symbol's references outside its own lines: longer names that hold it."""
    rows = catalog(spark, sf_dir).get_symbol_info(f"area{AREA}", mode="all", include_references=True)
    return rows.select("index_name", "name", "kind", "file", "start_line", "end_line", "language", F.coalesce(F.size("references"), F.lit(0)).cast("long").alias("n_references"))


@register(f"with {FILES}, l as (select path, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as line from files) select path, line::int as line, text from l where contains(text, 'Pt1') and not contains(path, '.glsl') order by not path like '%.cpp', path, line, text limit 30")
def catalog_references(spark, sf_dir):
    return catalog(spark, sf_dir).references("Pt1", "cpp", max_refs=30).select("path", "line", "text")


@register(f"with {FILES} select '' as index_name, path, sha256(text) as sha256, list_extract({LANGUAGES}, (p_partkey % 11 + 1)::int) as language, strlen(text)::bigint as size, (select count(*) from {CHUNKS_SQL} c where c.p_partkey = {KEY})::int as chunk_count from files {OF_KEY}")
def catalog_file_info(spark, sf_dir):
    return catalog(spark, sf_dir).file_info(path_of(spark, sf_dir))


@register(f"with {FILES} select '' as index_name, path from files union all select '', 'docs/b' || item_id || '.md' from benchmark")
def catalog_all_files(spark, sf_dir):
    return catalog(spark, sf_dir).all_files()


@register(f"with {FILES} select path as file_path, symbol_name, start_line, md5(c.text) as digest from {CHUNKS_SQL} c {FILE_OF} {OF_KEY}")
def catalog_chunks_of(spark, sf_dir):
    return catalog(spark, sf_dir).chunks_of(path_of(spark, sf_dir)).select("file_path", "symbol_name", "start_line", F.md5("text").alias("digest"))


@register(f"with {FILES}, f as (select path from files where path like 'src/7/%') select '(' || count(*) || ' files)' as shown, 1::bigint as place from f having count(*) > 30 union all select list_extract(string_split(path, '/'), 3), row_number() over (order by lower(path)) from f where (select count(*) from f) <= 30")
def catalog_structure(spark, sf_dir):
    """One directory's listing: its files in order, or their number where they are many."""
    rows = catalog(spark, sf_dir).get_repo_structure(depth=2, path="src/7").collect()
    return spark.createDataFrame([(r.name or f"({r.n_files} files)", i + 1) for i, r in enumerate(rows)], "shown string, place long")


@register("select path, (row_number() over (order by depth_key))::bigint as place from (select 'docs' as path, '0docs' as depth_key union all select 'src', '0src' union all select 'src/' || d, '0src/0' || d from (select distinct (p_partkey % 40)::varchar as d from part) where (select count(distinct p_partkey % 40) from part) <= 100000)")
def catalog_structure_top(spark, sf_dir):
    """Directories in depth-first order, files left out."""
    rows = [r for r in catalog(spark, sf_dir).get_repo_structure(depth=2).collect() if r.is_dir]
    return spark.createDataFrame([(r.path, i + 1) for i, r in enumerate(rows)], "path string, place long")


@register(f"with {FILES} select path, 0 as rank, symbol_name from {CHUNKS_SQL} c {FILE_OF} where symbol_name = 'area12'")
def catalog_search_code(spark, sf_dir):
    """The one chunk that has a name is the best by both lists."""
    return catalog(spark, sf_dir).search_code("area12", top_k=1).select("path", "rank", "symbol_name")


@register("select 'docs/b' || min(item_id) || '.md' as path, 0 as rank from benchmark where text = (select text from benchmark where item_id = 0)")
def catalog_search_docs(spark, sf_dir):
    """A whole text as the query finds its own file."""
    text = read(spark, sf_dir, "benchmark").where("item_id = 0").first().text
    return catalog(spark, sf_dir).search_docs(text, top_k=1).select("path", "rank")


@register("select 'name one index of [''a'', ''b'']' as said")
def catalog_several_indices(spark, sf_dir):
    """A search over several indices has to name one."""
    try:
        catalog(spark, sf_dir, "a", "b").search_code("x")
        said = "searched"
    except ValueError as e:
        said = str(e)
    return spark.createDataFrame([(said,)], "said string")


@register("select 0::bigint as hits, 0::bigint as files, 0::bigint as symbols")
def catalog_empty_store(spark, sf_dir):
    """A store without any table gives empty results."""
    c = Catalog(spark, "", indices=[Index(spark, "", f"{shared_dir(spark)}/nothing-here")])
    count = lambda df: df.count()
    return spark.createDataFrame([(count(c.search_code("x")), count(c.all_files()), count(c.get_symbol_info("x")))], "hits long, files long, symbols long")

