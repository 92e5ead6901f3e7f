"""Registered queries of the library and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .functions import files as P, text as T
from .operators import bm25, delta, fusion, knn, references as R, symbols as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

WORDS_QUERY = "oneninstance thread instance from_retitioning"
VECTOR_ID = 7


def register(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: path src/lang/id.md."""
    docs = read(spark, sf_dir, "documents")
    return docs.withColumn("path", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))))


# SQL counterparts of column functions -------------------------------------------------------------------------------
STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
PATH_SQL = "source || '/' || lang || '/' || doc_id || '.md'"


def parts_sql(t: str) -> str:
    snake = f"(case when contains({t}, '_') then list_filter(string_split(lower({t}), '_'), lambda p: p <> '') else [] end)"
    camel = f"list_filter(string_split_regex(lower(regexp_replace(regexp_replace({t}, '(.)([A-Z][a-z]+)', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '\\s+'), lambda p: p <> '')"
    parts = f"list_concat({snake}, list_distinct(list_filter({camel}, lambda q: not list_contains({snake}, q))))"
    return f"(case when list_contains({parts}, lower({t})) then {parts} else list_concat([lower({t})], {parts}) end)"


def tokens_sql(x: str) -> str:
    raw = f"list_filter(string_split_regex({x}, '[^a-zA-Z0-9_]+'), lambda r: length(r) >= 2)"
    return f"list_filter(flatten(list_transform({raw}, lambda t: {parts_sql('t')})), lambda z: length(z) >= 2 and z not in ({STOPS}))"


WORDS_SQL = "list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')"
TOKENS = f"tok as (select doc_id, {tokens_sql('text')} as tokens from documents), dl as (select doc_id, len(tokens)::bigint as dl from tok), posts as (select token, doc_id, count(*)::bigint as tf from (select doc_id, unnest(tokens) as token from tok) group by 1, 2)"
IDF = """stats as (select count(*) as n, avg(dl) as avgdl from dl),
rawidf as (select token, count(*) as df, ln((select n from stats) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from posts group by token),
idf as (select token, df, case when raw < 0 then 0.25 * (select avg(raw) from rawidf) else raw end as idf from rawidf)"""
QTOKENS = f"q as (select token, count(*) as times from (select unnest({tokens_sql(repr(WORDS_QUERY))}) as token) group by token)"
BM25 = f"""{TOKENS}, {IDF}, {QTOKENS},
scored as (select p.doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score
  from posts p join q using (token) join idf using (token) join dl on dl.doc_id = p.doc_id cross join stats group by p.doc_id)"""
DOT = "list_dot_product(e.embedding::double[], v.embedding::double[]) / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(v.embedding::double[], v.embedding::double[])))"
KNN = f"from embeddings e, (select embedding from embeddings where vec_id = {VECTOR_ID}) v"


def vector_of(vectors: DataFrame, vec_id: int) -> list[float]:
    """One row's vector, as the literal a query is made of."""
    row = vectors.where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row.embedding) if row else []


def keyword_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    tokens = counted(spark, sf_dir, "documents", "doc_id", "text")
    lengths = bm25.doc_lengths(tokens)
    hits = bm25.scores(bm25.postings(tokens), lengths, bm25.query_tokens(spark, WORDS_QUERY)).persist()
    _COUNTED[spark.sparkContext.applicationId, sf_dir, "hits"] = hits
    return bm25.top(hits, lengths, k)


_COUNTED: dict[tuple, DataFrame] = {}


def counted(spark: SparkSession, sf_dir: str, name: str, doc_id: str, text: str) -> DataFrame:
    """Tokens of a table, counted once in a query and kept until the next one asks: as a stored index would have them. The one before is let go."""
    for old in _COUNTED.values():
        old.unpersist()
    _COUNTED.clear()
    out = _COUNTED[spark.sparkContext.applicationId, sf_dir, name] = bm25.token_counts(read(spark, sf_dir, name), doc_id, text).persist()
    return out


def vector_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return knn.top(vectors, vector_of(vectors, VECTOR_ID), k)


# Text -----------------------------------------------------------------------------------------------------------------
@register(f"with {TOKENS} select token, count(*)::bigint as df, sum(tf)::bigint as total from posts group by token order by df desc, total desc, token limit 100")
def tokenize_count(spark, sf_dir):
    posts = bm25.postings(bm25.token_counts(read(spark, sf_dir, "documents"), "doc_id", "text"))
    return posts.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).orderBy(F.desc("df"), F.desc("total"), "token").limit(100)


IDENT_SQL = "select p_partkey, 'get' || list_extract(string_split(p_type, ' '), 1) || '_' || replace(p_name, ' ', '') || 'HTTPResponse' || p_size as ident from part"


@register(f"select p_partkey, array_to_string(list_sort({parts_sql('ident')}), ' ') as parts from ({IDENT_SQL})")
def identifier_split(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    ident = F.concat(F.lit("get"), F.split("p_type", " ")[0], F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("")), F.lit("HTTPResponse"), F.col("p_size").cast("string"))
    return part.select("p_partkey", ident.alias("ident")).select("p_partkey", F.array_join(F.array_sort(T.split_identifier(F.col("ident"))), " ").alias("parts"))


@register(f"with {BM25} select doc_id, score from (select dl.doc_id, coalesce(score, 0.0) as score, score is not null as hit from dl left join scored using (doc_id) order by 2 desc, 1 desc limit 10) where hit or score > 0")
def bm25_topk(spark, sf_dir):
    return keyword_hits(spark, sf_dir, 10)


@register(f"with {TOKENS}, {IDF} select token, df::bigint as df, round(idf, 6) as idf from idf where df >= 3")
def bm25_idf_table(spark, sf_dir):
    tokens = counted(spark, sf_dir, "documents", "doc_id", "text")
    idf = bm25.idf_table(bm25.postings(tokens), bm25.corpus_stats(bm25.doc_lengths(tokens)))
    return idf.where("df >= 3").select("token", "df", F.round("idf", 6).alias("idf"))


PAGES = f"with docs as (select page_id as doc_id, html as text from pages), {TOKENS.replace('from documents', 'from docs')}, {IDF}"


@register(f"{PAGES}, q as (select token, 1 as times from rawidf where raw < 0) select p.doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score from posts p join q using (token) join idf using (token) join dl on dl.doc_id = p.doc_id cross join stats group by p.doc_id")
def bm25_negative_idf_whole(spark, sf_dir):
    """All pages, asked for the tokens that more than half of them hold, as those of markup."""
    tokens = counted(spark, sf_dir, "pages", "page_id", "html")
    posts, lengths = bm25.postings(tokens), bm25.doc_lengths(tokens)
    n = lengths.count()
    common = posts.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") > n / 2).select("token").collect()
    return bm25.scores(posts, lengths, {r.token: 1 for r in common})


@register(f"with w as (select doc_id, {WORDS_SQL} as w from documents), n as (select doc_id, w, len(w) as n from w), s as (select doc_id, w, n, unnest(range(0, case when n = 0 then 0 else greatest(0, ceil((n - 64) / 58.0))::int + 1 end)) as i from n) select doc_id, i::int as win, len(list_slice(w, i * 58 + 1, i * 58 + 64))::int as n_words, md5(array_to_string(list_slice(w, i * 58 + 1, i * 58 + 64), ' ')) as digest from s")
def sliding_window_chunks(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.word_windows(F.col("text"), 64)).alias("win", "t"))
    return docs.select("doc_id", "win", T.count_words(F.col("t")).alias("n_words"), F.md5("t").alias("digest"))


@register("""with docs as (select conv_id, string_agg('# ' || role || chr(10) || text, chr(10) order by turn, role, text) as text from conversations group by conv_id),
l as (select conv_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from docs),
s as (select *, sum(case when starts_with(line, '#') and pos > 0 then 1 else 0 end) over (partition by conv_id order by pos) as section from l),
g as (select conv_id, section, min(pos) + 1 as start_line, max(pos) + 1 as end_line, length(regexp_extract(first(line order by pos), '^(#*)', 1)) as heading_level, string_agg(line, chr(10) order by pos) as text from s group by 1, 2)
select conv_id, section::bigint as section, start_line::int as start_line, end_line::int as end_line, heading_level::int as heading_level, md5(text) as digest from g where trim(regexp_replace(text, '\\s', ' ', 'g')) <> ''""")
def heading_sections(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    docs = c.select("conv_id", F.array_join(F.transform("t", lambda x: F.concat(F.lit("# "), x.role, F.lit("\n"), x.text)), "\n").alias("text"))
    return T.heading_sections(docs, "conv_id", "text").select("conv_id", "section", "start_line", "end_line", "heading_level", F.md5("text").alias("digest"))


@register(f"with w as (select page_id, url, html as text, {WORDS_SQL.replace('text', 'html')} as w from pages), p as (select page_id, text, w, len(w) as n from w), x as (select page_id, unnest(case when n <= 200 then [text] else list_transform(range(0, greatest(0, ceil((n - 200) / 180.0))::int + 1), lambda i: array_to_string(list_slice(w, i * 180 + 1, i * 180 + 200), ' ')) end) as t, generate_subscripts(case when n <= 200 then [text] else list_transform(range(0, greatest(0, ceil((n - 200) / 180.0))::int + 1), lambda i: '') end, 1) - 1 as win, n > 200 as windowed from p) select page_id, win::int as win, windowed, md5(t) as digest from x")
def config_whole_or_window(spark, sf_dir):
    p = read(spark, sf_dir, "pages").withColumn("windowed", T.count_words(F.col("html")) > 200)
    t = F.when(F.col("windowed"), T.word_windows(F.col("html"), 200)).otherwise(F.array("html"))
    return p.select("page_id", "windowed", F.posexplode(t).alias("win", "t")).select("page_id", "win", "windowed", F.md5("t").alias("digest"))


@register(f"select doc_id, {PATH_SQL} as path, sha256(text) as sha256 from documents")
def fingerprint_sha256(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", "path", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@register(f"select source, avg(length(t)) as mean_chars, count(*)::bigint as chunks from (select source, unnest(list_transform(range(0, case when n = 0 then 0 else greatest(0, ceil((n - 512) / 461.0))::int + 1 end), lambda i: array_to_string(list_slice(w, i * 461 + 1, i * 461 + 512), ' '))) as t from (select source, {WORDS_SQL} as w, len({WORDS_SQL}) as n from documents)) group by source")
def mean_chunk_length(spark, sf_dir):
    c = read(spark, sf_dir, "documents").select("source", F.explode(T.word_windows(F.col("text"), 512)).alias("t"))
    return c.groupBy("source").agg(F.avg(F.length("t")).alias("mean_chars"), F.count("*").alias("chunks"))


@register("with d as (select doc_id, string_split(text, chr(10)) as l from documents), r as (select doc_id, unnest(list_slice(l, 2, 4)) as line, unnest(range(2, 2 + len(list_slice(l, 2, 4)))) as n from d) select doc_id, n::int as n, n || ': ' || line as shown from r where not (line = '' and n = (select len(l) from d where d.doc_id = r.doc_id))")
def read_range(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.line_range(F.col("text"), 2, 4)).alias("at", "shown"))
    return rows.select("doc_id", (F.col("at") + 2).alias("n"), "shown")


# Vectors and fusion -----------------------------------------------------------------------------------------------------
@register(f"select e.vec_id, round({DOT}, 6) as score {KNN} order by 2 desc, 1 limit 10")
def knn_cosine_topk(spark, sf_dir):
    return vector_hits(spark, sf_dir, 10)


@register(f"select e.vec_id, round({DOT}, 6) as score {KNN} where e.label = 3 order by 2 desc, 1 limit 10")
def knn_filtered(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return knn.top(vectors, vector_of(vectors, VECTOR_ID), 10, F.col("label") == 3)


@register("select vec_id, label from embeddings where label = 3")
def filter_expression_whole(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").where(P.parse_condition('label == "3" and nonsense')).select("vec_id", "label")


def sides(spark: SparkSession, sf_dir: str, k: int) -> tuple[DataFrame, DataFrame]:
    sem = fusion.ranked(vector_hits(spark, sf_dir, k).withColumnRenamed("vec_id", "doc_id"), F.desc("score"), F.col("doc_id"))
    key = fusion.ranked(keyword_hits(spark, sf_dir, k), F.desc("score"), F.desc("doc_id"))
    return sem, key


SIDES = f"""{BM25}, kw as (select doc_id, row_number() over (order by score desc, doc_id desc) as rank from (select doc_id, score from scored order by score desc, doc_id desc limit 40)),
sem as (select vec_id as doc_id, row_number() over (order by score desc, vec_id) as rank from (select e.vec_id, round({DOT}, 6) as score {KNN} order by 2 desc, 1 limit 40))"""
FUSED = "fused as (select coalesce(s.doc_id, k.doc_id) as doc_id, round((coalesce(1.0 / (60 + s.rank), 0) + coalesce(1.0 / (60 + k.rank), 0)) / (2.0 / 61), 10) as score, coalesce(s.rank, k.rank) as first, s.rank is null as keyword_only from sem s full join kw k on s.doc_id = k.doc_id)"


@register(f"with {SIDES}, {FUSED} select doc_id, score, keyword_only from fused order by score desc, keyword_only, first limit 20")
def hybrid_search(spark, sf_dir):
    sem, key = sides(spark, sf_dir, 40)
    fused = fusion.fuse(sem, key, ("doc_id",))
    return fused.orderBy(*fusion.ordered(fused)).limit(20).select("doc_id", "score", "keyword_only")


@register(f"with {SIDES}, {FUSED} select doc_id, score, (rn - 1)::int as rank from (select *, row_number() over (order by score desc, keyword_only, first) as rn from fused) where rn > 8 and rn <= 16")
def search_page_offset(spark, sf_dir):
    sem, key = sides(spark, sf_dir, 40)
    return fusion.page(fusion.fuse(sem, key, ("doc_id",)), 8, 8).select("doc_id", "score", "rank")


@register(f"with {SIDES}, s2 as (select doc_id % 7 as k, max(rank) as r from sem group by 1), k2 as (select doc_id % 7 as k, sum(1.0 / (60 + rank)) as w from kw group by 1) select coalesce(s2.k, k2.k) as bucket, round((coalesce(1.0 / (60 + r), 0) + coalesce(w, 0)) / (2.0 / 61), 6) as score from s2 full join k2 on s2.k = k2.k")
def rrf_duplicate_keys(spark, sf_dir):
    """Several hits of one key: the vector side keeps the worst rank, the keyword side adds up."""
    sem, key = (x.withColumn("bucket", F.col("doc_id") % 7) for x in sides(spark, sf_dir, 40))
    return fusion.fuse(sem, key, ("bucket",)).select("bucket", F.round("score", 6).alias("score"))


@register(f"with {SIDES}, kw2 as (select k.doc_id, row_number() over (order by k.rank) as rank from kw k join documents d using (doc_id) where lang = 'en'), sem2 as (select e.vec_id as doc_id, row_number() over (order by round({DOT}, 6) desc, e.vec_id) as rank from embeddings e join documents d on d.doc_id = e.vec_id and lang = 'en', (select embedding from embeddings where vec_id = {VECTOR_ID}) v qualify rank <= 40), {FUSED.replace('sem s', 'sem2 s').replace('kw k', 'kw2 k')} select doc_id, score from fused order by score desc, keyword_only, first limit 20")
def hybrid_language_postfilter(spark, sf_dir):
    """A language narrows the vectors before their top-k, and the keyword list after its own, where ranks are then counted anew."""
    en = read(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    vectors = read(spark, sf_dir, "embeddings")
    narrowed = vectors.join(en.withColumnRenamed("doc_id", "vec_id"), "vec_id", "left_semi")
    sem = knn.top(narrowed, vector_of(vectors, VECTOR_ID), 40).withColumnRenamed("vec_id", "doc_id")
    key = fusion.ranked(keyword_hits(spark, sf_dir, 40), F.desc("score"), F.desc("doc_id")).join(en, "doc_id", "left_semi")
    key = fusion.ranked(key.withColumnRenamed("rank", "old"), F.col("old"))
    fused = fusion.fuse(fusion.ranked(sem, F.desc("score"), F.col("doc_id")), key, ("doc_id",))
    return fused.orderBy(*fusion.ordered(fused)).limit(20).select("doc_id", "score")


@register("select page_id from pages where not contains(lower(url), 'thr') union all select page_id + 1000000 from pages")
def exclude_path(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    keep = lambda pats: pages.where(~P.path_has_any(F.col("url"), P.excluded_paths(pats))).select("page_id")
    return keep(["THR"]).union(keep([]).select((F.col("page_id") + 1000000).alias("page_id")))


# Changes ----------------------------------------------------------------------------------------------------------------
STORED_SQL = f"stored as (select {PATH_SQL} as path, sha256(text) as sha256, doc_id from documents where doc_id % 10 <> 0)"
CURRENT_SQL = f"cur as (select {PATH_SQL} as path, sha256(case when doc_id % 7 = 0 then text || '!' else text end) as sha256 from documents where doc_id % 9 <> 0)"
DIFF_SQL = f"with {STORED_SQL}, {CURRENT_SQL}, d as (select coalesce(s.path, c.path) as path, case when s.path is null then 'new' when c.path is null then 'deleted' when s.sha256 = c.sha256 then 'unchanged' else 'modified' end as status from stored s full join cur c on s.path = c.path)"


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the corpus: rows gone on either side, and some texts changed."""
    docs = corpus(spark, sf_dir)
    stored = docs.where("doc_id % 10 <> 0").select("path", F.sha2("text", 256).alias("sha256"))
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return stored, docs.where("doc_id % 9 <> 0").select("path", F.sha2(text, 256).alias("sha256"))


@register(f"{DIFF_SQL} select path, status from d")
def snapshot_diff(spark, sf_dir):
    return delta.snapshot_diff(*snapshots(spark, sf_dir))


@register(f"{DIFF_SQL} select (count(*) filter (status in ('new', 'modified')))::bigint as files_processed, (count(*) filter (status = 'unchanged'))::bigint as files_skipped, (count(*) filter (status = 'deleted'))::bigint as files_deleted from d")
def index_run_stats(spark, sf_dir):
    return delta.statistics(delta.snapshot_diff(*snapshots(spark, sf_dir)))


@register(f"{DIFF_SQL} select path, sha256 from stored where path not in (select path from d where status in ('deleted', 'modified')) union all select path, sha256 from cur where path in (select path from d where status in ('new', 'modified'))")
def snapshot_apply(spark, sf_dir):
    """The stored table brought to the current state by copy-on-write."""
    stored, current = snapshots(spark, sf_dir)
    status = delta.snapshot_diff(stored, current)
    kept = delta.without(stored, status.where("status = 'deleted'"), "path")
    return delta.upserted(kept, current.join(status.where("status in ('new', 'modified')"), "path", "left_semi"), "path")


@register("select doc_id from documents d where n_chars > 500 and not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def resume_detection(spark, sf_dir):
    files = read(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("n_chars") / 501).alias("chunk_count"))
    return delta.unfinished(files, read(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@register("select vec_id as chunk_id from embeddings where vec_id not in (select doc_id from documents where n_chars > 300)")
def postings_repair(spark, sf_dir):
    """Chunks without postings, to be tokenized again."""
    have = read(spark, sf_dir, "documents").where("n_chars > 300").select(F.col("doc_id").alias("chunk_id"))
    return delta.without(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id")), have, "chunk_id")


@register("select item_id, (select max(vec_id) from embeddings) + row_number() over (order by substr(md5(text), 1, 3), text, item_id) as chunk_id from benchmark")
def id_allocation(spark, sf_dir):
    top_id = read(spark, sf_dir, "embeddings").agg(F.max("vec_id").alias("m")).first().m
    return delta.with_new_ids(read(spark, sf_dir, "benchmark"), top_id, ["text", "item_id"]).select("item_id", "chunk_id")


@register(f"select doc_id from documents where lang <> 'fr' and doc_id not in (select vec_id from embeddings where label = 1)")
def delete_by_file_and_id(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    left = delta.without(docs, docs.where("lang = 'fr'").select("path").distinct(), "path")
    return delta.without(left, read(spark, sf_dir, "embeddings").where("label = 1").select(F.col("vec_id").alias("doc_id")), "doc_id").select("doc_id")


@register("select lang, source, count(*)::bigint as files, sum(n_chars)::bigint as chars, count(distinct md5(text))::bigint as texts from documents group by 1, 2")
def index_stats(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.groupBy("lang", "source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.count_distinct(F.md5("text")).alias("texts"))


@register("with ext as (select 'src' || (item_id % 7) as index_name, item_id as id from benchmark), cat as (select source as index_name, doc_id as id from documents) select index_name, id from ext union all select index_name, id from cat where index_name not in (select index_name from ext)")
def multi_index_union_whole(spark, sf_dir):
    """Both tables whole: an index for each source, some of which the external database has."""
    ext = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 7).cast("string")).alias("index_name"), F.col("item_id").alias("id"))
    return S.tiered(ext, read(spark, sf_dir, "documents").select(F.col("source").alias("index_name"), F.col("doc_id").alias("id")))


# Files ------------------------------------------------------------------------------------------------------------------
ENDINGS = ("py", "H", "inl", "tsx", "md", "rst", "yml", "toml", "glsl", "exe", "")
FILES_SQL = f"(select page_id, regexp_extract(url, '://([^?#]*)', 1) || case when list_extract({list(ENDINGS)}, (page_id % 11 + 1)::int) = '' then 'Makefile' else 'f.' || list_extract({list(ENDINGS)}, (page_id % 11 + 1)::int) end as path from pages)"


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as files with names of several languages."""
    end = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("page_id") % 11 + 1).cast("int"))
    path = F.concat(F.regexp_extract("url", "://([^?#]*)", 1), F.when(end == "", "Makefile").otherwise(F.concat(F.lit("f."), end)))
    return read(spark, sf_dir, "pages").withColumn("path", path)


def case_sql(x: str, table: dict[str, str]) -> str:
    return f"case {x} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + " end"


NAME_SQL = "list_extract(string_split(path, '/'), -1)"
LANG_SQL = f"coalesce({case_sql(NAME_SQL, P.NAMES)}, case when lower(regexp_extract({NAME_SQL}, '^.+\\.([^.]+)$', 1)) = 'glsl' then 'glsl' end, {case_sql(f'''lower(regexp_extract({NAME_SQL}, '^.+\\.([^.]+)$', 1))''', P.EXTENSIONS)})"
IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
CLASS_SQL = f"case when language in {IN(P.CODE)} then 'code' when language in {IN(P.DOCS)} then 'doc' when language in {IN(P.CONFIG)} then 'config' else 'unknown' end"


@register(f"select page_id, path, language, {CLASS_SQL} as file_class from (select page_id, path, {LANG_SQL} as language from {FILES_SQL})")
def language_detect(spark, sf_dir):
    rows = page_files(spark, sf_dir).withColumn("language", P.language(F.col("path"), ["glsl"]))
    return rows.select("page_id", "path", "language", P.file_class(F.col("language"), ["glsl"]).alias("file_class"))


@register(f"select page_id, path from (select page_id, path, {LANG_SQL} as language from {FILES_SQL}) where language is not null and not regexp_matches(path, '^(?:.*/)?[^/]*blog[^/]*(?:/.*)?$') and regexp_matches(path, '/(?:en|fr|de)/') and not regexp_matches(path, '(^|/)\\.[^/]*/')")
def file_filter_chain(spark, sf_dir):
    """Exclude patterns, then include patterns, then pruned directories, then known languages."""
    rows, path = page_files(spark, sf_dir), F.col("path")
    rows = rows.where(~P.matches_any(path, ["*blog*"]) & P.matches_any(path, ["**/en/**", "**/fr/**", "**/de/**"]) & ~P.in_pruned_dir(path))
    return rows.where(P.language(path, ["glsl"]).isNotNull()).select("page_id", "path")


@register(f"with actual as (select distinct path from {FILES_SQL}), asked as (select page_id, replace('C:/Repo/' || upper(path), '/', chr(92)) as raw, path from {FILES_SQL}) select page_id, 'idx/' || min(a.path) as restored from asked q join actual a on lower(replace(substr(replace(raw, chr(92), '/'), 9), chr(92), '/')) = lower(a.path) group by page_id")
def path_case_restore(spark, sf_dir):
    """Absolute paths in another case and with back-slashes, to the paths as stored."""
    files = page_files(spark, sf_dir)
    asked = files.select("page_id", F.translate(F.concat(F.lit("C:/Repo/"), F.upper("path")), "/", "\\").alias("raw"))
    rel = asked.select("page_id", F.lower(F.expr("substring(translate(raw, '\\\\', '/'), 9)")).alias("low"))
    actual = files.select("path", F.lower("path").alias("low")).groupBy("low").agg(F.min("path").alias("path"))
    return rel.join(actual, "low").select("page_id", P.qualified(F.lit("idx"), F.col("path")).alias("restored"))


@register(f"""with f as (select distinct {PATH_SQL} as path from documents), p as (select string_split(path, '/') as a from f),
s as (select distinct array_to_string(list_slice(a, 1, i - 1), '/') as parent, list_extract(a, i) as name, i < len(a) as is_dir from (select a, unnest(range(1, least(len(a), 3) + 1)) as i from p)),
c as (select parent, count(*) as children from s group by parent)
select parent, name, is_dir, 0::bigint as n_files from s join c using (parent) where children <= 30 or is_dir
union all select parent, '', false, count(*)::bigint from s join c using (parent) where children > 30 and not is_dir group by parent""")
def repo_tree(spark, sf_dir):
    return R.tree(corpus(spark, sf_dir).select("path").distinct(), 3).fillna("", ["name"]).fillna(0, ["n_files"])


# Symbols ----------------------------------------------------------------------------------------------------------------
def part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as symbols: name, kind by size, order by key."""
    kinds = ("class", "function", "struct", "method", "enum", "type", "impl")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("p_size") % 7 + 1).cast("int"))
    return read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), kind.alias("kind"), F.col("p_partkey").alias("seq"))


NAME_OF = "(select p_name from part order by p_partkey limit 1)"


def first_name(spark: SparkSession, sf_dir: str) -> str:
    return read(spark, sf_dir, "part").orderBy("p_partkey").select("p_name").first().p_name


@register(f"select p_name as name, p_partkey as seq from part where lower(p_name) = lower({NAME_OF}) order by p_partkey limit 200")
def symbol_exact(spark, sf_dir):
    return S.lookup(part_symbols(spark, sf_dir), first_name(spark, sf_dir).upper()).select("name", "seq")


@register("select p_name as name, p_partkey as seq, is_exact from (select *, lower(p_name) = 'ring' as is_exact from part) where contains(lower(p_name), 'ring') order by is_exact desc, p_partkey limit 200")
def symbol_substring(spark, sf_dir):
    return S.lookup(part_symbols(spark, sf_dir), "RING", exact=False).select("name", "seq", "is_exact")


@register("select p_partkey as seq from part where p_size % 7 in (0, 2, 4)")
def declaration_filter(spark, sf_dir):
    return S.declarations(part_symbols(spark, sf_dir)).select("seq")


SPANS_SQL = "select l_orderkey as file, (l_partkey % 60 + 1)::int as start_line, (l_partkey % 60 + 1 + l_quantity)::int as end_line from lineitem"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("l_partkey") % 60 + 1).cast("int")
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), start.alias("start_line"), (start + F.col("l_quantity")).cast("int").alias("end_line"), F.col("l_linenumber").alias("line"))


@register(f"""with s as ({SPANS_SQL}), n as (select *, max(end_line) over (partition by file order by start_line, end_line rows between unbounded preceding and 1 preceding) as seen from s),
g as (select *, sum((seen is null or start_line > seen + 5)::int) over (partition by file order by start_line, end_line rows unbounded preceding) as island from n)
select file, min(start_line) as start_line, max(end_line) as end_line, count(*)::bigint as n_symbols, least(max(end_line), min(start_line) + 199) as shown_end from g group by file, island""")
def symbol_islands(spark, sf_dir):
    return S.islands(spans(spark, sf_dir).drop("line"), "file")


@register(f"with s as ({SPANS_SQL}) select o_orderkey as file, count(*)::bigint as symbols, sum(s.start_line)::bigint as starts from orders join s on s.file = o_orderkey and s.start_line between o_custkey % 40 and o_custkey % 40 + 30 group by 1")
def chunk_symbol_span_join(spark, sf_dir):
    chunks = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_path"), (F.col("o_custkey") % 40).alias("start_line"), (F.col("o_custkey") % 40 + 30).alias("end_line"))
    hits = S.within_chunks(chunks, spans(spark, sf_dir).withColumnRenamed("file", "file_path"))
    return hits.groupBy(F.col("c.file_path").alias("file")).agg(F.count("*").alias("symbols"), F.sum("s.start_line").alias("starts"))


ITEMS_SQL = "items as (select s_suppkey as id, 'sym' || (s_suppkey % 17) as name, (s_suppkey % 40)::int as kind, s_nationkey as file_id, (s_suppkey % 90)::int as start_line, (s_suppkey % 90 + s_suppkey % 3)::int as end_line, s_suppkey % 11 as parent_id from supplier), files as (select n_nationkey as id, n_name as name from nation), kinds as (select r_regionkey as id, r_name as name from region), inherits as (select s_suppkey as parent_code_item_id, (s_suppkey * 7) % (select count(*) from supplier) + 1 as base_code_item_id from supplier)"


def external_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """supplier, nation and region as code items, files, kinds and inheritance of an external database."""
    s = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    items = s.select(k.alias("id"), F.concat(F.lit("sym"), k % 17).alias("name"), (k % 40).cast("int").alias("kind"), F.col("s_nationkey").alias("file_id"), (k % 90).cast("int").alias("start_line"), (k % 90 + k % 3).cast("int").alias("end_line"), (k % 11).alias("parent_id"))
    files = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    kinds = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return items, files, kinds, s.select(k.alias("parent_code_item_id"), ((k * 7) % s.count() + 1).alias("base_code_item_id"))


@register(f"with {ITEMS_SQL} select i.id, coalesce(k.name, 'kind_' || i.kind) as kind, f.name as file, i.start_line, i.end_line from items i join files f on f.id = i.file_id left join kinds k on k.id = i.kind where i.name = 'sym5' and i.start_line <> i.end_line and i.kind in {S.NAVIGABLE} order by f.name, i.start_line, i.id limit 50")
def external_symbol_lookup(spark, sf_dir):
    items, files, kinds, _ = external_tables(spark, sf_dir)
    return S.external_symbols(items, files, kinds, "sym5").select("id", "kind", "file", "start_line", "end_line")


@register(f"with {ITEMS_SQL} select distinct b.name as base from inherits h join items d on h.parent_code_item_id = d.id join items b on h.base_code_item_id = b.id where d.name = 'sym3'")
def base_classes(spark, sf_dir):
    items, _, _, inherits = external_tables(spark, sf_dir)
    return S.base_classes(inherits, items, "sym3")


@register(f"with {ITEMS_SQL} select distinct d.name, f.name as file from inherits h join items d on h.parent_code_item_id = d.id join items b on h.base_code_item_id = b.id join files f on f.id = d.file_id where b.name = 'sym3' order by 1, 2 limit 50")
def derived_classes(spark, sf_dir):
    items, files, _, inherits = external_tables(spark, sf_dir)
    return S.derived_classes(inherits, items, files, "sym3")


@register(f"with {ITEMS_SQL} select id, name, start_line from items where parent_id = 4 order by start_line, id limit 200")
def members_ordered(spark, sf_dir):
    return S.members(external_tables(spark, sf_dir)[0], 4).select("id", "name", "start_line")


# References and display -------------------------------------------------------------------------------------------------
LINES_SQL = f"(select {PATH_SQL} as path, lang, source, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as line from documents where strlen(text) <= 524288)"


@register(f"select path, line::int as line, text from {LINES_SQL} where contains(text, 'Licen') and not (path = 'src1/en/2.md' and line between 1 and 3)")
def find_references(spark, sf_dir):
    return R.outside_definition(R.reference_lines(corpus(spark, sf_dir), "Licen"), "src1/en/2.md", 1, 3)


@register(f"select distinct path, line::int as line, md5(text) as digest, lang <> 'fr' as other from {LINES_SQL} where contains(text, 'tion') order by lang <> 'fr', path, line, digest limit 50")
def references_ranked(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    refs = R.reference_lines(docs.unionByName(docs), "tion")
    lang = F.split("path", "/")[1]
    return R.ranked_references(refs.withColumn("text", F.md5("text")), lang, "fr", 50).select("path", "line", F.col("text").alias("digest"), (F.col("language") != "fr").alias("other"))


@register("select k::int as k, rank::int as rank, case when k <= 3 then 200 when k <= 5 then 150 when k <= 10 then 100 when rank < 10 then 100 else 80 end as full_lines, case when k <= 3 then 15 when k <= 5 then 10 else 5 end as symbol_lines from (select distinct p_size as k, p_partkey % 20 as rank from part)")
def snippet_limits(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_size").alias("k"), (F.col("p_partkey") % 20).cast("int").alias("rank")).distinct()
    full, each = R.snippet_limits(F.col("k"), F.col("rank"))
    return rows.select("k", "rank", full.alias("full_lines"), each.alias("symbol_lines"))


@register("with d as (select doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) as l from documents), b as (select doc_id, list_slice(l, 2, len(l)) as l, greatest(len(l) - 1, 0) as n from d), s as (select *, case when n <= 8 then n else 8 end as shown from b) select doc_id, md5(array_to_string(list_transform(list_slice(l, 1, shown), lambda x, i: (9 + i) || ': ' || x), chr(10)) || case when n > 8 then chr(10) || '... (' || (n - 8) || ' more lines — use read_code(10, 40) for full content)' else '' end) as digest from s")
def snippets(spark, sf_dir):
    shown = R.snippet(F.col("text"), F.lit(10), F.lit(40), F.lit(1), F.lit("doc"), F.lit(8))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(shown).alias("digest"))
