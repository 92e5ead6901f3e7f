import hashlib
import math

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from codelake.operators import bm25, delta, fusion, knn, references as R, symbols as S


def scored(spark, docs, query):
    tokens = bm25.token_counts(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string"), "doc_id", "text")
    posts, lengths = bm25.postings(tokens), bm25.doc_lengths(tokens)
    counts = {t: query.count(t) for t in query}
    stored = bm25.idf_table(posts, bm25.corpus_stats(lengths))
    rows = bm25.scores(posts, lengths, counts).collect()
    assert sorted(rows) == sorted(bm25.scores(posts, lengths, counts, stored).collect()) and bm25.scores(posts, lengths, {}).isEmpty()
    return {r.doc_id: r.score for r in rows}


def test_bm25(spark):
    assert scored(spark, [["alpha", "beta"]], ["alpha"]) == {0: -0.274653}
    assert scored(spark, [["alpha", "beta"], ["gamma", "beta"]], ["alpha", "beta"]) == {0: -0.13412, 1: -0.13412}
    assert scored(spark, [["alpha", "beta", "alpha"], ["gamma", "beta"], ["delta", "eps"]], ["alpha", "beta", "alpha"]) == {0: 1.404634, 1: 0.081888}


def test_bm25_counts_and_top(spark):
    docs = spark.createDataFrame([(1, "getHTTPName getHTTPName the x"), (2, ""), (3, None), (4, "alpha")], "doc_id long, text string")
    tokens = bm25.token_counts(docs, "doc_id", "text")
    assert {(r.token, r.doc_id): r.tf for r in bm25.postings(tokens).collect()} == {("gethttpname", 1): 2, ("get", 1): 2, ("http", 1): 2, ("name", 1): 2, ("alpha", 4): 1}
    lengths = bm25.doc_lengths(tokens)
    assert {r.doc_id: r.dl for r in lengths.collect()} == {1: 8, 2: 0, 3: 0, 4: 1}
    hits = lambda *s: spark.createDataFrame(list(s), "doc_id long, score double")
    ids = lambda s, k: [r.doc_id for r in bm25.top(s, lengths, k).collect()]
    assert ids(hits((1, 0.5), (4, 0.7)), 3) == [4, 1] and ids(hits((1, -0.5), (4, 0.7)), 3) == [4] and ids(hits((1, -0.5), (4, 0.7)), 9) == [4, 1]


def test_mean_idf_keeps_its_digits(spark):
    n, words = 100, 300_000
    rare = spark.range(words).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("token"), (F.col("id") % n).alias("doc_id"), F.lit(1).alias("tf"))
    posts = rare.unionByName(spark.range(n).select(F.lit("all").alias("token"), F.col("id").alias("doc_id"), F.lit(1).alias("tf")))
    stats = spark.createDataFrame([(n, 1.0)], "n long, avgdl double")
    raw = lambda df: math.log(n - df + 0.5) - math.log(df + 0.5)
    floor = bm25.idf_table(posts, stats).where("token = 'all'").first().idf
    assert math.isclose(floor, 0.25 * math.fsum([*[raw(1)] * words, raw(n)]) / (words + 1), rel_tol=1e-15)


def test_knn(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.01, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in knn.top(vectors, [1.0, 0.0, 0.0], 3).collect()] == [0, 1, 2]
    assert vectors.select(knn.normalized(F.col("embedding")).alias("v")).collect()[2].v == [0.0, 0.0, 0.0]


def test_fusion_of_equal_keys(spark):
    side = lambda keys: spark.createDataFrame([(k, i + 1) for i, k in enumerate(keys)], "k string, rank int")
    fused = fusion.fuse(side("fgfh"), side("ffkh"), ("k",))
    rows = fused.orderBy(*fusion.ordered(fused)).collect()
    assert [(r.k, round(r.score, 9)) for r in rows] == [("f", 1.476062468), ("h", 0.953125), ("g", 0.491935484), ("k", 0.484126984)]


def test_islands(spark):
    spans = spark.createDataFrame([("a", 1, 10), ("a", 12, 20), ("a", 13, 14), ("a", 24, 30), ("a", 40, 41), ("b", 1, 2)], "f string, start_line int, end_line int")
    assert sorted((r.f, r.start_line, r.end_line, r.n_symbols) for r in S.islands(spans, "f").collect()) == [("a", 1, 30, 4), ("a", 40, 41, 1), ("b", 1, 2, 1)]


@settings(max_examples=8, deadline=None)
@given(stored=st.dictionaries(st.sampled_from("abcdef"), st.sampled_from("xyz")), current=st.dictionaries(st.sampled_from("abcdef"), st.sampled_from("xyz")))
def test_diff(spark, stored, current):
    table = lambda d: spark.createDataFrame(list(d.items()), "path string, sha256 string")
    got = {r.path: r.status for r in delta.snapshot_diff(table(stored), table(current)).collect()}
    assert got == {p: "new" if p not in stored else "deleted" if p not in current else "unchanged" if stored[p] == current[p] else "modified" for p in {**stored, **current}}


def test_new_ids(spark):
    new = spark.range(50).select((49 - F.col("id")).alias("x")).repartition(7)
    rows = delta.with_new_ids(new, 9, ["x"]).collect()
    ordered = sorted(range(50), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest()[:3], i))
    assert sorted((r.chunk_id, r.x) for r in rows) == [(10 + i, x) for i, x in enumerate(ordered)]
    assert min(r.chunk_id for r in delta.with_new_ids(new, None, ["x"]).collect()) == 0


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "path string, n int")
    new = spark.createDataFrame([("b", 3), ("b", 4), ("c", 5)], "path string, n int")
    assert sorted(map(tuple, delta.upserted(old, new, "path").collect())) == [("a", 1), ("b", 3), ("b", 4), ("c", 5)]


def test_references(spark):
    files = spark.createDataFrame([("a.py", "def foo():\n    pass\n"), ("b.py", "foo()\nx\nfoo() + foo()\n"), ("c.md", "Foo")], "path string, text string")
    refs = R.outside_definition(R.reference_lines(files, "foo"), "a.py", 1, 2)
    assert sorted((r.path, r.line) for r in refs.collect()) == [("b.py", 1), ("b.py", 3)]


def test_tree(spark):
    files = spark.createDataFrame([(f"d/f{i}.py",) for i in range(31)] + [("d/e/x.py",), ("README.md",)], "path string")
    rows = R.tree(files, 2).orderBy(*R.tree_order()).collect()
    assert [(r.parent, r.name, r.is_dir, r.n_files) for r in rows] == [("", "d", True, None), ("", "README.md", False, None), ("d", "e", True, None), ("d", None, False, 31)]


def test_hot_query_plan_stays_in_the_jvm(spark):
    tokens = spark.createDataFrame([(1, "alpha beta")], "id long, text string")
    plan = bm25.postings(bm25.token_counts(tokens, "id", "text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert np.isfinite(bm25.K1)


def test_whole_tables(spark):
    from codelake.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    ids = lambda table, col, where="true": {r[0] for r in spark.read.parquet(f"{sf}/{table}.parquet").where(where).select(col).collect()}
    assert {r.vec_id for r in QUERIES["filter_expression_whole"](spark, sf).collect()} == ids("embeddings", "vec_id", "label = 3")
    rows = QUERIES["multi_index_union_whole"](spark, sf).collect()
    ours = {f"src{i}" for i in range(7)}
    assert {r.id for r in rows if r.index_name in ours} == ids("benchmark", "item_id") and {r.index_name for r in rows} == ids("documents", "source") | ours
    assert {r.id for r in rows if r.index_name not in ours} == ids("documents", "doc_id", "source not in (" + ", ".join(f"'{x}'" for x in ours) + ")")
    assert 2 * QUERIES["bm25_negative_idf_whole"](spark, sf).count() > len(ids("pages", "page_id"))
