import duckdb
from pyspark.sql import functions as F

from codelake.functions import files as P, text as T
from codelake.queries import tokens_sql

TOKENS = {
    "handleAuthCallback": "handleauthcallback handle auth callback",
    "get_file_symbols": "get file symbols get_file_symbols",
    "HTTPResponse": "httpresponse http response",
    "K2_GetActorRotation": "k2_getactorrotation k2 getactorrotation k2_ get actor rotation",
    "get_get_x": "get get get_get_x",
    "__init__": "init __init__",
    "parseHTTP2Frame": "parsehttp2frame parse http2 frame",
    "XMLHttpRequest_v2": "xmlhttprequest_v2 xmlhttprequest v2 xml http request_v2",
    "the quick brown fox": "quick brown fox",
    "def search_code(query, top_k):": "def search code search_code query top top_k",
    "a b c def": "def",
    "Hello WORLD x2y": "hello world x2y",
}


def test_tokens(spark):
    rows = spark.createDataFrame([(k,) for k in TOKENS], "t string").select("t", F.array_join(T.code_tokens(F.col("t")), " ").alias("x"))
    assert {r.t: r.x for r in rows.collect()} == TOKENS
    assert "Python" not in rows._jdf.queryExecution().toString()


def test_tokens_of_capitals_and_digits(spark):
    words = ["AKIA3XYZ9Q", "AKIACXBNCR5X", "A1B", "5X", "HTTP2", "2HTTP", "AB12", "ABC", "x5Y", "Abc9d", "A_B3C", "7F7F7F"]
    got = spark.createDataFrame([(w,) for w in words], "t string").select("t", T.code_tokens(F.col("t")).alias("x")).collect()
    assert {r.t: sorted(r.x) for r in got} == {w: sorted(duckdb.sql(f"select {tokens_sql(repr(w))}").fetchall()[0][0]) for w in words}
    assert {r.t: r.x for r in got}["AKIA3XYZ9Q"] == ["akia3xyz9q", "akia3", "xyz9"]


def test_windows(spark):
    for n, w in ((0, 5), (1, 5), (5, 5), (6, 5), (512, 512), (513, 512), (1000, 64)):
        text = " ".join(map(str, range(n)))
        got = spark.createDataFrame([(text,)], "t string").select(T.word_windows(F.col("t"), w).alias("x")).first().x
        step = w - w // 10
        expected, i = [], 0
        words = text.split()
        while words:
            expected.append(" ".join(words[i : i + w]))
            if i + w >= n:
                break
            i += step
        assert got == expected


def test_sections(spark):
    cases = {"# A\nx\n## B\ny\n": [(1, 2, 1), (3, 5, 2)], "pre\n\n# A\n#inc\n\n### C": [(1, 2, 0), (3, 3, 1), (4, 5, 1), (6, 6, 3)], "\n\n# Z": [(3, 3, 1)], "#": [(1, 1, 1)], "": [], "no heads\nx": [(1, 2, 0)]}
    rows = T.heading_sections(spark.createDataFrame(list(enumerate(cases)), "i long, t string"), "i", "t").collect()
    for i, (_, expected) in enumerate(cases.items()):
        assert sorted((r.start_line, r.end_line, r.heading_level) for r in rows if r.i == i) == expected


def test_lines(spark):
    got = spark.createDataFrame([("a\r\nb\n\nc\n",)], "t string").select(T.line_range(F.col("t"), 2, 9).alias("x"), T.line_range(F.col("t"), 7, 9).alias("y")).first()
    assert got.x == ["2: b", "3: ", "4: c"] and got.y == []


def test_languages(spark):
    names = {"a/b.py": "python", "x.H": "cpp", "Makefile": "makefile", "d/Dockerfile": "dockerfile", "s.glsl": "glsl", "n.exe": None, ".hidden.py": "python", ".py": None}
    rows = spark.createDataFrame([(k,) for k in names], "p string").select("p", P.language(F.col("p"), ["glsl"]).alias("l")).collect()
    assert {r.p: r.l for r in rows} == names


def test_globs(spark):
    cases = [("*.log", "a/b.log", True), ("*.log", "a/b.logs", False), ("node_modules/", "x/node_modules/y.js", True), ("/src/*.py", "src/a.py", True), ("/src/*.py", "x/src/a.py", False), ("src/**/t.py", "src/a/b/t.py", True), ("src/**/t.py", "src/t.py", True), ("docs", "docs/a.md", True), ("a?.c", "ab.c", True), ("[ab].c", "c.c", False)]
    for pattern, path, expected in cases:
        assert spark.createDataFrame([(path,)], "p string").select(P.matches_any(F.col("p"), [pattern]).alias("m")).first().m == expected, (pattern, path)


def test_filter_file():
    assert P.parse_filter_file("# c\nbuild/\n!keep.log\n[INCLUDE]\n*.py\n[exclude]\n*.log\n") == (["keep.log", "*.py"], ["build/", "*.log"])
    assert P.parse_condition('a == "x" and b == "y"') is not None and P.parse_condition("nonsense") is None and P.parse_condition("") is None
