import numpy as np
from pyspark.sql import functions as F

from codelake.llm.ann import filled, nearest, rotate


def brute(rows, k):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, []).append(np.array(v, float))
    out = {}
    for i in ok:
        if i % 20 == 0:
            hits = [(-max(float((x * q).sum()) for x in ok[j] for q in ok[i] if len(x) == len(q)), j) for j in ok if j != i and any(len(x) == len(ok[i][0]) for x in ok[j])]
            out[i] = [(j, -s) for s, j in sorted(hits)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(21)] + [(40, None), (60, [0.0] * 5), (80, [1.0, None, 1.0, 1.0, 1.0]), (100, [float("nan")] * 5), (120, []), (None, [1.0] * 5), (3, [1.0] * 5), (140, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, key string")
    expected = {k: v for k, v in brute(rows, 20).items() if v}
    got = found(nearest(df, F.col("vec_id") % 20 == 0))
    assert got.keys() == expected.keys()
    for i in got:
        assert [j for j, _ in got[i]] == [j for j, _ in expected[i]] and np.allclose([s for _, s in got[i]], [s for _, s in expected[i]])
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_recall_and_ties(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    copies = df.where("vec_id < 40").select((F.col("vec_id") + 100000).alias("vec_id"), "embedding", "label")
    both = df.union(copies)
    got = found(nearest(both, F.col("vec_id") % 20 == 0))
    expected = brute([(r.vec_id, r.embedding) for r in both.collect()], 20)
    hits = sum(len({j for j, _ in got[i]} & {j for j, _ in expected[i]}) for i in expected)
    assert hits / sum(map(len, expected.values())) >= 0.9


def test_rotation_keeps_angles():
    x = filled(np.random.default_rng(0).normal(size=(10, 33)))
    y = rotate(x, 1)
    assert x.shape[1] == 64 and np.allclose(x @ x.T, y @ y.T)


def test_repeated_ids_take_one_place():
    from codelake.llm import ann

    rng = np.random.default_rng(5)
    q, x = rng.normal(size=(3, 8)), rng.normal(size=(60, 8))
    ids = np.arange(60)
    many = np.r_[ids, np.repeat(7, 30), ids]
    once = [(i, a.tolist(), s.tolist()) for i, a, s in ann.best(np.arange(100, 103), q, ids, x, 20)]
    again = [(i, a.tolist(), s.tolist()) for i, a, s in ann.best(np.arange(100, 103), q, many, np.r_[x, np.repeat(x[7:8], 30, 0), x], 20)]
    assert once == again and all(len(a) == 20 for _, a, _ in again)
