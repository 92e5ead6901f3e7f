import numpy as np
import pytest

from codelake.llm import minhash
from codelake.llm.minhash import Circulant, near_duplicates, overlaps


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(width, len(w))
        sets.setdefault(i, []).append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())
    top = {i: i for i in sets if i is not None}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = list(top)
    for a in ids:
        for b in ids:
            for x in sets[a]:
                for y in sets[b]:
                    if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                        p, q = root(a), root(b)
                        top[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}, sets


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_against_all_pairs(odd, width, percent):
    rows = near_duplicates(odd, width, percent).collect()
    expected, sets = brute([(r.doc_id, r.text) for r in odd.collect()], width, percent)
    assert len(rows) == odd.count()
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == expected[r.doc_id] and r.kept == (r.doc_id == r.component_id) and r.n_shingles in [len(s) for s in sets[r.doc_id]]


def test_empty(none):
    assert near_duplicates(none).collect() == []


def test_group_without_its_original(spark):
    """Many copies of one text, each with its own changes: most pairs are candidates and few are links."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        for at in rng.choice(200, int(rng.integers(2, 9)), replace=False):
            w[at] = f"x{i}_{at}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected, _ = brute(rows, 3, 85)
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, 3, 85).collect()} == expected


def test_coordinates_are_turns_of_one_permutation():
    c = Circulant(circle_bits=10)
    assert sorted(c.turned[:, 0].tolist()) == list(range(1 << 10))
    shingles = np.arange(50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sig = c.signature(shingles)
    assert len(sig) == 128 and (c.turned[:, 1][:-1] == c.turned[1:, 0]).all()
    same = np.mean(c.signature(shingles[:40]) == c.signature(shingles[10:]))
    assert abs(same - 30 / 50) < 0.2


def test_sets_over_a_million_shingles_stay_apart():
    c, rng = Circulant(), np.random.default_rng(3)
    a, b = (c.signature(np.unique(rng.integers(0, 1 << 63, 1_100_000).astype(np.uint64))) for _ in range(2))
    assert np.mean(a == b) < 0.15 and not np.isin(c.band_keys(a), c.band_keys(b)).any()


def test_overlaps_dense_and_sparse():
    rng = np.random.default_rng(8)
    for many in (40, 4000):
        sets = [[np.unique(rng.integers(0, many, 60)).astype(np.uint64) for _ in range(n)] for n in (30, 50)]
        flat = [(np.concatenate(s), np.repeat(np.arange(len(s)), [len(x) for x in s])) for s in sets]
        expected = [[len(np.intersect1d(x, y)) for y in sets[1]] for x in sets[0]]
        assert overlaps(*flat, (30, 50)).tolist() == expected


def test_blocks_of_a_large_group(spark, monkeypatch):
    """Copies that are mostly no links, in buckets of several blocks; one link for each component comes back."""
    monkeypatch.setattr(minhash, "BLOCK", 64)
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(600):
        w = list(base)
        for at in rng.choice(150, int(rng.integers(4, 12)), replace=False):
            w[at] = f"x{rng.integers(0, 3)}_{at}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected, _ = brute(rows, 3, 85)
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, 3, 85).collect()} == expected
