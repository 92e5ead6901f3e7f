import hashlib

from codelake.llm.suffix import repeats


def brute(rows):
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for k in range(len(t) - 49):
            if i is not None:
                w = t[k : k + 50]
                first[w] = min(i, first.get(w, i))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if i is not None and first[t[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        rest = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(odd):
    assert sorted(map(tuple, repeats(odd).collect()), key=str) == brute([(r.doc_id, r.text) for r in odd.collect()])


def test_small_buckets_and_edges(spark):
    p = "the quick brown fox jumps over the lazy dog and then sleeps for a long while"
    rows = [(3, "a" * 50), (1, "a" * 49), (2, "a" * 60), (7, p), (5, "xx" + p[:50]), (9, p[:50] + "q" + p[26:]), (8, "é" * 40), (4, "é" * 25 + "z"), (6, p + p), (-2, p[5:60])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, repeats(docs, bucket_bytes=1).collect()), key=str) == brute(rows)


def test_empty(none):
    assert repeats(none).collect() == []
