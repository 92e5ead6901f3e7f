from pyspark.sql import functions as F

import corpus_pipeline as P
from codelake.llm.common import materialize
from codelake.llm.quality import quality_report
from codelake.llm.secrets import find_secrets


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = materialize(P.quality(spark, docs, sf), "good")
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality_report(docs, labels).where("kept").collect()}
    kept = materialize(P.deduplicated(spark, good, sf), "kept")
    sets = {}
    for r in good.collect():
        w = r.text.encode().lower().split()
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = root(a), root(b)
                top[max(p, q)] = min(p, q)
    assert {r.doc_id for r in kept.collect()} == {i for i in top if root(i) == i}
    clean = materialize(P.secrets(spark, kept, sf), "clean")
    assert clean.columns == docs.columns and clean.count() == kept.count() and not any(find_secrets(r.text) for r in clean.collect())
    mixed = materialize(P.mixing(spark, clean, sf), "mixed")
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in clean.collect()}
    assert P.encoding(spark, mixed, sf).columns == ["doc_id", "n_tokens", "ids", "decoded"]


def brute_kept(rows):
    """Ids that stay, from all pairs of rows (id, text); one of rows that repeat both."""
    sets = [(i, t, {tuple(w[k : k + min(5, len(w))]) for k in range(max(1, len(w) - 4))} if (w := (t or "").encode().lower().split()) else set()) for i, t in rows]
    top = {i: i for i, _, _ in sets if i is not None}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, _, a in sets:
        for j, _, b in sets:
            if None not in (i, j) and i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = root(i), root(j)
                top[max(p, q)] = min(p, q)
    kept = sorted({(i, t or "", t is None) for i, t, _ in sets if i is not None and root(i) == i}, key=str)
    return kept, sum(i is None for i, _ in rows)


def test_odd_tables(spark, odd, none, tmp_path):
    """Nulls, repeated rows, extra columns whose names operators use themselves; empty tables."""
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for c in ("_hash", "_before", "row", "hash", "tie", "key", "size", "_row", "text_a"):
        odd, none = odd.withColumn(c, F.col("text")), none.withColumn(c, F.col("text"))
    good = P.quality(spark, odd, str(tmp_path))
    assert good.columns == odd.columns and all(r.text is not None and r._hash == r.text and r.row == r.text for r in good.collect())
    kept = P.deduplicated(spark, odd, str(tmp_path))
    rows = kept.collect()
    expected, without_id = brute_kept([(r.doc_id, r.text) for r in odd.collect()])
    assert kept.columns == odd.columns and all(r._hash == r.text == r.size == r.tie for r in rows)
    assert sorted(((r.doc_id, r.text or "", r.text is None) for r in rows if r.doc_id is not None), key=str) == expected and sum(r.doc_id is None for r in rows) == without_id
    for stage in (P.secrets, P.mixing):
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns and all(r.row == r._hash == r.key for r in out.collect())
    assert P.encoding(spark, odd, str(tmp_path)).count() == odd.count()
    for _, stage in P.STAGES:
        assert stage(spark, none, str(tmp_path)).collect() == []


def test_encoding_by_the_library(spark, odd, tmp_path):
    import tokenizers

    from codelake.llm.bpe import tokenizer_path

    own = tokenizers.Tokenizer.from_file(tokenizer_path())
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, set()).add(r.text or "")
    for r in P.encoding(spark, odd, str(tmp_path)).collect():
        options = [own.encode(t, add_special_tokens=False).ids for t in texts[r.doc_id]]
        assert [int(x) for x in r.ids.split()] in options and r.n_tokens == len(r.ids.split()) and r.decoded in [own.decode(o, skip_special_tokens=False) for o in options]
