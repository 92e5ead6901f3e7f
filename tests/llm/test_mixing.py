import duckdb
import pyarrow.parquet as pq
import pytest

from codelake.llm import mixing


def by_sql(odd, tmp_path):
    pq.write_table(odd.select("doc_id", "text", "source").toArrow(), tmp_path / "d.parquet")
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/d.parquet'")
    return sorted(db.sql(mixing.oracle()).fetchall(), key=str)


def test_against_sql(odd, tmp_path):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(r.taken <= 3 * r["size"] for r in rows)
    unique = [r for r in rows if r.doc_id is not None and r.doc_id not in (0, 3)]
    assert sorted(map(tuple, unique), key=str) == [r for r in by_sql(odd, tmp_path) if r[0] is not None and r[0] not in (0, 3)]
    total = {}
    for r in rows:
        t = total.setdefault(r.source, [0, 0, r.target])
        t[0], t[1] = t[0] + r["size"], t[1] + r.taken
    assert all(abs(taken - target) <= 1 for _, taken, target in total.values()) and abs(sum(t[2] for t in total.values()) - sum(t[0] for t in total.values())) < 1e-6


def test_caps_are_shared_again(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), ("d", 10)], "source string, source_size long")
    rows = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert rows["a"] == 30 and rows["d"] == 30 and rows["b"] == pytest.approx(1960 * 2 / 3) and rows["c"] == pytest.approx(1960 / 3)


def test_quotas_are_highest_quotients(spark):
    goals = mixing.targets(spark.createDataFrame([("a", 50), ("b", 30), ("c", 20)], "source string, source_size long"))
    got = {}
    for r in mixing.quotas(goals, seats=40, shards=4).collect():
        got[r.k] = got.get(r.k, 0) + r.blocks
    target = {r.k: r.target for r in goals.collect()}
    seats = dict.fromkeys(target, 0)
    for _ in range(sum(got.values())):
        k = max(seats, key=lambda k: (target[k] / (2 * seats[k] + 1), -k))
        seats[k] += 1
    assert got == seats


def test_documents(odd, none):
    out = mixing.mixed_documents(odd)
    taken = {}
    for r in mixing.mix(odd).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len((r.text or "").encode().split())
    assert out.columns == odd.columns and {k: v for k, v in taken.items() if v} == {k: v for k, v in words.items() if v}
    assert mixing.mix(none).collect() == [] and mixing.mixed_documents(none).collect() == []


def of_words(spark, sizes):
    """Documents of 10 words at most for each source."""
    rows, i = [], 0
    for source, n in sizes.items():
        for at in range(0, n, 10):
            rows.append((i, " ".join(f"w{j}" for j in range(at, min(at + 10, n))), source))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def sums(rows):
    total = {}
    for r in rows:
        t = total.setdefault(r.source, [r.source_size, r.target, 0])
        t[2] += r.taken
    return total


def test_small_sources_at_long_blocks(spark):
    docs = of_words(spark, {"a": 5000, "b": 4000, "tiny": 1, "u": 7, "v": 25})
    rows = mixing.mix(docs, seats=2000).collect()  # blocks of 5 words
    total = sums(rows)
    assert all(r.taken <= 3 * r["size"] for r in rows) and abs(sum(t[2] for t in total.values()) - 9033) <= 10
    assert all(abs(total[k][2] - total[k][1]) <= 1 and total[k][2] > 0 for k in ("tiny", "u", "v")) and all(abs(total[k][2] - total[k][1]) <= 10 for k in "ab")
    out = {}
    for r in mixing.mixed_documents(docs, seats=2000).collect():
        out[r.source] = out.get(r.source, 0) + len(r.text.split())
    assert out == {k: t[2] for k, t in total.items()}


def test_more_sources_than_seats(spark):
    total = sums(mixing.mix(of_words(spark, {f"s{i}": 1 + i % 13 for i in range(300)}), seats=40).collect())
    assert len(total) == 300 and all(abs(t[2] - t[1]) <= 1 and t[2] > 0 for t in total.values()) and sum(t[2] for t in total.values()) == sum(t[0] for t in total.values())


def test_against_sql_at_long_blocks(spark, tmp_path):
    docs = of_words(spark, {"a": 3001, "b": 2500, "c": 2600})
    pq.write_table(docs.toArrow(), tmp_path / "d.parquet")
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/d.parquet'")
    assert sorted(map(tuple, mixing.mix(docs, seats=4000).collect())) == sorted(db.sql(mixing.oracle(seats=4000)).fetchall())


def test_many_sources(spark):
    sizes = spark.range(100_000).selectExpr("cast(id as string) as source", "1 + id % 97 as source_size")
    rows = mixing.targets(sizes).agg({"target": "sum", "all": "max", "*": "count"}).first().asDict()
    assert rows["count(1)"] == 100_000 and abs(rows["sum(target)"] - rows["max(all)"]) < 1e-3


def test_rows_that_differ_in_text_only(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 5), (1, "d e f", "s", 5), (None, "g h i", "s", 5), (None, "j k l", None, 5)], "doc_id long, text string, source string, key int")
    out = sorted((r.text for r in mixing.mixed_documents(docs).collect()), key=str)
    assert out == ["a b c", "d e f", "g h i", "j k l"]
