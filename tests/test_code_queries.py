import json
import math

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
from codelake import cli
from codelake.functions import embedding as M, parsing

SF = "/root/testdata/sf0.001"
NAMES = ["parse_symbols", "parse_tree", "code_chunks", "code_chunks_recursive", "code_windows", "offset_windows", "decode_and_binary", "external_path_case", "stream_merge", "catalog_symbol_grouped", "catalog_references", "catalog_structure_top", "catalog_search_code", "catalog_empty_store", "heading_sections"]


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    for t in ("part", "benchmark", "documents", "pages", "events", "conversations"):
        out.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, db, name):
    df, known = E.queries()[name](spark, SF), db.sql(E.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(known.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    assert rows == sorted(tuple(map(plain, r)) for r in known.select(*columns).fetchall())


def test_batches_keep_order_and_are_halved():
    seen = []

    def run(texts):
        seen.append(len(texts))
        if sum(map(len, texts)) > 40:
            raise MemoryError
        return np.array([[len(t)] for t in texts], np.float32)

    texts = ["x" * n for n in (30, 1, 20, 2, 3)]
    assert M.in_batches(run, texts, most=4).ravel().tolist() == [30, 1, 20, 2, 3] and max(seen) == 4
    with pytest.raises(MemoryError):
        M.in_batches(run, ["x" * 50])


def test_models():
    assert M.resolved(M.DEFAULT_MODEL, gpus=1) == ("cuda", M.GPU_MODEL) and M.resolved(M.DEFAULT_MODEL) == ("cpu", M.DEFAULT_MODEL)
    assert M.resolved("minishlab/potion-code-16M", gpus=2)[0] == "cpu" and M.loaded("hashing-64").dim == 64
    with pytest.raises(ValueError):
        M.loaded("BAAI/bge-small-en-v1.5")


def test_own_word_is_nearest_among_many():
    e, body = M.HashingEmbedder(), "int Box{k}::area{k}(int a) {{\n  if (a) {{ return 1; }}\n  return 0;\n}}"
    vectors = e.passages([body.format(k=k) for k in range(20_000)])
    assert [int(np.argmax(vectors @ e.query(f"area{k}"))) for k in (12, 4321, 19_999)] == [12, 4321, 19_999]
    assert np.allclose(np.linalg.norm(vectors, axis=1), 1, atol=1e-6) and not e.query("").any() and np.allclose(e.query("a b B a"), e.query("b a a b"))


def test_time_limit():
    with pytest.raises(TimeoutError), parsing.limited(0.05):
        while True:
            pass
    with parsing.limited(5):
        pass


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "m.py").write_text("def find_me():\n    return 1\n")
    last = str(tmp_path / "home" / "last.json")
    assert cli.main(["init", "--repo", str(tmp_path)], spark, last) == 0 and cli.last_repository(last) == str(tmp_path)
    assert cli.main(["search", "find_me"], spark, last) == 0 and "m.py" in capsys.readouterr().out
    config = tmp_path / "c.json"
    config.write_text('{"servers": {"other": {"a": 1}}, "b": 2}')
    assert cli.main(["setup", str(config)], spark, last) == 0
    made = json.loads(config.read_text())
    assert made["b"] == 2 and set(made["servers"]) == {"other", "codelake"}
