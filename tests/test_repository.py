import os
import sqlite3

import pytest

from codelake.functions.files import with_stored_case
from codelake.operators import bm25
from codelake.plans.api import Catalog, render
from codelake.plans.index import build, build_from
from codelake.sources.external import load
from codelake.sources.store import Store
from codelake.streaming.ingest import ingest, merge_batch

FILES = {
    "README.md": "# Shapes\nDraws shapes.\n## Use\nCall the renderer.\n",
    "docs/guide.md": "# Guide\nHow to draw a circle with the renderer.\n",
    "src/shapes.py": '"""Shapes."""\n\n# area of a disc\ndef circle_area(r):\n    return 3.14 * r * r\n\n\ndef report(r):\n    return circle_area(r)\n',
    "src/view.ts": "export function renderView(x: number): number { return x; }\n",
    "src/math.cpp": "int addNumbers(int a, int b) { return a + b; }\n",
    "src/__init__.py": "",
    ".hidden.py": "def hidden_one():\n    pass\n",
    "build/skip.py": "def skipped(): pass\n",
    "bin.txt": "a\0b",
    "config.json": '{"a": 1}\n',
    "latin.txt": "caf\xe9\r\nx",
}


@pytest.fixture(scope="module")
def repo(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text.encode("latin-1" if name == "latin.txt" else "utf-8"))
    stats = build(spark, str(root), Store(spark, str(root / ".codelake")))
    assert stats.files_processed == 9 and stats.chunks_created == 10, stats
    return root


def test_calls(spark, repo):
    c = Catalog(spark, str(repo))
    assert c.list_indices().first().files == 9
    assert {r.name for r in c.get_file_symbols("src/shapes.py").collect()} == {"circle_area", "report"}
    hits = c.search_code("circle area").collect()
    assert {h.symbol_name for h in hits[:2]} == {"circle_area", "report"} and hits[0].path == "src/shapes.py" and 0 < hits[0].score <= 1.5
    assert "renderer" in render(c.search_docs("draw circle renderer"))
    assert c.read_code("src/shapes.py", 4, 5).first().code == "4: def circle_area(r):\n5:     return 3.14 * r * r"
    assert c.read_code("nope.py", 1, 2).isEmpty()
    assert [(r.start_line, r.end_line) for r in c.get_symbol_info("CIRCLE_AREA").collect()] == [(4, 5)]
    assert c.get_symbol_info("area", exact_match=False, mode="all").count() == 1
    assert [(r.path, r.line) for r in c.references("circle_area", "python", ("src/shapes.py", 4, 5)).collect()] == [("src/shapes.py", 9)]
    assert [r.name for r in c.get_repo_structure(1).collect()] == ["docs", "src", ".hidden.py", "config.json", "latin.txt", "README.md"]
    assert c.table("files").where("path = 'latin.txt'").first().text == "café\nx"


def test_symbol_info(spark, repo):
    c = Catalog(spark, str(repo))
    row = c.get_symbol_info("circle_area", include_code=True, include_references=True).first()
    assert row.code == "def circle_area(r):\n    return 3.14 * r * r" and [(r.path, r.line) for r in row.references] == [("src/shapes.py", 9)] and row.symbols == "function circle_area (L4–5)"
    assert c.get_symbol_info("circle_area", mode="declaration").count() == 0 and c.get_symbol_info("renderview", mode="all", include_code=True).first().code.startswith("export function")
    assert c.file_info("src/shapes.py").first().chunk_count == 2 and c.all_files().count() == 9 and c.chunks_of("src/shapes.py").count() == 2
    assert c.semantic("circle area", 3).count() == 3 and c.keyword("circle area", 3).first().rank == 1 and c.hybrid("circle area", 2).count() == 2
    assert [r.path for r in c.get_repo_structure(3).collect()] == ["docs", "docs/guide.md", "src", "src/__init__.py", "src/math.cpp", "src/shapes.py", "src/view.ts", ".hidden.py", "config.json", "latin.txt", "README.md"]


def test_several_indices(spark, repo, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "m.py").write_text(f"def of_{name}():\n    return 1\n")
        build(spark, str(tmp_path / name), Store(spark, str(tmp_path / name / ".codelake")))
    c = Catalog(spark, str(tmp_path))
    with pytest.raises(ValueError, match="a.*b"):
        c.search_code("of a")
    assert c.search_code("of a", index_name="a").first().path == "a/m.py" and c.list_indices().count() == 2
    assert {r.file for r in c.get_symbol_info("of_", exact_match=False).collect()} == {"m.py"}
    assert Catalog(spark, str(tmp_path / "none"), indices=[]).table("files").isEmpty()


def test_large_code_results_show_symbols(spark, tmp_path):
    body = "".join(f"    def m{i}(self):\n" + "        x = 1\n" * 60 for i in range(5))
    (tmp_path / "big.py").write_text("class Big:\n" + body)
    store = Store(spark, str(tmp_path / ".codelake"))
    build(spark, str(tmp_path), store)
    shown = Catalog(spark, str(tmp_path)).search_code("big", top_k=1).first().snippet
    assert shown.startswith("306 lines, 15 shown of each symbol") and "method m4 (L246–306)\n  246:     def m4(self):" in shown and shown.count("x = 1") == 14 * 5 + 13


def test_broken_tables_and_errors(spark, tmp_path):
    for name in ("x.py", "y.py"):
        (tmp_path / name).write_text(f"def {name[0]}_one():\n    return 1\n")
    store = Store(spark, str(tmp_path / ".codelake"))
    build(spark, str(tmp_path), store, exclude=["y.py"])
    assert build(spark, str(tmp_path), store).files_processed == 0  # the stored filter holds
    pointer = store._current()
    for f in os.listdir(tmp_path / ".codelake" / pointer["tables"]["postings"]):
        os.remove(tmp_path / ".codelake" / pointer["tables"]["postings"] / f)
    c = Catalog(spark, str(tmp_path))
    with pytest.warns(UserWarning):
        assert c.search_code("x_one").first().path == "x.py"
    unread = store.table("files").select("path", "size", "language", "file_class", "sha256", "text").selectExpr("*", "'error' as status")
    stats = build_from(unread, store)
    assert stats.files_deleted == 0 and store.table("chunks").count() == 1
    (tmp_path / "x.py").write_text("def x_two():\n    return 1\n")
    assert build(spark, str(tmp_path), store).files_processed == 1 and {r.token for r in store.table("postings").collect()} >= {"x_two"}
    assert store.vacuum(1) > 0 and store.table("chunks").count() == 1
    open(tmp_path / ".codelake" / "_versions" / "000000000099.json", "w").write("{broken")
    assert store.table("chunks").count() == 1


def test_increment(spark, repo):
    store = Store(spark, str(repo / ".codelake"))
    assert build(spark, str(repo), store).files_processed == 0
    (repo / "src/shapes.py").write_text("def square_area(a):\n    return a * a\n")
    os.remove(repo / "docs/guide.md")
    stats = build(spark, str(repo), store)
    assert (stats.files_processed, stats.files_deleted, stats.files_skipped) == (1, 1, 7)
    names = {r.name for r in store.table("symbols").collect()}
    assert "square_area" in names and "circle_area" not in names
    ids = [r.chunk_id for r in store.table("chunks").collect()]
    assert len(ids) == len(set(ids)) == store.table("vectors").count() == store.table("lengths").count()


def test_external(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "b.db")
    db.executescript(
        "create table code_items(id,name,kind,file_id,start_line,end_line,parent_id);create table files(id,name);create table code_item_kinds(id,name);create table base_class_parents(parent_code_item_id,base_code_item_id);"
        "insert into code_items values(1,'Base',1,1,1,9,0),(2,'Derived',1,1,10,20,0);insert into files values(1,'a.h');insert into code_item_kinds values(1,'class');insert into base_class_parents values(2,1);"
    )
    db.commit()
    found = load(spark, str(tmp_path / "b.db"))
    assert found["code_items"].count() == 2 and load(spark, None)["files"].isEmpty()
    one = load(spark, str(tmp_path / "b.db"), "Derived")
    assert one["code_items"].count() == 2 and one["base_class_parents"].count() == 1 and load(spark, str(tmp_path / "b.db"), "None")["files"].isEmpty()
    files = spark.createDataFrame([("Src/A.h",)], "path string")
    rows = with_stored_case(spark.createDataFrame([("C:\\R\\SRC\\A.H",), ("C:\\R\\b.h",), ("D:\\x.h",)], "file string"), files, "c:/r/")
    assert sorted(r.file for r in rows.collect()) == ["D:/x.h", "Src/A.h", "b.h"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"path": "a", "text": "alpha beta", "ts": 1}\n{"path": "b", "text": "gamma", "ts": 1}\n')
    store = Store(spark, str(tmp_path / "store"))
    store.commit({"files": spark.range(3)})  # other tables of the store stay
    read = lambda: spark.readStream.schema("path string, text string, ts long").json(str(tmp_path / "in"))
    ingest(read(), store, str(tmp_path / "cp")).awaitTermination(120)
    (tmp_path / "in/2.json").write_text('{"path": "a", "text": "a longer old text", "ts": 2}\n{"path": "a", "text": "delta", "ts": 3}\n')
    ingest(read(), store, str(tmp_path / "cp")).awaitTermination(120)
    assert {(r.path, r.token) for r in store.table("text_postings").collect()} == {("a", "delta"), ("b", "gamma")}
    assert store.table("files").count() == 3 and bm25.B == 0.75
    with pytest.raises(ValueError):
        merge_batch(store, spark.createDataFrame([("a", "x")], "path string, text string"))
