"""A symbol database that another tool left beside a repository (SQLite), as DataFrames."""

from __future__ import annotations

import glob
import os
import sqlite3

from pyspark.sql import DataFrame, SparkSession

#: Names a database outright.
VARIABLE = "CODELAKE_SYMBOL_DB"
TABLES = {
    "code_items": "id long, name string, kind long, file_id long, start_line long, end_line long, parent_id long",
    "files": "id long, name string",
    "code_item_kinds": "id long, name string",
    "base_class_parents": "parent_code_item_id long, base_code_item_id long",
}


def find_databases(repo: str, max_parents: int = 4) -> list[str]:
    """The file that VARIABLE names, whatever else there is; else Browse.VC.db files in .vs folders of ``repo`` and the folders above, newest first."""
    if named := os.environ.get(VARIABLE):
        return [named] if os.path.isfile(named) else []
    found: set[str] = set()
    at = os.path.abspath(repo)
    for _ in range(max_parents + 1):
        found.update(glob.glob(os.path.join(at, ".vs", "*", "v*", "Browse.VC.db")))
        at = os.path.dirname(at)
    return sorted(found, key=lambda p: (-os.path.getmtime(p), p))


def load(spark: SparkSession, path: str | None, symbol: str | None = None) -> dict[str, DataFrame]:
    """The four tables; empty ones where the file or a table is missing. With ``symbol`` only rows about it: its items, their parents, bases, derived items and members, found by the database's own indexes."""
    rows: dict[str, list[tuple]] = {name: [] for name in TABLES}
    try:
        db = sqlite3.connect(f"file:{path}?mode=ro", uri=True) if path and os.path.exists(path) else None
    except sqlite3.Error:
        db = None
    columns = {name: ", ".join(c.split()[0] for c in schema.split(", ")) for name, schema in TABLES.items()}

    def ask(name: str, where: str = "", values: list | tuple = ()) -> list[tuple]:
        try:
            return db.execute(f"select {columns[name]} from {name} {where}", values).fetchall() if db else []
        except sqlite3.Error:
            return []

    def among(name: str, column: str, values: set) -> set[tuple]:
        out, values = set(), sorted(values)
        for i in range(0, len(values), 500):
            some = values[i : i + 500]
            out.update(ask(name, f"where {column} in ({', '.join('?' * len(some))})", some))
        return out

    if symbol is None:
        rows = {name: ask(name) for name in TABLES}
    else:
        own = set(ask("code_items", "where name = ?", [symbol]))
        ids = {i[0] for i in own}
        links = among("base_class_parents", "parent_code_item_id", ids) | among("base_class_parents", "base_code_item_id", ids)
        items = own | among("code_items", "id", {x for link in links for x in link} - ids) | among("code_items", "parent_id", ids)
        rows = {"code_items": sorted(items), "files": sorted(among("files", "id", {i[3] for i in items})), "code_item_kinds": ask("code_item_kinds"), "base_class_parents": sorted(links)}
    if db:
        db.close()
    return {name: spark.createDataFrame(rows[name], schema) for name, schema in TABLES.items()}
