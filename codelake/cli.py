"""Command line: ``python -m codelake.cli init|update|search|symbol|setup ...``."""

from __future__ import annotations

import argparse
import json
import os
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .plans.api import Catalog, render
from .plans.index import build
from .sources.store import Store

FOLDER = ".codelake"
#: Remembers the repository that was last indexed, below the user's home.
LAST = os.path.join("~", FOLDER, "last.json")


def merged(base: dict, new: dict) -> dict:
    """``new`` over ``base``; objects that both have are merged in turn."""
    return base | {k: merged(base[k], v) if isinstance(base.get(k), dict) and isinstance(v, dict) else v for k, v in new.items()}


def merge_json(path: str, new: dict) -> dict:
    """The JSON file with ``new`` merged in, written back whole; what can't be read counts as empty."""
    path = os.path.expanduser(path)
    try:
        with open(path, encoding="utf-8") as f:
            base = json.load(f)
    except (OSError, ValueError):
        base = {}
    out = merged(base if isinstance(base, dict) else {}, new)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".new", "w", encoding="utf-8") as f:
        json.dump(out, f, indent=2, ensure_ascii=False)
    os.replace(path + ".new", path)
    return out


def last_repository(path: str = LAST) -> str | None:
    """The repository of the last run, if it is still there."""
    try:
        with open(os.path.expanduser(path), encoding="utf-8") as f:
            found = json.load(f)["repo"]
    except (OSError, ValueError, KeyError, TypeError):
        return None
    return found if os.path.isdir(found) else None


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None, last: str = LAST) -> int:
    parser = argparse.ArgumentParser(prog="codelake")
    parser.add_argument("command", choices=("init", "update", "search", "symbol", "setup"))
    parser.add_argument("what", nargs="?", help="a query, a symbol, or the client's configuration file")
    parser.add_argument("--repo", help="the repository; else that of the last run, or the current folder")
    parser.add_argument("--index", help="which of several indices")
    parser.add_argument("--include", action="append")
    parser.add_argument("--exclude", action="append")
    parser.add_argument("--top", type=int, default=8)
    got = parser.parse_args(args)
    repo = os.path.abspath(got.repo or (os.getcwd() if got.command == "init" else last_repository(last) or os.getcwd()))
    if got.command == "setup":
        merge_json(got.what or os.path.join(repo, ".mcp.json"), {"servers": {"codelake": {"command": "python", "args": ["-m", "codelake.cli", "search", "--repo", repo]}}})
        return 0
    spark = spark or SparkSession.builder.appName("codelake").getOrCreate()
    if got.command in ("init", "update"):
        print(build(spark, repo, Store(spark, os.path.join(repo, FOLDER)), include=got.include, exclude=got.exclude))
        merge_json(last, {"repo": repo})
        return 0
    catalog = Catalog(spark, repo)
    if not catalog.indices or not got.what:
        print("nothing is indexed here" if not catalog.indices else "search for what?")
        return 1
    print(render(catalog.search_code(got.what, got.top, index_name=got.index) if got.command == "search" else catalog.get_symbol_info(got.what, include_code=True, index_name=got.index)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
