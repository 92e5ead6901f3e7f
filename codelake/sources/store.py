"""Versioned tables: every commit writes a pointer file that names each table's folder; tables that a commit leaves out stay as they were."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
import warnings

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

POINTERS = "_versions"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where executors are threads of the driver."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="codelake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Store:
    """Tables below ``root``, a path of any file system that Spark reaches. Readers keep the version they opened while a writer makes the next.

    A pointer is created whole or not at all by one writer: of two that commit the same version, the later one fails and
    the store keeps the first. A pointer that can't be read counts as not written.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _pointers(self) -> list[str]:
        """Names of pointer files, the newest first."""
        at = self._path(POINTERS)
        return sorted((f.getPath().getName() for f in self._fs.listStatus(at)), reverse=True) if self._fs.exists(at) else []

    def _read(self, name: str) -> dict | None:
        try:
            stream = self._fs.open(self._path(POINTERS, name))
            try:
                found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
            return found if isinstance(found["tables"], dict) and isinstance(found["version"], int) else None
        except (ValueError, KeyError, TypeError):
            return None

    def _current(self) -> dict:
        return next((p for p in map(self._read, self._pointers()) if p), {"version": 0, "tables": {}, "config": {}})

    @property
    def version(self) -> int:
        return self._current()["version"]

    def table(self, name: str) -> DataFrame | None:
        """The table, or None where it is missing or its files can't be read."""
        at = self._current()["tables"].get(name)
        if at is None:
            return None
        try:
            return self.spark.read.parquet(f"{self.root}/{at}")
        except PySparkException:
            warnings.warn(f"{self.root}/{at} can't be read; {name} counts as missing", stacklevel=2)
            return None

    def config(self) -> dict:
        found = self._current().get("config")
        return found if isinstance(found, dict) else {}

    def commit(self, tables: dict[str, DataFrame], config: dict | None = None, drop: tuple[str, ...] = ()) -> int:
        """Writes ``tables`` and points to them and to the other tables of the version before, less ``drop``."""
        before = self._current()
        new, folder = before["version"] + 1, f"data/{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{folder}/{name}")
        kept = {name: at for name, at in before["tables"].items() if name not in drop}
        pointer = {"version": new, "tables": kept | {name: f"{folder}/{name}" for name in tables}, "config": self.config() if config is None else config}
        out = self._fs.create(self._path(POINTERS, f"{new:012d}.json"), False)
        try:
            out.write(json.dumps(pointer).encode())
        finally:
            out.close()
        return new

    def vacuum(self, keep: int = 2) -> int:
        """Deletes pointers but the newest ``keep``, and the folders of tables that none of those names; says how many folders."""
        names, used = self._pointers(), set()
        for name in names[:keep]:
            used.update(at.split("/")[1] for at in (self._read(name) or {"tables": {}})["tables"].values())
        for name in names[keep:]:
            self._fs.delete(self._path(POINTERS, name), False)
        at = self._path("data")
        gone = [f.getPath() for f in self._fs.listStatus(at) if f.getPath().getName() not in used] if self._fs.exists(at) else []
        for path in gone:
            self._fs.delete(path, True)
        return len(gone)


def find_indices(root: str, folder: str = ".codelake") -> list[tuple[str, str]]:
    """(prefix, path) of the stores below ``root``, sorted; just the root's own where it has one, with an empty prefix."""
    if os.path.exists(os.path.join(root, folder, POINTERS)):
        return [("", os.path.join(root, folder))]
    out = []
    for at, dirs, _ in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d != "node_modules")
        if folder in dirs and os.path.exists(os.path.join(at, folder, POINTERS)):
            out.append((os.path.relpath(at, root).replace(os.sep, "/"), os.path.join(at, folder)))
    return sorted(out)
