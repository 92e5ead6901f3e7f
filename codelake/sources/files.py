"""Repositories on a file system, as DataFrames."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import files as P

FILTER_FILE = ".codelakefilter"


def paths(root: str) -> list[tuple[str, int]]:
    """Relative paths and sizes below ``root``, sorted; hidden and junk directories and links left out, hidden files kept."""
    out = []
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and d not in P.JUNK_DIRS and not os.path.islink(os.path.join(folder, d)))
        for n in names:
            full = os.path.join(folder, n)
            if not os.path.islink(full) and os.path.isfile(full):
                out.append((os.path.relpath(full, root).replace(os.sep, "/"), os.path.getsize(full)))
    return sorted(out)


def listing(spark: SparkSession, root: str, include: Sequence[str] = (), exclude: Sequence[str] = (), custom: Sequence[str] = ("glsl", "hlsl", "fx")) -> DataFrame:
    """path, size, language, file_class of the files that filters and sizes let through; only names are looked at."""
    own_in, own_out = [], []
    if os.path.exists(rule := os.path.join(root, FILTER_FILE)):
        with open(rule, encoding="utf-8") as f:
            own_in, own_out = P.parse_filter_file(f.read())
    rows = spark.createDataFrame(paths(root) or [], "path string, size long")
    path = F.col("path")
    for out, into in ((own_out, own_in), (exclude, include)):
        rows = rows.where(~P.matches_any(path, out)) if out else rows
        rows = rows.where(P.matches_any(path, into)) if into else rows
    rows = rows.withColumn("language", P.language(path, custom)).where("language is not null")
    rows = rows.withColumn("file_class", P.file_class(F.col("language"), custom))
    return sized(rows)


def sized(rows: DataFrame) -> DataFrame:
    """Files up to MAX_BYTES, and all code."""
    return rows.where((F.col("size") <= P.MAX_BYTES) | (F.col("file_class") == "code"))


def contents(listed: DataFrame, root: str, slices: int | None = None) -> DataFrame:
    """``listed`` with content (null where unreadable), binary files left out; files are dealt out by a hash and read on executors."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listed.schema) + ", content binary"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for p in frame["path"]:
                try:
                    with open(os.path.join(root, p), "rb") as f:
                        found.append(f.read())
                except OSError:
                    found.append(None)
            yield frame.assign(content=found)

    rows = (listed.repartition(slices, "path") if slices else listed.repartition("path")).mapInPandas(run, schema)
    return without_binary(rows)


def without_binary(rows: DataFrame) -> DataFrame:
    """Less those with a NUL in their first BINARY_HEAD bytes; empty and unreadable ones stay."""
    head = F.decode(F.substring("content", 1, P.BINARY_HEAD), "ISO-8859-1")
    return rows.where(F.col("content").isNull() | (F.instr(head, "\u0000") == 0))


def decoded(files: DataFrame) -> DataFrame:
    """``files`` with sha256 of the bytes, and text: UTF-8, else Latin-1, line ends made one; status 'error' where nothing was read."""
    raw = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return files.select("*", F.sha2("content", 256).alias("sha256"), F.regexp_replace(raw, "\r\n?", "\n").alias("text"), F.when(F.col("content").isNull(), "error").otherwise("ok").alias("status")).drop("content")
