"""Textual references, directory trees and snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T
from ..functions.files import MAX_REFERENCE_BYTES


def reference_lines(files: DataFrame, symbol: str, path: str = "path", text: str = "text") -> DataFrame:
    """path, line, text of the lines that hold ``symbol``; case matters; large files are left out. Files without it are dropped before lines are made."""
    rows = files.where((F.octet_length(F.col(text)) <= MAX_REFERENCE_BYTES) & F.contains(F.col(text), F.lit(symbol)))
    rows = rows.select(F.col(path).alias("path"), F.posexplode(T.lines(F.col(text))).alias("at", "text"))
    return rows.where(F.contains("text", F.lit(symbol))).select("path", (F.col("at") + 1).alias("line"), "text")


def outside_definition(refs: DataFrame, path: str, start: int, end: int) -> DataFrame:
    return refs.where(~((F.col("path") == path) & F.col("line").between(start, end)))


def ranked_references(refs: DataFrame, lang: Column, wanted: str, limit: int) -> DataFrame:
    """Distinct references, those of the symbol's language first, then by path and line."""
    rows = refs.withColumn("language", lang).dropDuplicates(["path", "line", "text"])
    return rows.orderBy((F.col("language") != wanted).cast("int"), "path", "line", "text").limit(limit)


def snippet_limits(k: Column, rank: Column) -> tuple[Column, Column]:
    """(lines shown in full, lines shown of each symbol) by how many results were asked for, and the rank."""
    full = F.when(k <= 3, 200).when(k <= 5, 150).when(k <= 10, 100).when(rank < 10, 100).otherwise(80)
    return full, F.when(k <= 3, 15).when(k <= 5, 10).otherwise(5)


# The words that tell of lines left out.
MORE, RANGE, FULL = " more lines — use read_code(", ", ", ") for full content)"


def snippet(text: Column, start: Column, end: Column, header: Column, kind: Column, full: Column) -> Column:
    """Numbered lines of a chunk without its header: all, if they fit, else the first (30 of code, ``full`` of others) and a hint."""
    body = F.slice(T.lines(text), header + 1, F.greatest(F.lit(0), F.size(T.lines(text)) - header))
    n = F.size(body)
    shown = F.when(n <= full, n).when(kind == "code", F.lit(30)).otherwise(full)
    numbered = F.array_join(F.transform(F.slice(body, 1, shown), lambda line, i: F.concat((start + i).cast("string"), F.lit(": "), line)), "\n")
    hint = F.concat(F.lit("\n... ("), (n - shown).cast("string"), F.lit(MORE), start.cast("string"), F.lit(RANGE), end.cast("string"), F.lit(FULL))
    return F.when(n <= full, numbered).otherwise(F.concat(numbered, hint))


def previews(text: Column, start: Column, header: Column, symbols: Column, each: Column) -> Column:
    """The first ``each`` lines of every symbol (array of start_line, end_line, kind, name) of a chunk, numbered, under a line that names it; symbols that begin outside the text are left out."""
    ls = T.lines(text)

    def one(s: Column) -> Column:
        at = s["start_line"] - start + header
        shown = F.slice(ls, F.greatest(at, F.lit(0)) + 1, F.least(each, s["end_line"] - s["start_line"] + 1))
        body = F.array_join(F.transform(shown, lambda line, i: F.concat(F.lit("  "), (s["start_line"] + i).cast("string"), F.lit(": "), line)), "\n")
        return F.when((at >= 0) & (at < F.size(ls)), F.concat(s["kind"], F.lit(" "), s["name"], F.lit(" (L"), s["start_line"].cast("string"), F.when(s["end_line"] != s["start_line"], F.concat(F.lit("–"), s["end_line"].cast("string"))).otherwise(""), F.lit(")\n"), body))

    first = F.concat((F.size(ls) - header).cast("string"), F.lit(" lines, "), each.cast("string"), F.lit(" shown of each symbol"))
    return F.array_join(F.concat(F.array(first), F.filter(F.transform(symbols, one), lambda x: x.isNotNull())), "\n\n")


def tree(files: DataFrame, depth: int = 3, most_children: int = 30, path: str = "path") -> DataFrame:
    """parent, name, is_dir, n_files: what a listing down to ``depth`` shows; a directory of more than ``most_children`` shows its files as one count (name null)."""
    parts = F.split(F.col(path), "/")
    steps = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda i: F.struct(F.array_join(F.slice(parts, 1, i - 1), "/").alias("parent"), F.element_at(parts, i).alias("name"), (i < F.size(parts)).alias("is_dir")))
    nodes = files.select(F.explode(steps).alias("s")).select("s.*").distinct()
    crowded = nodes.groupBy("parent").agg(F.count("*").alias("children"))
    nodes = nodes.join(crowded, "parent")
    kept = nodes.where((F.col("children") <= most_children) | F.col("is_dir")).select("parent", "name", "is_dir", F.lit(None).cast("long").alias("n_files"))
    counted = nodes.where((F.col("children") > most_children) & ~F.col("is_dir")).groupBy("parent").agg(F.count("*").alias("n_files"))
    return kept.unionByName(counted.select("parent", F.lit(None).cast("string").alias("name"), F.lit(False).alias("is_dir"), "n_files"))


def tree_order() -> list[Column]:
    """Directories first, then names whatever the case; counts last."""
    return [F.col("parent"), F.desc("is_dir"), F.col("name").isNull(), F.lower("name"), F.col("name")]


def depth_first(nodes: DataFrame) -> Column:
    """What orders a listing: every directory's own entries right below it, directories before files, names whatever the case, counts last."""
    parts = F.filter(F.split("parent", "/"), lambda p: p != "")
    step = lambda rank, name: F.struct(rank.alias("rank"), F.lower(name).alias("low"), name.alias("name"))
    own = F.when(F.col("name").isNull(), F.lit(2)).when(F.col("is_dir"), F.lit(0)).otherwise(F.lit(1))
    return F.concat(F.transform(parts, lambda p: step(F.lit(0), p)), F.array(step(own, F.coalesce("name", F.lit("")))))


def tree_ranks(nodes: DataFrame) -> DataFrame:
    """``nodes`` with their place in their own directory."""
    return nodes.withColumn("place", F.row_number().over(W.partitionBy("parent").orderBy(*tree_order()[1:])))
