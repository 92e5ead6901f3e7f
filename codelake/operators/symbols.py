"""Symbol lookup, merged ranges, joins with chunks and with an external symbol database."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

# Kinds that count as declarations, ids of kinds that can be navigated to, and limits.
DECLARATIONS = ("class", "struct", "interface", "enum", "trait", "protocol", "type_alias")
NAVIGABLE = (1, 2, 3, 4, 5, 6, 7, 8, 10, 16, 18, 20, 21, 27, 28, 37)
MERGE_GAP, GROUP_LINES, LOOKUP_LIMIT = 5, 200, 200


def lookup(symbols: DataFrame, name: str, exact: bool = True, limit: int = LOOKUP_LIMIT, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Symbols of that name, whatever the case; with ``exact`` off those that hold it as well, after the exact ones. ``order`` says which the limit keeps."""
    low, key = name.lower(), F.lower("name")
    same = key == low
    rows = symbols.where(same if exact else same | F.contains(key, F.lit(low)))
    return rows.withColumn("is_exact", same).orderBy(F.desc("is_exact"), *order).limit(limit)


def declarations(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.col("kind").isin(*DECLARATIONS))


def islands(spans: DataFrame, *by: str, gap: int = MERGE_GAP, most: int = GROUP_LINES) -> DataFrame:
    """by, start_line, end_line, shown_end (at most ``most`` lines), n_symbols: spans merged where the next begins within ``gap`` lines of the end so far."""
    order = W.partitionBy(*by).orderBy("start_line", "end_line")
    seen = F.max("end_line").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = spans.withColumn("new", (seen.isNull() | (F.col("start_line") > seen + gap)).cast("int"))
    rows = rows.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    out = rows.groupBy(*by, "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count("*").alias("n_symbols"))
    return out.withColumn("shown_end", F.least("end_line", F.col("start_line") + most - 1)).drop("island")


def described(spans: DataFrame, *by: str, gap: int = MERGE_GAP, most: int = GROUP_LINES) -> DataFrame:
    """islands() of symbols (name, kind, at: their order) with ``symbols`` (all, in order of lines), ``hidden`` (those that begin below shown_end), first_at and name (the first one's)."""
    shown = islands(spans.select(*by, "start_line", "end_line"), *by, gap=gap, most=most).withColumnsRenamed({"start_line": "lo", "end_line": "hi"})
    s = spans.select(*(F.col(c).alias(f"_{c}") for c in by), "start_line", "end_line", "name", "kind", "at")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    both = shown.join(s, [*same, F.col("start_line").between(F.col("lo"), F.col("hi"))])
    label = F.concat(F.col("kind"), F.lit(" "), F.col("name"), F.lit(" (L"), F.col("start_line").cast("string"), F.lit("–"), F.col("end_line").cast("string"), F.lit(")"))
    brief = F.concat(F.col("kind"), F.lit(" "), F.col("name"), F.lit(" (L"), F.col("start_line").cast("string"), F.lit(")"))
    listed = lambda c: F.array_sort(F.collect_list(c))
    key = [F.col("start_line").alias("l"), F.col("at").alias("a")]
    out = both.groupBy(*by, "lo", "hi", "shown_end", "n_symbols").agg(listed(F.struct(*key, label.alias("t"))).alias("all"), listed(F.when(F.col("start_line") > F.col("shown_end"), F.struct(*key, brief.alias("t")))).alias("below"), F.min("at").alias("first_at"), F.min_by("name", F.struct(*key)).alias("name"))
    text = lambda c, sep: F.array_join(F.transform(c, lambda x: x.t), sep)
    return out.select(*by, F.col("lo").alias("start_line"), F.col("hi").alias("end_line"), "shown_end", "n_symbols", text("all", "  ").alias("symbols"), text("below", ", ").alias("hidden"), "first_at", "name")


def within_chunks(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols that begin in a chunk of their file: an equi-join on the file with a range condition."""
    c, s = chunks.alias("c"), symbols.alias("s")
    return c.join(s, F.expr("c.file_path = s.file_path and s.start_line between c.start_line and c.end_line"))


def external_symbols(items: DataFrame, files: DataFrame, kinds: DataFrame, name: str, navigable: tuple[int, ...] | None = NAVIGABLE, definitions: bool = True, limit: int = 50) -> DataFrame:
    """name, kind, file, start_line, end_line of an external database; case matters; one-line items are declarations."""
    rows = items.where(F.col("name") == name)
    rows = rows.where(F.col("kind").isin(*navigable)) if navigable else rows
    rows = rows.where("start_line <> end_line") if definitions else rows
    rows = rows.join(files.select(F.col("id").alias("file_id"), F.col("name").alias("file")), "file_id")
    rows = rows.join(kinds.select(F.col("id").alias("kind"), F.col("name").alias("kind_name")), "kind", "left")
    kind = F.coalesce("kind_name", F.concat(F.lit("kind_"), F.col("kind").cast("string")))
    return rows.select("name", kind.alias("kind"), "file", "start_line", "end_line", "id").orderBy("file", "start_line", "id").limit(limit)


def members(items: DataFrame, parent_id: int, limit: int = LOOKUP_LIMIT) -> DataFrame:
    return items.where(F.col("parent_id") == parent_id).orderBy("start_line", "id").limit(limit)


def base_classes(inherits: DataFrame, items: DataFrame, name: str) -> DataFrame:
    """Distinct names of what classes of that name derive from."""
    derived = items.where(F.col("name") == name).select(F.col("id").alias("parent_code_item_id"))
    bases = items.select(F.col("id").alias("base_code_item_id"), F.col("name").alias("base"))
    return inherits.join(derived, "parent_code_item_id").join(bases, "base_code_item_id").select("base").distinct()


def derived_classes(inherits: DataFrame, items: DataFrame, files: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """Distinct (name, file) of what derives from classes of that name."""
    bases = items.where(F.col("name") == name).select(F.col("id").alias("base_code_item_id"))
    derived = items.select(F.col("id").alias("parent_code_item_id"), "name", "file_id")
    rows = inherits.join(bases, "base_code_item_id").join(derived, "parent_code_item_id")
    return rows.join(files.select(F.col("id").alias("file_id"), F.col("name").alias("file")), "file_id").select("name", "file").distinct().orderBy("name", "file").limit(limit)


def tiered(external: DataFrame, catalog: DataFrame, by: str = "index_name") -> DataFrame:
    """What an external database found replaces the catalog's rows of that index."""
    return external.unionByName(catalog.join(external.select(by).distinct(), by, "left_anti"))
