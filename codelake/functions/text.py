"""Tokenizing, windows, sections and line ranges as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# English stop words of the keyword index.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such",
    "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)


def split_identifier(token: Column) -> Column:
    """Lower-cased parts of an identifier: those between underscores, those at case changes not among them, and the whole in front if new."""
    snake = F.when(token.contains("_"), F.filter(F.split(F.lower(token), "_"), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    humps = F.regexp_replace(F.regexp_replace(token, "(.)([A-Z][a-z]+)", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    camel = F.filter(F.split(F.lower(humps), r"\s+"), lambda x: x != "")
    parts = F.concat(snake, F.array_except(camel, snake))
    whole = F.when(F.array_contains(parts, F.lower(token)), parts).otherwise(F.concat(F.array(F.lower(token)), parts))
    # most tokens have one part only: no underscore, and no capital after the first letter or capitals with digits behind them only, as a capital behind a digit begins a part
    return F.when(token.rlike(r"^(?:[A-Z]?[^A-Z_\s]*|[A-Z]+[0-9]*)\z"), F.array(F.lower(token))).otherwise(whole)


# What separates raw words of the keyword index.
RAW_BREAK = "[^a-zA-Z0-9_]+"


def expanded(raw: Column) -> Column:
    """Tokens of one raw word: its parts of two characters or more, less stop words."""
    return F.filter(split_identifier(raw), lambda x: (F.length(x) >= 2) & ~x.isin(*STOP_WORDS))


def code_tokens(text: Column) -> Column:
    """Tokens of code or prose in order, repeats kept: identifiers of two characters or more, expanded, less stop words."""
    raw = F.filter(F.split(F.coalesce(text, F.lit("")), RAW_BREAK), lambda x: F.length(x) >= 2)
    return F.flatten(F.transform(raw, expanded))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def count_words(text: Column) -> Column:
    return F.size(words(text))


def window_starts(n: Column, width: int) -> Column:
    """Starts (from 0) of windows of ``width`` over n items, a tenth of the width shared; empty for n = 0."""
    step = max(1, width - int(width * 0.1))
    last = F.greatest(F.lit(0), F.ceil((n - width) / step)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def word_windows(text: Column, width: int) -> Column:
    """Texts of the windows, words joined by one space. The words are bound once, not split anew for each window."""
    one = F.transform(F.array(words(text)), lambda w: F.transform(window_starts(F.size(w), width), lambda i: F.array_join(F.slice(w, i + 1, width), " ")))
    return one[0]


def offset_windows(text: Column, offsets: Column, width: int) -> Column:
    """Slices of the text from the first to the last token of each window of ``width`` tokens; blank ones are left out.

    ``offsets``: array of (start, end) in characters. A text without tokens, or with blank windows only, is one window; a
    blank text without tokens is none.
    """
    filled = lambda x: F.length(F.regexp_replace(x, r"\s", "")) > 0

    def cut(o: Column, i: Column) -> Column:
        first, last = F.get(o, i), F.get(o, F.least(i + width, F.size(o)) - 1)
        return F.substring(text, first["start"] + 1, last["end"] - first["start"])

    # offsets, and then windows, are bound once
    windows = F.transform(F.array(offsets), lambda o: F.filter(F.transform(window_starts(F.size(o), width), lambda i: cut(o, i)), filled))[0]
    return F.transform(F.array(windows), lambda w: F.when(F.size(w) > 0, w).when((F.size(offsets) == 0) & ~filled(text), F.array().cast("array<string>")).otherwise(F.array(text)))[0]


def lines(text: Column) -> Column:
    """Lines without their ends; none for an empty text, no empty one after a final end."""
    clean = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"\n\z", "")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(clean, "\n"))


def line_range(text: Column, start: Column | int, end: Column | int) -> Column:
    """Lines start .. end (from 1, both included, clamped), each as "n: line"."""
    start, end = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    first = F.greatest(F.lit(1), start)
    picked = F.slice(lines(text), first, F.greatest(F.lit(0), F.least(end, F.size(lines(text))) - first + 1))
    return F.transform(picked, lambda line, i: F.concat((first + i).cast("string"), F.lit(": "), line))


def heading_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, section, start_line, end_line, heading_level (0: none), text of the sections that lines with a leading # begin; blank ones dropped. A text is cut inside its row: no shuffle."""
    count = lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit(""))) + 1
    rows = docs.select(key, F.split(F.col(text), "\n(?=#)").alias("ps"))
    # the line that each piece begins at, and one more: a running sum
    begins = F.aggregate("ps", F.array(F.lit(1)), lambda done, p: F.concat(done, F.array((F.element_at(done, -1) + count(p)).cast("int"))))
    out = rows.select(key, "ps", begins.alias("at")).select(key, F.posexplode(F.arrays_zip("ps", F.slice("at", 1, F.size("ps")).alias("first"), F.slice("at", 2, F.size("ps")).alias("next"))).alias("section", "z"))
    out = out.select(key, F.col("section").cast("long").alias("section"), F.col("z.first").alias("start_line"), (F.col("z.next") - 1).alias("end_line"), F.col("z.ps").alias("text"))
    level = F.length(F.regexp_extract("text", "^(#*)", 1))
    return out.where(F.trim(F.regexp_replace("text", r"\s", " ")) != "").select(key, "section", "start_line", "end_line", level.alias("heading_level"), "text")
