"""Quality rules: decision lists learned by sequential covering, applied as one Spark conditional expression.

Statistics of whole texts are DataFrame expressions. A bounded sample of labelled rows (MAX_LABELS, by a hash of the id)
is aggregated on the driver into rules: each rule is a conjunction of thresholds grown for the gain on two thirds of the
sample, pruned on the other third, and taken only where it is precise on both; then the rows it covers are removed and the
next is grown. The list becomes nested when/otherwise: first match decides, none keeps.

Defined cases: null text counts as empty (no words; rejected by the fixed rule). No labels: only the fixed rule. Null
labels or ids take no part in learning. Repeated rows are judged alike; an empty table gives an empty result. Extra columns
of the input don't meet those made here: only id and text are read for features.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, id_and_text

#: The most labelled rows that rules are learned from.
MAX_LABELS = 20_000
WORD = "[^\\x20\\x09-\\x0D]"
#: What rules are made of: name and SQL over the base columns.
RATES = {
    "n_words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(word_chars, 1)",
    "mark_rate": "n_marks / greatest(word_chars, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "distinct_rate": "n_distinct / greatest(n_words, 1)",
}
#: Words covered by 3-word windows whose hash comes twice: sort (hash, place), keep equal neighbours, add up what each place covers.
REPEATED = """case when size(array_distinct(h)) = size(h) then 0L else
  transform(array(sort_array(transform(h, (x, i) -> struct(x as h, i as i)))), s ->
    transform(array(sort_array(transform(filter(s, (x, i) -> x.h = get(s, i - 1).h or x.h = get(s, i + 1).h), x -> x.i))), p ->
      aggregate(transform(p, (x, i) -> least(3, coalesce(get(p, i + 1) - x, 3))), 0L, (a, v) -> a + v))[0])[0] end"""


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and others) with n_words, word_chars, n_symbols, n_marks, n_upper, n_lines, n_dup_lines, n_distinct, n_repeat_words, base_failed, and _row for filters."""
    t = docs.withColumn("t", F.coalesce("text", F.lit("")))
    t = t.withColumn("w", F.expr(f"filter(split(t, r'{SPACE}'), x -> x <> '')"))
    t = t.withColumn("lines", F.expr(f"filter(split(t, '\\n'), x -> x rlike r'{WORD}')")).withColumn("joined", F.array_join("w", ""))
    t = t.withColumn("h", F.expr("case when size(w) < 3 then cast(array() as array<bigint>) else transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) end"))
    less = lambda chars: (F.length("joined") - F.length(F.regexp_replace("joined", chars, ""))).cast("long")
    t = t.withColumns(
        {
            "n_words": F.size("w").cast("long"), "word_chars": F.length("joined").cast("long"), "n_symbols": less("[#*$%&|<>]+"), "n_marks": less("[!?]+"), "n_upper": less("[A-Z]+"),
            "n_lines": F.size("lines").cast("long"), "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_distinct": F.size(F.array_distinct("w")).cast("long"), "n_repeat_words": F.expr(REPEATED).cast("long"),
            "_row": F.monotonically_increasing_id(),  # read by filters: they stay above this projection and don't repeat its expressions
        }
    ).drop("t", "w", "lines", "joined", "h")
    return t.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


Rule = list[tuple[str, str, float]]


def cover(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 12, most_terms: int = 3, precision: float = 0.9, least: int = 8) -> list[Rule]:
    """Rules for ``bad`` rows, in order; each is a conjunction of (feature, '<=' or '>', threshold)."""
    n = len(bad)
    grow = np.arange(n) % 3 != 2
    left, rules = np.ones(n, bool), []

    def holds(rule: Rule, rows: np.ndarray) -> np.ndarray:
        return reduce(lambda m, t: m & ((x[t[0]] <= t[2]) if t[1] == "<=" else (x[t[0]] > t[2])), rule, rows)

    def score(rows: np.ndarray) -> float:
        return (bad[rows].sum() + 1) / (rows.sum() + 2)

    while len(rules) < most_rules:
        rule, rows = [], left & grow
        while len(rule) < most_terms and rows.any() and not bad[rows].all():
            before, best = score(rows), (0.0, None)
            for name, v in x.items():
                own = np.unique(v[rows])
                at = np.unique(np.searchsorted(own, np.quantile(v[rows], np.linspace(0.02, 0.98, 49)), "right"))
                for i in at[(at > 0) & (at < len(own))]:
                    cut = (own[i - 1] + own[i]) / 2  # halfway, not on the edge of either side
                    low = v <= cut
                    for op, m in (("<=", rows & low), (">", rows & ~low)):
                        hits = bad[m].sum()
                        gain = hits * (np.log2(score(m)) - np.log2(before)) if hits else 0.0
                        if gain > best[0] + 1e-9:
                            best = (gain, (name, op, float(cut)))
            if best[1] is None:
                break
            rule.append(best[1])
            rows = holds(rule, left & grow)
        held = left & ~grow
        while len(rule) > 1 and score(holds(rule[:-1], held)) >= score(holds(rule, held)):
            rule = rule[:-1]
        both, check = holds(rule, left), holds(rule, held)
        if not rule or bad[both].sum() < least or bad[both].mean() < precision or (check.any() and bad[check].mean() < precision):
            break
        rules.append(rule)
        left &= ~both
    return rules


def learn(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> list[Rule]:
    """Rules from at most ``max_labels`` labelled documents; none where no label meets a document."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    rows = with_statistics(id_and_text(docs).join(F.broadcast(marks), "doc_id")).where("not base_failed and _row >= 0")
    rows = rows.select("doc_id", "quality", *(F.expr(sql).cast("double").alias(k) for k, sql in RATES.items())).collect()
    rows.sort(key=lambda r: (hash(r.doc_id * 2654435761 % 4294967291), r.doc_id))
    if not rows:
        return []
    return cover({k: np.array([r[k] for r in rows]) for k in RATES}, np.array([r.quality == 0 for r in rows]))


def verdict(rules: list[Rule]) -> Column:
    """The list as one expression over the statistics: false for the first rule that holds, else true."""
    term = lambda t: F.expr(RATES[t[0]]) <= t[2] if t[1] == "<=" else F.expr(RATES[t[0]]) > t[2]
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(reduce(Column.__and__, map(term, rule)), F.lit(False)).otherwise(out)
    return out


def quality_report(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """doc_id, the statistics, base_failed and kept for every row."""
    rules = learn(docs, labels, max_labels)
    rows = with_statistics(id_and_text(docs)).withColumn("kept", ~F.col("base_failed") & verdict(rules))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_marks", "n_upper", "n_lines", "n_distinct")


def good_documents(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns only."""
    rules = learn(docs, labels, max_labels)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id"), F.col("text").cast("string").alias("text"))
    return with_statistics(rows).where(~F.col("base_failed") & verdict(rules) & (F.col("_row") >= 0)).select("row.*")
