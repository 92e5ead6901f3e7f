"""Secrets in texts: fixed patterns, and high-entropy strings that no pattern names.

Candidate strings are runs of one character class (hexadecimal digits; base64 characters). A window slides over each;
its Shannon entropy follows from counts changed by one character in and one out. Windows at or over the class's
threshold are joined to spans. An allow-list suppresses what is known to be harmless: strings without digits or without
letters (long words, numbers), and windows that touch an identifier in UUID form or a placeholder word; what is left of
the string on either side is judged by its own windows.

Defined cases: null or empty text: no spans. Offsets count code points, ends are exclusive. Rows are independent, so
repeated rows and ids give equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import id_and_text

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile("AKIA[A-Z0-9]+")
#: A run of 24 or more is the same as a whole run that has 24 or more.
HEX = re.compile("[0-9a-f]{24,}")
#: One of these, in either case, is in every match of ASSIGN.
WORDS = ("passw", "secret", "token", "apikey", "api_key")
#: Class: candidate pattern, window, bits.
CLASSES = {
    "hex": (re.compile("[0-9a-fA-F]{20,}"), 20, 3.0),
    "base64": (re.compile("[A-Za-z0-9+/=_-]{20,}"), 20, 3.7),
}
PLACEHOLDER = re.compile("example|sample|placeholder|dummy|changeme|test|xxxx|0000|1234", re.I)
UUID = re.compile("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
KINDS = ("assign", "access", "hex", "entropy")
_BITS = [0.0] + [c * math.log2(c) for c in range(1, 129)]


def judged(s: str) -> list[tuple[int, int]]:
    """The parts of the candidate ``s`` that the allow-list leaves."""
    if not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)):
        return []
    harmless = []
    for pattern in (PLACEHOLDER, UUID):
        m = pattern.search(s)
        while m:
            harmless.append(m.span())
            m = pattern.search(s, m.start() + 1)  # matches may overlap
    parts, at = [], 0
    for start, end in sorted(harmless):
        if start > at:
            parts.append((at, start))
        at = max(at, end)
    return [*parts, (at, len(s))]


def dense_windows(s: str, width: int, bits: float) -> list[tuple[int, int]]:
    """Spans of ``s`` covered by windows of ``width`` characters with an entropy of ``bits`` or more."""
    counts: dict[str, int] = {}
    total, spans, base = 0.0, [], math.log2(width)
    for i, c in enumerate(s):
        n = counts[c] = counts.get(c, 0) + 1
        total += _BITS[n] - _BITS[n - 1]
        if i >= width:
            n = counts[s[i - width]] = counts[s[i - width]] - 1
            total += _BITS[n] - _BITS[n + 1]
        if i >= width - 1 and base - total / width >= bits - 1e-9:
            start = i - width + 1
            if spans and spans[-1][1] >= start:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind in the order of KINDS."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    base = sorted((x, y) for x, y, _ in found)
    starts, reach = [x for x, _ in base], list(accumulate((y for _, y in base), max))
    dense: set[tuple[int, int]] = set()
    for pattern, width, bits in CLASSES.values():
        for m in pattern.finditer(text):
            for start, end in judged(m[0]):
                for a, b in dense_windows(m[0][start:end], width, bits) if end - start >= width else ():
                    a, b = a + m.start() + start, b + m.start() + start
                    k = bisect.bisect_right(starts, a)
                    if not k or reach[k - 1] < b:  # no base span holds it
                        dense.add((a, b))
    return sorted(found + [(a, b, "entropy") for a, b in dense], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """``text`` with every found span, overlapping ones together, replaced by ``mark``."""
    spans = find_secrets(text)
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, i = spans[i][0], spans[i][1], i + 1
        while i < len(spans) and spans[i][0] < end:
            end, i = max(end, spans[i][1]), i + 1
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, found: array of (start, end, kind), for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            texts = batch.column(1)
            rows = [[dict(zip(("start", "end", "kind"), s)) for s in find_secrets(texts[i].as_py())] for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "found"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, found array<struct<start:long,end:long,kind:string>>")


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    shown = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return secret_spans(docs).select(
        "doc_id", *(count(k) for k in KINDS[:3]), F.sha2(shown(F.filter("found", lambda s: s.kind != "entropy")), 256).alias("base_sha256"), shown(F.col("found")).alias("spans")
    )


def redacted(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """All rows and columns of ``docs`` with secrets in ``text`` replaced, and ``n_chars`` counted anew where that column exists."""
    at, length = docs.columns.index(text), docs.columns.index(n_chars) if n_chars in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([redact(t) for t in batch.column(at).to_pylist()], pa.string())
            columns = [new if i == at else pc.utf8_length(new).cast(pa.int64()) if i == length else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    schema = ", ".join(f"`{f.name}` {'string' if i == at else 'long' if i == length else f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    return docs.mapInArrow(run, schema)
