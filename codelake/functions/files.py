"""Languages, file classes and path rules."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Languages by extension, by whole name, and classes of languages.
EXTENSIONS = {
    "py": "python", "js": "javascript", "ts": "typescript", "tsx": "tsx",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "h": "cpp", "hxx": "cpp", "inl": "cpp",
    "c": "c", "java": "java", "cs": "csharp", "lua": "lua", "rs": "rust", "go": "go",
    "md": "markdown", "rst": "rst", "txt": "text", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml",
}
NAMES = {"Makefile": "makefile", "Dockerfile": "dockerfile"}
SHADERS = ("glsl", "hlsl", "fx", "vert", "frag", "comp", "geom", "tesc", "tese", "usf", "ush", "metal")
CODE = ("python", "javascript", "typescript", "tsx", "cpp", "c", "java", "csharp", "lua", "rust", "go", *SHADERS)
DOCS = ("markdown", "rst", "text")
CONFIG = ("json", "yaml", "toml", "makefile", "dockerfile")
JUNK_DIRS = ("node_modules", "__pycache__", ".venv", "venv", "build", "dist", ".tox", ".codelake")
# Languages that references are looked for in, by extension; limits in bytes and characters.
REFERENCE_EXTENSIONS = {
    "py": "python", "js": "javascript", "ts": "typescript", "tsx": "tsx", "jsx": "jsx", "cpp": "cpp", "cc": "cpp", "cxx": "cpp",
    "c": "c", "h": "cpp", "hpp": "cpp", "hxx": "cpp", "java": "java", "cs": "csharp", "rs": "rust", "go": "go", "lua": "lua",
}
MAX_CHUNK_CHARS = 65_535
MAX_BYTES, BINARY_HEAD, MAX_SYMBOL_BYTES, MAX_REFERENCE_BYTES = 2 * 1024 * 1024, 8192, 1_000_000, 512 * 1024


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased, without the dot; empty where the name has none or only a leading one."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]+)$", 1))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]


def language(path: Column, custom: Iterable[str] = ()) -> Column:
    """By whole name, then a custom extension (which is then the language's name), then extension; null if unknown."""
    ext, own = extension(path), list(custom)
    named = _lookup(base_name(path), NAMES)
    return F.coalesce(named, F.when(ext.isin(*own), ext) if own else F.lit(None).cast("string"), _lookup(ext, EXTENSIONS))


def reference_language(path: Column) -> Column:
    return F.coalesce(_lookup(extension(path), REFERENCE_EXTENSIONS), F.lit(""))


def file_class(lang: Column, custom: Iterable[str] = ()) -> Column:
    return F.when(lang.isin(*CODE, *custom), "code").when(lang.isin(*DOCS), "doc").when(lang.isin(*CONFIG), "config").otherwise("unknown")


def in_pruned_dir(path: Column) -> Column:
    """Whether a directory of the path is hidden or one of JUNK_DIRS."""
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.startswith(".") | p.isin(*JUNK_DIRS))


def posix(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def restored(path: Column, root: str) -> Column:
    """An absolute path, in any case and with either slash, below ``root``: relative and lower-cased, to be joined with stored paths; null for others."""
    base = root.replace("\\", "/").rstrip("/").lower() + "/"
    low = F.lower(posix(path))
    return F.when(low.startswith(base), F.substr(low, F.lit(len(base) + 1)))


def with_stored_case(found: DataFrame, files: DataFrame, root: str, file: str = "file", path: str = "path") -> DataFrame:
    """``found`` with column ``file`` as the relative path that ``files`` has, whatever the case; relative but as given where there is none, and with slashes where it is not below ``root``."""
    stored = files.groupBy(F.lower(path).alias("_low")).agg(F.min(path).alias("_stored"))
    cut = len(root.replace("\\", "/").rstrip("/")) + 2
    rows = found.withColumn("_low", restored(F.col(file), root))
    given = F.when(F.col("_low").isNull(), posix(F.col(file))).otherwise(F.substr(posix(F.col(file)), F.lit(cut)))
    return rows.join(stored, "_low", "left").withColumn(file, F.coalesce("_stored", given)).drop("_low", "_stored")


def qualified(index: Column, path: Column) -> Column:
    return F.when(index == "", path).otherwise(F.concat_ws("/", index, path))


def path_has_any(path: Column, patterns: Iterable[str]) -> Column:
    """Whether the path holds one of the patterns, whatever the case."""
    low = F.lower(posix(path))
    return reduce(Column.__or__, (F.contains(low, F.lit(p.lower().replace("\\", "/"))) for p in patterns), F.lit(False))


def excluded_paths(patterns: list[str] | None) -> list[str]:
    """None means the default; an empty list means none."""
    return ["Test"] if patterns is None else list(patterns)


def glob_regex(pattern: str) -> str:
    """A pattern of an ignore file as a regex for whole relative paths."""
    p, rooted = pattern.strip(), False
    only_dir = p.endswith("/")
    p = p.rstrip("/")
    if p.startswith("/"):
        p, rooted = p[1:], True
    rooted = rooted or "/" in p
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out, i = out + "/.*", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 2 :]:
            j = p.index("]", i + 2)
            body = p[i + 1 : j]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", j + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return "^" + ("" if rooted else "(?:.*/)?") + out + ("/.*" if only_dir else "(?:/.*)?") + "$"


def matches_any(path: Column, globs: Iterable[str]) -> Column:
    regexes = [glob_regex(g) for g in globs]
    return path.rlike("|".join(f"(?:{r})" for r in regexes)) if regexes else F.lit(False)


def parse_filter_file(text: str) -> tuple[list[str], list[str]]:
    """(include, exclude) patterns: under [include] and [exclude], or before any header bare lines exclude and !lines include."""
    into: dict[str, list[str]] = {"include": [], "exclude": []}
    section = None
    for line in (raw.strip() for raw in text.splitlines()):
        if line.lower() in ("[include]", "[exclude]"):
            section = line.lower()[1:-1]
        elif line and not line.startswith("#"):
            kept = section is None and line.startswith("!")
            into[section or ("include" if kept else "exclude")].append(line[1:] if kept else line)
    return into["include"], into["exclude"]


def parse_condition(text: str) -> Column | None:
    """``field == "value" [and ...]``; conjuncts of another form are left out; None where nothing is left."""
    found = [m for c in re.split(r"\s+and\s+", text or "") if (m := re.fullmatch(r'\s*(\w+)\s*==\s*"([^"]*)"\s*', c))]
    return reduce(Column.__and__, (F.col(m[1]) == m[2] for m in found)) if found else None
