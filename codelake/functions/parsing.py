"""Symbols of source files.

Python is parsed by its own ``ast``; the other languages by one scanner that blanks comments and strings, follows braces and
reads what stands in front of each. It runs inside Arrow batches on executors; no tree leaves it, only flat symbol rows.
"""

from __future__ import annotations

import ast
import bisect
import re
import signal
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

# Grammars by language name, and kinds whose functions are methods.
GRAMMARS = {
    "py": "python", "js": "javascript", "ts": "typescript", "cs": "csharp", "c#": "csharp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "h": "c",
    "glsl": "c", "hlsl": "c", "fx": "c", "vert": "c", "frag": "c", "comp": "c", "geom": "c", "tesc": "c", "tese": "c", "metal": "c", "usf": "cpp", "ush": "cpp",
}
LANGUAGES = ("python", "javascript", "typescript", "tsx", "cpp", "c", "java", "csharp", "lua", "rust", "go")
CONTAINERS = ("class", "struct", "interface", "impl", "trait", "namespace", "type")
CONTROL = {"if", "for", "while", "switch", "catch", "return", "else", "do", "try", "finally", "synchronized", "using", "lock", "foreach", "fixed", "unsafe", "sizeof", "new", "match", "loop", "with", "when", "case", "function", "select", "defer", "throw"}


#: What one file may take.
SECONDS = 30.0


@contextmanager
def limited(seconds: float) -> Iterator[None]:
    """TimeoutError inside the block after ``seconds``, where the platform has timers and this is a worker's main thread."""
    if seconds <= 0 or threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_: object) -> None:
        raise TimeoutError(f"over {seconds} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


@dataclass
class Symbol:
    name: str
    kind: str
    start: int  # offsets in the text, the end exclusive
    end: int
    parent: int = -1
    doc: str = ""
    children: list[int] = field(default_factory=list)


def grammar(language: str) -> str:
    found = GRAMMARS.get(language, language)
    if found not in LANGUAGES:
        raise ValueError(f"no grammar for {language}")
    return found


def _python(text: str) -> list[Symbol]:
    ends = line_starts(text)
    lines = text.split("\n")
    place = lambda line, col: ends[line - 1] + len(lines[line - 1].encode()[:col].decode("utf-8", "ignore"))
    out: list[Symbol] = []

    def walk(node: ast.AST, parent: int) -> None:
        for child in ast.iter_child_nodes(node):
            at = parent
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if parent >= 0 and out[parent].kind in CONTAINERS else "function"
                start = place(child.lineno, child.col_offset)
                out.append(Symbol(child.name, kind, start, place(child.end_lineno, child.end_col_offset), parent, _comment_above(text, start, "#") or ast.get_docstring(child, clean=False) or ""))
                at = len(out) - 1
            walk(child, at)

    walk(ast.parse(text), -1)
    return out


def _comment_above(text: str, start: int, mark: str) -> str:
    """The comments in front of ``start`` with nothing but white space between: lines that begin with ``mark``, and blocks where that is //."""
    out: list[str] = []
    end = start
    while True:
        while end and text[end - 1].isspace():
            end -= 1
        at = text.rfind("\n", 0, end) + 1
        if mark == "//" and text.endswith("*/", 0, end):
            at = max(text.rfind("/*", 0, end - 1), 0)
            first = text.rfind("\n", 0, at) + 1
        else:
            first = at
            at += len(text[at:end]) - len(text[at:end].lstrip())
            if not text.startswith(mark, at, end):
                break
        if text[first:at].strip():  # behind something else in its line
            break
        out.append(text[at:end])
        end = at
    return "\n".join(reversed(out))


def blanked(text: str, language: str) -> str:
    """``text`` with comments and strings as spaces, of the same length."""
    quotes = r"`(?:\\.|[^`\\])*`|" if language in ("javascript", "typescript", "tsx", "go") else ""
    chars = r"'(?:\\.|[^'\\\n]){1,8}'" if language in ("rust", "c", "cpp", "go", "java", "csharp") else r"'(?:\\.|[^'\\\n])*'"
    comment = r"--\[\[.*?\]\]|--[^\n]*|\[\[.*?\]\]|" if language == "lua" else r"//[^\n]*|/\*.*?\*/|"
    pattern = re.compile(comment + quotes + r'"(?:\\.|[^"\\\n])*"|' + chars, re.S)
    text = pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    return re.sub(r"^[ \t]*#[^\n]*", lambda m: " " * len(m[0]), text, flags=re.M) if language in ("c", "cpp", "csharp") else text


def _callable(head: str) -> str | None:
    """Name in front of the first bracket of a function's head; the last part of a qualified one."""
    m = re.search(r"(operator\s*(?:\(\s*\)|\[\s*\]|[^\s\w(]+|\s\w+))\s*\(", head) or re.search(r"(~?[A-Za-z_$#]\w*)\s*(?:<[^<>()]*>)?\s*\(", head)
    if not m:
        return None
    name = re.sub(r"^operator\s+(?=\W)", "operator", m[1].strip())
    return None if name in CONTROL else name


def _classify(head: str, language: str, parent: Symbol | None, body: str) -> tuple[str, str] | None:
    """(name, kind) of what a brace opens, from the text in front of it."""
    inside = parent is not None and parent.kind in CONTAINERS
    if language == "go":
        if m := re.search(r"\bfunc\s+\(\s*[^)]*\)\s*(\w+)\s*[\[(]", head):
            return m[1], "method"
        if m := re.search(r"\bfunc\s+(\w+)\s*[\[(]", head):
            return m[1], "function"
        return (m[1], "type") if (m := re.search(r"\btype\s+(\w+)\b[^=]*$", head)) else None
    if language == "rust":
        if m := re.search(r"\bfn\s+(\w+)", head):
            return m[1], "method" if inside else "function"
        if m := re.search(r"\bimpl\b(?:\s*<[^{]*?>)?\s+(?:[^{]*?\bfor\s+)?([A-Za-z_][\w:]*(?:\s*<[^{]*>)?)\s*(?:where\b[^{]*)?$", head):
            return m[1].strip(), "impl"
        return (m[2], m[1]) if (m := re.search(r"\b(struct|enum|trait)\s+(\w+)", head)) else None
    if language in ("javascript", "typescript", "tsx"):
        if m := re.search(r"\bfunction\s*\*?\s*(\w+)\s*(?:<[^{]*>)?\s*\(", head):
            return m[1], "function"
        if (m := re.search(r"(?:^|[\s;])(class|interface)\s+(\w+)", head)) and "(" not in head[: m.start()] and "abstract" not in head[: m.start()]:
            return None if m[1] == "interface" and language == "javascript" else (m[2], m[1])
        if m := re.fullmatch(r"\s*(?:(?:static|async|get|set|public|private|protected|override|readonly)\s+)*\*?\s*(#?\w+)\s*(?:<[^{]*>)?\s*\(.*\)\s*(?::\s*[^={]+)?", head, re.S):
            return None if m[1] in CONTROL else (m[1], "method")
        return None
    if language in ("java", "csharp"):
        kinds = "class|interface" if language == "java" else "class|struct|enum|interface|namespace"
        if m := re.search(rf"(?:^|\s)({kinds})\s+([\w.]+)", head):
            return m[2], m[1]
        if "=" in head or not inside:
            return None
        if "(" in head:
            name, before = _callable(head), head.split("(")[0].split()
            before = [w for w in before if w not in ("public", "private", "protected", "internal", "static", "async", "final", "abstract", "override", "virtual", "sealed", "synchronized", "native", "extern", "partial", "default") and not w.startswith("@")]
            if not name or (len(before) < 2):
                return (name, "constructor") if name and language == "csharp" and name == parent.name else None
            return name, "method"
        if language == "csharp" and re.search(r"\b(get|set|init)\b", body) and (m := re.search(r"(\w+)\s*$", head)):
            return m[1], "property"
        return None
    head = re.sub(r"\btemplate\s*<[^{}]*?>\s*(?=class|struct|typename|[\w:~])", "", head)
    if (m := re.search(r"\b(class|struct|enum)\s+(?:class\s+)?(?:\w+\s+)*?([A-Za-z_]\w*)\s*(?:final\s*)?(?::[^:(][^(]*)?$", head)) and "(" not in head and "=" not in head:
        if language == "cpp":
            return None if m[1] == "enum" else (m[2], "class")
        return None if m[1] == "class" else (m[2], m[1])
    if "(" in head and not re.search(r"=\s*[^=]*$", re.sub(r"operator\s*[=<>!+\-*/%&|^]+", "", head.split("(")[0])):
        if name := _callable(head):
            return name, "method" if inside and language == "cpp" else "function"
    return None


def _braces(text: str, language: str) -> list[Symbol]:
    clean = blanked(text, language)
    out: list[Symbol] = []
    opened: list[tuple[int, int]] = []  # (symbol or that of the nearest opener, whether it is one's own)
    head_at = 0
    closing: dict[int, int] = {}
    stack: list[int] = []
    for m in re.finditer(r"[{}]", clean):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            closing[stack.pop()] = m.start() + 1
    parents = [-1]
    for m in re.finditer(r"[{};]|\n", clean):
        at, c = m.start(), m[0]
        if c == "\n":
            if language == "go" and (t := re.fullmatch(r"\s*type\s+(\w+)\s+(?!struct|interface)[^{}]*", clean[head_at:at])):
                start = head_at + len(clean[head_at:at]) - len(clean[head_at:at].lstrip())
                out.append(Symbol(t[1], "type", start, at, parents[-1], _comment_above(text, start, "//")))
            if language == "go":
                head_at = at + 1 if clean[head_at:at].count("(") == clean[head_at:at].count(")") else head_at
            continue
        head = clean[head_at:at]
        if language == "cpp" and (label := re.match(r"\s*(?:(?:public|private|protected)\s*:(?!:)\s*)+", head)):
            head_at, head = head_at + label.end(), head[label.end() :]
        start = head_at + len(head) - len(head.lstrip())
        parent = out[parents[-1]] if parents[-1] >= 0 else None
        if c == "{":
            end = closing.get(at, len(text))
            found = _classify(head.strip(), language, parent, clean[at:end])
            if found:
                if language in ("javascript", "typescript", "tsx"):
                    start += len(m2[0]) if (m2 := re.match(r"(?:export\s+(?:default\s+)?)", clean[start:at])) else 0
                out.append(Symbol(*found, start, end, parents[-1], _comment_above(text, start, "//")))
                parents.append(len(out) - 1)
            else:
                parents.append(parents[-1])
        elif c == "}":
            if len(parents) > 1:
                parents.pop()
        elif language in ("java", "csharp") and parent is not None and parent.kind in CONTAINERS and "=" not in head and (f := _classify(head.strip(), language, parent, "")) and f[1] == "method":
            out.append(Symbol(*f, start, at + 1, parents[-1], _comment_above(text, start, "//")))
        elif language == "rust" and (t := re.search(r"\bstruct\s+(\w+)\s*(?:<[^;]*>)?\s*\(", head)):
            out.append(Symbol(t[1], "struct", start, at + 1, parents[-1], _comment_above(text, start, "//")))
        head_at = at + 1
    return out


def _lua(text: str) -> list[Symbol]:
    clean, out, stack = blanked(text, "lua"), [], []
    for m in re.finditer(r"\b(?:local\s+)?function\b(?:\s+([\w.:]+))?|\b(?:if|do|repeat)\b|\b(?:end|until)\b", clean):
        word = m[0].split()[0]
        if word in ("end", "until"):
            if stack and (i := stack.pop()) >= 0:
                out[i].end = m.end()
        elif "function" in m[0]:
            parent = next((i for i in reversed(stack) if i >= 0), -1)
            if m[1]:
                out.append(Symbol(m[1], "function", m.start(), len(text), parent, _comment_above(text, m.start(), "--")))
            stack.append(len(out) - 1 if m[1] else -1)
        else:
            stack.append(-1)
    return out


def symbols(text: str, language: str) -> list[Symbol]:
    """Symbols in the order of their starts; ``parent`` is the index of the nearest enclosing one."""
    g = grammar(language)
    found = _python(text) if g == "python" else _lua(text) if g == "lua" else _braces(text, g)
    for i, s in enumerate(found):
        if s.parent >= 0:
            found[s.parent].children.append(i)
    return found


def line_starts(text: str) -> list[int]:
    """Offsets of the lines."""
    return [0, *(m.end() for m in re.finditer("\n", text))]


def line_finder(text: str) -> Callable[[int], int]:
    """The line (from 1) of an offset; the text is looked through once."""
    starts = line_starts(text)
    return lambda offset: bisect.bisect_right(starts, offset)


def split_windows(text: str, width: int) -> list[str]:
    words = text.split()
    step = max(1, width - int(width * 0.1))
    last = max(0, -(-(len(words) - width) // step))
    return [" ".join(words[i * step : i * step + width]) for i in range(last + 1)] if words else []


def code_chunks(text: str, language: str, width: int) -> list[dict]:
    """Chunks of a source file: a symbol with its comment, or its children under its first line where it is too long, or windows."""
    n_lines = text.count("\n") + (not text.endswith("\n"))
    try:
        found = symbols(text, language)
    except (SyntaxError, ValueError, RecursionError):
        found = []
    out: list[dict] = []
    line = line_finder(text)

    def add(body: str, s: Symbol | None, header: int = 0, window: int | None = None) -> None:
        span = (line(s.start), line(max(s.start, s.end - 1))) if s else (1, n_lines)
        out.append({"text": body, "start_line": span[0], "end_line": span[1], "symbol_name": s.name if s else None, "symbol_kind": s.kind if s else None, "header_lines": header, "window": window})

    def emit(s: Symbol, prefix: str) -> None:
        own = text[s.start : s.end]
        front = (f"# {s.doc}\n" if s.doc else "") + prefix
        if len((front + own).split()) <= width:
            add(front + own, s, front.count("\n"))
        elif s.children:
            for c in s.children:
                emit(found[c], prefix + own.split("\n", 1)[0] + "\n")
        else:
            for i, w in enumerate(split_windows(prefix + own, width)):
                add(w, s, 0, i)

    if not text.strip():
        return []
    for s in found:
        if s.parent < 0:
            emit(s, "")
    if not found:
        parts = split_windows(text, width) if len(text.split()) > width else [text]
        for i, w in enumerate(parts):
            add(w, None, 0, i if len(parts) > 1 else None)
    return out
