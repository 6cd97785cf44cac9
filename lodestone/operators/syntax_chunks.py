"""Python files by their syntax: chunks per definition, and the names a file uses.

Files are put together from their windows in the task that parses them; a file that doesn't parse, or has no
definitions, comes as line windows. Empty files give no rows.
"""

from __future__ import annotations

import ast
import io
import keyword
import re
import tokenize
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def _whole(parts: list[dict]) -> str:
    lines: list[str] = []
    for p in sorted(parts, key=lambda p: (p["start_line"], p["end_line"])):
        new = p["doc"].split("\n")
        start = p["start_line"] - 1
        lines += [""] * max(0, start - len(lines))
        lines += new[max(0, len(lines) - start) :]
    return "\n".join(lines)


def _gathered(chunks: DataFrame) -> DataFrame:
    return chunks.where("doc is not null").groupBy("file").agg(F.collect_set(F.struct("start_line", "end_line", "doc")).alias("parts"))


def _windows(lines: list[str]) -> list[tuple[int, int, str | None]]:
    step, out = fixed.CHUNK_LINES - fixed.CHUNK_OVERLAP, []
    for i in range(0, max(1, len(lines)), step):
        part = lines[i : i + fixed.CHUNK_LINES]
        if len("\n".join(part).strip()) >= fixed.MIN_CHUNK_LEN:
            out.append((i + 1, i + len(part), None))
        if i + fixed.CHUNK_LINES >= len(lines):
            break
    return out


def syntax_spans(text: str) -> list[tuple[int, int, str | None]]:
    """(start_line, end_line, symbol) of the chunks of one Python file."""
    lines = text.split("\n")
    if not text.strip():
        return []
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            body = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError):
        return _windows(lines)
    out: list[tuple[int, int, str | None]] = []
    head = [n for n in body]
    k = 0
    while k < len(head) and isinstance(head[k], (ast.Import, ast.ImportFrom, ast.Assign, ast.AnnAssign, ast.Expr)):
        k += 1
    if k:
        out.append((head[0].lineno, head[k - 1].end_lineno, "<module header>"))

    def span(n: ast.AST) -> tuple[int, int]:
        first = min([n.lineno, *(x.lineno for x in n.decorator_list)])
        return first, n.end_lineno

    for n in body:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append((*span(n), n.name))
        elif isinstance(n, ast.ClassDef):
            out.append((*span(n), f"class {n.name}"))
            out += [(*span(m), f"{n.name}.{m.name}") for m in n.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
    out = [x for x in out if len("\n".join(lines[x[0] - 1 : x[1]]).strip()) >= 10]
    return out or _windows(lines)


def used_names(text: str, python: bool) -> set[tuple[str, int]]:
    """(name, line) of the names in a text, without comments, strings and key words."""
    if python:
        try:
            found = {(t.string, t.start[0]) for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type == tokenize.NAME}
            return {(n, i) for n, i in found if len(n) >= 2 and not keyword.iskeyword(n)}
        except (tokenize.TokenError, SyntaxError, IndentationError):
            pass
    bare = re.sub(r"/\*.*?\*/|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`", lambda m: "\n" * m.group().count("\n"), text, flags=re.S)
    return {(w, i) for i, line in enumerate(bare.split("\n"), 1) for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", line) if len(w) >= 2}


def python_chunks(chunks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(f, *s) for f, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s in syntax_spans(_whole(p))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["file", "start_line", "end_line", "symbol"])

    return _gathered(chunks.where(F.col("file").endswith(".py"))).mapInArrow(run, "file string, start_line int, end_line int, symbol string")


def references(chunks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(f, n, i) for f, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n, i in sorted(used_names(_whole(p), f.endswith(".py")))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))], names=["file", "symbol", "line"])

    return _gathered(chunks.where(F.col("file").rlike(r"\.(py|js|ts|go|java|rs|c)$"))).mapInArrow(run, "file string, symbol string, line int")
