"""Symbols and edges of source texts: Python by its own grammar, other languages by declarations on a line."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "file_path string, kind string, name string, parent string, target string, start_line int, end_line int, confidence double"
_DECLARATION = re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:public\s+|private\s+|static\s+|async\s+)*(class|interface|function|func|enum)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)(?:\s+extends\s+([A-Za-z_]\w*))?")


def python_rows(path: str, source: str) -> list[tuple]:
    """Classes, functions, imports, bases and calls of a Python source; none if it doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[tuple] = []
    own = {n.name for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))}
    stack: list[tuple[ast.AST, str | None]] = [(tree, None)]
    while stack:
        node, parent = stack.pop()
        for child in ast.iter_child_nodes(node):
            inside = parent
            if isinstance(child, ast.ClassDef):
                out.append((path, "Class", child.name, parent, None, child.lineno, child.end_lineno, 1.0))
                out += [(path, "EXTENDS", child.name, parent, b.id, child.lineno, child.lineno, 0.7) for b in child.bases if isinstance(b, ast.Name)]
                inside = child.name
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append((path, "Method" if isinstance(node, ast.ClassDef) else "Function", child.name, parent, None, child.lineno, child.end_lineno, 1.0))
                inside = child.name
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                out += [(path, "IMPORTS", None, parent, a.name, child.lineno, child.lineno, 0.6) for a in child.names]
            elif isinstance(child, ast.Call):
                name = child.func.id if isinstance(child.func, ast.Name) else child.func.attr if isinstance(child.func, ast.Attribute) else None
                if name:
                    out.append((path, "CALLS", None, parent, name, child.lineno, child.lineno, 1.0 if name in own else 0.75 if isinstance(child.func, ast.Attribute) else 0.5))
            stack.append((child, inside))
    return sorted(out, key=lambda r: (r[5], r[1], r[2] or "", r[4] or ""))


def line_rows(path: str, source: str) -> list[tuple]:
    """Declarations that a line shows, for languages without a parser here."""
    out = []
    for n, line in enumerate(source.split("\n"), 1):
        m = _DECLARATION.match(line)
        if m:
            kind = {"function": "Function", "func": "Function", "interface": "Interface", "enum": "Enum"}.get(m[1], "Class")
            out.append((path, kind, m[2], None, None, n, n, 1.0))
            if m[3]:
                out.append((path, "EXTENDS", m[2], None, m[3], n, n, 0.7))
    return out


def extract(files: DataFrame) -> DataFrame:
    """files(path, language, content) -> symbols and edges, one row each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for path, language, content in zip(pdf.path, pdf.language, pdf.content, strict=True):
                rows += (python_rows if language == "python" else line_rows)(path, content or "")
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.select("path", "language", "content").mapInPandas(run, SCHEMA)


def python_chunks(path: str, source: str, budget: int) -> list[tuple]:
    """Line ranges of a Python source that cover it: whole top-level statements up to `budget` solid characters."""
    lines = source.split("\n")
    try:
        starts = sorted({min([n.lineno, *[d.lineno for d in getattr(n, "decorator_list", [])]]) for n in ast.parse(source).body})
    except (SyntaxError, ValueError, RecursionError):
        starts = []
    cuts = [1, *[s for s in starts if s > 1], len(lines) + 1]
    out, first, size = [], 1, 0
    for a, b in zip(cuts, cuts[1:], strict=False):
        solid = sum(len("".join(x.split())) for x in lines[a - 1 : b - 1])
        if a > first and size + solid > budget:
            out.append((path, len(out), first, a - 1))
            first, size = a, 0
        size += solid
    out.append((path, len(out), first, len(lines)))
    return out


def chunk_python(files: DataFrame, budget: int = 500) -> DataFrame:
    """files(path, content) -> path, chunk_index, start_line, end_line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for p, c in zip(pdf.path, pdf.content, strict=True) for r in python_chunks(p, c or "", budget)]
            yield pd.DataFrame(rows, columns=["path", "chunk_index", "start_line", "end_line"])

    return files.select("path", "content").mapInPandas(run, "path string, chunk_index int, start_line int, end_line int")
