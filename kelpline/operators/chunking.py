"""Chunks of source texts along their structure, within a budget of solid characters (all but white space).

A file is a tree: brackets (blocks, in Python) hold statements, statements hold tokens and brackets. The tree is cut from
the top: what fits the budget is one window, what doesn't is cut into its parts, and neighbouring windows are merged
again as far as the budget goes, with what lies between them. Comments at a window's end go to the next one. Raw spans
cover the file without gaps; the span that is embedded may begin earlier, in the chunk before.

One file is one row's work and needs no other, so nothing is shuffled; a file's memory follows its length.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame

from kelpline.operators.lexer import RULES, lex

SCHEMA = "path string, chunk_index int, raw_start int, raw_end int, start int, stop int, vector_start int, solid int, context string"

# What a window across a border may use of the budget, how far a tiny one may go over it, raw characters
# for a solid one, and the share of those that an overlap may take.
ACROSS, TINY, RAW, OVERLAP = 0.7, 1.5, 4, 0.25
_NAMED = {"class": "class ", "interface": "interface ", "function": "fn ", "def": "def ", "func": "fn ", "struct": "struct ", "type": "type "}


class Window:
    """Neighbouring pieces (start, stop, whether it is a comment) of one context, and their solid characters with what lies between."""

    __slots__ = ("pieces", "solid", "context")

    def __init__(self, pieces: list[tuple[int, int, bool]], solid: int, context: tuple[str, ...]):
        self.pieces, self.solid, self.context = pieces, solid, context


class Cutter:
    def __init__(self, text: str, language: str, most: int, least: int):
        self.text, self.most, self.least = text, most, least
        self.solid = [0, *accumulate(not c.isspace() for c in text)]
        self.rows = lex(text, language)
        self.inside: dict[int, list[int]] = {}
        for r in self.rows:
            self.inside.setdefault(r[7], []).append(r[0])
        self.by_line = language in ("python", "go")

    def size(self, start: int, stop: int) -> int:
        return self.solid[stop] - self.solid[start]

    def statements(self, bracket: int) -> list[list[int]]:
        """The direct contents of a bracket, cut at semicolons, after blocks and at new lines that begin something."""
        out: list[list[int]] = []
        last = None
        for k in self.inside.get(bracket, []):
            r = self.rows[k]
            new_line = last is not None and r[3] > last[4]
            ends = last is not None and (last[2] == ";" or last[1] == "comment" or new_line and (self.by_line or last[1] not in ("punct",) and r[1] != "punct"))
            if last is None or (ends or r[1] == "comment") and r[2] != "INDENT":
                out.append([])
            out[-1].append(k)
            last = r
        return out

    def closed(self, row: list) -> bool:
        """Whether a bracket has its closing character, which no part of it holds."""
        last = self.rows[self.inside[row[0]][-1]][6] if row[0] in self.inside else row[5] + 1
        return row[2] != "INDENT" and last < row[6] and self.text[row[6] - 1] in ")]}"

    def named(self, statement: list[int]) -> str | None:
        for a, b in zip(statement, statement[1:], strict=False):
            if self.rows[a][2] in _NAMED and self.rows[a][1] == "word" and self.rows[b][1] == "word":
                return _NAMED[self.rows[a][2]] + self.rows[b][2]
        return None

    def windows(self, path: str) -> list[Window]:
        """Windows of the file. Parents are finished after their parts, on a stack of its own, however deep they lie."""
        done: dict[tuple[str, int], list[Window]] = {}
        todo: list[tuple[str, int, object, tuple[str, ...], bool]] = [("bracket", -1, None, (path,), False)]
        while todo:
            kind, key, statement, context, ready = todo.pop()
            parts: list = []  # of this node: a window, or the key of what its own windows are
            if kind == "bracket":
                row = self.rows[key] if key >= 0 else None
                if row and row[2] != "INDENT":
                    parts.append(Window([(row[5], row[5] + len(row[2]), False)], self.size(row[5], row[5] + len(row[2])), context))
                for s in self.statements(key):
                    a, b = self.rows[s[0]][5], self.rows[s[-1]][6]
                    name = self.named(s)
                    inner = (*context, name) if name else context
                    if self.size(a, b) <= self.most:
                        parts.append(Window([(a, b, len(s) == 1 and self.rows[s[0]][1] == "comment")], self.size(a, b), inner))
                    else:
                        parts.append(("statement", s[0], s, inner))
                if row and self.closed(row):
                    parts.append(Window([(row[6] - 1, row[6], False)], self.size(row[6] - 1, row[6]), context))
            else:
                for k in statement:
                    r = self.rows[k]
                    if r[1] == "open" and self.size(r[5], r[6]) > self.most:
                        parts.append(("bracket", k, None, context))
                    else:
                        parts.append(Window([(r[5], r[6], r[1] == "comment")], self.size(r[5], r[6]), context))
            open_ = [p for p in parts if not isinstance(p, Window)]
            if open_ and not ready:
                todo.append((kind, key, statement, context, True))
                todo += [(*p, False) for p in open_]
                continue
            flat: list[Window] = []
            for p in parts:
                flat += [p] if isinstance(p, Window) else done.pop((p[0], p[1]))
            done[kind, key] = self.merged(flat)
        return done["bracket", -1]

    def merged(self, windows: list[Window]) -> list[Window]:
        """Comments handed on to what follows them; then each window joined to the one before where both fit together."""
        led, held = [], []
        for k, w in enumerate(windows):
            pieces, held = held + w.pieces, []
            while k < len(windows) - 1 and pieces and pieces[-1][2]:
                held.insert(0, pieces.pop())
            if pieces:
                led.append(Window(pieces, self.size(pieces[0][0], pieces[-1][1]), w.context))
        out: list[Window] = []
        for w in led:
            if out and self.fit(out[-1], w):
                last = out[-1]
                out[-1] = Window(last.pieces + w.pieces, self.size(last.pieces[0][0], w.pieces[-1][1]), max(last.context, w.context, key=len))
            else:
                out.append(w)
        return out

    def fit(self, a: Window, b: Window) -> bool:
        """Whether two neighbours are one window: by solid characters with the gap, and by raw ones; less across contexts."""
        start, stop = a.pieces[0][0], b.pieces[-1][1]
        same = all(x == y for x, y in zip(a.context, b.context, strict=False))
        budget = self.most * (1.0 if same else ACROSS)
        solid = self.size(start, stop)
        return stop - start <= budget * RAW and (solid <= budget or a.solid < self.least and solid < budget * TINY)


def lines_cut(text: str, most: int) -> list[tuple[int, int, int, int, int]]:
    """(raw start, raw end, start, stop, solid) of runs of whole lines within the budget, for texts without a lexer."""
    out, start, at, solid = [], 0, 0, 0
    for line in text.split("\n"):
        more = sum(not c.isspace() for c in line)
        if at > start and solid + more > most:
            out.append((start, at, start, at - 1, solid))
            start, solid = at, 0
        solid, at = solid + more, at + len(line) + 1
    return [*out, (start, len(text), start, len(text), solid)]


def cut(path: str, text: str, language: str, most: int, least: int, overlap: int) -> list[tuple]:
    """Rows of SCHEMA without the path."""
    if language not in RULES:
        return [(k, a, b, s, e, s, n, path) for k, (a, b, s, e, n) in enumerate(lines_cut(text, most))]
    cutter = Cutter(text, language, most, least)
    out, before = [], 0
    windows = cutter.windows(path)
    if not windows:
        return [(0, 0, len(text), 0, len(text), 0, 0, path)]
    for k, w in enumerate(windows):
        start, stop = w.pieces[0][0], w.pieces[-1][1]
        vector = start
        if k and overlap:
            at = bisect_right(cutter.solid, cutter.solid[start] - overlap) - 1 if cutter.solid[start] >= overlap else start
            vector = at if start - at <= most * RAW * OVERLAP else start
        end = len(text) if k == len(windows) - 1 else stop
        out.append((k, before, end, start, stop, vector, w.solid, " > ".join(w.context)))
        before = stop
    return out


def structure_chunks(files: DataFrame, most: int = 500, least: int = 50, overlap: int = 40) -> DataFrame:
    """files(path, language, content) -> a row a chunk: raw_start .. raw_end cover the text without a gap, start .. stop
    is what the chunk shows, vector_start .. stop what is embedded; solid characters; context (path > class A > fn b).

    A chunk has at most `most` solid characters, 1.5 times that where it began as a tiny one (under `least`), and more only
    where a single token has. The overlap is the last `overlap` solid characters before, unless they take more than `most`
    raw characters. Languages without a lexer are cut at lines, without overlap; null and empty texts have no chunks.
    """

    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            files = zip(pdf.path, pdf.language, pdf.content, strict=True)
            yield pd.DataFrame([(path, *r) for path, language, content in files if content for r in cut(path or "", content, language, most, least, overlap)], columns=names)

    return files.select("path", "language", "content").mapInPandas(run, SCHEMA)
