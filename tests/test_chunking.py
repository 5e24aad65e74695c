"""Chunks along structure: what any cut must hold, the rule by plain recursion on small sources, and hand-made cases."""

from __future__ import annotations

import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from kelpline.operators.chunking import Cutter, cut, lines_cut, structure_chunks


def solid(x: str) -> int:
    return len(re.sub(r"\s", "", x))


def by_recursion(cutter: Cutter, text: str, path: str) -> list[tuple[int, int, str]]:
    """(start, stop, context) of the windows: every node visited from the top, no sums, no stack of its own."""
    size = lambda a, b: solid(text[a:b])

    def merge(ws):  # ws: [pieces, context]
        ws = [[list(p), c] for p, c in ws]
        out = []
        for k, w in enumerate(ws):
            if k + 1 < len(ws):
                while w[0] and w[0][-1][2]:
                    ws[k + 1][0].insert(0, w[0].pop())
            if not w[0]:
                continue
            if out:
                a, b = out[-1][0][0][0], w[0][-1][1]
                n = min(len(out[-1][1]), len(w[1]))
                budget = cutter.most if out[-1][1][:n] == w[1][:n] else 0.7 * cutter.most
                tiny = size(a, out[-1][0][-1][1]) < cutter.least
                if b - a <= 4 * budget and (size(a, b) <= budget or tiny and size(a, b) < 1.5 * budget):
                    out[-1] = [out[-1][0] + w[0], max(out[-1][1], w[1], key=len)]
                    continue
            out.append(w)
        return out

    def bracket(k, context):
        r = cutter.rows[k] if k >= 0 else None
        edge = r is not None and r[2] != "INDENT"
        parts = [[[(r[5], r[5] + len(r[2]), False)], context]] if edge else []
        for s in cutter.statements(k):
            a, b = cutter.rows[s[0]][5], cutter.rows[s[-1]][6]
            name = cutter.named(s)
            inner = context + [name] if name else context
            if size(a, b) <= cutter.most:
                parts.append([[(a, b, len(s) == 1 and cutter.rows[s[0]][1] == "comment")], inner])
                continue
            own = []
            for t in s:
                q = cutter.rows[t]
                own += bracket(t, inner) if q[1] == "open" and size(q[5], q[6]) > cutter.most else [[[(q[5], q[6], q[1] == "comment")], inner]]
            parts += merge(own)
        if edge and cutter.closed(r):
            parts.append([[(r[6] - 1, r[6], False)], context])
        return merge(parts)

    return [(w[0][0][0], w[0][-1][1], " > ".join(w[1])) for w in bracket(-1, [path])]


PIECES = ["class A {", "}", "{", "(", ")", "f(a, b);", "x = 1;", "// note one two three\n", "/* c */", "\n", "function g() {", "'text text'", "verylongname" * 3, "return y;\n", "if (z) {", "def h():\n    q = 1\n", "   "]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40), st.sampled_from(["typescript", "python", "java"]), st.integers(5, 60), st.integers(0, 15), st.integers(0, 12))
def test_rule_and_invariants(pieces, language, most, least, overlap):
    text = " ".join(pieces)
    if not text:
        return
    rows = cut("p", text, language, most, least, overlap)
    cutter = Cutter(text, language, most, least)
    if cutter.rows:
        assert [(r[3], r[4], r[7]) for r in rows] == by_recursion(cutter, text, "p")
    assert [r[0] for r in rows] == list(range(len(rows))) and rows[0][1] == 0 and rows[-1][2] == len(text)
    assert all(a[2] == b[1] for a, b in zip(rows, rows[1:], strict=False))
    assert not cutter.rows or solid(text) == sum(solid(text[r[1] : r[2]]) for r in rows)
    longest = max([solid(text[r[5] : r[6]]) for r in cutter.rows if r[1] != "open"], default=0)
    for _, a, b, start, stop, vector, n, _ in rows:
        assert a <= start <= stop <= b and (not cutter.rows or n == solid(text[start:stop]))
        core = next((r[5] for r in cutter.rows if start <= r[5] < stop and r[1] != "comment"), stop)  # comments go with what follows, however long
        assert solid(text[core:max(core, stop)]) <= max(1.5 * most, longest) or not cutter.rows
        assert vector <= start and start - vector <= most and (vector == start or solid(text[vector:start]) == overlap)


def test_a_class_is_cut_between_methods():
    body = "".join(f"  // about m{k}\n  m{k}(a) {{\n    return work{k}(a);\n  }}\n\n" for k in range(6))
    text = "import a from 'b';\n\nclass Service {\n" + body + "}\n"
    rows = cut("s.ts", text, "typescript", 70, 10, 15)
    shown = [text[r[3] : r[4]] for r in rows]
    for k in range(6):  # a comment goes with its method, which is whole
        assert any(f"// about m{k}\n  m{k}(a) {{\n    return work{k}(a);\n  }}" in x for x in shown)
    assert len(rows) >= 3
    assert rows[1][7] == "s.ts > class Service"
    assert cut("s.ts", text, "typescript", 5000, 10, 15) == [(0, 0, len(text), 0, len(text) - 1, 0, solid(text), "s.ts > class Service")]


def test_python_blocks():
    text = "import os\n\nclass A:\n" + "".join(f"    def f{k}(self):\n        value = {k}\n        return value + {k}\n\n" for k in range(5)) + "def tail():\n    pass\n"
    rows = cut("a.py", text, "python", 60, 10, 0)
    starts = [text[r[3] : r[4]].split("(")[0] for r in rows]
    assert {"def f1", "def f2", "def f3"} <= set(starts) and [r[7] for r in rows if text[r[3] :].startswith("def f2")] == ["a.py > class A > def f2"]


def test_lines_of_other_languages():
    assert lines_cut("ab\ncd\n\nef", 4) == [(0, 7, 0, 6, 4), (7, 9, 7, 9, 2)]
    assert lines_cut("abcdef\ng", 4) == [(0, 7, 0, 6, 6), (7, 8, 7, 8, 1)]


def test_deep_and_long_sources_are_linear():
    began = time.perf_counter()
    for text, language in (("{" * 20_000 + "x" + "}" * 20_000, "typescript"), ("class A { f() { return x.g(1, 2); } }\n" * 8000, "java"), ("a" * 400_000, "go"), ("x = (1, 2)\n" * 20_000, "python")):
        rows = cut("p", text, language, 500, 50, 40)
        assert rows[-1][2] == len(text)
    assert time.perf_counter() - began < 30


def test_odd_files(spark):
    df = spark.createDataFrame([("a", "typescript", None, 1), ("b", "java", "", 1), ("c", None, "x\ny", 1), (None, "python", "x = 1", 1), ("d", "go", " \n ", 1)], "path string, language string, content string, solid int")
    got = {r.path: (r.raw_start, r.raw_end, r.solid) for r in structure_chunks(df).collect()}
    assert got == {"c": (0, 3, 2), None: (0, 5, 3), "d": (0, 3, 0)}
