"""Source texts as tables of tokens: a row a token with the bracket that it stands in.

The lexer knows strings, templates, comments and regular expressions, and keeps a stack of open brackets (for Python, of
indented blocks too). What tokens mean is left to joins and windows over the table: tokens of one (path, up) are the
direct contents of one bracket.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "path string, language string, i int, kind string, text string, line int, end_line int, start int, stop int, up int, around string, close int"

#: Tokens that are handed on at a time.
BLOCK = 1 << 16

_WORD = r"(?P<word>[^\W\d][\w$]*|[$#@][\w$]*[\w$])"
_REST = r"(?P<number>\d[\w.]*)|(?P<line>\n)|(?P<open>[({\[])|(?P<close>[)}\]])|(?P<punct>=>|\.\.\.|:=|[=!]==?|.)"
_QUOTES = r""""(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?"""
_COMMENT = r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"
#: Languages that share lexical rules.
RULES = {
    "typescript": re.compile(rf"(?P<blank>[^\S\n]+)|{_COMMENT}|(?P<string>{_QUOTES})|(?P<template>`)|{_WORD}|{_REST}", re.S),
    "java": re.compile(rf'(?P<blank>[^\S\n]+)|{_COMMENT}|(?P<string>"""(?:[^\\]|\\.)*?"""|{_QUOTES})|{_WORD}|{_REST}', re.S),
    "go": re.compile(rf"(?P<blank>[^\S\n]+)|{_COMMENT}|(?P<string>{_QUOTES}|`[^`]*`?)|{_WORD}|{_REST}", re.S),
    "python": re.compile(rf"""(?P<blank>[^\S\n]+|\\\n)|(?P<comment>#[^\n]*)|(?P<string>[rbufRBUF]{{0,2}}(?:\"{{3}}(?:[^\\]|\\.)*?\"{{3}}|'{{3}}(?:[^\\]|\\.)*?'{{3}}|{_QUOTES}))|{_WORD}|{_REST}""", re.S),
}
RULES["javascript"] = RULES["typescript"]
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(?P<end>`|\$\{|\Z)", re.S)
_REGEX = re.compile(r"/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
#: After these a slash begins a regular expression.
_VALUE_NEXT = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do"}


def lex(source: str, language: str) -> list[list]:
    """[i, kind, text, line, end_line, start, stop, up, around, close] of each token; an open bracket has its end, closes are no rows.

    kind: word, string, number, punct, comment, open. Unclosed brackets close at the end, a close without an open is
    skipped, and one that closes an outer bracket closes the inner ones with it.
    """
    rule, out, stack, line, pos, n = RULES[language], [], [], 1, 0, len(source)
    pairs, indents, fresh, after_close = {")": "(", "]": "[", "}": "{"}, [0], True, False
    held = {"(": 0, "[": 0, "{": 0, "${": 0, "INDENT": 0}  # open brackets of each kind
    script, indented = language in ("typescript", "javascript"), language == "python"

    def put(kind: str, text: str, start: int, stop: int, first: int) -> None:
        out.append([len(out), kind, text, first, line, start, stop, stack[-1] if stack else -1, out[stack[-1]][2] if stack else '', -1])

    def shut(at: int, stop: int, last: int) -> None:
        while len(stack) > at:
            row = out[stack.pop()]
            held[row[2]] -= 1
            row[4], row[6], row[9] = last, stop, len(out)

    while pos < n:
        m = _REGEX.match(source, pos) if script and source[pos] == "/" else None
        if m and (after_close or out and out[-1][1] in ("word", "string", "number") and out[-1][2] not in _VALUE_NEXT):
            m = None
        if m:
            kind, text = "string", m[0]
        else:
            m = rule.match(source, pos)
            kind, text = m.lastgroup, m[0]
        start, pos, first = pos, m.end(), line
        if indented and fresh and kind not in ("blank", "comment", "line") and len(stack) == held["INDENT"]:
            width = start - (source.rfind("\n", 0, start) + 1)
            while width < indents[-1] and stack:
                last = out[-1]
                shut(len(stack) - 1, last[6], last[4])
                indents.pop()
            if width > indents[-1] and out and out[-1][2] == ":":
                indents.append(width)
                put("open", "INDENT", start, start, line)
                stack.append(len(out) - 1)
                held["INDENT"] += 1
        after_close = kind == "close" or after_close and kind in ("blank", "comment", "line")
        fresh = fresh and kind in ("blank", "comment") or kind == "line"
        line += text.count("\n")
        if kind == "template" or kind == "close" and text == "}" and stack and out[stack[-1]][2] == "${":
            if kind == "close":
                shut(len(stack) - 1, pos, line)
            m = _TEMPLATE.match(source, pos)
            line += m[0].count("\n")
            if kind == "template":
                put("string", source[start : m.end()], start, m.end(), first)
            pos = m.end()
            if m["end"] == "${":
                put("open", "${", pos - 2, pos, line)
                stack.append(len(out) - 1)
                held["${"] += 1
        elif kind == "open":
            put(kind, text, start, pos, first)
            stack.append(len(out) - 1)
            held[text] += 1
        elif kind == "close" and held[pairs[text]]:
            at = len(stack) - 1
            while out[stack[at]][2] != pairs[text]:
                at -= 1
            shut(at, pos, line)
        elif kind not in ("blank", "line", "close"):
            put(kind, text, start, pos, first)
    last = out[-1] if out else None
    if last:
        shut(0, last[6] if indented else n, last[4] if indented else line)
    return out


def token_table(files: DataFrame) -> DataFrame:
    """files(path, language, content) -> the tokens of sources in the RULES' languages; others and nulls have none.

    Tokens of a file are numbered from 0 (comments too); start and stop are its offsets in characters, up and
    around are the number and text of the bracket around (-1 at the top), close the number after a bracket's last token.
    """

    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for path, language, content in zip(pdf.path, pdf.language, pdf.content, strict=True):
                if language in RULES and content:
                    rows += [(path, language, *r) for r in lex(content, language)]
                if len(rows) > BLOCK:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "language", "content").mapInPandas(run, SCHEMA)
