"""Symbols and relations of sources in five languages against hand-made tables."""

from __future__ import annotations

import pytest

from kelpline.operators.lexer import lex
from kelpline.operators.syntax import extract, imports_of

TS = """// class Commented { f() {} }
import base, { hash as h, Salt } from './crypto';
import * as all from "./all";

interface Port {
  update(input: string): string;
  size: number;
}

export abstract class Service<T extends Other> extends Base<T> implements Port, Away {
  private repo: Repo;
  static token = `x ${make('}')} class Not { }`;

  async update(input: string, n = pair(1, 2)) {
    this.repo.save(input);
    this.token = h(input);
    function inner(a) { return deep(a); }
    if (/[/)}]class X {/.test(input)) { return new Thing(this.token); }
    return inner(input);
  }
  handler = () => { this.update('a'); };
}

class Base { update(x) { return x; } }
function* go(a, b) { yield other(a); }
const f = function named(z) { return z; };
"""
PYTHON = '''import os, a.b as c
from crypto.hash import (one as two,
    three)

class Service(Base, mixin.Other, metaclass=Meta):
    """class Fake: def no(): pass"""
    repo = None
    size: int = 3

    def __init__(self, repo, n=1):
        self.repo = repo

    async def update(self, text):
        self.repo.save(text)
        def inner():
            return helper(text)
        return inner()


def helper(x): return x.strip()
'''
GO = """package user

import (
  "strings"
  crypto "app/crypto"
)
import "fmt"

// func no() {}
type (
  Service struct {
    Repo UserRepo
    a, b int
    Embedded
  }
)

func (s *Service) Update(ctx Ctx, a, b string) string {
  s.Repo.Save(a)
  s.a = crypto.Hash(a)
  return local(strings.TrimSpace(a))
}

func local(string, int) string { return `raw { } func` }
"""
JAVA = """package user;
import app.crypto.Hash;
import static app.Util.run;

public class Service<T> extends Base implements Port, Away {
  private Map<String, Repo> repo;
  int n = call(1), m;

  Service(int n) { this.n = n; }

  @Override
  public void update(String a, int... b) throws Bad {
    this.repo.save(a);
    this.n = Hash.hash(a);
    new Thing(a);
    local(a);
  }
  abstract String local(String v);
}
interface Port { void update(String a); }
"""


@pytest.fixture(scope="module")
def found(spark):
    files = [("a.ts", "typescript", TS), ("b.py", "python", PYTHON), ("c.go", "go", GO), ("d.java", "java", JAVA), ("e.rb", "ruby", "def x; end"), ("f.ts", "typescript", ""), ("g.js", "javascript", None)]
    df = spark.createDataFrame([(*f, 1) for f in files], "path string, language string, content string, name int").repartition(3)
    symbols, relations = extract(df)
    return symbols.collect(), relations.collect()


def short(found, path):
    names = {s.id: s.name for s in found[0]}
    own = [s for s in found[0] if s.file_path == path]
    table = sorted((s.start_line, s.end_line, s.type, s.name, names.get(s.parent_id), int(s.id.split(":")[-3])) for s in own)
    ids = {s.id for s in own}
    edges = sorted({(names[r.from_id], r.type, names.get(r.to_id, r.to_id.split(":", 3)[-1])) for r in found[1] if r.from_id in ids and not r.type.startswith("HAS")})
    return table, edges


def test_typescript(found):
    table, edges = short(found, "a.ts")
    assert table == [
        (5, 8, "Interface", "Port", None, 0), (6, 6, "Method", "update", "Port", 1), (7, 7, "Variable", "size", "Port", 0), (10, 22, "Class", "Service", None, 0), (11, 11, "Variable", "repo", "Service", 0), (12, 12, "Variable", "token", "Service", 0),
        (14, 20, "Method", "update", "Service", 2), (17, 17, "Function", "inner", "update", 1), (21, 21, "Variable", "handler", "Service", 0), (24, 24, "Class", "Base", None, 0), (24, 24, "Method", "update", "Base", 1), (25, 25, "Function", "go", None, 2),
    ]
    assert [e for e in edges if e[1] != "IMPORTS"] == [
        ("Service", "EXTENDS", "Base"), ("Service", "IMPLEMENTS", "Port"), ("Service", "IMPLEMENTS", "implements:Away"), ("go", "CALLS", "call:other"), ("inner", "CALLS", "call:deep"),
        ("update", "ACCESSES", "repo"), ("update", "ACCESSES", "token"), ("update", "CALLS", "call:deep"), ("update", "CALLS", "call:h"), ("update", "CALLS", "call:pair"), ("update", "CALLS", "call:save"), ("update", "CALLS", "call:test"), ("update", "CALLS", "inner"),
        ("update", "METHOD_IMPLEMENTS", "update"), ("update", "METHOD_OVERRIDES", "update"),
    ]
    assert {e[2] for e in edges if e[1] == "IMPORTS"} == {"import:./crypto:base", "import:./crypto:h", "import:./crypto:Salt", "import:./all:all"}
    by = {(s.name, s.start_line): s for s in found[0] if s.file_path == "a.ts"}
    assert by["update", 14].modifiers == ["async"] and by["Service", 10].modifiers == ["abstract"] and by["repo", 11].modifiers == ["private"]
    assert by["Service", 10].exported and by["inner", 17].exported and not by["Base", 24].exported
    assert by["update", 14].id == "typescript:a.ts:Service:update:2:14:20"
    modes = {(r.to_id.split(":")[3], r.reason) for r in found[1] if r.type == "ACCESSES" and ":a.ts:" in r.from_id}
    assert modes == {("repo", "read:repo"), ("token", "write:token"), ("token", "read:token")}


def test_python(found):
    table, edges = short(found, "b.py")
    assert table == [
        (5, 17, "Class", "Service", None, 0), (7, 7, "Variable", "repo", "Service", 0), (8, 8, "Variable", "size", "Service", 0), (10, 11, "Method", "__init__", "Service", 1), (13, 17, "Method", "update", "Service", 1),
        (15, 16, "Function", "inner", "update", 0), (20, 20, "Function", "helper", None, 1),
    ]
    assert [e for e in edges if e[1] != "IMPORTS"] == [
        ("Service", "EXTENDS", "extends:Base"), ("__init__", "ACCESSES", "repo"), ("helper", "CALLS", "call:strip"), ("inner", "CALLS", "helper"), ("update", "ACCESSES", "repo"), ("update", "CALLS", "call:save"), ("update", "CALLS", "helper"), ("update", "CALLS", "inner"),
    ]
    assert {e[2] for e in edges if e[1] == "IMPORTS"} == {"import:os:os", "import:a.b:c", "import:crypto.hash:two", "import:crypto.hash:three"}


def test_go(found):
    table, edges = short(found, "c.go")
    assert table == [
        (11, 15, "Class", "Service", None, 0), (12, 12, "Variable", "Repo", "Service", 0), (13, 13, "Variable", "a", "Service", 0), (18, 22, "Method", "Update", "Service", 2), (24, 24, "Function", "local", None, 2),
    ]
    assert [e for e in edges if e[1] != "IMPORTS"] == [
        ("Update", "ACCESSES", "Repo"), ("Update", "ACCESSES", "a"), ("Update", "CALLS", "call:Hash"), ("Update", "CALLS", "call:Save"), ("Update", "CALLS", "call:TrimSpace"), ("Update", "CALLS", "local"),
    ]
    assert {e[2] for e in edges if e[1] == "IMPORTS"} == {"import:strings:strings", "import:app/crypto:crypto", "import:fmt:fmt"}


def test_java(found):
    table, edges = short(found, "d.java")
    assert table == [
        (5, 19, "Class", "Service", None, 0), (6, 6, "Variable", "repo", "Service", 0), (7, 7, "Variable", "n", "Service", 0), (11, 17, "Method", "update", "Service", 2), (18, 18, "Method", "local", "Service", 1),
        (20, 20, "Interface", "Port", None, 0), (20, 20, "Method", "update", "Port", 1),
    ]
    assert {e[2] for e in edges if e[1] == "IMPORTS"} == {"import:app.crypto.Hash:Hash", "import:app.Util.run:run"}
    assert [e for e in edges if e[1] != "IMPORTS"] == [
        ("Service", "EXTENDS", "extends:Base"), ("Service", "IMPLEMENTS", "implements:Away"), ("Service", "IMPLEMENTS", "implements:Port"), ("update", "ACCESSES", "n"), ("update", "ACCESSES", "repo"), ("update", "CALLS", "call:hash"), ("update", "CALLS", "call:save"), ("update", "CALLS", "local"),
    ]


def test_other_languages_have_no_rows(found):
    assert not [s for s in found[0] if s.file_path in ("e.rb", "f.ts", "g.js")]


def test_lexer_is_linear_and_robust():
    import time

    began = time.perf_counter()
    for source, language in (("{" * 100_000 + ")" * 100_000, "typescript"), ("`${" * 50_000, "typescript"), ("a /b/ c " * 50_000, "javascript"), ("if x:\n" + "    y = (1)\n" * 30_000, "python"), ('"\\a' * 100_000, "java"), ("'''" + "a" * 300_000, "python"), ("/*" * 100_000, "go")):
        rows = lex(source, language)
        assert all(r[7] < r[0] for r in rows) and all(r[9] >= r[0] for r in rows if r[1] == "open")
    assert time.perf_counter() - began < 20
