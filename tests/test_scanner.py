"""The scanner of brace languages and Ruby on small sources, and the engine over a mixed tree."""

import pytest

from weftgraph.api import Engine
from weftgraph.sources.scanner import SPECS, blanked, extract_source

JAVA = """package a;
import java.util.List;
// comment foo() {
public class Dog extends Animal implements Runs {
  public String bark(int times, List<String> xs) { return helper.say("woof ( }", times); }
  Dog() { super(1); }
}
interface Runs { void run(); }
"""
SOURCES = {
    "java": (JAVA, {("class", "Dog"), ("method", "Dog.bark"), ("constructor", "Dog.Dog"), ("interface", "Runs")}, {"java.util.List"}, {"say"}),
    "c": ('#include <stdio.h>\n#include "my.h"\nstruct node { int v; };\nstatic int add(int a, int *b) { int c = a; return c + *b; }\nint main(void) { printf("%d", add(1, 2)); }\n', {("struct", "node"), ("function", "add"), ("function", "main")}, {"stdio.h", "my.h"}, {"printf", "add"}),
    "cpp": ("namespace n { class A : public B { int f(int x) const { return g(x); } }; }\nint A::h(int y) { return y; }\n", {("namespace", "n"), ("class", "n.A"), ("method", "n.A.f"), ("function", "h")}, set(), {"g"}),
    "csharp": ("using System.Text;\nnamespace N { class A : B { public int F(int x, string y) { return G(x); } } }\n", {("namespace", "N"), ("class", "N.A"), ("method", "N.A.F")}, {"System.Text"}, {"G"}),
    "go": ('package main\nimport (\n  "fmt"\n)\ntype Server struct { Port int }\nfunc (s *Server) Start(a int) error { return run(a) }\nfunc main() { srv := Server{}; srv.Start(1) }\n', {("struct", "Server"), ("method", "Server.Start"), ("function", "main")}, {"fmt"}, {"run", "Start"}),
    "rust": ("use std::io::{self, Read};\nstruct P { x: i32 }\nimpl P { fn new(x: i32) -> P { make(x) } }\nfn main() { let p = P::new(1); }\n", {("struct", "P"), ("method", "P.new"), ("function", "main")}, {"std::io::{self, Read}"}, {"make"}),
    "typescript": ("import { a, b as c } from './m';\nexport class Foo extends Bar { run(x: number): string { return this.go(x, [1,2]); } }\nconst f = (p: string, q) => { call(p); };\nfunction g(a) { return `x ${a} {`; }\n", {("class", "Foo"), ("method", "Foo.run"), ("function", "f"), ("function", "g")}, {"./m"}, {"go", "call"}),
    "javascript": ("const m = require('./m');\nfunction g(a) { return h(a); }\n", {("function", "g")}, {"./m"}, {"h", "require"}),
    "arkts": ("@Component\nstruct Page { build() { show(); } }\n", {("struct", "Page"), ("method", "Page.build")}, set(), {"show"}),
    "kotlin": ("import a.b.C\nclass Foo(val x: Int) : Base(x) { fun go(y: Int): Int { return run(y) } }\n", {("class", "Foo"), ("method", "Foo.go")}, {"a.b.C"}, {"Base", "run"}),
    "php": ("<?php\nuse A\\B;\n# no f() {\nclass C extends D { public function go($x) { return $this->run($x); } }\n", {("class", "C"), ("method", "C.go")}, {"A\\B"}, {"run"}),
    "cangjie": ("import std.io.*\nclass A { func f(x: Int64) { g(x) } }\n", {("class", "A"), ("method", "A.f")}, {"std.io.*"}, {"g"}),
    "ruby": ("require 'json'\nmodule M\n  class Dog < Animal\n    def bark(times)\n      if times > 1\n        puts(times)\n      end\n    end\n  end\nend\ndef top(a, b)\n  a\nend\n", {("module", "M"), ("class", "M.Dog"), ("method", "M.Dog.bark"), ("function", "top")}, {"json"}, {"puts"}),
}


@pytest.mark.parametrize("language", sorted(SPECS))
def test_languages(language):
    text, symbols, modules, calls = SOURCES[language]
    rows = extract_source("p", language, text)
    got = {f: [r for r in rows if r[1] == f] for f in ("symbol", "import", "reference")}
    assert {(r[4], r[6]) for r in got["symbol"]} == symbols
    assert {r[7] for r in got["import"]} == modules
    found = {r[5] for r in got["reference"] if r[4] in ("call", "instantiation")}
    assert calls <= found and not found & {"foo", "if", "function", "f" if language == "php" else "if"}
    data = text.encode()
    for r in rows:
        assert 0 <= r[9] <= r[10] <= len(data)
        if r[1] == "reference":
            assert data[r[9] : r[10]].decode() == r[5]


def test_bases_arguments_and_positions():
    rows = extract_source("p", "java", JAVA)
    assert {r[5] for r in rows if r[4] == "inheritance"} == {"Animal", "Runs"}
    say = next(r for r in rows if r[1] == "callsite" and r[5].endswith("say"))
    assert say[7] == "helper" and say[8] == 2 and say[3] == "Dog.bark"
    bark = next(r for r in rows if r[1] == "symbol" and r[5] == "bark")
    assert bark[8] == 2 and bark[11] == bark[12] == 4
    text = 'int é(int a) { return "}"; } // {\nint g(int b) { return b; }\n'
    assert [r[6] for r in extract_source("p", "c", text) if r[1] == "symbol"] == ["é", "g"]


def test_odd_sources():
    for language, spec in SPECS.items():
        for text in ("", "}", "{", "((((", '"', "/*", "class", "def f", "\x00\x80", "a = " * 500, "f(" * 300, "'\\"):
            extract_source("p", language, text)
            assert len(blanked(text, spec)[0]) == len(text)


def test_engine_over_languages(spark, tmp_path):
    (tmp_path / "a.go").write_text("package main\nfunc helper(x int) int { return x }\nfunc main() { helper(1) }\n")
    (tmp_path / "b.java").write_text("class A { int f(int x) { return g(x); } int g(int y) { return y; } }\n")
    (tmp_path / "c.py").write_text("def p():\n    return q()\ndef q():\n    return 1\n")
    engine = Engine.index(spark, str(tmp_path))
    names = {r.symbol_id: (r.language, r.name) for r in engine.facts["symbols"].collect()}
    calls = {(names[r.source], names[r.target]) for r in engine.facts["edges"].where("kind = 'calls'").collect()}
    assert calls == {(("go", "main"), ("go", "helper")), (("java", "f"), ("java", "g")), (("python", "p"), ("python", "q"))}


def test_sync_equals_a_new_index(spark, tmp_path):
    (tmp_path / "a.py").write_text("def p():\n    return q()\n")
    (tmp_path / "b.py").write_text("def q():\n    return 1\n")
    (tmp_path / "c.go").write_text("package main\nfunc main() { q() }\n")
    (tmp_path / "d.py").write_text("def r():\n    return p()\n")
    engine = Engine.index(spark, str(tmp_path))
    (tmp_path / "b.py").write_text("def other():\n    return p()\n\ndef q2():\n    return other()\n")
    (tmp_path / "d.py").unlink()
    (tmp_path / "e.go").write_text("package main\nfunc q() int { return 1 }\n")
    synced, changes = engine.sync(str(tmp_path))
    short = {r.path.rsplit("/", 1)[-1]: r.change for r in changes.collect()}
    assert short == {"a.py": "unchanged", "b.py": "modified", "c.go": "unchanged", "d.py": "deleted", "e.go": "new"}
    fresh = Engine.index(spark, str(tmp_path))
    for name in fresh.facts:
        rows = lambda e, n=name: sorted(map(repr, e.facts[n].collect()))
        assert rows(synced) == rows(fresh), name
    again, changes = synced.sync(str(tmp_path))
    assert {r.change for r in changes.collect()} == {"unchanged"} and again.facts["edges"].count() == fresh.facts["edges"].count()
