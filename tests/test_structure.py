from seamstone.operators import graph, structure

LANGUAGES = {
    "a.js": ("class Q {\n  async run(a) {\n    if (a) {\n    }\n  }\n}\n// class No\nfunction free() {}\nconst go = async (x) => x\n", [("Q", "class", 1, 6, None), ("run", "method", 2, 8, "Q"), ("free", "function", 8, 9, None), ("free", "method", 8, 9, "Q"), ("go", "method", 9, 6, "Q")]),
    "a.ts": ("export interface Shape {\n  area(): number\n}\nenum E { A }\nfunction f(): void {}\n", [("Shape", "interface", 1, 17, None), ("area", "method", 2, 2, "Shape"), ("E", "enum", 4, 5, None), ("f", "function", 5, 0, None), ("f", "method", 5, 0, "E")]),
    "A.java": ("public final class A {\n  public static int size(int x) { return x; }\n  interface B {}\n}\n", [("A", "class", 1, 19, None), ("size", "method", 2, 20, "A"), ("B", "interface", 3, 12, None)]),
    "a.cs": ("internal sealed class C {\n  protected override string Say(int n) => \"\";\n}\n", [("C", "class", 1, 22, None), ("Say", "method", 2, 28, "C")]),
    "a.go": ("type Store struct {\n}\nfunc (s *Store) Open(n int) error {\nfunc New() *Store {\ntype R interface {\n", [("Store", "struct", 1, 5, None), ("Open", "method", 3, 16, "Store"), ("New", "function", 4, 5, None), ("R", "interface", 5, 5, None)]),
    "a.rs": ("# not here\npub struct P;\ntrait T {}\nfn main() {}\n", [("P", "struct", 2, 11, None), ("T", "trait", 3, 6, None), ("main", "function", 4, 3, None)]),
    "a.hpp": ("class W {\n  static int count(int a) const;\n  int go() {\n", [("W", "class", 1, 6, None), ("count", "function", 2, 13, None), ("go", "function", 3, 6, None)]),
    "a.php": ("<?php\ntrait L {}\nclass K {\n  public function run() {}\n", [("L", "trait", 2, 6, None), ("K", "class", 3, 6, None), ("run", "function", 4, 18, None)]),
    "a.rb": ("def free\nend\nclass K\n  def run\n", [("free", "function", 1, 4, None), ("K", "class", 3, 6, None), ("run", "method", 4, 6, "K")]),
}


def test_symbols_of_every_language(spark):
    rows = [(n, path, text, "z") for n, (path, (text, _)) in enumerate(LANGUAGES.items())] + [(90, None, "class A", "z"), (91, "a.js", None, "z"), (92, "a.js", "", "z"), (93, "a.txt", "class A", "z")]
    df = spark.createDataFrame(rows, "file_id BIGINT, path STRING, content STRING, name STRING")
    got = {}
    for r in structure.line_symbols(df).collect():
        got.setdefault(r["file_id"], []).append((r["name"], r["symbol_type"], r["line"], r["col_offset"], r["class_name"]))
    for n, (path, (_, want)) in enumerate(LANGUAGES.items()):
        assert sorted(got.pop(n), key=str) == sorted(want, key=str), path
    assert got == {} and structure.line_symbols(df.limit(0)).count() == 0
    stats = {r["language"]: (r["files"], r["symbols"]) for r in structure.symbol_stats(structure.symbols(df), df).collect()}
    assert stats["javascript"] == (3, 5) and stats["ruby"] == (1, 3)


def test_python_symbols():
    text = "import a\n\nif a:\n    class K(B):\n        @x.y(1)\n        @prop\n        def m(self, n: int = 2, *r, k=1, **w) -> str:\n            MAX_ROWS = 1\n            def inner():\n                low = 2\n            return low\n        size = 3\nasync def f(): 'doc'\n@(lambda g: g)\nclass Z: pass\nTOP_LEVEL = 1\n"
    assert structure.python_symbols_of(text) == [
        ("K", "class", 4, 4, None, None, [], None, None), ("m", "method", 7, 8, "K", "K", ["x.y()", "prop"], "(self, n: int, *r, **w) -> str", None), ("MAX_ROWS", "constant", 8, 12, "K", "m", [], None, None), ("low", "variable", 10, 16, "K", "m", [], None, None),
        ("f", "function", 13, 0, None, None, [], "()", "doc"), ("Z", "class", 15, 0, None, None, ["<unknown>"], None, None),
    ]
    assert structure.python_symbols_of("def (") == structure.python_symbols_of(None) == structure.python_symbols_of("") == []


def test_python_calls():
    text = (
        "import os.path\nimport numpy as np\nfrom .pkg import thing as t, other\nfrom .. import up\nfrom m import *\nrun()\nclass K(base()):\n    x = setup()\n    def m(self):\n        self.n(); cls.n(); super().m(); m(); n()\n"
        "        np.zeros(3); np.linalg.norm(1); t(); up.go(); os.path.join(a); d['k'].go(); f()(); (lambda: 1)(); a.b.c(); len(x); [1].sort()\n        t[0]()\ndef free():\n    def inner(): free()\n    other()\n"
    )
    got = {(c[0], c[5]): (c[1], c[2]) for c in structure.python_calls_of(text)}
    want = {
        ("K", "base()"): ("K.base", "internal"), ("K", "setup()"): ("K.setup", "internal"), ("K.m", "self.n()"): ("K.n", "internal"), ("K.m", "cls.n()"): ("K.n", "internal"), ("K.m", "super().m()"): ("K.m", "external"), ("K.m", "super()"): ("builtins.super", "external"), ("K.m", "m()"): ("K.m", "recursive"), ("K.m", "n()"): ("K.n", "internal"),
        ("K.m", "np.zeros(3)"): ("numpy.zeros", "external"), ("K.m", "np.linalg.norm(1)"): ("numpy.linalg.norm", "external"), ("K.m", "t()"): (".pkg.thing", "external"), ("K.m", "up.go()"): ("...up.go", "external"), ("K.m", "os.path.join(a)"): ("os.path.join", "external"), ("K.m", "d['k'].go()"): ("d.go", "external"),
        ("K.m", "f()()"): ("UNKNOWN", "unknown"), ("K.m", "f()"): ("K.f", "internal"), ("K.m", "(lambda: 1)()"): ("<lambda>", "external"), ("K.m", "a.b.c()"): ("a.b.c", "external"), ("K.m", "len(x)"): ("builtins.len", "external"), ("K.m", "[1].sort()"): ("<unknown>.sort", "unknown"), ("K.m", "t[0]()"): ("UNKNOWN", "unknown"),
        ("free.inner", "free()"): ("free", "unknown"), ("free", "other()"): (".pkg.other", "external"),
    }
    assert got == want
    assert structure.python_calls_of("def f(): g('" + "x" * 5000 + "')")[0][5] == "g('" + "x" * 5000 + "')"


def test_call_graph_from_sources(spark):
    files = [("r", 1, "a.py", "class A:\n    def m(self):\n        self.n(); self.gone(); self.m()\n    def n(self): pass\n"), ("r", 2, "b.py", "class A:\n    def n(self): pass\n"), ("q", 3, "c.py", "def f(): f()\n"), ("q", 4, "d.js", "class Q {\n  run(a) {\n"), (None, 5, None, None)]
    df = spark.createDataFrame(files, "repo STRING, file_id BIGINT, path STRING, content STRING")
    nodes, calls = structure.call_graph(df, ["repo"])
    assert {(r["repo"], r["full_name"], r["file_id"]) for r in nodes.collect()} == {("r", "A", 2), ("r", "A.m", 1), ("r", "A.n", 2), ("q", "f", 3), ("q", "Q", 4), ("q", "Q.run", 4)}
    assert {(r["caller"], r["callee"], r["resolved_type"]) for r in calls.collect()} == {("A.m", "A.n", "internal"), ("A.m", "A.gone", "unknown"), ("A.m", "A.m", "internal"), ("f", "f", "recursive")}
    assert structure.call_graph(df, ["repo"], with_calls=False)[1].count() == 0
    radius = {r["start"]: (r["direct_calls"], r["total"]) for r in graph.call_radius(calls.withColumn("call_type", calls.resolved_type), ["repo"]).collect()}
    assert radius == {"A.n": (1, 1)}


def test_import_edges(spark):
    rows = [("r", "x/a.py", ["import lib.util", "from util import f", "os", None, "  "]), ("r", "lib/util.py", None), ("r", "zz/util.js", ["util"]), ("r", None, ["util"]), ("q", "y/util.py", [])]
    df = spark.createDataFrame(rows, "repo STRING, path STRING, imports ARRAY<STRING>")
    pairs = lambda d: {(r["src"], r["dst"]) for r in d.where("src IS NOT NULL").collect()}
    assert pairs(structure.import_edges(df, ["repo"])) == {("x/a.py", "lib/util.py"), ("zz/util.js", "lib/util.py")}
    every = {("x/a.py", "lib/util.py"), ("x/a.py", "zz/util.js"), ("zz/util.js", "lib/util.py")}
    assert pairs(structure.import_edges_by_stem(df, ["repo"])) == every == pairs(structure.import_edges_by_part(df, ["repo"]))
    symbols = spark.createDataFrame([("r", "f", "a"), ("r", "f", "b"), ("r", "f", "b"), ("r", "g", "a"), ("r", None, "a"), ("r", "f", None)], "repo STRING, name STRING, file STRING")
    assert {tuple(r) for r in structure.shared_symbol_files(symbols, ["repo"]).collect()} == {("r", "f", "a", "a", 1), ("r", "f", "b", "a", 1)}


def test_structure_of_more_families(spark):
    rows = [(1, "a.swift", "import UIKit\nprivate class A {}\nfunc go() {}\n"), (2, "a.kt", "import a.b\ndata class D(val x: Int)\nfun run() {}\n"), (3, "a.sql", "CREATE TABLE t (x int);\nCREATE OR REPLACE FUNCTION f() AS 1;\n-- IMPORT other\n"), (4, "a.md", "class A\n")]
    got = {r["file_id"]: (r["family"], r["found_classes"], r["found_functions"], r["found_imports"]) for r in structure.structure(spark.createDataFrame(rows, "file_id INT, path STRING, content STRING")).collect()}
    assert got == {1: ("swift", ["A"], ["go"], ["UIKit"]), 2: ("kotlin", ["D"], ["run"], ["a.b"]), 3: ("sql", ["t"], ["f"], ["other"]), 4: ("python", ["A"], [], [])}
