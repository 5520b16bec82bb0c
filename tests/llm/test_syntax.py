import ast
import json

import pytest

from seamstone.llm import gll, syntax

VALID = {
    "a.js": [
        "const {a, b: [c, ...d], ...e} = require('x'), f = async ({g = 1}, ...h) => { await g; };\n",
        "export default class A extends B { static #x = 1; get y() { return this.#x ?? 2; } async *gen() { yield* z; } static { init(); } }\n",
        "for (const [k, v] of Object.entries(o)) if (k) continue; else break;\nlabel: while (1) { break label }\n",
        "let r = /[/\\]]+/g.test(s) ? `a${`b${c}`}d` : x / y / z;\n",
        "var a = 1\nvar b = a\n++b\nreturn_(b)\n",
        "import x, {y as z} from 'm'; import * as q from \"n\"; export {z as default, q}; export * from 'p'\n",
        "a?.b?.[c]?.(d); new Foo; new Bar(1).baz; x = y = z; delete o.p, void 0;\n",
        "const el = <div className=\"a\" {...props}>text {items.map(i => <Item key={i} />)} <></> </div>;\n",
        "switch (x) { case 1: case 2: f(); break; default: g() }\ntry { a() } catch { b() } finally { c() }\n",
        "if (a) { b } else if (c) d; do x++; while (x < 5)\nthrow new Error('e')\n", "", "// only\n/* comments */",
    ],
    "a.ts": [
        "interface A<T extends object = {}> extends B<T>, C { readonly x?: number; [k: string]: unknown; m<U>(u: U): Promise<U[]>; new (s: string): A<T> }\n",
        "type M<T> = { readonly [K in keyof T]?: T[K] extends infer U ? U | null : never };\n",
        "export abstract class S<T> implements I { constructor(private readonly a: string, public b?: number) { super(); } abstract go(): void; protected get v(): T { return this.x!; } }\n",
        "enum E { A = 1, B = 'b' }\ndeclare module 'x' { export const y: number; }\nnamespace N.M { let z = <any>w; }\n",
        "function f(this: Window, a: string | undefined, ...r: Array<Map<string, number[]>>): asserts a is string { return; }\n",
        "const g = async <T,>(x: T): Promise<T> => x as unknown as T; let t: [a: string, b?: number, ...rest: boolean[]];\n",
        "@Dec({a: 1}) class D { @Input() name!: string; @Output() e = new EventEmitter<string>(); }\n",
        "import type { A } from './a'; export type { A }; let u: typeof x.y; let fn: (a: number, b?: string) => void;\n",
    ],
    "a.java": [
        "package a.b; import static java.util.Map.*; import java.util.List;\n@FunctionalInterface public interface F<T extends Comparable<? super T>> { T go(T... x) throws E; default void d() {} }\n",
        "class A<T> extends B<List<T>[]> implements C { private final int[] x = {1, 2}, y; static { z(); } A(int a) { this(a, 1); } <U> U m(U u) { return u; } }\n",
        "enum Color { RED(1) { @Override int v() { return 2; } }, GREEN; private int k; Color(int... k) { } }\nrecord P(int x, String y) { P { check(x); } }\n",
        "class S { void f(Object o) { for (int i = 0, j = 1; i < 3; i++, j--) {} for (var e : list) ; String s = switch (o) { case Integer i when i > 0 -> \"a\"; case null, default -> { yield \"b\"; } }; } }\n",
        "class L { Runnable r = () -> {}; F<A, B> g = (a, b) -> a + b; Supplier<X> h = X::new; int[][] m = new int[3][]; Object o = (Runnable & Serializable) () -> f(); boolean q = a < b && c > d; char c = '\\u0041'; }\n",
        "class T { void t() { try (var a = open(); b) { } catch (IOException | RuntimeException e) { throw e; } finally { } synchronized (this) { assert x > 0 : \"m\"; } label: do { continue label; } while (true); } }\n",
        "class G { Map<String, Map<Integer, List<int[]>>> m = new HashMap<>(); @SuppressWarnings({\"a\", \"b\"}) <T> void n(@NonNull final T t) { List.<T>of(t).forEach(System.out::println); String x = \"\"\"\n  text \"q\" \n\"\"\"; } }\n",
    ],
    "a.go": [
        "package m\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\ntype T[K comparable, V any] struct {\n\tm map[K][]*V `json:\"m\"`\n\tsync.Mutex\n}\n\nfunc (t *T[K, V]) Get(k K) (v V, ok bool) {\n\tdefer func() { recover() }()\n\tif v, ok := t.m[k]; ok && len(v) > 0 {\n\t\treturn *v[0], true\n\t} else if !ok {\n\t\tgoto end\n\t}\nend:\n\treturn\n}\n",
        "package m\n\nfunc f(a, b int, c ...string) {\n\tfor i := 0; i < 3; i++ {\n\t\tgo g(i)\n\t}\n\tfor range ch {\n\t}\n\tfor k, v := range m {\n\t\tdelete(m, k)\n\t}\n\tswitch x := y.(type) {\n\tcase int, string:\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-ch:\n\tcase ch <- 1:\n\t}\n\ts := []T{{1, 2}, {A: 3}}\n\tp := &T{A: map[string]int{\"a\": 1}}\n\tx, y = y, x\n\tvar fn func(int) (string, error) = nil\n\t_ = arr[1:2:3]\n\tif p == (T{}) {\n\t}\n}\n",
        "package m\n\ntype I interface {\n\tM(x int) error\n\t~int | ~string\n}\n\nconst (\n\tA = iota\n\tB\n)\n\nvar x, y = 1, func() int { return 2 }()\n",
    ],
    "a.rs": [
        "use std::{collections::{HashMap, *}, io as i};\n#[derive(Debug)]\npub(crate) struct S<'a, T: Clone + 'a = i32> where T: Fn(&T) -> bool { pub x: &'a mut [T; 3], y: Option<Box<dyn Fn(i32) -> i32 + Send>> }\n",
        "impl<'a, T> Tr for S<'a, T> { type O = T; const C: usize = 1; async fn f(&mut self, mut a: i32, (b, _): (u8, u8)) -> Result<(), E> { let Some(x) = g()? else { return Err(e); }; Ok(()) } }\n",
        "fn m() { let v: Vec<_> = (0..=10).filter(|&x| x % 2 == 0).map(|x| -> i32 { x << 1 }).collect::<Vec<Vec<i32>>>(); match v { [a, .., b] if a > b => {} Foo::Bar { x, ref y, .. } | Baz(_) => (), 1..=5 => println!(\"{}\", x), _ => unreachable!() } 'o: loop { break 'o; } if let Some(x) = y && z {} while let Ok(_) = w {} }\n",
        "macro_rules! mm { ($x:expr) => { $x + 1 }; }\nenum E { A, B(i32), C { x: u8 } = 3 }\ntrait T: Sized + 'static { fn d(&self) {} }\nfn c() -> char { let s = S { x: 1, ..Default::default() }; let r = r#\"raw \"q\"\"#; let t = &s.0.1; *p += 1; 'x' }\n",
    ],
    "a.rb": [
        "require 'a'\nmodule M\n  class A < B\n    attr_accessor :x, :y\n    def initialize(a, b = 1, *c, d:, e: 2, **f, &g)\n      @a, @b = a, b\n      super\n    end\n    def self.go?; true; end\n  end\nend\n",
        "x = if a then b else c end\nputs \"v #{x}\" unless y\nfoo do |a, (b, c)|\n  next if a\nend\nlist.map { |v| v * 2 }.select(&:odd?).each_with_index do |v, i|\n  puts v\nend\n",
        "case x\nwhen 1, 2 then y\nwhen /re/i\n  z\nelse\n  w\nend\nbegin\n  a\nrescue E, F => e\n  b\nelse\n  c\nensure\n  d\nend\n",
        "h = { a: 1, 'b' => 2, \"c\": 3 }\ns = <<~EOS\n  text\nEOS\nw = %w[a b]\nf = ->(x) { x + 1 }\nwhile i < 3 do i += 1 end\nputs a ? b : c\nfoo.bar = baz rescue nil\nreturn 1, 2 if x && !y\n",
        "class << self\n  def a(b) = b + 1\nend\nfoo(1, *args, key: 2, &blk)\n@x ||= {}\nx.y&.z\nputs [1, 2,\n  3].sum\n",
    ],
    "a.php": [
        "<?php\nnamespace A\\B;\nuse C\\{D, E as F};\nabstract class X extends Y implements Z { use T; const K = 1; private ?int $a = null; public static function f(int|string $x, &...$y): ?self { return new static($x); } abstract function g(); }\n",
        "<html><?php foreach ($a as $k => [$b, $c]): ?><p><?= $b ?></p><?php endforeach; ?></html>",
        "<?php\n$f = function ($x) use (&$y): int { return $x ** 2; };\n$g = fn($x) => $x?->y ?? 'z';\n$s = match(true) { $a, $b => 1, default => throw new E };\n$h = <<<EOT\ntext $x\nEOT;\nif ($a): echo 1; elseif ($b): else: endif;\necho \"a{$b['c']}\", PHP_EOL;\n[$a, , $b] = $c;\n#[Attr(1)]\nfunction k() { static $n = 0; yield $n => 1; }\ntry { } catch (A | B $e) { } finally { }\n",
        "<?php\nenum S: string { case A = 'a'; public function l(): string { return static::class . self::A->value; } }\n$x = (int) $y + $$z; switch ($x) { case 1: break; default: } $a::{$b}(); isset($a['b']) and die();\n",
    ],
    "a.cs": [
        "using System; using X = Y.Z;\n[assembly: Foo(\"a\")]\nnamespace A.B { public sealed partial class C<T> : D, IE<T> where T : class, new() { private readonly int? x = 1; public string P { get; private set; } = \"a\"; public int this[int i] => i; event Action<T> Ev; ~C() { } public static C<T> operator +(C<T> a, C<T> b) => a; } }\n",
        "namespace N;\npublic record R(int X, string Y) : B(X);\nclass K { async Task<List<int>> M(params string[] a) { await foreach (var x in y) { yield return x; } var q = from i in xs where i > 0 orderby i descending select new { i, Z = i * 2 }; return s switch { 1 or 2 => a, > 5 when b => c, { P: 1 } p => d, _ => throw new E() }; } }\n",
        "class U { void F() { if (o is string { Length: > 3 } s && s != null) { } var d = new Dictionary<string, int> { [\"a\"] = 1, { \"b\", 2 } }; using var f = Open($\"{x:N2} {y}\"); int[] a = new[] { 1, 2 }; lock (this) { } Func<int, int> g = static x => x + 1; x ??= y?.Z?[0] ?? default; for (int i = 0; i < n; i++) ; try { } catch (E e) when (e.X) { throw; } foreach (var (k, v) in d) { } } }\n",
    ],
    "a.cpp": [
        "#include <vector>\n#define X(a) \\\n  a\nnamespace a::b { template <typename T, int N = 3> class V : public B<T>, private C { public: explicit V(int n) noexcept : B<T>(n), x_{n} {} virtual ~V() = default; T operator[](size_t i) const { return d_[i]; } private: std::unique_ptr<T[]> d_; static constexpr int k = 1 << 3; }; }\n",
        "auto f(const std::map<std::string, std::vector<int>>& m, int (*cb)(int, char*)) -> decltype(m.size()) { for (const auto& [k, v] : m) { if (auto it = m.find(k); it != m.end()) return it->second.size(); } auto l = [&, x = 1](auto&&... a) mutable { return g(std::forward<decltype(a)>(a)...); }; return static_cast<size_t>(-1); }\n",
        "enum class E : uint8_t { A = 1, B };\nstruct S { int a : 3; union { int i; float f; }; } s = { .a = 1 };\nusing F = void (*)(int);\ntypedef struct { int x; } T;\nextern \"C\" { void g(void); }\nint arr[3][2] = {{1, 2}, {3, 4}};\nconst char* r = R\"(raw \")\" \"b\";\n",
        "int main(int argc, char** argv) { switch (argc) { case 1: { break; } default: goto end; } try { throw std::runtime_error(\"x\"); } catch (const std::exception& e) { delete[] p; } catch (...) {} do { x++; } while (x < 3); end: return a ? b : c; }\n",
    ],
    "a.py": ["def f(a, /, b: int = 1, *c, d, **e) -> 'x':\n\treturn (yield)\n", "match x:\n    case {'a': [1, *_], **r} if r:\n        pass\n    case A(b=1) | None:\n        pass\n", "x: int = 1; y = z = 2\nwith a as b, c() as (d, e): pass\nasync def g():\n    async for i in h: await i\n", ""],
    "a.json": ['{"a": [1, -2.5e3, "x\\u00e9", null, true], "b": {}}', "[]", '"s"'],
}
INVALID = {
    "a.js": ['{"a": 1, "b": 2}', "function f( {", "const a: number = 1;", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x\n", "let x = ;", "}", "class { m() }", "def f(x):\n    return x\n", "'open"],
    "a.ts": ["interface {", "let x: = 3;", "function f(a: ) {}", "package a;\nimport java.util.List;\n"],
    "a.java": ["class A { void f() { int x = 1 } }", "public A {", "package a\nfunc f() {}\n", "class A { /* open", "import { a } from 'b';"],
    "a.go": ["package m\nfunc f() {\n\tx :=\n}\n", "package m\nfunc f()\n{\n", "class A {}\n", "package m\n\nfunc f() { if x { }\n"],
    "a.rs": ["fn f( {}", "struct S { x: }", "let x = 1;\nfn", "fn f() { match x { a => } }"],
    "a.rb": ["def f\n  1\n", "class A\nend\nend\n", "def f(x):\n  return x\n", "x = [1, 2\n", "foo(}\n"],
    "a.php": ["<?php function f( { }", "<?php $x = ;", "<?php class A { function }", "<?php if ($a) { "],
    "a.cs": ["class A { void F() { int x = ; } }", "package a.b;\nimport java.util.List;\n", "class A { int P { get } }", "namespace A {"],
    "a.cpp": ["int f( { }", "class A { int x }", "int x = ;", "def f(x):\n  return x\n", "void f() { if (x { } }"],
    "a.py": ["def f(:\n  pass\n", "x = (1\n", "if x:\npass\n", "  x = 1\n", "print 'x\n", "a b\n", "=======\n"],
    "a.json": ["{'a': 1}", '{"a": 1,}', "[1 2]", "{", "// c\n{}", "nul", "<html>"],
}


@pytest.mark.parametrize(("path", "text"), [(p, t) for p, ts in VALID.items() for t in ts])
def test_valid(path, text):
    assert syntax.parses(path, text)


@pytest.mark.parametrize(("path", "text"), [(p, t) for p, ts in INVALID.items() for t in ts])
def test_invalid(path, text):
    assert syntax.parses(path, text) is False


def test_every_prefix_of_python_and_json_agrees_with_the_real_parser():
    code = "import a\n\nclass A(B):\n    x: int = {'k': [1, 2]}\n\n    @d\n    def f(self, *a):\n        '''doc'''\n        if a and not self.x[1:]:\n            return [i for i in a if i]\n        else:\n            raise E from None\n"
    data = '{"a": [1, {"b": null}], "c": "x"}'
    for text, path, real in ((code, "a.py", ast.parse), (data, "a.json", json.loads)):
        for cut in range(1, len(text)):
            try:
                real(text[:cut])
                want = True
            except ValueError:
                want = False
            except SyntaxError:
                want = False
            if text[:cut].strip():
                assert syntax.parses(path, text[:cut]) == want, text[:cut]


def test_ambiguous_and_left_recursive_grammars():
    g = gll.Grammar("Seq = Seq Seq | A | A A ; Sum = Sum '+' Sum | N ;", ())
    assert g.recognise(("Seq",), ("A",) * 12) and not g.recognise(("Seq",), ("A", "B"))
    assert g.recognise(("Sum",), tuple("N+N+N+N")) and not g.recognise(("Sum",), tuple("N+N+"))
    assert g.recognise(("Seq", "Sum"), ("N",))


def test_deep_nesting_and_long_files_end():
    assert syntax.parses("a.json", "[" * 900 + "]" * 900)
    assert syntax.parses("a.rb", "x = [\n" + '  "word",\n' * 3000 + "]\n")
    assert syntax.parses("a.js", "f();\n" * 5000)
    assert syntax.parses("a.json", "[" * 200_000) is False


@pytest.mark.parametrize(
    ("path", "before", "middle", "after"),
    [("a.json", "[", "1", "]"), ("a.json", '{"a": [', "1", "]}"), ("a.js", "(", "1", ")"), ("a.js", "`${", "1", "}`"), ("a.js", "{", "f();", "}"), ("a.rs", "fn f() {", "1", "}"), ("a.js", "<b>{", "1", "}</b>")],
)
def test_any_depth(path, before, middle, after):
    for n in (1_000, 15_000):
        assert syntax.parses(path, before * n + middle + after * n)
        assert syntax.parses(path, before * n + "1 2" + after * n) is False


DIALECTS = [
    ("a.py", "print 'x'\nprint >>f, x, y,\nprint\nexec code in d\nraise E, 'm', tb\n", True), ("a.py", "try:\n    x = 0777 + 10L <> `y`\nexcept (A, B), e:\n    def f((a, b), c=ur'x'): return lambda (k, v): k\n", True),
    ("a.py", "print('x', file=f)\nx: int = 1\nasync def f(): await g()\n", True), ("a.py", "print 'x'\nx: int = 1\n", False), ("a.py", "print 'x'\nasync def f(): await g()\n", False), ("a.py", "print 'x'\nif (y := 2): pass\n", False), ("a.py", "x = 0779\n", False), ("a.py", "exec = print\n", True),
    ("a.js", "with (o) { f(); }\nvar await = 1;\n", True), ("a.js", "import a from 'b';\nwith (o) { f(); }\n", False), ("a.mjs", "export const x = await f();\n", True), ("a.js", "import a from 'b';\nvar await = 1;\n", False),
    ("tsconfig.json", '// c\n{"a": [1, 2,], /* d */ "b": {"c": null,},}', True), ("x/.vscode/settings.json", '{"a": 1} // c', True), ("a.jsonc", '{"a": 1}', True), ("a.json", '{"a": 1} // c', False), ("a.json", '{"a": 1,}', False), ("tsconfig.json", '{"a": [1,,2]}', False),
    ("a.c", "struct shape { int class; void *new; };\nint f(struct shape *this) { return this->class; }\n", True), ("a.c", "template <class T> struct A { T x; };\n", False), ("a.c", "int f( {", False),
]


@pytest.mark.parametrize(("path", "text", "want"), DIALECTS)
def test_dialects(path, text, want):
    assert syntax.parses(path, text) is want


LOOSE = [
    ("a.kt", "package a.b\n\nimport c.*\n\n@Deco(\"x\")\ndata class D(val x: Int = 0x1F, val c: Char = '\\n') {\n    fun go(): String = \"a ${f(x)} }\" + \"\"\"raw \" { \"\"\"\n    val `odd name` = list.map { it + 1L }\n}\n", True), ("a.kt", "fun f() {\n    g(1\n", False), ("a.kt", "fun f() {}\n<<<<<<< HEAD\nval a = 1\n=======\nval a = 2\n>>>>>>> x\n", False), ("a.kt", "<!DOCTYPE html>\n<html></html>\n", False), ("a.kts", "// only a comment\n", True),
    ("a.swift", "import UIKit\n@main struct A: B {\n    let s = #\"a \" b\"# + \"\"\"\n  x } \"\n  \"\"\"\n    func go<T>(_ x: [T?]) -> Int { guard let y = x.first else { return 0 }; return y ?? 1 }\n}\n", True), ("a.swift", "func f() { g(1 }\n", False), ("a.swift", "<html>\n", False),
    ("a.sql", "-- all\nSELECT a, 'it''s', \"b c\" FROM t WHERE (x > 1.5e3) AND y IN (1, 2);\nCREATE FUNCTION f() RETURNS int AS $$ begin return '('; end $$ LANGUAGE plpgsql;\n", True), ("a.sql", "select count(* from t;", False), ("a.sql", "select 'open from t;", False), ("a.sql", "<!-- page -->", False),
    ("a.css", "@import 'x.css';\n@media (min-width: 10px) { .a > b:hover, #c::before { color: #fff; margin: -1px 2em } }\na[href^=\"x\"] { content: \"}\" }\n.x-1 { width: calc(100% - 3px) }\n50% { top: 0 }\n", True), ("a.css", ".a { color: red; ", False), ("a.css", "<<<<<<< HEAD\n.a { }\n=======\n.b { }\n>>>>>>> x\n", False),
]


@pytest.mark.parametrize(("path", "text", "want"), LOOSE)
def test_languages_by_tokens_and_brackets(path, text, want):
    assert syntax.parses(path, text) is want


C_HEADERS = [
    "struct shape { int class; void *new; };\nint template(struct shape *this, int delete);\n",
    "#ifdef __cplusplus\nextern \"C\" {\n#endif\nextern int try;\nvoid copy(char *restrict to, int n, int a[static 3], int b[const *]);\n#ifdef __cplusplus\n}\n#endif\n",
    "static int sum(a, b)\n    int a;\n    char *b;\n{\n    return a + *b;\n}\n",
    "static inline struct p at(int x) { return (struct p){ .x = x, .y = (int[]){1, 2}[0] }; }\n",
    "#define abs(x) y\nstatic double up(int private) { return _Generic(private, int: 1, struct s *: 2.0, default: f)(private); }\n_Noreturn void stop(void);\nstatic _Thread_local my_t x;\n_Atomic my_t y;\n_Static_assert(sizeof(int) == 4, \"int\");\n",
    "enum { A = 1, B = A << 2, };\ntypedef int (*call)(void *, ...);\nint (*pick(int public))(void);\nunion u { unsigned f : 3, : 2; float g[4]; } v = { .g = { [1] = 2 } };\n",
    "static int run(int n) { int new = n, *virtual = &new; for (int i = 0; i < n; i++) { switch (i) { case 1: continue; default: goto end; } } do { new += sizeof(struct s) * (long) n; } while (n--); end: return virtual ? virtual[0] : -1; }\n",
]


@pytest.mark.parametrize("text", C_HEADERS)
def test_headers_may_be_c(text):
    assert syntax.parses("a.h", text)


def test_headers_are_one_dialect():
    assert not syntax.parses("a.hpp", C_HEADERS[0])
    assert all(syntax.parses("a.h", t) for t in VALID["a.cpp"])
    assert syntax.parses("a.h", "_Atomic x;\ntemplate <class T> struct A { T _Generic; };\n")
    bad = ["int class;\ntemplate <class T> struct A { T x; };\n", "int new = ;", "struct s { int class }", "int f(a) int a; b {", "void f(void) { return (struct s){1 }", "int x[static;", *INVALID["a.cpp"]]
    assert [t for t in bad if syntax.parses("a.h", t) is not False] == []


def test_frame(spark):
    rows = [(1, "r", "a.py", "x = 1\n", "z"), (1, "r", "a.py", "x = \n", "z"), (2, "r", "a.py", None, None), (3, None, None, "x", None), (4, "r", "a.xyz", "(", None), (5, "r", "b.json", "", None), (6, "r", "a.JS", "let = (", None)]
    df = spark.createDataFrame(rows, "file_id BIGINT, repo STRING, path STRING, content STRING, parsed STRING")
    assert sorted(r["file_id"] for r in syntax.unparsed_files(df).collect()) == [1, 6]
    assert syntax.unparsed_files(df.limit(0)).count() == 0
    rates = {(r["repo"], r["intended"]): (r["n_files"], r["n_unparsed"]) for r in syntax.unparsed_rates(df.where("file_id <> 1")).collect()}
    assert rates == {("r", "python"): (1, 0), ("r", "json"): (1, 0), ("r", "javascript"): (1, 1)}
