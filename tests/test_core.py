import inspect
import math
import random
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from seamstone.functions import quality as Q
from seamstone.functions import text as T
from seamstone.operators import findings, graph, incremental, packing_context, recipes, similarity, structure, telemetry
from seamstone.operators.ordinals import with_ordinal, with_previous


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_entropy_lines_tokens(spark):
    texts = ["", "aaaa", "abab", "abcd", "x\r\ny\n\nz\n", "a\n\nb\n", None, "çığ😀"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    for r in df.select("i", "t", T.entropy(F.col("t")).alias("h"), F.size(T.split_lines(F.col("t"))).alias("n"), T.token_estimate(F.col("t")).alias("k")).collect():
        t = r["t"]
        if t is None:
            assert r["h"] is None
            continue
        want = -sum(c / len(t) * math.log2(c / len(t)) for c in Counter(t).values()) if t else 0.0
        assert abs(r["h"] - want) < 1e-9 and r["n"] == len(t.splitlines()) and r["k"] == len(t.encode()) // 4


def test_golden_quality(spark):
    assert round(Q.condition_number(), 9) == 19
    assert Q.condition_number(((1, 1, 1), (1, 1, 1), (0, 0, 1))) == math.inf
    assert one(spark, Q.confidence(F.lit(7.6))) == 0.532
    for (s, c, p), want in {(1, 0, 1): 0.999713, (0.5, 0.5, 1): 0.999335, (0.1, 0.9, 0.9): 0.990664, (0, 0.5, 1): 0.356080, (0, 0, 0): 0.0}.items():
        assert round(one(spark, Q.field_score(F.lit(float(s)), F.lit(float(c)), F.lit(float(p)))), 6) == want
    assert [round(one(spark, Q.pulse(F.lit(1.0), F.lit(1.0), F.lit(k))), 4) for k in ("Refactor", "Patch", "Feature", "x")] == [0.75, 0.92, 0.85, 0.9]
    assert tuple(one(spark, Q.heal(F.lit("UNSTABLE"), F.lit(1.0), F.lit(2)))) == (pytest.approx(3e-6), "WEAK", 3)
    assert tuple(one(spark, Q.divide(F.lit(1.0), F.lit(0.0), F.lit("DEGENERATE"), F.lit("STABLE")))) == (0.0, "UNSTABLE")
    assert [one(spark, Q.drift_gate(F.lit(x))) for x in (0.20, 0.21, 0.05)] == ["warn", "fail", "ok"]


def test_lattice_is_a_semilattice(spark):
    df = spark.createDataFrame([(a, b, c) for a in Q.LATTICE for b in Q.LATTICE for c in Q.LATTICE], "a STRING, b STRING, c STRING")
    a, b, c = map(F.col, "abc")
    bad = df.where((Q.combine(a, b) != Q.combine(b, a)) | (Q.combine(a, a) != a) | (Q.combine(Q.combine(a, b), c) != Q.combine(a, Q.combine(b, c))))
    assert bad.count() == 0


def test_short_names(spark):
    names = {"ts": "ts", "user_id": "ui", "createdAtTime": "at", "value": "val", "a_bc": "ab"}
    for name, want in names.items():
        assert one(spark, T.shorten_field(F.lit(name))) == want == packing_context.short_name(name)


EDGES = [("r", "a", "b"), ("r", "b", "c"), ("r", "c", "a"), ("r", "a", "d"), ("r", "d", "e"), ("r", "x", "e"), ("q", "a", "b"), ("r", "a", "b"), ("r", None, "b"), ("r", "a", None), ("r", "e", "e")]


def test_graph(spark):
    raw = spark.createDataFrame(EDGES, "repo STRING, src STRING, dst STRING")
    e = graph.edges_of(raw, "src", "dst", ["repo"])
    assert e.count() == 7
    assert graph.transpose(graph.transpose(e)).exceptAll(e.select("repo", "src", "dst")).count() == 0
    start = spark.createDataFrame([("r", "a"), ("q", "a")], "repo STRING, start STRING")
    got = {(r["repo"], r["node"]): r["depth"] for r in graph.closure(e, start, ["repo"]).collect()}
    assert got == {("r", "b"): 1, ("r", "d"): 1, ("r", "c"): 2, ("r", "e"): 2, ("q", "b"): 1}
    level = {(r["repo"], r["node"]): r["level"] for r in graph.levels(e, ["repo"]).collect()}
    assert level["r", "e"] == 0 and level["r", "d"] == 1 and level["r", "a"] is None and level["q", "a"] == 1
    assert {r["node"] for r in graph.neighbourhood(e, start.where("repo = 'r'"), 1, ["repo"]).collect()} == {"b", "c", "d"}
    assert graph.closure(e.limit(0), start, ["repo"]).count() == 0


def test_closures_have_no_depth_bound(spark, tmp_path):
    chain = [(r, f"n{i:02}", f"n{i + 1:02}") for r in ("down", "up") for i in range(44)]
    hubs = [("down", "x", "n00"), ("down", "y", "n00"), ("up", "x", "n44")]
    spark.createDataFrame(chain + hubs, "repo STRING, src STRING, dst STRING").coalesce(1).write.parquet(str(tmp_path / "file_deps.parquet"))
    for name, repo in (("o83_dependencies", "down"), ("o78_dependents", "up")):
        rows = entry.queries()[name](spark, str(tmp_path)).where(F.col("repo") == repo).collect()
        assert {r["depth"] for r in rows} == set(range(1, 45))


def test_levels_have_no_bound_of_rounds(spark):
    assert list(inspect.signature(graph.levels).parameters) == ["edges", "within"]  # a chain of over 1,000 takes minutes
    chain = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(9)] + [("x", "y"), ("y", "x")], "src STRING, dst STRING")
    assert {r["node"]: r["level"] for r in graph.levels(chain).collect()} == {**{f"n{i:02}": 9 - i for i in range(10)}, "x": None, "y": None}


def test_ordinals_over_hot_groups(spark):
    df = spark.createDataFrame([("hot", i, i * 2) for i in range(500)] + [(None, 1, 7), ("cold", 5, 1), ("cold", 3, 2)], "g STRING, o INT, v INT")
    placed = with_ordinal(df, ["g"], ["o"])
    got = {(r["g"], r["o"]): (r["ordinal"], r["previous"]) for r in with_previous(placed, ["g"], "v").collect()}
    assert len(got) == 503 and got["hot", 0] == (1, None) and got["hot", 499] == (500, 996) and got["cold", 5] == (2, 2) and got[None, 1] == (1, None)


def test_diff_then_merge_is_the_new_snapshot(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "path STRING, hash STRING")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("d", "4"), ("c", None)], "path STRING, hash STRING")
    d = incremental.diff(old, new, ["path"])
    assert {tuple(r) for r in d.collect()} == {("a", "same"), ("b", "changed"), ("c", "same"), ("d", "added")}
    gone = d.where("change = 'removed'").select("path")
    assert incremental.merge(old, new, gone, ["path"]).exceptAll(new).count() == 0
    s = incremental.staleness(d).first()
    assert (s["total_files"], s["stale_files"], s["recommendation"]) == (3, 1, "RESCAN")


def test_similarity(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta gamma"), (50, "alpha beta delta"), (3, None), (4, "")], "doc_id BIGINT, text STRING")
    prints = {r["doc_id"]: (r["hi"], r["lo"]) for r in similarity.simhash(docs, "doc_id", "text").collect()}
    assert prints[1] == prints[2] and prints[3] == prints[4] == (0, 0)
    same = similarity.similarity_percent(F.lit(5), F.lit(6), F.lit(5), F.lit(6))
    assert one(spark, same) == 100.0 and one(spark, similarity.similarity_percent(F.lit(-1), F.lit(-1), F.lit(0), F.lit(0))) == 0.0
    hits = similarity.hybrid_search(docs.where("doc_id = 50"), docs, "doc_id", "text", 1, 0.0).collect()
    assert len(hits) == 1 and hits[0]["id"] == 1
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0])], "vec_id BIGINT, v ARRAY<DOUBLE>")
    assert {r["id"] for r in similarity.focus_projection(vecs.where("vec_id = 1"), vecs, "vec_id", "v").collect()} == {2}
    assert similarity.focus_projection(vecs.where("vec_id = 1"), vecs, "vec_id", "v", signed=True).count() == 0


@given(st.text(max_size=40), st.text(max_size=40))
def test_fingerprint_distance_is_symmetric(a, b):
    maker = similarity.Fingerprinter()
    x, y = (int.from_bytes(maker.of(t)) for t in (a, b))
    assert (x ^ y).bit_count() == (y ^ x).bit_count() and maker.of(a) == similarity.Fingerprinter().of(a)


def test_set_cosine_against_brute_force(spark):
    random.seed(3)
    sets = [[random.choice("abcdefghijklmnopqrst") for _ in range(random.choice([1, 2, 5, 9, 14]))] + ["hot"] for _ in range(120)] + [None, [], [None], ["hot"]]
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sets)], "i BIGINT, s ARRAY<STRING>, element STRING")
    plain = [{x for x in s or () if x} for s in sets]
    for floor in (0.1, 0.5, 0.8):
        want = {(a, b) for a in range(0, 124, 7) for b in range(124) if a != b and plain[a] and plain[b] and round(len(plain[a] & plain[b]) / math.sqrt(len(plain[a]) * len(plain[b])), 6) > floor}
        got = {(r["query_id"], r["id"]) for r in similarity.set_cosine(df.where("i % 7 = 0"), df, "i", "s", floor, None).collect()}
        assert got == want
    assert similarity.set_cosine(df.limit(0), df, "i", "s").count() == 0 == similarity.set_cosine(df, df.limit(0), "i", "s").count()


def test_structure_and_findings(spark):
    code = "import os\nimport spare\nfrom m import f as g\nclass A(B):\n    @deco(1)\n    def m(self, x: int, *a) -> str:\n        '''Doc.'''\n        self.n()\n        g()\n        return m\n    def n(self):\n        try:\n            self.n()\n        except:\n            pass\ndef free():\n    free()\n    print(1)\n"
    files = spark.createDataFrame([(1, "p/a.py", code), (2, "p/bad.py", "def ("), (3, "p/x.js", "export class Q {\n  run(a) {\n  }\n}\n"), (4, "p/n.py", None)], "file_id BIGINT, path STRING, content STRING")
    syms = {(r["name"], r["symbol_type"], r["class_name"], r["signature"]) for r in structure.python_symbols(files).collect()}
    assert ("m", "method", "A", "(self, x: int, *a) -> str") in syms and ("free", "function", None, "()") in syms and len(syms) == 4
    calls = {(r["caller"], r["callee"], r["call_type"]) for r in structure.python_calls(files).collect()}
    assert {("A.m", "A.n", "internal"), ("A.m", "m.f", "external"), ("A.n", "A.n", "internal"), ("free", "free", "recursive"), ("free", "builtins.print", "external"), ("A.m", "A.deco", "internal")} == calls
    found = {r["file_id"]: (r["found_classes"], r["found_functions"]) for r in structure.structure(files).collect()}
    assert found[3] == (["Q"], ["run"]) and found[1][0] == ["A"]
    assert {tuple(r) for r in findings.except_issues(structure.numbered_lines(files)).collect()} == {(1, 14, "bare_except")}
    assert [tuple(r) for r in findings.unused_imports(files).collect()] == [(1, "spare")]


def test_recipes(spark):
    text = "--- FILE: a.py ---\ncode here\n--- FILE: b.md ---\n# Title"
    assert [(k, b) for k, b, _ in recipes.segments_of(text)] == [("code", "code here"), ("documentation", "# Title")]
    assert [k for k, _, _ in recipes.segments_of("A long text before the script <script>var x = 1234567;</script> and a long text after")] == ["documentation", "code", "documentation"]
    assert recipes.segments_of(None) == [("documentation", "", 0)]
    log = spark.createDataFrame([(1, "INFO error\nwarn x\nFATAL boom\n")], "doc_id INT, text STRING")
    assert tuple(recipes.log_recipe(log, "doc_id", "text").first()) == (1, 1, 0, 1, 0, 1)
    assert packing_context.compacted({"user_id": None, "some": [], "longName": 1.239, "t": " x "}) == {"lon": 1.24, "t": "x"}
    bad = recipes.config_recipe(spark.createDataFrame([(1, "{"), (2, '{"a": [1, "b"]}')], "i INT, t STRING"), "i", "t").orderBy("i").collect()
    assert bad[0]["violation"] == "output_format" and bad[1]["n_keys"] == 1


def test_constant_stream_changes_at_most_once(spark):
    df = spark.createDataFrame([("g", i, "abcd") for i in range(20)], "g STRING, i INT, t STRING")
    assert packing_context.changes_in_entropy(df, ["g"], ["i"], "t").count() == 1


def test_adaptive_sample_keeps_ends(spark):
    df = spark.createDataFrame([(i, "abcdefgh"[: 1 + i % 8]) for i in range(200)], "i INT, t STRING")
    got = {r["i"] for r in packing_context.adaptive_sample(df, ["i"], "t").collect()}
    assert {0, 199} <= got and 10 <= len(got) <= 40


def test_telemetry(spark):
    rows = [("a", (None, -5.0, None, 3, None, None, None), "s"), ("b", None, None), ("c", ("run", 2.0, 1, None, None, False, None), "s")]
    df = spark.createDataFrame([("2025-01-01T00:00:00", e, d, s, None) for e, d, s in rows], "ts STRING, event STRING, data STRUCT<command: STRING, duration_sec: DOUBLE, files: INT, tokens_saved: INT, savings_pct: DOUBLE, success: BOOLEAN, mode: STRING>, session STRING, received_at TIMESTAMP")
    got = {r["command"]: (r["total_sec"], r["tokens_saved"], r["success_rate"]) for r in telemetry.by_command(df).collect()}
    assert got == {"unknown": (0.0, 3, 100.0), "run": (2.0, 0, 0.0)}


def test_patches_and_determinism(spark):
    df = spark.createDataFrame([(1, "a = b\na = b\n", "a = b", "c"), (2, "aaaa", "x", "y"), (3, "aaaa", "aaaa", "abcdefgh"), (4, None, "a", "b")], "i INT, content STRING, old STRING, new STRING")
    got = {r["i"]: (r["after"], r["safe"]) for r in findings.patch_score(df).collect()}
    assert got[1] == ("c\na = b\n", True) and got[2] == ("aaaa", True) and got[3] == ("abcdefgh", False) and got[4][0] is None
    assert findings.deterministic(df, df.orderBy(F.desc("i"))) and not findings.deterministic(df, df.limit(2))


def test_decisions_and_stat_changes(spark):
    calls = spark.createDataFrame([("f", f"c{i}", "t", "internal") for i in range(7)] + [("f", "d", "c0", "internal"), ("f", "x", "t", "external")], "file_id STRING, caller STRING, callee STRING, call_type STRING")
    radius = graph.blast_radius(calls, spark.createDataFrame([("f", "t")], "file_id STRING, start STRING"), ["file_id"])
    got = {r["node"]: (r["depth"], r["score"], r["category"]) for r in radius.collect()}
    assert got["t"] == (0, 1.0, "primary") and got["c0"] == (1, 0.75, "direct") and got["c1"] == (1, 0.675, "direct") and got["d"] == (2, 0.45, "indirect") and "x" not in got
    d = graph.context_decision(radius, ["file_id"], most=3).first()
    assert (d["analysed"], d["selected"], d["reaches"]) == (9, 3, True)
    old = spark.createDataFrame([("a", 1.0, 5), ("b", 1.0, 5), ("c", None, 5)], "p STRING, mtime DOUBLE, size INT")
    new = spark.createDataFrame([("a", 1.005, 5), ("b", 1.0, 6), ("d", 2.0, 1)], "p STRING, mtime DOUBLE, size INT")
    assert {tuple(r) for r in incremental.stat_changes(old, new, ["p"]).collect()} == {("a", "same"), ("b", "changed"), ("c", "removed"), ("d", "added")}
