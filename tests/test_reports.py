import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamstone.functions import quality as Q
from seamstone.operators import findings, graph, impact, packing_context, recipes
from seamstone.sources import weights


def test_weights_are_kept(spark, tmp_path):
    path = str(tmp_path / "w")
    zero = weights.load_weights(spark, path)
    assert zero.count() == 9 and zero.where("value <> 0 OR state <> 'STABLE'").count() == 0
    weights.save_weights(zero.withColumn("value", F.col("i") + F.col("j") * 0.5), path)
    assert {(r["i"], r["j"]): r["value"] for r in weights.load_weights(spark, path).collect()}[2, 1] == 2.5


def test_matrices(spark):
    rows = [(i, j, float(v)) for i, r in enumerate([[2, 0, 1], [1, 3, 2], [1, 1, 2]]) for j, v in enumerate(r)]
    a = spark.createDataFrame(rows, "i INT, j INT, v DOUBLE")
    same = {(r["i"], r["j"]): r["v"] for r in Q.matmul(a, Q.identity(spark, 3)).collect()}
    assert {k: v for k, v in same.items() if v} == {(i, j): v for i, j, v in rows if v}
    full = np.array([[2.0, 0, 1], [1, 3, 2], [1, 1, 2]])
    cols = [[F.lit(float(v)) for v in r] for r in full]
    got = spark.range(1).select(F.array(*[c for r in Q.inverse(cols) for c in r]).alias("a"), Q.row_norm(cols).alias("n")).first()
    assert np.allclose(np.array(got["a"]).reshape(3, 3), np.linalg.inv(full)) and got["n"] == 6.0
    singular = [[F.lit(1.0)] * 3] * 3
    assert spark.range(1).select(Q.inverse(singular)[0][0].alias("x")).first()["x"] is None
    assert np.allclose(Q.pseudo_inverse(full), np.linalg.inv(full)) and np.allclose(Q.pseudo_inverse(np.ones((2, 2))), 0.25)


FILES = "repo STRING, path STRING, classes ARRAY<STRING>, functions ARRAY<STRING>, imports ARRAY<STRING>, lines INT, code_lines INT"


def test_semantic_pack(spark):
    rows = [("r", f"lib/sub/f{k}.py", ["A"], None, ["os", "sys", None], 9, 9) for k in range(3)] + [("r", "lib/sub/deep/x.py", [], [], ["os"], 5, 5), ("r", "y.py", None, ["f"], None, None, None), ("r", None, None, None, None, None, None), ("q", "lib/sub/z.py", [None], [], ["os", "os", "os"], 40, 20)]
    packed = packing_context.semantic_pack(spark.createDataFrame(rows, FILES), ["repo"])
    got = {(r["repo"], r["path"]): (r["packed_path"], r["imports"], r["refs"], r["collapsed"]) for r in packed.collect()}
    assert got["r", "lib/sub/f0.py"] == ("@a/f0.py", [], ["I0", "I1"], False) and got["r", "lib/sub/deep/x.py"] == ("@a/deep/x.py", [], [], True)
    assert got["r", "y.py"] == ("y.py", [], [], False) and got["q", "lib/sub/z.py"] == ("lib/sub/z.py", [], ["I0", "I0", "I0"], False) and len(got) == 6
    hard = packing_context.semantic_pack(spark.createDataFrame(rows, FILES), ["repo"], aggressive=True)
    assert {r["path"] for r in hard.where("collapsed").collect()} == {"lib/sub/deep/x.py", "lib/sub/z.py"}
    saved = {r["repo"]: r["savings_pct"] for r in packing_context.pack_savings(packed, ["repo"]).collect()}
    assert saved["r"] > 0
    assert packing_context.semantic_pack(spark.createDataFrame([], FILES), ["repo"]).count() == 0


def test_review_ranking(spark):
    files = spark.createDataFrame([("r", "a", 250), ("r", "b", 900), ("r", "c", 0), ("r", "d", None), ("q", "a", 10), ("q", "b", 20)], "repo STRING, path STRING, code_lines INT")
    critical = spark.createDataFrame([("q", "b"), ("q", "gone"), ("q", "b")], "repo STRING, path STRING")
    got = {(r["repo"], r["path"]): (r["score"], r["rank"]) for r in packing_context.review_ranking(files, critical, ["repo"]).collect()}
    assert got == {("r", "b"): (0.6, 1), ("r", "a"): (0.3, 2), ("q", "b"): (0.8, 1)}
    assert packing_context.review_ranking(files, critical.limit(0), ["repo"], "fallback").where("path = 'b' AND repo = 'r'").first()["score"] == 0.5


def test_impact(spark):
    deps = spark.createDataFrame([("r", "a", "t"), ("r", "b", "a"), ("r", "t", "b"), ("r", None, "t"), ("r", "a", "t")], "repo STRING, src STRING, dst STRING")
    files = spark.createDataFrame([("r", "a", ["AB"], None), ("r", "b", None, ["C", "D"]), ("r", "t", ["T"], []), *[("r", f"z{k}", None, None) for k in range(17)]], "repo STRING, path STRING, classes ARRAY<STRING>, functions ARRAY<STRING>")
    got = {r["start"]: r for r in impact.impact_report(deps, spark.createDataFrame([("r", "t"), ("r", "z1")], "repo STRING, start STRING"), files, ["repo"]).collect()}
    t = got["t"]
    assert (t["direct_count"], t["indirect_count"], t["total_affected"], t["impact_ratio"]) == (1, 1, 2, 0.1)
    assert t["chaos"] == pytest.approx(math.log2(5), abs=1e-6) and t["raw_state"] == "STABLE" and t["verdict"] == "SAFE_TO_CHANGE"
    assert (got["z1"]["total_affected"], got["z1"]["chaos"], got["z1"]["verdict"]) == (0, 0.0, "SAFE_TO_CHANGE")
    assert impact.impact_report(deps.limit(0), spark.createDataFrame([("r", "t")], "repo STRING, start STRING"), files.limit(0), ["repo"]).first()["verdict"] == "SAFE_TO_CHANGE"


def test_lookup_and_answers(spark):
    symbols = spark.createDataFrame([("r", "OpenFile", "b.py"), ("r", "openfile", "a.py"), ("r", "f", "c.py"), ("r", None, "d.py"), ("r", "x", None), ("q", "Open", "z.py")], "repo STRING, name STRING, file STRING")
    asked = [("r", "OPEN", 0.95), ("r", "nfil", 0.95), ("r", "f", 0.5), ("r", "", 0.95), ("r", None, 0.95), ("r", "fo", 0.95), ("q", "File", 0.9)]
    terms = spark.createDataFrame(asked, "repo STRING, term STRING, match_ratio DOUBLE")
    assert {(r["repo"], r["term"]): r["file"] for r in impact.find_symbols(terms, symbols, ["repo"]).collect()} == {("r", "OPEN"): "a.py", ("r", "nfil"): "a.py", ("r", "f"): "a.py"}
    got = {(r["repo"], r["term"]): (r["mode"], r["confidence"], r["answer"]) for r in impact.answers(terms, symbols, ["repo"]).collect()}
    assert got["r", "OPEN"] == ("strict", 0.95, "[OPEN] found in: a.py") and got["r", "f"] == ("relaxed", 0.5, None) and got["q", "File"] == ("strict", 0.0, impact.NOT_FOUND)
    assert impact.find_symbols(terms.limit(0), symbols, ["repo"]).count() == 0 == impact.find_symbols(terms, symbols.limit(0), ["repo"]).count()


def test_secret_findings(spark):
    text = 'x = 1\ntoken = "q7Zp2Mx4Lk9Tb3Vd8Rw5"\npassword: "aaaaaa1"\nmail me@example.org AKIA' + "Q7ZP2MX4LK9TB3VD" + "\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "i INT, t STRING")
    got = {(r["label"], r["line_number"], r["masked_value"]) for r in findings.secret_findings(df, "i", "t").collect()}
    assert got == {("token_assignment", 2, "toke****"), ("password_assignment", 3, "pass****"), ("email", 4, "me@e****"), ("cloud_key_id", 4, "AKIA****")}
    assert findings.secret_findings(df, "i", "t", least=1.01).count() == 0


def test_pipeline_degrades_by_segment(spark):
    bad = "--- FILE: a.py ---\nclass A:\n    pass\n--- FILE: b.md ---\n# My Comment\n"
    df = spark.createDataFrame([(1, bad), (2, "--- FILE: a.py ---\nclass A: # speculative\nimport os\n"), (3, "# Title\nplain words here"), (4, None), (5, "")], "i INT, t STRING")
    got = {r["i"]: (r["segments"], r["ok"], r["degraded"], r["status"]) for r in recipes.pipeline(df, "i", "t").collect()}
    assert got == {1: (2, 1, 1, "degraded"), 2: (1, 0, 1, "degraded"), 3: (1, 1, 0, "stable"), 4: (1, 1, 0, "stable"), 5: (1, 1, 0, "stable")}
    assert recipes.pipeline(df.limit(0), "i", "t").count() == 0
    assert recipes.validate(recipes.doc_results(df, "i", "t"), "i", "documentation", "soft").where("i = 1").first()["decision"] == "discard"
    lines = spark.createDataFrame([(1, "ok\n  Timeout reached\nFATAL " + "x" * 200)], "i INT, t STRING")
    assert [(r["pos"], len(r["anomaly"])) for r in recipes.log_anomalies(lines, "i", "t").orderBy("pos").collect()] == [(0, 15), (1, 120)]


def test_users_of_symbols(spark):
    symbols = spark.createDataFrame([("r", "a", "f"), ("r", "b", "f"), ("r", "a", "g"), ("r", "a", None)], "repo STRING, file STRING, name STRING")
    calls = spark.createDataFrame([("r", "a", "f"), ("r", "c", "K.f"), ("r", "d", "f"), ("r", "d", "f"), ("r", "a", "g"), ("r", "d", None)], "repo STRING, file STRING, callee STRING")
    assert {tuple(r) for r in graph.symbol_users(symbols, calls, ["repo"]).collect()} == {("r", "a", "f", 2), ("r", "b", "f", 3)}


def test_long_closures_are_compacted(spark):
    edges = spark.createDataFrame([("r", f"n{k:03}", f"n{k + 1:03}") for k in range(30)], "repo STRING, src STRING, dst STRING")
    start = spark.createDataFrame([("r", "n000")], "repo STRING, start STRING")
    assert {r["node"]: r["depth"] for r in graph.closure(edges, start, ["repo"]).collect()} == {f"n{k:03}": k for k in range(1, 31)}
    assert graph.closure(edges, start, ["repo"], 3, include_start=True).count() == 4
