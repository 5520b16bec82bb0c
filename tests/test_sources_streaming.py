import hashlib
import json
import shutil

import pytest

from seamstone.sources import checkpoints, exporters, scan
from seamstone.streaming import watch


def test_scan(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "pkg/a.py").write_text("# c\nx = 1\n")
    (tmp_path / "pkg/latin.py").write_bytes(b"\xff\xfe\xfd")
    (tmp_path / "pkg/skip.bin").write_text("no")
    (tmp_path / "node_modules/b.js").write_text("var a;")
    got = scan.scan_project(spark, str(tmp_path)).collect()
    assert [(r["path"], r["lines"], r["code_lines"]) for r in got] == [("pkg/a.py", 2, 1)]
    assert got[0]["hash"] == hashlib.sha256(b"# c\nx = 1\n").hexdigest()
    (tmp_path / "pkg/b.py").write_text("y = 2\n")
    assert [r["path"] for r in scan.scan_project(spark, str(tmp_path), max_files=1).collect()] == ["pkg/a.py"] and scan.scan_project(spark, str(tmp_path), pruned=("pkg",)).count() == 1
    (tmp_path / "pkg/b.py").unlink()
    assert {r["path"] for r in scan.stat_scan(spark, str(tmp_path)).collect()} == {"pkg/a.py", "pkg/latin.py"}
    kinds = spark.createDataFrame([("python", ".py"), ("node", "package.json"), ("node", ".js")], "type STRING, pattern STRING")
    assert scan.project_type(scan.hash_scan(spark, str(tmp_path)), kinds).first()["type"] == "python"


def test_events_and_counters(spark, tmp_path):
    lines = [{"ts": "2025-01-01T00:00:00", "event": "command", "data": {"files": 2, "tokens_saved": 5}, "session": "s"}] * 2
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n")
    assert scan.read_events(spark, str(tmp_path / "in")).count() == 2
    stream = watch.session_counters(watch.telemetry_stream(spark, str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counters").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("counters").collect()] == [("s", 2, 4, 10)]


def test_watch_diffs_batches(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a", "1"), ("b", "2")], "path STRING, hash STRING").coalesce(1).write.parquet(str(source))
    stream = lambda: spark.readStream.schema("path STRING, hash STRING").parquet(str(source))
    args = (str(tmp_path / "snap"), str(tmp_path / "out"), str(tmp_path / "check"), None)
    watch.watch(stream(), *args).awaitTermination(60)
    spark.createDataFrame([("b", "3"), ("c", "4")], "path STRING, hash STRING").coalesce(1).write.mode("append").parquet(str(source))
    watch.watch(stream(), *args).awaitTermination(60)
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/batch=1").collect()} == {("b", "changed"), ("c", "added")}
    assert spark.read.parquet(f"{tmp_path}/snap/1").count() == 3


def test_debounce_and_ladder(spark, tmp_path):
    source = tmp_path / "ev"
    spark.createDataFrame([("a", 0), ("a", 500_000), ("a", 1_200_000), ("b", 5)], "path STRING, at BIGINT").coalesce(1).write.parquet(str(source))
    q = watch.debounced(spark.readStream.schema("path STRING, at BIGINT").parquet(str(source))).writeStream.format("memory").queryName("kept").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(90)
    assert {tuple(r) for r in spark.table("kept").collect()} == {("a", 0), ("a", 1_200_000), ("b", 5)}


def test_feedback(spark):
    steps = [("a", [True, True]), ("b", [False]), ("c", [False, False]), ("d", [False] * 4), ("e", [False] * 5 + [True]), (None, [False])]
    rows = [(w, n, 1.0, ok) for w, some in steps for n, ok in enumerate(some)]
    df = spark.createDataFrame(rows, "weight STRING, seq INT, delta DOUBLE, stable BOOLEAN")
    got = {r["weight"]: (round(r["value"], 9), r["state"], r["heal_count"], r["code"]) for r in watch.feedback(df).collect()}
    assert got == {"a": (0.002, "STABLE", 0, 0), "b": (0.0, "WEAK", 0, 0), "c": (1e-6, "WEAK", 1, 1), "d": (3e-6, "WEAK", 3, 1), "e": (0.001003, "DEGENERATE", 3, -1)}
    poor = {r["weight"]: (r["state"], r["code"]) for r in watch.feedback(df, budget=1).collect()}
    assert poor["c"] == ("WEAK", 1) and poor["d"] == ("NEG_ZERO", -2) and watch.feedback(df.limit(0)).count() == 0


def test_watch_fails_on_a_lost_snapshot_and_shows_removals(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "0")], "path STRING, hash STRING").coalesce(1).write.parquet(str(source))
    stream = lambda: spark.readStream.schema("path STRING, hash STRING").parquet(str(source))
    args = (str(tmp_path / "snap"), str(tmp_path / "out"), str(tmp_path / "check"), None)
    watch.watch(stream(), *args).awaitTermination(60)
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/snap/0").collect()} == {("a", "1"), ("b", "2")}
    spark.createDataFrame([("c", "4")], "path STRING, hash STRING").coalesce(1).write.mode("append").parquet(str(source))
    watch.watch(stream(), *args, full=spark.createDataFrame([("a",), ("c",)], "path STRING")).awaitTermination(60)
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/batch=1").collect()} == {("b", "removed"), ("c", "added")}
    shutil.rmtree(tmp_path / "snap")
    spark.createDataFrame([("d", "5")], "path STRING, hash STRING").coalesce(1).write.mode("append").parquet(str(source))
    with pytest.raises(Exception):
        watch.watch(stream(), *args).awaitTermination(60)
    runs = spark.createDataFrame([("w", 1, True), ("w", 5, False), ("v", 7, True)], "name STRING, at INT, ok BOOLEAN")
    assert {tuple(r) for r in watch.retry_after(runs).collect()} == {("w", 305), ("v", 37)}


def test_tables_of_cut_lineage_can_be_released(spark):
    df = checkpoints.cut_lineage(spark.range(5))
    assert df.count() == 5 and len(df.inputFiles()) > 0
    checkpoints.release(df)
    with pytest.raises(Exception):
        spark.read.parquet(df._seamstone_folder).count()


def test_exporters(spark, tmp_path):
    files = spark.createDataFrame([("r", "a.py", ["B", "A", None, "A"], None)], "repo STRING, path STRING, classes ARRAY<STRING>, functions ARRAY<STRING>")
    assert exporters.render(files, "markdown").first()["body"] == "- **a.py**: A, B; "
    for style in exporters.LIMITS:
        assert exporters.render(files, style).count() == 1
    exporters.write_index(files.select("path"), str(tmp_path / "ix"), "path", 4)
    assert spark.read.parquet(str(tmp_path / "ix")).count() == 1
