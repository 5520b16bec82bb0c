import json

from seamstone.operators import context_tables
from seamstone.operators.nested import decode_record, dewey_nodes

RECORD = {
    "code_structure": [
        {"path": "a.py", "structure": {"classes": "One", "functions": ["f", None, "g"], "imports": None}},
        None,
        "b.py",
        {"path": "c.py", "classes": ["X"], "functions": []},
    ],
    "symbol_graph": {"symbols": [{"symbol": "f", "calls": {"symbol": "g"}, "called_by": ["h", {"symbol": "k"}]}, "lone"]},
}
WANT = {
    ("file", -1, 0, "a.py"), ("file", -1, 2, "b.py"), ("file", -1, 3, "c.py"), ("class", 0, 0, "One"), ("class", 3, 0, "X"), ("function", 0, 0, "f"), ("function", 0, 2, "g"),
    ("symbol", -1, 0, "f"), ("symbol", -1, 1, "lone"), ("calls", 0, 0, "g"), ("called_by", 0, 0, "h"), ("called_by", 0, 1, "k"),
}


def rows(spark, payloads):
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(payloads)], "context_id BIGINT, payload STRING, rel STRING")
    out = {}
    for r in context_tables.found_rows(df).collect():
        out.setdefault(r[0], set()).add(tuple(r[1:]))
    return out


def test_shapes_and_wrappings(spark):
    text = json.dumps(RECORD)
    got = rows(spark, [text, json.dumps(text), json.dumps({"bbc_context": RECORD}), json.dumps({"bbc_context": text}), json.dumps(RECORD | {"symbols": RECORD["symbol_graph"]["symbols"], "symbol_graph": None})])
    assert all(got[i] == WANT for i in range(5))


def test_unreadable_and_empty(spark):
    assert rows(spark, [None, "", "   ", "scan aborted", "[]", "3", "{}", "{} {}", '{"code_structure": [{"path": "a', '"[1]"', "[" * 100_000]) == {}
    assert rows(spark, []) == {}


def test_numbers_as_text_and_odd_sections(spark):
    got = rows(spark, [json.dumps({"code_structure": {"path": "only.py"}, "symbols": 7, "secrets_scan": []}), json.dumps({"code_structure": [[1, 2], {"path": 5}]})])
    assert got[0] == {("file", -1, 0, "only.py"), ("symbol", -1, 0, "7")}
    assert ("file", -1, 1, "5") in got[1]


def test_parent_is_a_truncated_label(spark):
    df = spark.createDataFrame([(1, json.dumps(RECORD))], "context_id BIGINT, payload STRING")
    made = context_tables.context_rows(df).collect()
    nodes = {r["node"] for r in made}
    assert all(r["parent"] == "" or (r["node"].startswith(r["parent"] + ".") and r["parent"] in nodes) for r in made)


def test_deep_record_does_not_recurse(spark):
    deep = "{" + '"a": {' * 300 + "}" * 301
    df = spark.createDataFrame([(1, deep)], "context_id BIGINT, payload STRING")
    assert dewey_nodes(df, "context_id", "payload").count() == 301


def test_decode_record():
    assert decode_record('﻿{"a": 1}') == {"a": 1}
    assert decode_record('{"a": 1') is None


def test_tables_have_typed_columns(spark):
    record = {"symbol_graph": {"symbols": [{"symbol": "f", "line": "12", "calls": [{"symbol": "g", "line": 3, "column": "x"}, "h"]}, {"symbol": "g", "line": None}]}}
    tables = context_tables.context_tables(spark.createDataFrame([(1, json.dumps(record))], "context_id BIGINT, payload STRING"))
    assert {(r["symbol"], r["line"]) for r in tables["symbol"].collect()} == {("f", 12), ("g", None)}
    assert [(r["val"], r["line"], r["column"], r["parent"]) for r in tables["calls"].orderBy("ix").collect()] == [("g", 3, None, tables["symbol"].where("val = 'f'").first()["node"]), ("h", None, None, tables["symbol"].where("val = 'f'").first()["node"])]
    assert set(tables) == {r.name for r in context_tables.RELATIONS} and tables["file"].count() == 0
