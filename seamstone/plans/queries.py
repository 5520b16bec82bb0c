"""Registered queries of the core: name -> (spark, directory) -> DataFrame, and their SQL.

Names begin with the identifier of the operator they run.  Every query runs
over its whole tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamstone.functions import quality as Q
from seamstone.functions import text as T
from seamstone.operators import context_tables, findings, graph, incremental, packing_context, recipes, similarity, structure, telemetry
from seamstone.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL where there is one."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_files")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _elements(source: str, json: str, keys: str) -> str:
    """SQL: the elements of a JSON list (a lone value is a list of one) with their positions."""
    json = f"({json})"
    listed = f"CASE json_type({json}) WHEN 'ARRAY' THEN from_json({json}, '[\"JSON\"]') WHEN 'NULL' THEN [] ELSE [{json}] END"
    return f"(SELECT {keys}, unnest({listed}) AS e, generate_subscripts({listed}, 1) - 1 AS ix FROM {source} WHERE {json} IS NOT NULL)"


def _context_sql() -> str:
    value = lambda k: f"CASE json_type(e) WHEN 'OBJECT' THEN e ->> '$.{k}' ELSE e ->> '$' END"
    parts = ["SELECT context_id, 'file' AS rel, -1 AS parent_ix, ix, " + value("path") + " AS val FROM f", "SELECT context_id, 'symbol', -1, ix, " + value("symbol") + " FROM s"]
    for rel, key in (("class", "classes"), ("function", "functions"), ("import", "imports")):
        for at in (f"e -> '$.structure.{key}'", f"e -> '$.{key}'"):
            parts.append(f"SELECT context_id, '{rel}', parent_ix, ix, {value('name')} FROM " + _elements("f", at, "context_id, ix AS parent_ix"))
    for rel in ("calls", "called_by"):
        parts.append(f"SELECT context_id, '{rel}', parent_ix, ix, {value('symbol')} FROM " + _elements("s", f"e -> '$.{rel}'", "context_id, ix AS parent_ix"))
    kept = [re.sub(r" FROM (f|s)$", r" FROM \1 WHERE true", p) + " AND json_type(e) <> 'NULL'" if re.search(r" FROM (?:f|s)$", p) else p + " WHERE json_type(e) <> 'NULL'" for p in parts]
    return f"""WITH a AS (SELECT context_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM repo_contexts), b AS (SELECT context_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j ->> '$') THEN (j ->> '$')::JSON END ELSE j END AS j FROM a),
c AS (SELECT context_id, CASE WHEN json_type(j, '$.bbc_context') = 'OBJECT' THEN j -> '$.bbc_context' ELSE j END AS j FROM b WHERE json_type(j) = 'OBJECT'),
f AS {_elements("c", "j -> '$.code_structure'", "context_id")}, s1 AS {_elements("c", "j -> '$.symbol_graph.symbols'", "context_id")}, s2 AS {_elements("c", "j -> '$.symbols'", "context_id")}, s AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2)
SELECT context_id, rel, CAST(parent_ix AS INTEGER) AS parent_ix, CAST(ix AS INTEGER) AS ix, val FROM ({" UNION ALL ".join(kept)})"""


@query("p1_found", _context_sql())
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tables.found_rows(table(spark, sf_dir, "repo_contexts"))


@query("p1_tables")
def p1_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = context_tables.context_rows(table(spark, sf_dir, "repo_contexts"))
    return rows.groupBy("context_id", "rel").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("parent").alias("parents"))


_LINES = r"string_split_regex(content, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')"
_LINE_ROWS = rf"""
raw AS (SELECT file_id, {_LINES} AS parts FROM source_files WHERE content IS NOT NULL),
l AS (SELECT file_id, unnest(CASE WHEN parts[len(parts)] = '' THEN parts[:len(parts) - 1] ELSE parts END) AS line, unnest(range(1, len(CASE WHEN parts[len(parts)] = '' THEN parts[:len(parts) - 1] ELSE parts END) + 1)) AS n FROM raw)"""


@query("o03_content_hash", "SELECT file_id, sha256(content) = hash AS hash_ok FROM source_files")
def o03_content_hash(spark, sf_dir):
    return _files(spark, sf_dir).select("file_id", (F.sha2("content", 256) == F.col("hash")).alias("hash_ok"))


@query("o77_duplicate_texts", "SELECT sha256(text) AS text_hash, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def o77_duplicate_texts(spark, sf_dir):
    return _docs(spark, sf_dir).where(F.col("text").isNotNull()).groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(
    "o22_language",
    r"""SELECT file_id,
  CASE lower(regexp_extract(path, '\.([^./]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'pyw' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'java' THEN 'java' WHEN 'cs' THEN 'csharp'
    WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'cpp' THEN 'cpp' WHEN 'cc' THEN 'cpp' WHEN 'cxx' THEN 'cpp' WHEN 'hpp' THEN 'cpp' WHEN 'h' THEN 'cpp' WHEN 'php' THEN 'php' WHEN 'rb' THEN 'ruby' END AS by_path,
  CASE WHEN contains(content, '#include') THEN 'c_cpp' WHEN contains(content, 'public class') THEN 'java' WHEN contains(content, 'func ') AND contains(content, 'var ') THEN 'go' WHEN contains(content, 'fn ') THEN 'rust' ELSE 'python' END AS by_content
FROM source_files""",
)
def o22_language(spark, sf_dir):
    return _files(spark, sf_dir).select("file_id", T.language_of_path(F.col("path")).alias("by_path"), T.language_of_content(F.col("content")).alias("by_content"))


@query(
    "o23_line_metrics",
    rf"""WITH {_LINE_ROWS}
SELECT f.file_id, CAST(count(l.n) AS INTEGER) AS n_lines, CAST(count(CASE WHEN b <> '' AND NOT starts_with(b, '#') AND NOT starts_with(b, '//') AND NOT starts_with(b, '/*') AND NOT starts_with(b, '*') THEN 1 END) AS INTEGER) AS n_code
FROM source_files f LEFT JOIN (SELECT *, regexp_replace(line, '^\s+', '') AS b FROM l) l USING (file_id) WHERE f.content IS NOT NULL GROUP BY 1""",
)
def o23_line_metrics(spark, sf_dir):
    c = F.col("content")
    return _files(spark, sf_dir).where(c.isNotNull()).select("file_id", F.size(T.split_lines(c)).alias("n_lines"), T.code_lines(c).alias("n_code"))


@query(
    "o24_router",
    r"""SELECT doc_id, CASE WHEN ((starts_with(trim(text), '{') AND ends_with(trim(text), '}')) OR (starts_with(trim(text), '[') AND ends_with(trim(text), ']'))) AND NOT regexp_matches(upper(text), 'INFO|ERROR|WARN|DEBUG|TIMESTAMP|EXCEPTION') THEN 'config'
  WHEN regexp_matches(upper(text), 'INFO|ERROR|WARN|DEBUG|TIMESTAMP|EXCEPTION') THEN 'log'
  WHEN contains(upper(text), '<HTML') OR contains(upper(text), '<!DOCTYPE') OR contains(trim(text)[1:10], '# ') THEN 'documentation' ELSE 'code' END AS recipe FROM documents WHERE text IS NOT NULL""",
)
def o24_router(spark, sf_dir):
    return _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", T.route(F.col("text")).alias("recipe"))


@query(
    "o26_code_recipe",
    rf"""WITH {_LINE_ROWS} SELECT file_id, count(*) FILTER (contains(line, 'class ')) AS class_lines, count(*) FILTER (contains(line, 'def ')) AS def_lines, count(*) FILTER (contains(line, 'import ') OR contains(line, 'from ')) AS import_lines FROM l GROUP BY 1""",
)
def o26_code_recipe(spark, sf_dir):
    return recipes.code_recipe(_files(spark, sf_dir), "file_id", "content")


@query(
    "o27_log_recipe",
    r"""WITH p AS (SELECT doc_id, unnest(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')) AS line FROM documents), u AS (SELECT doc_id, upper(line) AS u FROM p),
k AS (SELECT doc_id, CASE WHEN contains(u, 'INFO') THEN 'INFO' WHEN contains(u, 'ERROR') THEN 'ERROR' WHEN contains(u, 'WARN') THEN 'WARNING' WHEN contains(u, 'DEBUG') THEN 'DEBUG' END AS level, regexp_matches(u, 'EXCEPTION|CRITICAL|FATAL|TIMEOUT') AS bad FROM u)
SELECT doc_id, count(*) FILTER (level = 'INFO') AS info, count(*) FILTER (level = 'ERROR') AS error, count(*) FILTER (level = 'WARNING') AS warning, count(*) FILTER (level = 'DEBUG') AS debug, count(*) FILTER (bad) AS anomalies FROM k GROUP BY 1""",
)
def o27_log_recipe(spark, sf_dir):
    return recipes.log_recipe(_docs(spark, sf_dir), "doc_id", "text")


@query("o28_json_shape", "SELECT event_id, CAST(len(json_keys(props)) AS INTEGER) AS n_keys, array_to_string(json_keys(props), ',') AS keys FROM events")
def o28_json_shape(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.size(F.json_object_keys("props")).alias("n_keys"), F.array_join(F.json_object_keys("props"), ",").alias("keys"))


@query("o28_config_recipe")
def o28_config_recipe(spark, sf_dir):
    return recipes.config_recipe(table(spark, sf_dir, "repo_contexts"), "context_id", "payload")


@query(
    "o29_doc_recipe",
    r"""WITH p AS (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS parts FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, list_filter(list_transform(parts, lambda x: trim(x)), lambda x: starts_with(x, '#') OR (starts_with(lower(x), '<h') AND contains(x, '>')))[1:20] AS hs FROM p)
SELECT doc_id, CAST(len(hs) AS INTEGER) AS n_headers, array_to_string(hs, '|') AS headers FROM h""",
)
def o29_doc_recipe(spark, sf_dir):
    return _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.size(T.headers(F.col("text"))).alias("n_headers"), F.array_join(T.headers(F.col("text")), "|").alias("headers"))


_ENTROPY = "(SELECT coalesce(round(-sum(n / t * log2(n / t)), 6), 0) FROM (SELECT count(*)::DOUBLE AS n, sum(count(*)) OVER ()::DOUBLE AS t FROM (SELECT unnest(string_split({0}, '')) AS c) GROUP BY c))"
_DOC_H = """chars AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents), cnt AS (SELECT doc_id, c, count(*)::DOUBLE AS n FROM chars GROUP BY ALL), tot AS (SELECT doc_id, sum(n) AS t FROM cnt GROUP BY 1),
h AS (SELECT doc_id, round(-sum(n / t * log2(n / t)), 6) AS h FROM cnt JOIN tot USING (doc_id) GROUP BY 1)"""


@query("o46_entropy", f"WITH {_DOC_H} SELECT doc_id, abs(h) AS h, CASE WHEN h <= 3 THEN 'STABLE' WHEN h <= 5 THEN 'WEAK' WHEN h <= 7 THEN 'UNSTABLE' ELSE 'DEGENERATE' END AS state FROM h")
def o46_entropy(spark, sf_dir):
    return _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.round(T.entropy(F.col("text")), 6).alias("h")).withColumn("h", F.abs("h")).withColumn("state", T.entropy_state(F.col("h")))


@query("o31_chaos_constraints", f"WITH {_DOC_H} SELECT doc_id, CASE WHEN h > 4.5 THEN 0.65 WHEN h < 2.5 THEN 0.95 ELSE 0.8 END::DOUBLE AS target, CASE WHEN h > 4.5 THEN 'soft' ELSE 'hard' END AS determinism FROM h")
def o31_chaos_constraints(spark, sf_dir):
    return recipes.tuned_constraints(_docs(spark, sf_dir).where("text IS NOT NULL"), "doc_id", "text")


@query("o30_constraints")
def o30_constraints(spark, sf_dir):
    return recipes.validate(recipes.doc_results(_docs(spark, sf_dir), "doc_id", "text"), "doc_id", "documentation")


@query("o33_savings", "SELECT source, sum(octet_length(encode(text))) AS raw_bytes, sum(octet_length(encode(text)) // 4) AS tokens FROM documents WHERE text IS NOT NULL GROUP BY 1")
def o33_savings(spark, sf_dir):
    return _docs(spark, sf_dir).where("text IS NOT NULL").groupBy("source").agg(F.sum(F.octet_length("text")).alias("raw_bytes"), F.sum(T.token_estimate(F.col("text"))).alias("tokens"))


@query("o39_token_estimate", "SELECT doc_id, octet_length(encode(text)) // 4 AS tokens FROM documents")
def o39_token_estimate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(
    "o35_speculative",
    "WITH p AS (SELECT unnest(["
    + ", ".join(f"'{p}'" for p in T.SPECULATIVE_LONG)
    + "]) AS pattern) SELECT doc_id, pattern FROM documents, p WHERE regexp_matches(lower(text), pattern)",
)
def o35_speculative(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(T.speculative(F.col("text"))).alias("pattern"))


@query("o38_balance", "SELECT file_id, len(replace(content, '{', '')) = len(replace(content, '}', '')) AS balanced FROM source_files WHERE content IS NOT NULL")
def o38_balance(spark, sf_dir):
    return _files(spark, sf_dir).where("content IS NOT NULL").select("file_id", T.balanced(F.col("content")).alias("balanced"))


def _re2(pattern: str) -> str:
    """A pattern as SQL text."""
    return pattern.replace("'", "''")


def _structure_sql() -> str:
    family = "CASE " + " ".join(f"WHEN ext = '{e}' THEN '{f}'" for e, f in structure.FAMILY.items()) + " ELSE 'python' END"
    case = lambda make: "CASE family " + " ".join(f"WHEN '{f}' THEN {make(p)}" for f, p in structure.PATTERNS.items()) + " END"
    found = lambda p: f"regexp_extract_all(content, '(?m){_re2(p)}', 1)"
    functions = lambda fns: " || ".join(f"list_filter({found(f)}, lambda x: x NOT IN ('if', 'for', 'while', 'switch', 'catch', 'with'))" if k == 2 else found(f) for k, f in enumerate(fns))
    return f"""WITH f AS (SELECT file_id, content, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext FROM source_files), g AS (SELECT file_id, content, {family} AS family FROM f)
SELECT file_id, family, array_to_string({case(lambda p: found(p[0]))}, ',') AS classes, array_to_string({case(lambda p: functions(p[1]))}, ',') AS functions, array_to_string({case(lambda p: found(p[2]))}, ',') AS imports FROM g WHERE content IS NOT NULL"""


@query("o19_structure", _structure_sql())
def o19_structure(spark, sf_dir):
    got = structure.structure(_files(spark, sf_dir).where("content IS NOT NULL").select("file_id", "path", "content"))
    return got.select("file_id", "family", *[F.array_join(f"found_{k}", ",").alias(k) for k in ("classes", "functions", "imports")])


@query("o20_python_symbols")
def o20_python_symbols(spark, sf_dir):
    return structure.python_symbols(_files(spark, sf_dir))


def _line_symbols_sql() -> str:
    kinds = (*structure.CLASS_KINDS, *structure.FUNCTION_KINDS)
    unicode = lambda p: p.replace(r"\w", r"[0-9A-Za-z_]")
    one = lambda k: "CASE lang " + " ".join(f"WHEN '{lang}' THEN nullif(regexp_extract(text, '{_re2(unicode(p[k]))}', 1), '')" for lang, p in structure.SYMBOL_PATTERNS.items() if k in p) + " END"
    named = ", ".join(f"{one(k)} AS k_{k}" for k in kinds)
    entries = ", ".join(f"{{'kind': '{k}', 'name': " + (f"CASE WHEN k_{k} NOT IN ('if', 'while', 'for', 'switch', 'catch') THEN k_{k} END" if k in structure.FUNCTION_KINDS else f"k_{k}") + "}" for k in kinds)
    languages = " ".join(f"WHEN '{e}' THEN '{lang}'" for e, lang in T.LANGUAGE_BY_EXTENSION.items())
    return f"""WITH f AS (SELECT file_id, CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) {languages} END AS lang, string_split(content, chr(10)) AS ls FROM source_files WHERE content IS NOT NULL),
l AS (SELECT file_id, lang, unnest(ls) AS text, generate_subscripts(ls, 1) AS line FROM f WHERE lang <> 'python'), n AS (SELECT file_id, line, text, {named} FROM l WHERE NOT regexp_matches(text, '^\\s*(//|#)')),
s AS (SELECT file_id, line, text, coalesce(k_trait, k_enum, k_interface, k_struct, k_class) AS own, list_filter([{entries}], lambda x: x.name IS NOT NULL) AS es FROM n), o AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS owner FROM s),
e AS (SELECT file_id, line, text, owner, unnest(es) AS e FROM o), t AS (SELECT file_id, e.name AS name, CASE WHEN e.kind IN ('class', 'struct', 'interface', 'enum', 'trait') THEN e.kind WHEN e.kind <> 'function' AND owner IS NOT NULL THEN 'method' ELSE 'function' END AS symbol_type, CAST(line AS INTEGER) AS line, CAST(instr(text, e.name) - 1 AS INTEGER) AS col_offset, owner FROM e)
SELECT file_id, name, symbol_type, line, col_offset, CASE WHEN symbol_type = 'method' THEN owner END AS class_name FROM t"""


@query("o21_symbols", _line_symbols_sql())
def o21_symbols(spark, sf_dir):
    return structure.line_symbols(_files(spark, sf_dir))


@query("o121_symbol_stats")
def o121_symbol_stats(spark, sf_dir):
    files = _files(spark, sf_dir)
    return structure.symbol_stats(structure.symbols(files), files)


@query("o40_python_imports")
def o40_python_imports(spark, sf_dir):
    return structure.python_imports(_files(spark, sf_dir))


@query("o41_python_calls")
def o41_python_calls(spark, sf_dir):
    return structure.python_calls(_files(spark, sf_dir))


@query("o122_call_graph")
def o122_call_graph(spark, sf_dir):
    _, calls = structure.call_graph(_files(spark, sf_dir), ["repo"])
    return calls.groupBy("repo", "caller", "callee", "resolved_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "o21_current_class",
    rf"""WITH {_LINE_ROWS}, s AS (SELECT l.file_id, n, line, nullif(regexp_extract(line, '^\s*(?:public\s+|export\s+)?class\s+(\w+)', 1), '') AS cls FROM l),
c AS (SELECT file_id, n, last_value(cls IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current_class FROM s)
SELECT file_id, current_class, count(*) AS n_lines FROM c WHERE current_class IS NOT NULL GROUP BY 1, 2""",
)
def o21_current_class(spark, sf_dir):
    lines = structure.numbered_lines(_files(spark, sf_dir))
    return structure.carried_class(lines).where("current_class IS NOT NULL").groupBy("file_id", "current_class").agg(F.count(F.lit(1)).alias("n_lines"))


_REFERENCED = r"""def AS (SELECT {i}, regexp_extract_all({t}, '(?m)^\s*(?:class|def|function|fn|func|struct)\s+([a-zA-Z_][a-zA-Z0-9_]*)', 1) AS a, list_filter(regexp_extract_all({t}, '\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\(', 1), lambda x: NOT list_contains({k}, x)) AS b, regexp_extract_all({t}, '\b([A-Z][a-zA-Z0-9_]*)\s*\(', 1) AS c,
list_filter(list_transform(flatten(list_transform(regexp_extract_all({t}, 'from[ \t]+\S+[ \t]+import[ \t]+([^\n]+)', 1), lambda x: string_split(x, ','))), lambda x: trim(string_split(trim(x), ' as ')[1])), lambda x: regexp_matches(x, '^[A-Za-z]')) AS d FROM {f} WHERE {t} IS NOT NULL), refs AS (SELECT {i}, list_distinct(a || b || c || d) AS names FROM def)"""
_KEYWORDS = "[" + ", ".join(f"'{k}'" for k in T.CALL_KEYWORDS) + "]"


def _referenced_sql(i: str, t: str, f: str) -> str:
    return _REFERENCED.replace("{i}", i).replace("{t}", t).replace("{f}", f).replace("{k}", _KEYWORDS)


@query("o34_referenced", f"WITH {_referenced_sql('file_id', 'content', 'source_files')} SELECT file_id, CAST(len(names) AS INTEGER) AS n_symbols, array_to_string(list_sort(names), ',') AS names FROM refs")
def o34_referenced(spark, sf_dir):
    return _files(spark, sf_dir).where("content IS NOT NULL").select("file_id", T.referenced_symbols(F.col("content")).alias("r")).select("file_id", F.size("r").alias("n_symbols"), F.array_join(F.array_sort("r"), ",").alias("names"))


@query("o36_unused_imports")
def o36_unused_imports(spark, sf_dir):
    return findings.unused_imports(_files(spark, sf_dir).where(F.col("path").endswith(".py")))


@query(
    "o37_except_issues",
    rf"""WITH {_LINE_ROWS}, w AS (SELECT l.file_id, n, line, lead(line) OVER (PARTITION BY l.file_id ORDER BY n) AS nx FROM l JOIN source_files f USING (file_id) WHERE f.path LIKE '%.py'),
a AS (SELECT file_id, CAST(n AS INTEGER) AS n, CASE WHEN regexp_matches(line, '^\s*except\s*:') THEN 'bare_except' WHEN regexp_matches(line, '^\s*except\b.*:\s*$') AND coalesce(regexp_matches(nx, '^\s*pass\s*$'), false) THEN 'silent_pass' END AS action FROM w) SELECT * FROM a WHERE action IS NOT NULL""",
)
def o37_except_issues(spark, sf_dir):
    return findings.except_issues(structure.numbered_lines(_files(spark, sf_dir).where(F.col("path").endswith(".py"))))


def _import_lines(spark, sf_dir):
    """Files with import lines written from the dependency table: (repo, path, imports)."""
    deps = table(spark, sf_dir, "file_deps").where("src IS NOT NULL")
    line = F.concat(F.lit("import "), F.regexp_replace(F.regexp_replace("dst", r"\.[^./]*$", ""), "/", "."))
    have = deps.groupBy("repo", F.col("src").alias("path")).agg(F.collect_set(line).alias("imports"))
    targets = deps.where("dst IS NOT NULL").select("repo", F.col("dst").alias("path")).distinct().join(have, ["repo", "path"], "left_anti")
    return have.unionByName(targets.withColumn("imports", F.array().cast("array<string>")))


_IMPORTED = r"""d AS (SELECT repo, src, dst FROM file_deps WHERE src IS NOT NULL), own AS (SELECT DISTINCT repo, path, regexp_replace(string_split(path, '/')[-1], '\.[^./]*$', '') AS stem FROM (SELECT repo, src AS path FROM d UNION ALL SELECT repo, dst FROM d WHERE dst IS NOT NULL)),
i AS (SELECT DISTINCT repo, src, string_split(replace(regexp_replace(dst, '\.[^./]*$', ''), '/', '.'), '.') AS parts FROM d WHERE dst IS NOT NULL)"""


@query("o45a_import_edges", f"WITH {_IMPORTED} SELECT DISTINCT repo, src, dst FROM (SELECT i.repo, i.src, i.parts, min(o.path) AS dst FROM i JOIN own o ON o.repo = i.repo AND o.stem = i.parts[-1] AND o.path <> i.src GROUP BY ALL)")
def o45a_import_edges(spark, sf_dir):
    return structure.import_edges(_import_lines(spark, sf_dir), ["repo"])


@query("o45b_import_edges", f"WITH {_IMPORTED}, p AS (SELECT DISTINCT repo, src, unnest(['import'] || parts) AS part FROM i) SELECT DISTINCT p.repo, p.src, o.path AS dst FROM p JOIN own o ON o.repo = p.repo AND o.stem = p.part WHERE part <> '' AND o.path <> p.src")
def o45b_import_edges(spark, sf_dir):
    lines = _import_lines(spark, sf_dir)
    return structure.import_edges_by_part(lines.withColumn("imports", F.transform("imports", lambda x: F.replace(x, F.lit(" "), F.lit(".")))), ["repo"])


@query("o45c_import_edges", f"WITH {_IMPORTED}, t AS (SELECT DISTINCT repo, src, unnest(list_transform(range(1, len(parts) + 1), lambda k: array_to_string(parts[k:], '.'))) AS tail FROM i) SELECT DISTINCT t.repo, t.src, o.path AS dst FROM t JOIN own o ON o.repo = t.repo AND o.stem = t.tail WHERE o.path <> t.src")
def o45c_import_edges(spark, sf_dir):
    return structure.import_edges_by_stem(_import_lines(spark, sf_dir), ["repo"])


@query("o45d_shared_files", "WITH h AS (SELECT DISTINCT repo, name, file FROM code_symbols WHERE name IS NOT NULL AND file IS NOT NULL) SELECT repo, name, file, min(file) OVER w AS representative, count(*) OVER w - 1 AS others FROM h WINDOW w AS (PARTITION BY repo, name) QUALIFY count(*) OVER w > 1")
def o45d_shared_files(spark, sf_dir):
    return structure.shared_symbol_files(table(spark, sf_dir, "code_symbols"), ["repo"])


@query(
    "o45e_resolve_calls",
    """WITH s AS (SELECT DISTINCT file_id, CASE WHEN class_name IS NOT NULL THEN class_name || '.' || name ELSE name END AS full_name FROM code_symbols WHERE name IS NOT NULL)
SELECT c.file_id, c.line, c.col_offset, c.caller, c.callee, CASE WHEN c.call_type = 'internal' AND k.full_name IS NULL THEN 'unknown' ELSE c.call_type END AS resolved_type, count(*) AS n
FROM call_edges c JOIN s ON s.file_id = c.file_id AND s.full_name = c.caller LEFT JOIN s k ON k.file_id = c.file_id AND k.full_name = c.callee GROUP BY ALL""",
)
def o45e_resolve_calls(spark, sf_dir):
    s = table(spark, sf_dir, "code_symbols").where("name IS NOT NULL").select("file_id", F.when(F.col("class_name").isNotNull(), F.concat("class_name", F.lit("."), "name")).otherwise(F.col("name")).alias("full_name"))
    return structure.resolve_calls(table(spark, sf_dir, "call_edges"), s, ["file_id"]).groupBy("file_id", "line", "col_offset", "caller", "callee", "resolved_type").agg(F.count(F.lit(1)).alias("n"))


@query("o45f_called_by", "SELECT file_id, callee, count(DISTINCT caller) AS callers FROM call_edges WHERE callee IS NOT NULL AND call_type IN ('internal', 'recursive') GROUP BY 1, 2")
def o45f_called_by(spark, sf_dir):
    return table(spark, sf_dir, "call_edges").where("callee IS NOT NULL AND call_type IN ('internal', 'recursive')").groupBy("file_id", "callee").agg(F.countDistinct("caller").alias("callers"))


@query("o44_find_symbol", "SELECT repo, lower(name) AS name, min({'k': CASE WHEN symbol_type = 'class' THEN 0 ELSE 1 END, 'file': file, 'line': line}).file AS file FROM code_symbols WHERE name IS NOT NULL GROUP BY 1, 2")
def o44_find_symbol(spark, sf_dir):
    pick = F.min(F.struct(F.when(F.col("symbol_type") == "class", 0).otherwise(1).alias("k"), "file", "line"))
    return table(spark, sf_dir, "code_symbols").where("name IS NOT NULL").groupBy("repo", F.lower("name").alias("name")).agg(pick.getField("file").alias("file"))


@query("o47_corpus_metrics", "SELECT count(*) AS n_files, sum(lines) AS n_lines, sum(code_lines) AS n_code, sum(size) AS n_chars, 250 * count(*) + 500 AS context_bytes, round(1 - (250 * count(*) + 500) / sum(size)::DOUBLE, 2) AS ratio FROM source_files")
def o47_corpus_metrics(spark, sf_dir):
    n = F.count(F.lit(1))
    return _files(spark, sf_dir).agg(n.alias("n_files"), F.sum("lines").alias("n_lines"), F.sum("code_lines").alias("n_code"), F.sum("size").alias("n_chars"), (250 * n + 500).alias("context_bytes"), F.round(1 - (250 * n + 500) / F.sum("size"), 2).alias("ratio"))


@query("o48_scan_report", r"SELECT lower(regexp_extract(path, '\.([^./]+)$', 1)) AS ext, count(*) AS n, sum(size) AS chars FROM source_files GROUP BY 1")
def o48_scan_report(spark, sf_dir):
    return _files(spark, sf_dir).groupBy(T.extension(F.col("path")).alias("ext")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("chars"))


@query("o49_graph_stats", "SELECT repo, count(*) AS total, count(*) FILTER (call_type = 'internal') AS internal, count(*) FILTER (call_type = 'external') AS external, count(*) FILTER (call_type = 'recursive') AS recursive_calls, count(*) FILTER (call_type = 'unknown') AS unknown FROM call_edges GROUP BY 1")
def o49_graph_stats(spark, sf_dir):
    n = lambda k: F.count_if(F.col("call_type") == k)
    return table(spark, sf_dir, "call_edges").groupBy("repo").agg(F.count(F.lit(1)).alias("total"), n("internal").alias("internal"), n("external").alias("external"), n("recursive").alias("recursive_calls"), n("unknown").alias("unknown"))


_EDGES = "e AS (SELECT DISTINCT repo, src, dst FROM file_deps WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst)"


def _deps(spark, sf_dir):
    return graph.edges_of(table(spark, sf_dir, "file_deps"), "src", "dst", ["repo"])


@query("o50_degrees", f"WITH {_EDGES}, n AS (SELECT repo, src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT repo, dst, 1, 0 FROM e) SELECT repo, node, sum(i)::BIGINT AS indegree, sum(o)::BIGINT AS outdegree, count(*) AS total FROM n GROUP BY 1, 2")
def o50_degrees(spark, sf_dir):
    return graph.degrees(_deps(spark, sf_dir), ["repo"])


@query("o86_transpose", f"WITH {_EDGES} SELECT repo, dst AS src, src AS dst FROM e")
def o86_transpose(spark, sf_dir):
    return graph.transpose(_deps(spark, sf_dir)).select("repo", "src", "dst")


#: Targets of the graph queries: the most depended-on file of every repository.
_HUBS = f"{_EDGES}, hubs AS (SELECT repo, dst AS start FROM (SELECT repo, dst, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, dst) AS r FROM e GROUP BY 1, 2) WHERE r = 1)"


def _hubs(spark, sf_dir):
    per = _deps(spark, sf_dir).groupBy("repo", "dst").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("repo").agg(F.min(F.struct((-F.col("n")).alias("n"), "dst")).alias("m")).select("repo", F.col("m.dst").alias("start"))


#: By key, so that a node is met once, at its least depth; ends where nothing new is found.
_CLOSURE = "reach(repo, start, node, depth) USING KEY (repo, start, node) AS (SELECT repo, start, start, 0 FROM hubs UNION SELECT r.repo, r.start, {to}, min(r.depth) + 1 FROM reach r JOIN e ON e.repo = r.repo AND {on} WHERE NOT EXISTS (SELECT 1 FROM recurring.reach k WHERE k.repo = r.repo AND k.start = r.start AND k.node = {to}){more} GROUP BY 1, 2, 3)"


@query("o78_dependents", f"WITH RECURSIVE {_HUBS}, {_CLOSURE.format(to='e.src', on='e.dst = r.node', more='')} SELECT repo, start, node, depth FROM reach WHERE depth > 0")
def o78_dependents(spark, sf_dir):
    return graph.closure(graph.transpose(_deps(spark, sf_dir)), _hubs(spark, sf_dir), ["repo"])


@query("o83_dependencies", f"WITH RECURSIVE {_HUBS}, {_CLOSURE.format(to='e.dst', on='e.src = r.node', more='')} SELECT repo, start, node, depth FROM reach WHERE depth > 0")
def o83_dependencies(spark, sf_dir):
    return graph.closure(_deps(spark, sf_dir), _hubs(spark, sf_dir), ["repo"])


@query(
    "o79_call_radius",
    """WITH RECURSIVE ce AS (SELECT DISTINCT file_id, caller AS src, callee AS dst FROM call_edges WHERE call_type IN ('internal', 'recursive') AND callee IS NOT NULL AND caller IS NOT NULL AND caller <> callee), t AS (SELECT DISTINCT file_id, dst AS start FROM ce),
reach(file_id, start, node, depth) USING KEY (file_id, start, node) AS (SELECT file_id, start, start, 0 FROM t UNION SELECT r.file_id, r.start, ce.src, min(r.depth) + 1 FROM reach r JOIN ce ON ce.file_id = r.file_id AND ce.dst = r.node WHERE NOT EXISTS (SELECT 1 FROM recurring.reach k WHERE k.file_id = r.file_id AND k.start = r.start AND k.node = ce.src) GROUP BY 1, 2, 3),
d AS (SELECT file_id, callee AS start, count(*) AS direct_calls FROM call_edges WHERE call_type IN ('internal', 'recursive') AND callee IS NOT NULL AND caller IS NOT NULL AND caller <> callee GROUP BY 1, 2)
SELECT t.file_id, t.start, any_value(direct_calls) AS direct_calls, count(r.node) AS total FROM t JOIN d USING (file_id, start) LEFT JOIN reach r ON r.file_id = t.file_id AND r.start = t.start AND r.depth > 0 GROUP BY 1, 2""",
)
def o79_call_radius(spark, sf_dir):
    return graph.call_radius(table(spark, sf_dir, "call_edges"), ["file_id"])


@query(
    "o85_k_hop",
    f"WITH RECURSIVE {_HUBS}, b AS (SELECT repo, src, dst FROM e UNION SELECT repo, dst, src FROM e), reach AS (SELECT repo, start, start AS node, 0 AS depth FROM hubs UNION SELECT r.repo, r.start, b.dst, r.depth + 1 FROM reach r JOIN b ON b.repo = r.repo AND b.src = r.node WHERE r.depth < 2) SELECT repo, start, node, min(depth) AS depth FROM reach GROUP BY ALL HAVING min(depth) > 0",
)
def o85_k_hop(spark, sf_dir):
    return graph.neighbourhood(_deps(spark, sf_dir), _hubs(spark, sf_dir), 2, ["repo"])


#: A node reaches a cycle if it reaches a node that reaches itself; levels of the others are the longest ways down.
_LEVELS = f"""WITH RECURSIVE {_EDGES}, n AS (SELECT repo, src AS node FROM e UNION SELECT repo, dst FROM e),
reach(repo, start, node) AS (SELECT repo, src, dst FROM e UNION SELECT r.repo, r.start, e.dst FROM reach r JOIN e ON e.repo = r.repo AND e.src = r.node), bad AS (SELECT repo, start AS node FROM reach WHERE start = node), stuck AS (SELECT repo, node FROM bad UNION SELECT r.repo, r.start FROM reach r JOIN bad b ON b.repo = r.repo AND b.node = r.node),
free AS (SELECT * FROM n ANTI JOIN stuck USING (repo, node)), up(repo, node, level) AS (SELECT repo, node, 0 FROM free ANTI JOIN e ON e.repo = free.repo AND e.src = free.node UNION SELECT f.repo, f.node, u.level + 1 FROM up u JOIN e ON e.repo = u.repo AND e.dst = u.node JOIN free f ON f.repo = e.repo AND f.node = e.src), lv AS (SELECT n.repo, n.node, max(up.level) AS level FROM n LEFT JOIN up USING (repo, node) GROUP BY 1, 2)"""


@query("o70_levels", _LEVELS + " SELECT * FROM lv")
def o70_levels(spark, sf_dir):
    return graph.levels(_deps(spark, sf_dir), ["repo"])


_CALLS = "ce AS (SELECT DISTINCT file_id, caller AS src, callee AS dst FROM call_edges WHERE call_type IN ('internal', 'recursive') AND callee IS NOT NULL AND caller IS NOT NULL AND caller <> callee), callhubs AS (SELECT file_id, dst AS start FROM (SELECT file_id, dst, row_number() OVER (PARTITION BY file_id ORDER BY count(*) DESC, dst) AS r FROM ce GROUP BY 1, 2) WHERE r = 1)"


@query(
    "o80_blast_radius",
    f"""WITH RECURSIVE {_CALLS}, reach AS (SELECT file_id, start, start AS node, 0 AS depth FROM callhubs UNION SELECT r.file_id, r.start, ce.src, r.depth + 1 FROM reach r JOIN ce ON ce.file_id = r.file_id AND ce.dst = r.node WHERE r.depth < 5),
best AS (SELECT file_id, start, node, min(depth) AS depth FROM reach GROUP BY ALL), cl AS (SELECT file_id, dst AS node, count(*) AS callers FROM ce GROUP BY 1, 2),
sc AS (SELECT b.*, coalesce(callers, 0) AS callers, round(least(1.0, [1.0, 0.75, 0.5, 0.25][least(depth, 3) + 1]::DOUBLE * CASE WHEN coalesce(callers, 0) > 5 THEN 1.1 WHEN coalesce(callers, 0) = 0 AND depth > 0 THEN 0.9 ELSE 1.0 END::DOUBLE), 4) AS score FROM best b LEFT JOIN cl USING (file_id, node))
SELECT *, CASE WHEN score >= 0.85 THEN 'primary' WHEN score >= 0.60 THEN 'direct' WHEN score >= 0.35 THEN 'indirect' ELSE 'ignored' END AS category FROM sc""",
)
def o80_blast_radius(spark, sf_dir):
    calls = table(spark, sf_dir, "call_edges")
    inside = graph.edges_of(calls.where("call_type IN ('internal', 'recursive')"), "caller", "callee", ["file_id"])
    per = inside.groupBy("file_id", "dst").agg(F.count(F.lit(1)).alias("n"))
    targets = per.groupBy("file_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "dst")).alias("m")).select("file_id", F.col("m.dst").alias("start"))
    return graph.blast_radius(calls, targets, ["file_id"])




@query(
    "o82_resolver",
    """WITH ce2 AS (SELECT DISTINCT repo, caller, callee FROM call_edges WHERE caller IS NOT NULL AND callee IS NOT NULL AND caller <> callee),
nd AS (SELECT repo, node, sum(i)::DOUBLE AS i, count(*)::DOUBLE AS t FROM (SELECT repo, caller AS node, 0 AS i FROM ce2 UNION ALL SELECT repo, callee, 1 FROM ce2) GROUP BY 1, 2),
s AS (SELECT repo, string_split(node, '.')[-1] AS short, node, 2.0::DOUBLE * i + 0.5::DOUBLE * t AS score FROM nd),
w AS (SELECT s.* FROM s SEMI JOIN code_symbols c ON c.repo = s.repo AND c.name = s.short),
r AS (SELECT *, row_number() OVER (PARTITION BY repo, short ORDER BY score DESC, node) AS r, count(*) OVER (PARTITION BY repo, short) AS candidates FROM w)
SELECT a.repo, a.short, a.node, a.candidates, a.score, coalesce(b.score > 0, false) AND coalesce(a.score - b.score < 1.0, false) AS ambiguous FROM r a LEFT JOIN r b ON a.repo = b.repo AND a.short = b.short AND b.r = 2 WHERE a.r = 1""",
)
def o82_resolver(spark, sf_dir):
    nodes = graph.degrees(graph.edges_of(table(spark, sf_dir, "call_edges"), "caller", "callee", ["repo"]), ["repo"])
    return graph.resolve_short(nodes, table(spark, sf_dir, "code_symbols").select("repo", F.col("name").alias("short")), ["repo"])


@query("o51_word_frequency", r"WITH w AS (SELECT unnest(string_split_regex(lower(text), '[\s\x{a0}\x{85}\x{1c}\x{1d}\x{1e}\x{1f}]+')) AS word FROM documents) SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY 1")
def o51_word_frequency(spark, sf_dir):
    return _docs(spark, sf_dir).select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("o52_shared_imports", "SELECT value, count(*) AS n FROM (SELECT DISTINCT file_id, unnest(imports) AS value FROM source_files) WHERE value IS NOT NULL AND value <> '' GROUP BY 1 HAVING count(*) >= 3")
def o52_shared_imports(spark, sf_dir):
    return packing_context.shared_values(_files(spark, sf_dir), "file_id", "imports")


@query("o53_path_prefixes", "WITH p AS (SELECT string_split(path, '/') AS a FROM source_files WHERE path IS NOT NULL), q AS (SELECT unnest(list_transform(range(1, len(a)), lambda i: array_to_string(a[1:i], '/'))) AS prefix FROM p) SELECT prefix, count(*) AS n FROM q GROUP BY 1 HAVING count(*) >= 3")
def o53_path_prefixes(spark, sf_dir):
    return packing_context.path_prefixes(_files(spark, sf_dir), "path")


@query("o54_dependency_summary", "SELECT repo, dst AS node, count(*) AS n, CAST(row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, dst) AS INTEGER) AS rank FROM (SELECT DISTINCT repo, src, dst FROM file_deps WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst) GROUP BY 1, 2 QUALIFY rank <= 5")
def o54_dependency_summary(spark, sf_dir):
    return packing_context.dependency_summary(_deps(spark, sf_dir), ["repo"])


@query(
    "o55_telemetry_summary",
    """SELECT coalesce(data.command, 'unknown') AS command, count(*) AS count, round(sum(greatest(coalesce(data.duration_sec, 0), 0)), 3) AS total_sec, round(sum(greatest(coalesce(data.duration_sec, 0), 0)) / count(*), 3) AS avg_sec, sum(coalesce(data.tokens_saved, 0))::BIGINT AS tokens_saved,
sum(coalesce(data.files, 0))::BIGINT AS files, round(count(*) FILTER (coalesce(data.success, true)) * 100.0::DOUBLE / count(*), 1) AS success_rate FROM telemetry WHERE data IS NOT NULL GROUP BY 1""",
)
def o55_telemetry_summary(spark, sf_dir):
    return telemetry.by_command(table(spark, sf_dir, "telemetry"))


@query("o111_session_counters", "SELECT session, count(*) AS events, sum(coalesce(data.files, 0))::BIGINT AS files, sum(coalesce(data.tokens_saved, 0))::BIGINT AS tokens_saved, max({'a': received_at, 'b': event}).b AS last_event FROM telemetry WHERE session IS NOT NULL GROUP BY 1")
def o111_session_counters(spark, sf_dir):
    return telemetry.by_session(table(spark, sf_dir, "telemetry"))


@query("o09_recent_events", "SELECT received_at, ts, event, data.command AS command, session FROM telemetry WHERE data IS NOT NULL ORDER BY received_at DESC NULLS LAST, ts ASC NULLS FIRST, event ASC NULLS FIRST, command ASC NULLS FIRST, session ASC NULLS FIRST LIMIT 500")
def o09_recent_events(spark, sf_dir):
    return telemetry.recent(table(spark, sf_dir, "telemetry"), 500)


@query(
    "o110_debounce",
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 3 HOUR THEN 0 ELSE 1 END AS b FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM g GROUP BY user_id, k""",
)
def o110_debounce(spark, sf_dir):
    return telemetry.quiet_periods(table(spark, sf_dir, "events"), "user_id", "ts", "3 hours")


def _snapshots(spark, sf_dir):
    files = _files(spark, sf_dir).select("repo", "path", "scanned_at", "file_id", "hash")
    keys, order = ["repo", "path"], ["scanned_at", "file_id"]
    half = F.lit("2025-07-01").cast("timestamp_ntz")
    return incremental.latest(files.where(F.col("scanned_at") < half), keys, order), incremental.latest(files, keys, order)


_SNAP = """s AS (SELECT repo, path, scanned_at, file_id, hash FROM source_files), old AS (SELECT * FROM s WHERE scanned_at < TIMESTAMP '2025-07-01' QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY scanned_at DESC, file_id DESC) = 1), new AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY scanned_at DESC NULLS LAST, file_id DESC) = 1),
d AS (SELECT repo, path, CASE WHEN o.file_id IS NULL THEN 'added' WHEN n.file_id IS NULL THEN 'removed' WHEN o.hash IS DISTINCT FROM n.hash THEN 'changed' ELSE 'same' END AS change FROM old o FULL JOIN new n USING (repo, path))"""


@query("o71_snapshot_diff", f"WITH {_SNAP} SELECT * FROM d")
def o71_snapshot_diff(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return incremental.diff(old, new, ["repo", "path"])


@query(
    "o56_staleness",
    f"WITH {_SNAP}, a AS (SELECT count(*) FILTER (change <> 'added') AS total_files, count(*) FILTER (change IN ('changed', 'removed')) AS stale_files, count(*) FILTER (change = 'added') AS new_files FROM d), b AS (SELECT *, round(coalesce(stale_files / nullif(total_files, 0)::DOUBLE, 0), 3) AS stale_ratio FROM a) SELECT *, CASE WHEN stale_ratio > 0.1 THEN 'RESCAN' WHEN stale_ratio = 0 THEN 'OK' ELSE 'PARTIAL_RESCAN' END AS recommendation FROM b",
)
def o56_staleness(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return incremental.staleness(incremental.diff(old, new, ["repo", "path"]))


@query("o72_merge", f"WITH {_SNAP} SELECT repo, path, file_id, hash FROM old WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.repo = old.repo AND n.path = old.path) UNION ALL SELECT repo, path, file_id, hash FROM new")
def o72_merge(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    cols = ["repo", "path", "file_id", "hash"]
    return incremental.merge(old.select(cols), new.select(cols), old.select("repo", "path").limit(0), ["repo", "path"])


@query("o118_verify_hash", f"WITH {_SNAP} SELECT o.repo, o.path, coalesce(o.hash = n.hash, false) AS fresh FROM old o LEFT JOIN new n USING (repo, path)")
def o118_verify_hash(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return incremental.verify_hash(new, old, ["repo", "path"])


@query(
    "o73_symbol_drift",
    "WITH a AS (SELECT DISTINCT file_id, unnest(functions) AS name FROM source_files), b AS (SELECT DISTINCT file_id, name FROM code_symbols WHERE symbol_type IN ('function', 'method')) SELECT file_id, name, CASE WHEN b.name IS NULL THEN 'only_left' ELSE 'only_right' END AS side FROM (SELECT * FROM a WHERE name IS NOT NULL) a FULL JOIN (SELECT *, name AS k FROM b WHERE name IS NOT NULL) b USING (file_id, name) WHERE b.k IS NULL OR a.file_id IS NULL".replace("CASE WHEN b.name IS NULL", "CASE WHEN b.k IS NULL").replace("a.file_id IS NULL", "a.k IS NULL").replace("SELECT * FROM a WHERE name", "SELECT *, name AS k FROM a WHERE name"),
)
def o73_symbol_drift(spark, sf_dir):
    a = _files(spark, sf_dir).select("file_id", F.explode("functions").alias("name"))
    b = table(spark, sf_dir, "code_symbols").where("symbol_type IN ('function', 'method')")
    return incremental.set_difference(a, b, ["file_id"], "name")


@query("o74_match_ratio", f"WITH {_referenced_sql('doc_id', 'text', 'documents')}, e AS (SELECT doc_id, unnest(names) AS name FROM refs), k AS (SELECT DISTINCT name FROM code_symbols WHERE name IS NOT NULL) SELECT doc_id, count(*) AS referenced, count(k.name) AS matched, round(count(k.name) / count(*)::DOUBLE, 3) AS match_ratio FROM e LEFT JOIN k USING (name) GROUP BY 1")
def o74_match_ratio(spark, sf_dir):
    return findings.symbol_match(_docs(spark, sf_dir).where("text IS NOT NULL"), "doc_id", table(spark, sf_dir, "code_symbols"), "text")


@query(
    "o60_entropy_changes",
    f"WITH {_DOC_H}, k AS (SELECT d.repo, d.doc_id, coalesce(abs(h.h), 0) AS h FROM documents d LEFT JOIN h USING (doc_id)), w AS (SELECT *, round(abs(h - coalesce(lag(h) OVER (PARTITION BY repo ORDER BY doc_id), 0)), 6) AS delta FROM k) SELECT repo, doc_id, h, delta FROM w WHERE delta > 0.4",
)
def o60_entropy_changes(spark, sf_dir):
    return packing_context.changes_in_entropy(_docs(spark, sf_dir), ["repo"], ["doc_id"], "text")


@query(
    "o61_chunk_weights",
    f"WITH {_DOC_H}, k AS (SELECT d.repo, d.doc_id, coalesce(abs(h.h), 0) AS h, row_number() OVER (PARTITION BY repo ORDER BY doc_id) AS o, count(*) OVER (PARTITION BY repo) AS c FROM documents d LEFT JOIN h USING (doc_id)), p AS (SELECT repo, (o - 1) // greatest(1, c // 10) AS chunk, count(*) AS n, round(avg(h), 4) AS h FROM k WHERE repo IS NOT NULL GROUP BY 1, 2) SELECT repo, chunk, n, h, round(CASE WHEN max(h) OVER (PARTITION BY repo) > 0 THEN h / max(h) OVER (PARTITION BY repo) ELSE 0 END, 3) AS weight FROM p",
)
def o61_chunk_weights(spark, sf_dir):
    return packing_context.chunk_weights(_docs(spark, sf_dir), ["repo"], ["doc_id"], "text")


_SAMPLE = f"""WITH RECURSIVE {_DOC_H}, d AS (SELECT doc_id, coalesce(abs(h.h), 0) AS h, row_number() OVER (ORDER BY doc_id) AS pos, count(*) OVER () AS n FROM documents LEFT JOIN h USING (doc_id)), z AS (SELECT *, greatest(1, n // 10) AS size FROM d),
c AS (SELECT (pos - 1) // size AS c, count(*) AS k, avg(h) AS h FROM z GROUP BY 1), m AS (SELECT max(h) AS most, sum(k) AS total FROM c),
w AS (SELECT c, k, h, h / CASE WHEN most = 0 THEN 1 ELSE most END AS w, lag(h, 1, 0) OVER (ORDER BY c) AS before FROM c, m), v AS (SELECT c, k, (CASE WHEN abs(h - before) > 0.4 THEN least(1.5::DOUBLE * w, 1) ELSE w END) * CASE WHEN h > 7 THEN 0.3::DOUBLE WHEN h > 5 THEN 0.6::DOUBLE ELSE 1 END AS w FROM w),
f(c, take, budget) AS (SELECT -1::BIGINT, 0::BIGINT, greatest(1, (total * 0.1::DOUBLE)::BIGINT) FROM m UNION ALL SELECT g.c, g.take, g.budget - g.take FROM (SELECT v.c, f.budget, CASE WHEN x <= 0 THEN 0 ELSE least(f.budget, ceil(v.k / greatest(1, v.k // greatest(x, 1))::DOUBLE)::BIGINT) END AS take FROM f JOIN v ON v.c = f.c + 1, LATERAL (SELECT least(greatest(1, round_even(v.k * v.w * 0.1::DOUBLE * 2, 0)::BIGINT), f.budget, v.k) AS x)) g),
s AS (SELECT f.c, take, CASE WHEN take > 0 THEN greatest(1, c.k // take) ELSE c.k + 1 END AS step FROM f JOIN c ON c.c = f.c)
SELECT doc_id FROM z JOIN s ON s.c = (pos - 1) // size WHERE ((pos - 1) % size % step = 0 AND (pos - 1) % size < take * step) OR pos = 1 OR pos = n"""


@query("o94_adaptive_sample", _SAMPLE)
def o94_adaptive_sample(spark, sf_dir):
    return packing_context.adaptive_sample(_docs(spark, sf_dir).select("doc_id", "text"), ["doc_id"], "text").select("doc_id")


@query("o63_critical_symbols", "SELECT repo, callee, count(DISTINCT caller) AS callers FROM call_edges WHERE callee IS NOT NULL GROUP BY 1, 2 ORDER BY callers DESC, repo, callee LIMIT 20")
def o63_critical_symbols(spark, sf_dir):
    per = table(spark, sf_dir, "call_edges").where("callee IS NOT NULL").groupBy("repo", "callee").agg(F.countDistinct("caller").alias("callers"))
    return per.orderBy(F.desc("callers"), "repo", "callee").limit(20)


@query("o67_hierarchy", "SELECT DISTINCT repo, path FROM source_files ORDER BY repo, path LIMIT 200")
def o67_hierarchy(spark, sf_dir):
    return _files(spark, sf_dir).select("repo", "path").distinct().orderBy("repo", "path").limit(200)


@query(
    "o97_task_ranking",
    f"""WITH RECURSIVE {_HUBS}, {_CLOSURE.format(to='e.dst', on='e.src = r.node', more=' AND r.depth < 3')}, best AS (SELECT * FROM reach),
near AS (SELECT repo, start, start AS node, 1.0 AS score FROM hubs UNION ALL SELECT h.repo, h.start, e.dst, 0.8 FROM hubs h JOIN e ON e.repo = h.repo AND e.src = h.start UNION ALL SELECT h.repo, h.start, e.src, 0.9 FROM hubs h JOIN e ON e.repo = h.repo AND e.dst = h.start),
u AS (SELECT * FROM near UNION ALL SELECT b.repo, b.start, b.node, 0.5 FROM best b WHERE depth > 0 AND NOT EXISTS (SELECT 1 FROM near n WHERE n.repo = b.repo AND n.start = b.start AND n.node = b.node)), m AS (SELECT repo, start, node, max(score)::DOUBLE AS score FROM u GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY repo, start ORDER BY score DESC, node) AS INTEGER) AS rank FROM m QUALIFY rank <= 30""",
)
def o97_task_ranking(spark, sf_dir):
    return packing_context.task_ranking(table(spark, sf_dir, "file_deps"), _hubs(spark, sf_dir), "refactor", ["repo"])


@query("o96_collapse", "SELECT file_id, coalesce(len(classes), 0) = 0 AND coalesce(len(functions), 0) = 0 AND coalesce(code_lines, 0) < 10 AS collapsed FROM source_files")
def o96_collapse(spark, sf_dir):
    return packing_context.collapse(_files(spark, sf_dir)).select("file_id", "collapsed")


@query("o95_compact_json")
def o95_compact_json(spark, sf_dir):
    return packing_context.compact_json(table(spark, sf_dir, "repo_contexts"), "context_id", "payload")


@query(
    "o95_short_names",
    r"""WITH n AS (SELECT DISTINCT name FROM code_symbols WHERE name IS NOT NULL), p AS (SELECT name, array_to_string(list_transform(list_filter(string_split(name, '_'), lambda x: x <> ''), lambda x: x[1]), '') AS ini, lower(regexp_replace(name, '[^A-Z]', '', 'g')) AS cap FROM n)
SELECT name, CASE WHEN len(name) <= 3 THEN name WHEN contains(name, '_') AND len(ini) >= 2 THEN ini WHEN len(cap) >= 2 THEN cap ELSE name[1:3] END AS short FROM p""",
)
def o95_short_names(spark, sf_dir):
    return table(spark, sf_dir, "code_symbols").where("name IS NOT NULL").select("name").distinct().withColumn("short", T.shorten_field(F.col("name")))


@query(
    "o87_simhash",
    r"""WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[\s\x{a0}\x{85}\x{1c}\x{1d}\x{1e}\x{1f}]+')) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL),
h AS (SELECT word, sha256(word)[1:32] AS x FROM (SELECT DISTINCT word FROM c)), b AS (SELECT word, i, (strpos('0123456789abcdef', x[i // 4 + 1]) - 1) >> (3 - i % 4) & 1 AS bit FROM h, range(0, 128) r(i)),
v AS (SELECT doc_id, i, CASE WHEN sum(CASE WHEN bit = 1 THEN n ELSE -n END) > 0 THEN 1 ELSE 0 END AS bit FROM c JOIN b USING (word) GROUP BY ALL)
SELECT doc_id, sum(CASE WHEN i = 0 THEN -bit::HUGEINT * 9223372036854775808 WHEN i < 64 THEN bit::HUGEINT * (1::HUGEINT << (63 - i)) ELSE 0 END)::BIGINT AS hi, sum(CASE WHEN i = 64 THEN -bit::HUGEINT * 9223372036854775808 WHEN i > 64 THEN bit::HUGEINT * (1::HUGEINT << (127 - i)) ELSE 0 END)::BIGINT AS lo FROM v GROUP BY 1""",
)
def o87_simhash(spark, sf_dir):
    return similarity.simhash(_docs(spark, sf_dir), "doc_id", "text")


_WORDS_SQL = r"list_filter(string_split_regex(lower(text), '[\s\x{a0}\x{85}\x{1c}\x{1d}\x{1e}\x{1f}]+'), lambda x: x <> '')"


@query(
    "o90_hybrid_search",
    ORACLES["o87_simhash"].replace("\nSELECT doc_id, sum(CASE", ", bits AS (SELECT doc_id, list(bit ORDER BY i) AS bits FROM v GROUP BY 1),\nws AS (SELECT doc_id, list_distinct(" + _WORDS_SQL + ") AS ws FROM documents WHERE text IS NOT NULL),\np AS (SELECT q.doc_id AS query_id, d.doc_id AS id, 100 - list_sum(list_transform(range(1, 129), lambda i: abs(a.bits[i] - b.bits[i]))) / 128.0::DOUBLE * 100 AS simhash_score, len(list_intersect(q.ws, d.ws)) / greatest(1, len(q.ws))::DOUBLE * 100 AS keyword_score FROM ws q JOIN ws d ON q.doc_id % 50 = 0 AND q.doc_id <> d.doc_id JOIN bits a ON a.doc_id = q.doc_id JOIN bits b ON b.doc_id = d.doc_id),\ns AS (SELECT *, simhash_score * 0.6::DOUBLE + keyword_score * 0.4::DOUBLE AS similarity FROM p)\nSELECT query_id, id, round(similarity, 6) AS similarity, round(simhash_score, 6) AS simhash_score, round(keyword_score, 6) AS keyword_score FROM s WHERE similarity >= 45 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 5 -- ").split(" -- ")[0],
)
def o90_hybrid_search(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return similarity.hybrid_search(docs.where("doc_id % 50 = 0"), docs, "doc_id", "text", 5, 45.0).withColumns({c: F.round(c, 6) for c in ("similarity", "simhash_score", "keyword_score")})


@query(
    "o92_focus_projection",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), p AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_sum(list_transform(range(1, 65), lambda i: q.e[i] * v.e[i])) AS d, list_sum(list_transform(q.e, lambda x: x * x)) AS a, list_sum(list_transform(v.e, lambda x: x * x)) AS b FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, id, round(d * d / (a * b), 6) AS cos2 FROM p WHERE d * d > 0.1 * (a * b)""",
)
def o92_focus_projection(spark, sf_dir):
    vecs = table(spark, sf_dir, "embeddings")
    return similarity.focus_projection(vecs.where("vec_id % 50 = 0"), vecs, "vec_id", "embedding", 0.1**0.5).withColumn("cos2", F.round("cos2", 6))


@query(
    "o93_symbol_cosine",
    """WITH e AS (SELECT DISTINCT file_id, unnest(functions) AS f FROM source_files), k AS (SELECT * FROM e WHERE f IS NOT NULL), n AS (SELECT file_id, count(*)::DOUBLE AS n FROM k GROUP BY 1), c AS (SELECT a.file_id AS query_id, b.file_id AS id, count(*) AS m FROM k a JOIN k b ON a.f = b.f AND a.file_id <> b.file_id WHERE a.file_id % 50 = 0 GROUP BY 1, 2),
s AS (SELECT query_id, id, round(m / sqrt(x.n * y.n), 6) AS similarity FROM c JOIN n x ON x.file_id = query_id JOIN n y ON y.file_id = id) SELECT * FROM s WHERE similarity > 0.1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 10""",
)
def o93_symbol_cosine(spark, sf_dir):
    files = _files(spark, sf_dir)
    return similarity.set_cosine(files.where("file_id % 50 = 0"), files, "file_id", "functions")


_SIGNALS = "SELECT file_id, unnest([" + ", ".join(f"{{'label': '{a}', 'category': '{b}', 'severity': '{c}', 'n': CAST(len(regexp_extract_all(content, $q${p}$q$)) AS INTEGER)}}" for a, b, c, p in findings.TEXT_SECRETS) + "]) AS f FROM source_files WHERE content IS NOT NULL"


@query("o115_secret_signals", f"SELECT file_id, f.label, f.category, f.severity, f.n FROM ({_SIGNALS}) WHERE f.n > 0")
def o115_secret_signals(spark, sf_dir):
    return findings.secret_signals(_files(spark, sf_dir), "file_id", "content")


@query("o99_secret_risk", f"SELECT file_id, max(CASE f.severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.7 WHEN 'medium' THEN 0.4 ELSE 0.1 END)::DOUBLE AS risk, CASE WHEN max(CASE f.severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.7 WHEN 'medium' THEN 0.4 ELSE 0.1 END) > 0.5 THEN 'HIGH' WHEN max(CASE f.severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.7 WHEN 'medium' THEN 0.4 ELSE 0.1 END) > 0.1 THEN 'MODERATE' ELSE 'LOW' END AS level FROM ({_SIGNALS}) WHERE f.n > 0 GROUP BY 1")
def o99_secret_risk(spark, sf_dir):
    return findings.secret_risk(findings.secret_signals(_files(spark, sf_dir), "file_id", "content"), "file_id")


_GRID = "g AS (SELECT file_id, greatest(0, least(1, coalesce(code_lines, 0) / greatest(1, lines)::DOUBLE)) AS s, greatest(0, least(1, (size % 97) / 97.0::DOUBLE)) AS c, greatest(0, least(1, 1 - (file_id % 31) / 31.0::DOUBLE)) AS p FROM source_files WHERE lines IS NOT NULL)"


def _grid(spark, sf_dir):
    share = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return _files(spark, sf_dir).where("lines IS NOT NULL").select(
        "file_id", share(F.coalesce("code_lines", F.lit(0)) / F.greatest(F.lit(1), F.col("lines")).cast("double")).alias("s"), share(F.col("size") % 97 / F.lit(97.0)).alias("c"), share(1 - F.col("file_id") % 31 / F.lit(31.0)).alias("p")
    )


def _aura_sql() -> str:
    """The five rounds of the field score, written out."""
    steps, last = [], "g"
    for k in range(1, 6):
        steps.append(f"m{k} AS (SELECT file_id, s AS x, 0.75 * s + 0.15 * c + 0.10 * p AS y, 0.70 * s + 0.10 * c + 0.20 * p AS z FROM {last}), n{k} AS (SELECT file_id, CASE WHEN greatest(x, y, z) > 0 THEN greatest(x, y, z) ELSE 1 END AS m, x / m AS s, y / m AS c, z / m AS p FROM m{k})")
        last = f"n{k}"
    return ", ".join(steps)


@query("o98_field_score", f"WITH {_GRID}, {_aura_sql()} SELECT file_id, round(0.6 * s + 0.2 * c + 0.2 * p, 6) AS aura FROM n5")
def o98_field_score(spark, sf_dir):
    return _grid(spark, sf_dir).select("file_id", F.round(Q.field_score(F.col("s"), F.col("c"), F.col("p")), 6).alias("aura"))


@query("o100_confidence", "SELECT 19.0::DOUBLE AS kappa, 7.6::DOUBLE AS stability, 0.532::DOUBLE AS confidence")
def o100_confidence(spark, sf_dir):
    kappa = Q.condition_number()
    return spark.range(1).select(F.round(F.lit(kappa), 6).alias("kappa"), F.round(F.lit(kappa / 2.5), 6).alias("stability"), Q.confidence(F.lit(kappa / 2.5)).alias("confidence"))


@query("o101_pulse", f"WITH {_GRID} SELECT file_id, round(s * (1 - 0.25 * c), 4) AS pulse, s * (1 - 0.25 * c) > 0.65 AS stable FROM g")
def o101_pulse(spark, sf_dir):
    pulse = Q.pulse(F.col("s"), F.col("c"), F.lit("Refactor"))
    return _grid(spark, sf_dir).select("file_id", F.round(pulse, 4).alias("pulse"), (pulse > 0.65).alias("stable"))


@query(
    "o58_combined_state",
    f"WITH {_GRID}, r AS (SELECT file_id, CASE WHEN s >= 0.8 THEN 0 WHEN s >= 0.5 THEN 2 WHEN s >= 0.2 THEN 5 ELSE 6 END AS a, CASE WHEN c <= 0.1 THEN 0 WHEN c <= 0.3 THEN 2 WHEN c <= 0.6 THEN 5 ELSE 6 END AS b FROM g) SELECT file_id, ['STABLE', 'SLEEPING', 'WEAK', 'SATURATED', 'NEG_ZERO', 'UNSTABLE', 'DEGENERATE'][greatest(a, b) + 1] AS state FROM r",
)
def o58_combined_state(spark, sf_dir):
    return _grid(spark, sf_dir).select("file_id", Q.combine(Q.band(F.col("s"), 0.8, 0.5, 0.2), Q.band(F.col("c"), 0.1, 0.3, 0.6, rising=False)).alias("state"))


@query("o103_guard_verdict", f"WITH {_GRID}, r AS (SELECT file_id, greatest(CASE WHEN s >= 0.9 THEN 0 WHEN s >= 0.7 THEN 2 WHEN s >= 0.4 THEN 5 ELSE 6 END, CASE WHEN c <= 0.1 THEN 0 WHEN c <= 0.3 THEN 2 WHEN c <= 0.6 THEN 5 ELSE 6 END) AS k FROM g) SELECT file_id, CASE WHEN k = 0 THEN 'SAFE' WHEN k IN (2, 5) THEN 'WARNING' ELSE 'HALLUCINATION_DETECTED' END AS verdict FROM r")
def o103_guard_verdict(spark, sf_dir):
    return _grid(spark, sf_dir).select("file_id", Q.guard_verdict(F.col("s"), F.col("c") * 8, F.lit(False)).alias("verdict"))


@query("o106_drift_gate", f"WITH {_GRID} SELECT file_id, CASE WHEN c > 0.20 THEN 'fail' WHEN c > 0.05 THEN 'warn' ELSE 'ok' END AS gate FROM g")
def o106_drift_gate(spark, sf_dir):
    return _grid(spark, sf_dir).select("file_id", Q.drift_gate(F.col("c")).alias("gate"))


@query("o42_name_filter", "SELECT DISTINCT repo, name FROM code_symbols WHERE len(name) > 3 AND name NOT IN ('if', 'for', 'while', 'switch', 'catch', 'with', 'main')")
def o42_name_filter(spark, sf_dir):
    return table(spark, sf_dir, "code_symbols").where((F.length("name") > 3) & ~F.col("name").isin("if", "for", "while", "switch", "catch", "with", "main")).select("repo", "name").distinct()


@query(
    "o45g_symbol_references",
    r"WITH u AS (SELECT DISTINCT repo, path, unnest(regexp_extract_all(content, '[A-Za-z_]\w{3,}')) AS name FROM source_files WHERE content IS NOT NULL), d AS (SELECT DISTINCT repo, file AS path, name FROM code_symbols WHERE len(name) > 3) SELECT u.repo, u.name, count(*) AS n_files FROM u WHERE EXISTS (SELECT 1 FROM d WHERE d.repo = u.repo AND d.name = u.name) AND NOT EXISTS (SELECT 1 FROM d WHERE d.repo = u.repo AND d.name = u.name AND d.path = u.path) GROUP BY 1, 2",
)
def o45g_symbol_references(spark, sf_dir):
    return structure.symbol_references(table(spark, sf_dir, "code_symbols"), _files(spark, sf_dir), ["repo"])


@query("o45d_shared_symbols", "SELECT name, count(DISTINCT repo || ':' || file) AS n_files, count(*) AS n FROM code_symbols WHERE name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT repo || ':' || file) > 1")
def o45d_shared_symbols(spark, sf_dir):
    return table(spark, sf_dir, "code_symbols").where("name IS NOT NULL").groupBy("name").agg(F.countDistinct(F.concat("repo", F.lit(":"), "file")).alias("n_files"), F.count(F.lit(1)).alias("n")).where("n_files > 1")


@query("o81_context_decision", ORACLES["o80_blast_radius"].replace("\nSELECT *, CASE WHEN score", ",\nrad AS (SELECT *, CASE WHEN score").rstrip() + """), k AS (SELECT file_id, start, row_number() OVER (PARTITION BY file_id, start ORDER BY CASE category WHEN 'primary' THEN 0 WHEN 'direct' THEN 1 ELSE 2 END, depth, node) AS r FROM rad WHERE category <> 'ignored')
SELECT a.file_id, a.start, a.n AS analysed, coalesce(k.n, 0) AS selected, round((a.n - coalesce(k.n, 0)) / a.n::DOUBLE, 4) AS reduction, round((a.n - coalesce(k.n, 0)) / a.n::DOUBLE, 4) >= 0.6 AS reaches FROM (SELECT file_id, start, count(*) AS n FROM rad GROUP BY 1, 2) a LEFT JOIN (SELECT file_id, start, count(*) AS n FROM k WHERE r <= 50 GROUP BY 1, 2) k USING (file_id, start)""")
def o81_context_decision(spark, sf_dir):
    return graph.context_decision(o80_blast_radius(spark, sf_dir), ["file_id"])


@query("o45h_symbol_users", "WITH d AS (SELECT DISTINCT repo, file, name FROM code_symbols WHERE name IS NOT NULL), u AS (SELECT DISTINCT repo, file AS user_file, string_split(callee, '.')[-1] AS name FROM call_edges WHERE callee IS NOT NULL) SELECT d.repo, d.file, d.name, count(*) AS users FROM d JOIN u ON u.repo = d.repo AND u.name = d.name AND user_file <> d.file GROUP BY 1, 2, 3")
def o45h_symbol_users(spark, sf_dir):
    return graph.symbol_users(table(spark, sf_dir, "code_symbols"), table(spark, sf_dir, "call_edges"), ["repo"])


@query("o76_stat_changes", f"WITH {_SNAP}, z AS (SELECT s.*, f.size, epoch(f.scanned_at) AS mtime FROM s JOIN source_files f USING (file_id)), o AS (SELECT repo, path, mtime, size FROM z WHERE file_id IN (SELECT file_id FROM old)), n AS (SELECT repo, path, mtime, size FROM z WHERE file_id IN (SELECT file_id FROM new)) SELECT repo, path, CASE WHEN o.size IS NULL THEN 'added' WHEN n.size IS NULL THEN 'removed' WHEN abs(o.mtime - n.mtime) <= 0.01 AND o.size = n.size THEN 'same' ELSE 'changed' END AS change FROM o FULL JOIN n USING (repo, path)")
def o76_stat_changes(spark, sf_dir):
    files = _files(spark, sf_dir).select("repo", "path", "scanned_at", "file_id", "size")
    keys, order = ["repo", "path"], ["scanned_at", "file_id"]
    old = incremental.latest(files.where(F.col("scanned_at") < F.lit("2025-07-01").cast("timestamp_ntz")), keys, order)
    mtime = (F.unix_micros(F.col("scanned_at").cast("timestamp")) / 1e6).alias("mtime")
    pick = lambda df: df.select("repo", "path", mtime, "size")
    return incremental.stat_changes(pick(old), pick(incremental.latest(files, keys, order)), keys)


@query("o117_diff_summary", f"WITH {_SNAP} SELECT count(*) FILTER (change = 'added') || ' added, ' || count(*) FILTER (change = 'changed') || ' modified, ' || count(*) FILTER (change = 'removed') || ' removed' AS summary FROM d")
def o117_diff_summary(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return incremental.diff_summary(incremental.diff(old, new, ["repo", "path"]))


@query("o88_weighted_score", r"WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[\s\x{a0}\x{85}\x{1c}\x{1d}\x{1e}\x{1f}]+'), lambda x: x <> '')) AS w FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, count(*) FILTER (len(w) > 5)::DOUBLE AS a, count(*) FILTER (len(w) < 4)::DOUBLE AS b, count(*)::DOUBLE AS n FROM w GROUP BY 1), m AS (SELECT doc_id, (a * (1::DOUBLE + 0.9::DOUBLE * 0.2::DOUBLE) + b * (1::DOUBLE - 0.5::DOUBLE * 0.3::DOUBLE) + (n - a - b)) / n AS m FROM k) SELECT d.doc_id, coalesce(least(m, 2.0::DOUBLE) / 2::DOUBLE, 0::DOUBLE) AS score, CASE WHEN m IS NULL THEN 'SLEEPING' WHEN m < 0.5 THEN 'WEAK' ELSE 'STABLE' END AS state FROM documents d LEFT JOIN m USING (doc_id) WHERE text IS NOT NULL")
def o88_weighted_score(spark, sf_dir):
    return similarity.weighted_score(_docs(spark, sf_dir), "doc_id", "text", 0.9, 0.5)


@query("o104_answer_mode", f"WITH {_GRID} SELECT file_id, CASE WHEN s >= 0.9 THEN 'strict' ELSE 'relaxed' END AS mode FROM g")
def o104_answer_mode(spark, sf_dir):
    return _grid(spark, sf_dir).select("file_id", Q.answer_mode(F.col("s")).alias("mode"))


@query("o103_verify_verdict", f"WITH {_GRID}, r AS (SELECT file_id, greatest(CASE WHEN s >= 0.8 THEN 0 WHEN s >= 0.5 THEN 2 WHEN s >= 0.2 THEN 5 ELSE 6 END, CASE WHEN c <= 0.1 THEN 0 WHEN c <= 0.3 THEN 2 WHEN c <= 0.6 THEN 5 ELSE 6 END, CASE WHEN p >= 0.9 THEN 0 WHEN p >= 0.7 THEN 2 WHEN p >= 0.4 THEN 5 ELSE 6 END) AS k, file_id % 7 <> 0 AS clean FROM g) SELECT file_id, CASE WHEN k = 0 AND clean THEN 'SEALED_STABLE' WHEN k IN (2, 5) THEN 'WEAK' ELSE 'DEGENERATE' END AS verdict FROM r")
def o103_verify_verdict(spark, sf_dir):
    return _grid(spark, sf_dir).select("file_id", Q.verify_verdict(F.col("s"), F.col("c"), F.col("p"), F.col("file_id") % 7 != 0).alias("verdict"))


@query("o129_duration_text", "SELECT command, lpad((s // 3600)::VARCHAR, 2, '0') || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS spent FROM (SELECT coalesce(data.command, 'unknown') AS command, floor(round(sum(greatest(coalesce(data.duration_sec, 0), 0)), 3))::BIGINT AS s FROM telemetry WHERE data IS NOT NULL GROUP BY 1)")
def o129_duration_text(spark, sf_dir):
    return telemetry.by_command(table(spark, sf_dir, "telemetry")).select("command", Q.clock(F.col("total_sec")).alias("spent"))


@query("o119_fallback_symbols", r"SELECT doc_id, name, count(*) AS n FROM (SELECT file_id AS doc_id, unnest(regexp_extract_all(content, '\b(?:class|function|def|fn|struct|func)\s+([A-Za-z_]\w*)', 1)) AS name FROM source_files) GROUP BY 1, 2")
def o119_fallback_symbols(spark, sf_dir):
    each = _files(spark, sf_dir).select(F.col("file_id").alias("doc_id"), F.explode(F.regexp_extract_all("content", F.lit(r"\b(?:class|function|def|fn|struct|func)\s+([A-Za-z_]\w*)"), F.lit(1))).alias("name"))
    return each.groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n"))


@query("o116_context_metrics", "SELECT context_id, CAST(payload ->> '$.metrics.files_scanned' AS BIGINT) AS files, CAST(payload ->> '$.metrics.total_lines' AS BIGINT) AS n_lines FROM repo_contexts WHERE CASE WHEN json_valid(payload) THEN json_type(payload, '$.metrics') = 'OBJECT' ELSE false END")
def o116_context_metrics(spark, sf_dir):
    m = table(spark, sf_dir, "repo_contexts").select("context_id", F.try_parse_json("payload").alias("v"))
    get = lambda k: F.try_variant_get("v", f"$.metrics.{k}", "bigint")
    return m.select("context_id", get("files_scanned").alias("files"), get("total_lines").alias("n_lines"), F.schema_of_variant(F.try_variant_get("v", "$.metrics", "variant")).alias("s")).where("s LIKE 'OBJECT%'").drop("s")


@query("o124_migration_ends", _LEVELS + ", k AS (SELECT * FROM lv WHERE level IS NOT NULL), r AS (SELECT repo, node, level, row_number() OVER (PARTITION BY repo ORDER BY level, node) AS rank, 'first' AS \"end\" FROM k UNION ALL SELECT repo, node, level, row_number() OVER (PARTITION BY repo ORDER BY level DESC, node DESC), 'last' FROM k) SELECT repo, node, level, rank::INTEGER AS rank, \"end\" FROM r WHERE rank <= 5")
def o124_migration_ends(spark, sf_dir):
    return structure.migration_ends(o70_levels(spark, sf_dir), ["repo"])


@query("o112_efficiency", """SELECT session, round(sum(CASE WHEN greatest(coalesce(data.savings_pct, 0), 0) > 0 THEN coalesce(data.tokens_saved, 0)::DOUBLE * (100 - least(greatest(coalesce(data.savings_pct, 0), 0), 100)) / greatest(coalesce(data.savings_pct, 0), 0) ELSE 0 END), 2) AS tokens_used, sum(coalesce(data.tokens_saved, 0)::DOUBLE) AS tokens_saved,
round(coalesce(sum(coalesce(data.tokens_saved, 0)::DOUBLE) * 100 / nullif(sum(coalesce(data.tokens_saved, 0)::DOUBLE) + round(sum(CASE WHEN greatest(coalesce(data.savings_pct, 0), 0) > 0 THEN coalesce(data.tokens_saved, 0)::DOUBLE * (100 - least(greatest(coalesce(data.savings_pct, 0), 0), 100)) / greatest(coalesce(data.savings_pct, 0), 0) ELSE 0 END), 2), 0), 0), 1) AS efficiency FROM telemetry WHERE session IS NOT NULL AND data IS NOT NULL GROUP BY 1""")
def o112_efficiency(spark, sf_dir):
    return telemetry.efficiency(table(spark, sf_dir, "telemetry"))


@query("o123_patch_actions")
def o123_patch_actions(spark, sf_dir):
    py = _files(spark, sf_dir).where(F.col("path").endswith(".py"))
    return findings.patch_actions(py, structure.numbered_lines(py), o73_symbol_drift(spark, sf_dir))


@query("o15_export", "SELECT repo, path, '- **' || path || '**: ' || array_to_string(list_sort(list_distinct(list_filter(coalesce(classes, []), lambda x: x IS NOT NULL)))[1:5], ', ') || '; ' || array_to_string(list_sort(list_distinct(list_filter(coalesce(functions, []), lambda x: x IS NOT NULL)))[1:10], ', ') AS body FROM source_files")
def o15_export(spark, sf_dir):
    from seamstone.sources import exporters

    return exporters.render(_files(spark, sf_dir), "markdown")
