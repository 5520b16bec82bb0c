"""Further registered queries of the core: reports, packs, lookups, sources and round trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamstone.functions import quality as Q
from seamstone.functions import text as T
from seamstone.operators import findings, graph, impact, incremental, packing_context, recipes, similarity, structure
from seamstone.plans import queries as base
from seamstone.plans.queries import ORACLES, query
from seamstone.sources import checkpoints, exporters, scan
from seamstone.sources.tables import table
from seamstone.streaming import watch


def _latest_files(spark, sf_dir, *columns: str) -> DataFrame:
    files = base._files(spark, sf_dir).select("repo", "path", "scanned_at", "file_id", *columns)
    return incremental.latest(files, ["repo", "path"], ["scanned_at", "file_id"])


_LATEST = "lf AS (SELECT * FROM source_files QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY scanned_at DESC NULLS LAST, file_id DESC) = 1)"


# ---- nested records: the number of rows and parents of every relation ------------------
ORACLES["p1_tables"] = f"SELECT context_id, rel, count(*) AS n, count(DISTINCT parent_ix) AS parents FROM ({base.ORACLES['p1_found']}) GROUP BY 1, 2"


# ---- sources -----------------------------------------------------------------------------
def _sql_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_EXT = r"lower(regexp_extract({p}, '\.([^./]+)$', 1))"


@query("o02_in_scope", f"SELECT file_id, {_EXT.format(p='path')} IN {_sql_list(scan.EXTENSIONS)} AND NOT list_has_any(string_split(path, '/')[:-2], [{', '.join(repr(p) for p in scan.PRUNED)}]) AS in_scope FROM source_files WHERE path IS NOT NULL")
def o02_in_scope(spark, sf_dir):
    return base._files(spark, sf_dir).where("path IS NOT NULL").select("file_id", scan.in_scope(F.col("path")).alias("in_scope"))


@query("o05_file_set", f"SELECT DISTINCT repo, path FROM source_files WHERE {_EXT.format(p='path')} IN {_sql_list(scan.EXTENSIONS)} AND NOT list_has_any(string_split(path, '/')[:-2], [{', '.join(repr(p) for p in scan.PRUNED)}])")
def o05_file_set(spark, sf_dir):
    return base._files(spark, sf_dir).where(scan.in_scope(F.col("path"))).select("repo", "path").distinct()


@query("o04_stat_scan", f"WITH {_LATEST} SELECT repo, path, epoch_us(scanned_at) AS mtime, size FROM lf")
def o04_stat_scan(spark, sf_dir):
    return _latest_files(spark, sf_dir, "size").select("repo", "path", F.unix_micros(F.col("scanned_at").cast("timestamp")).alias("mtime"), "size")


#: Indicators of project types: file names and suffixes.
_INDICATORS = [("python", ".py"), ("python", "setup.py"), ("node", ".js"), ("node", ".ts"), ("node", "package.json"), ("java", ".java"), ("go", ".go"), ("rust", ".rs"), ("dotnet", ".cs"), ("cpp", ".cpp"), ("cpp", ".hpp"), ("php", ".php"), ("ruby", ".rb")]


@query(
    "o11_project_type",
    f"WITH i AS (SELECT * FROM (VALUES {', '.join(map(str, _INDICATORS))}) t(type, pattern)), h AS (SELECT DISTINCT string_split(path, '/')[-1] AS pattern, 2 AS score FROM source_files UNION ALL SELECT DISTINCT '.' || {_EXT.format(p='path')}, 1 FROM source_files) SELECT type, sum(score)::BIGINT AS score FROM i JOIN h USING (pattern) GROUP BY 1 ORDER BY score DESC, type LIMIT 1",
)
def o11_project_type(spark, sf_dir):
    return scan.project_type(base._files(spark, sf_dir).select("path"), spark.createDataFrame(_INDICATORS, "type STRING, pattern STRING"))


@query("o14_event_log", "SELECT ts, event, data.command AS command, data.files AS files, session, count(*) AS n FROM telemetry GROUP BY ALL")
def o14_event_log(spark, sf_dir):
    path = checkpoints.new_folder(spark)
    events = table(spark, sf_dir, "telemetry").select("ts", "event", "data", "session")
    exporters.append_jsonl(events.where("data IS NULL"), path)
    exporters.append_jsonl(events.where("data IS NOT NULL"), path)
    return scan.read_events(spark, path).groupBy("ts", "event", F.col("data.command").alias("command"), F.col("data.files").alias("files"), "session").agg(F.count(F.lit(1)).alias("n"))


@query("o12_json_round_trip", "SELECT repo, src, dst, count(*) AS n FROM file_deps GROUP BY ALL")
def o12_json_round_trip(spark, sf_dir):
    path = checkpoints.new_folder(spark)
    exporters.write_json(table(spark, sf_dir, "file_deps"), path)
    return spark.read.schema("repo STRING, src STRING, dst STRING").json(path).groupBy("repo", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("o10_index_round_trip", base.ORACLES["o87_simhash"])
def o10_index_round_trip(spark, sf_dir):
    path = checkpoints.new_folder(spark)
    exporters.write_index(similarity.simhash(base._docs(spark, sf_dir), "doc_id", "text"), path, "doc_id")
    return spark.read.parquet(path).select("doc_id", "hi", "lo")


def _export_sql() -> str:
    some = lambda c, n: f"list_sort(list_distinct(list_filter(coalesce({c}, []), lambda x: x IS NOT NULL)))[1:{n}]"
    parts = []
    for style, (n, m) in exporters.LIMITS.items():
        cls, fns = some("classes", n), some("functions", m)
        body = {
            "markdown": f"'- **' || path || '**: ' || array_to_string({cls}, ', ') || '; ' || array_to_string({fns}, ', ')",
            "yaml": f"'- path: ' || path || chr(10) || '  classes: [' || array_to_string({cls}, ', ') || ']' || chr(10) || '  functions: [' || array_to_string({fns}, ', ') || ']'",
            "xml": f"'<file path=\"' || path || '\"><classes>' || array_to_string({cls}, ',') || '</classes><functions>' || array_to_string({fns}, ',') || '</functions></file>'",
            "text": f"path || ' | ' || array_to_string({cls}, ' ') || ' | ' || array_to_string({fns}, ' ')",
            "json": f"to_json({{'path': path, 'classes': {cls}, 'functions': {fns}}})::VARCHAR",
        }[style]
        parts.append(f"SELECT file_id, '{style}' AS style, {body} AS body FROM source_files WHERE path IS NOT NULL")
    return " UNION ALL ".join(parts)


@query("o15_export_styles", _export_sql())
def o15_export_styles(spark, sf_dir):
    files = base._files(spark, sf_dir).where("path IS NOT NULL")
    out = None
    for style in exporters.LIMITS:
        one = exporters.render(files.withColumn("repo", F.col("file_id")), style).select(F.col("repo").alias("file_id"), F.lit(style).alias("style"), "body")
        out = one if out is None else out.unionByName(one)
    return out


def _rewritten(column: str, pairs: tuple[tuple[str, str], ...]) -> Column:
    """A column with phrases replaced: the test tables hold nothing these queries look for."""
    made = F.col(column)
    for old, new in pairs:
        made = F.replace(made, F.lit(old), F.lit(new))
    return made


def _rewritten_sql(column: str, pairs: tuple[tuple[str, str], ...]) -> str:
    for old, new in pairs:
        column = f"replace({column}, '{old}', '" + new.replace("\n", "' || chr(10) || '") + "')"
    return column


# ---- recipes -----------------------------------------------------------------------------
_SPLIT = r"string_split_regex({t}, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"
_DOC_PARTS = (
    rf"""dp AS (SELECT doc_id, text, list_transform({_SPLIT.format(t='text')}, lambda x: trim(x)) AS t, {_SPLIT.format(t='text')} AS raw FROM documents WHERE text IS NOT NULL), dh AS (SELECT doc_id, CASE WHEN t[len(t)] = '' THEN len(t) - 1 ELSE len(t) END AS n_lines,
list_filter(t, lambda x: starts_with(x, '#') OR (starts_with(lower(x), '<h') AND contains(x, '>')))[1:20] AS headers, list_filter(flatten(list_transform(list_filter(t, lambda x: len(x) > 20 AND regexp_matches(x, '[A-Z]')), lambda x: string_split_regex(x, '\s+'))), lambda w: regexp_matches(w, '^[A-Z][A-Za-z0-9]{{5,}}$')) AS ws,
list_filter(raw, lambda x: contains(x, 'http') AND (contains(x, 'href') OR contains(x, 'src')))[1:10] AS links FROM dp), dr AS (SELECT doc_id, n_lines, headers, list_filter(ws, lambda w, i: list_position(ws, w) = i)[1:15] AS keywords, links FROM dh)"""
)


@query("o29_doc_fields", f"WITH {_DOC_PARTS} SELECT doc_id, array_to_string(headers, chr(10)) AS headers, 'Document length: ' || n_lines || ' lines.' AS summary, array_to_string(keywords, ' ') AS keywords, array_to_string(links, chr(10)) AS links FROM dr")
def o29_doc_fields(spark, sf_dir):
    r = F.col("result")
    return recipes.doc_results(base._docs(spark, sf_dir), "doc_id", "text").select("doc_id", *[r[k].alias(k) for k in ("headers", "summary", "keywords", "links")])


_FORBIDDEN = "CASE WHEN regexp_matches(lower(array_to_string(headers, ' ') || ' ' || array_to_string(keywords, ' ') || ' ' || array_to_string(links, ' ')), 'comment|probably|opinion') THEN 'forbidden_content' END"
ORACLES["o30_constraints"] = f'WITH {_DOC_PARTS} SELECT doc_id, {_FORBIDDEN} AS "constraint", CASE WHEN {_FORBIDDEN} IS NULL THEN \'keep\' ELSE \'abort\' END AS decision FROM dr'


@query(
    "o26_code_lines",
    rf"""WITH f AS (SELECT file_id, list_transform({_SPLIT.format(t='content')}, lambda x: trim(x)) AS t FROM source_files WHERE content IS NOT NULL) SELECT file_id, array_to_string(list_filter(t, lambda x: contains(x, 'class ')), chr(10)) AS classes, array_to_string(list_filter(t, lambda x: contains(x, 'def ')), chr(10)) AS functions, array_to_string(list_filter(t, lambda x: contains(x, 'import ') OR contains(x, 'from ')), chr(10)) AS imports FROM f""",
)
def o26_code_lines(spark, sf_dir):
    r = F.col("result")
    return recipes.code_results(base._files(spark, sf_dir).select("file_id", "content"), "file_id", "content").select("file_id", *[r[k].alias(k) for k in ("classes", "functions", "imports")])


_MARKED = "'--- FILE: ' || path || ' ---' || chr(10) || content || chr(10) || '--- FILE: note.md ---' || chr(10) || '# ' || path"


def _marked(spark, sf_dir, pairs: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Every file as a marked block before a block of documentation."""
    text = F.concat(F.lit("--- FILE: "), "path", F.lit(" ---\n"), _rewritten("content", pairs), F.lit("\n--- FILE: note.md ---\n# "), "path")
    return base._files(spark, sf_dir).where("content IS NOT NULL AND path IS NOT NULL").select("file_id", text.alias("text"))


_STRIP = r"regexp_replace({t}, '^[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}]+|[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}]+$', '', 'g')"


@query(
    "o25_segments",
    rf"""WITH f AS (SELECT file_id, path, content FROM source_files WHERE content IS NOT NULL AND path IS NOT NULL) SELECT file_id, 0::INTEGER AS pos, CASE WHEN {_EXT.format(p='path')} IN ('py', 'js', 'ts', 'sql') THEN 'code' ELSE 'documentation' END AS seg_type, {_STRIP.format(t='content')} AS body, 0::INTEGER AS start FROM f
UNION ALL SELECT file_id, 1::INTEGER, 'documentation', '# ' || trim(path), (len('--- FILE: ' || path || ' ---' || chr(10) || content || chr(10)))::INTEGER FROM f""",
)
def o25_segments(spark, sf_dir):
    return recipes.segments(_marked(spark, sf_dir), "file_id", "text")


@query("o32_pipeline")
def o32_pipeline(spark, sf_dir):
    return recipes.pipeline(_marked(spark, sf_dir), "file_id", "text")


#: Words of the tables that stand for forbidden ones here.
_FORBIDDEN_WORDS = (("merge", "guess"), ("Merge", "Comment"), ("Register", "Opinion"))
_SEGMENT_LINES = f"list_transform({_SPLIT.format(t=_STRIP.format(t=_rewritten_sql('content', _FORBIDDEN_WORDS)))}, lambda x: trim(x))"
_SHOWN = r"""lower(CASE WHEN code THEN array_to_string(list_filter(t, lambda x: contains(x, 'class ') OR contains(x, 'def ') OR contains(x, 'import ') OR contains(x, 'from ')), chr(10)) ELSE array_to_string(list_filter(t, lambda x: starts_with(x, '#') OR (starts_with(lower(x), '<h') AND contains(x, '>')))[1:20], chr(10)) || ' ' ||
array_to_string(list_filter(ws, lambda w, i: list_position(ws, w) = i)[1:15], ' ') || ' ' || array_to_string(list_filter(t, lambda x: contains(x, 'http') AND (contains(x, 'href') OR contains(x, 'src')))[1:10], chr(10)) END)"""


@query(
    "o32_segment_status",
    rf"""WITH f AS (SELECT file_id, path, {_EXT.format(p='path')} IN ('py', 'js', 'ts', 'sql') AS code, {_SEGMENT_LINES} AS t FROM source_files WHERE content IS NOT NULL AND path IS NOT NULL), g AS (SELECT *, list_filter(flatten(list_transform(list_filter(t, lambda x: len(x) > 20 AND regexp_matches(x, '[A-Z]')), lambda x: string_split_regex(x, '\s+'))), lambda w: regexp_matches(w, '^[A-Z][A-Za-z0-9]{{5,}}$')) AS ws FROM f),
h AS (SELECT file_id, regexp_matches({_SHOWN}, CASE WHEN code THEN 'speculative|commentary|guess' ELSE 'comment|probably|opinion' END) AS first_bad, regexp_matches(lower(path), 'comment|probably|opinion') AS second_bad FROM g)
SELECT file_id, 2::BIGINT AS segments, (NOT first_bad)::BIGINT + (NOT second_bad)::BIGINT AS ok, first_bad::BIGINT + second_bad::BIGINT AS degraded, CASE WHEN first_bad OR second_bad THEN 'degraded' ELSE 'stable' END AS status FROM h""",
)
def o32_segment_status(spark, sf_dir):
    return recipes.pipeline(_marked(spark, sf_dir, _FORBIDDEN_WORDS), "file_id", "text").select("file_id", "segments", "ok", "degraded", "status")


@query(
    "o28_config_keys",
    "WITH a AS (SELECT context_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM repo_contexts) SELECT context_id, CASE WHEN j IS NULL THEN 'output_format' END AS violation, CASE WHEN j IS NOT NULL THEN coalesce(CASE WHEN json_type(j) = 'OBJECT' THEN len(json_keys(j)) END, 0)::INTEGER END AS n_keys, CASE WHEN j IS NOT NULL THEN coalesce(CASE WHEN json_type(j) = 'OBJECT' THEN array_to_string(json_keys(j)[1:50], ',') END, '') END AS sections FROM a",
)
def o28_config_keys(spark, sf_dir):
    return recipes.config_recipe(table(spark, sf_dir, "repo_contexts"), "context_id", "payload").select("context_id", "violation", "n_keys", F.array_join("sections", ",").alias("sections"))


@query(
    "o27_log_anomalies",
    rf"""WITH p AS (SELECT doc_id, {_SPLIT.format(t="replace(text, ' fail', ' FATAL fail')")} AS t FROM documents), l AS (SELECT doc_id, unnest(t) AS line, generate_subscripts(t, 1) AS n FROM p), a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM l WHERE regexp_matches(upper(line), 'EXCEPTION|CRITICAL|FATAL|TIMEOUT'))
SELECT doc_id, (k - 1)::INTEGER AS pos, trim(line)[1:120] AS anomaly FROM a WHERE k <= 15""",
)
def o27_log_anomalies(spark, sf_dir):
    return recipes.log_anomalies(base._docs(spark, sf_dir).withColumn("text", F.replace("text", F.lit(" fail"), F.lit(" FATAL fail"))), "doc_id", "text")


# ---- findings -----------------------------------------------------------------------------
_HEDGES = ((" when ", " perhaps when "), (" never ", " might never "), (" is ", " could be "), (" nur ", " muhtemelen "))


@query("o35_speculative", base.ORACLES["o35_speculative"].replace("FROM documents, p", f"FROM (SELECT doc_id, {_rewritten_sql('text', _HEDGES)} AS text FROM documents), p"))
def o35_speculative(spark, sf_dir):
    return base._docs(spark, sf_dir).select("doc_id", F.explode(T.speculative(_rewritten("text", _HEDGES))).alias("pattern"))


_GUARDS = (("    for ", "    except "), ("    else:", "    except:"), ("        logger.info(", "        pass\n        logger.info("))
_NO_GUARDS = base.ORACLES["o37_except_issues"]


@query("o37_except_issues", _NO_GUARDS.replace("string_split_regex(content,", f"string_split_regex({_rewritten_sql('content', _GUARDS)},"))
def o37_except_issues(spark, sf_dir):
    py = base._files(spark, sf_dir).where(F.col("path").endswith(".py")).withColumn("content", _rewritten("content", _GUARDS))
    return findings.except_issues(structure.numbered_lines(py))


_UNUSED = r"""im AS (SELECT file_id, content, unnest(regexp_extract_all(content, '(?m)^[ \t]*(import[ \t]+\w+.*)$', 1)) AS line FROM source_files WHERE path LIKE '%.py'), mo AS (SELECT *, regexp_extract(line, '^import[ \t]+(\w+)', 1) AS module FROM im),
un AS (SELECT file_id, module FROM mo WHERE module NOT IN ('os', 'sys', 'json', 're', 'math') AND len(content) - len(replace(content, module, '')) = len(line) - len(replace(line, module, '')))"""
ORACLES["o36_unused_imports"] = f"WITH {_UNUSED} SELECT * FROM un"
ORACLES["o123_patch_actions"] = (
    f"WITH {_UNUSED}, ex AS ({_NO_GUARDS}), dr AS ({base.ORACLES['o73_symbol_drift']}) SELECT file_id, 'unused_import' AS action, module AS detail FROM un UNION ALL SELECT file_id, action, n::VARCHAR FROM ex UNION ALL SELECT file_id, 'symbol_drift', name FROM dr WHERE side = 'only_left'"
)


def _findings_sql() -> str:
    kinds = ", ".join(f"{{'label': '{a}', 'category': '{b}', 'severity': '{c}', 'found': regexp_extract_all(line, $q${p}$q$)}}" for a, b, c, p in findings.TEXT_SECRETS)
    return f"""WITH l AS (SELECT file_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_number FROM source_files WHERE content IS NOT NULL),
k AS (SELECT file_id, line_number, unnest([{kinds}]) AS k FROM l WHERE regexp_matches(line, '[@=:]|AKIA|BEGIN')), v AS (SELECT file_id, line_number, k.label AS label, k.category AS category, k.severity AS severity, unnest(k.found) AS value FROM k),
d AS (SELECT DISTINCT value FROM v), c AS (SELECT value, unnest(string_split(value, '')) AS c FROM d), n AS (SELECT value, c, count(*)::DOUBLE AS n FROM c GROUP BY 1, 2), s AS (SELECT value, sum(n) AS t FROM n GROUP BY 1), h AS (SELECT value, abs(round(-sum(n / t * log2(n / t)), 6)) AS h FROM n JOIN s USING (value) GROUP BY 1)
SELECT file_id, label, category, severity, line_number::INTEGER AS line_number, value[1:4] || '****' AS masked_value, round(least(1, h / 4), 3) AS confidence FROM v JOIN h USING (value) WHERE round(least(1, h / 4), 3) >= 0.5 AND (NOT ends_with(label, '_assignment') OR h >= 3)"""


@query("o115_secret_findings", _findings_sql())
def o115_secret_findings(spark, sf_dir):
    return findings.secret_findings(base._files(spark, sf_dir), "file_id", "content")


_H = "(SELECT id, abs(-sum(n / t * log2(n / t))) AS h FROM (SELECT id, n, sum(n) OVER (PARTITION BY id) AS t FROM (SELECT id, c, count(*)::DOUBLE AS n FROM (SELECT id, unnest(string_split(t, '')) AS c FROM {0}) GROUP BY 1, 2)) GROUP BY 1)"
_PATCHED = f"""pt AS (SELECT file_id AS id, repo, content AS a, CASE WHEN instr(content, 'return') > 0 THEN content[:instr(content, 'return') - 1] || 'RAISE_§ÄÖ' || content[instr(content, 'return') + 6:] ELSE content END AS b FROM source_files WHERE content <> ''), pa AS (SELECT id, a AS t FROM pt), pb AS (SELECT id, b AS t FROM pt),
ha AS {_H.format('pa')}, hb AS {_H.format('pb')}, sc AS (SELECT pt.id, pt.repo, round(hb.h - ha.h, 6) AS delta FROM pt JOIN ha USING (id) JOIN hb USING (id)), sq AS (SELECT *, round(1 - least(1, greatest(0, delta) / 8), 6) AS quality FROM sc)"""


def _patches(spark, sf_dir) -> DataFrame:
    files = base._files(spark, sf_dir).where("content <> ''").select("file_id", "repo", "content")
    return findings.patch_score(files.withColumn("old", F.lit("return")).withColumn("new", F.lit("RAISE_§ÄÖ")))


@query("o105_patch_score", f"WITH {_PATCHED} SELECT id AS file_id, delta, quality, CASE WHEN delta > 0.5 THEN 'UNSTABLE' WHEN delta > 0 THEN 'WEAK' ELSE 'STABLE' END AS raw_state, delta <= 0.5 AS safe FROM sq")
def o105_patch_score(spark, sf_dir):
    return _patches(spark, sf_dir).select("file_id", "delta", "quality", "raw_state", "safe")


@query("o59_patch_report", f"WITH {_PATCHED}, r AS (SELECT repo, count(*) AS patches, count(*) FILTER (delta > 0.5) AS skipped, round(avg(quality), 3) AS quality FROM sq GROUP BY 1) SELECT *, CASE WHEN quality >= 0.8 THEN 'STABLE' WHEN quality >= 0.5 THEN 'WEAK' ELSE 'UNSTABLE' END AS state FROM r")
def o59_patch_report(spark, sf_dir):
    return findings.patch_report(_patches(spark, sf_dir), ["repo"])


@query("o107_deterministic", "SELECT 'source_files' AS name, true AS deterministic")
def o107_deterministic(spark, sf_dir):
    made = [structure.structure(base._files(spark, sf_dir).repartition(n)).select("file_id", "found_classes", "found_functions") for n in (3, 5)]
    return spark.createDataFrame([("source_files", findings.deterministic(*made))], "name STRING, deterministic BOOLEAN")


# ---- fingerprints ------------------------------------------------------------------------------
def _weighted_sql() -> str:
    prints, score = base.ORACLES["o87_simhash"], base.ORACLES["o88_weighted_score"]
    weighted = prints.replace("sum(CASE WHEN bit = 1 THEN n ELSE -n END) > 0", "sum(CASE WHEN bit = 1 THEN 1 ELSE -1 END * n * CASE WHEN len(word) > 5 THEN 118 WHEN len(word) < 4 THEN 85 ELSE 100 END) > 0")
    return f"SELECT s.doc_id, coalesce(p.hi, 0) AS hi, coalesce(p.lo, 0) AS lo, s.score, s.state FROM ({score}) s LEFT JOIN ({weighted}) p USING (doc_id)"


@query("o88_weighted_simhash", _weighted_sql())
def o88_weighted_simhash(spark, sf_dir):
    return similarity.weighted_simhash(base._docs(spark, sf_dir), "doc_id", "text", 0.9, 0.5)


@query(
    "o125_reference_files",
    r"WITH u AS (SELECT DISTINCT repo, path, unnest(regexp_extract_all(content, '[A-Za-z_]\w{3,}')) AS name FROM source_files WHERE content IS NOT NULL), d AS (SELECT DISTINCT repo, file AS path, name FROM code_symbols WHERE len(name) > 3), w AS (SELECT DISTINCT repo, name FROM d) SELECT u.repo, u.name, u.path FROM u SEMI JOIN w USING (repo, name) ANTI JOIN d USING (repo, path, name)",
)
def o125_reference_files(spark, sf_dir):
    return structure.reference_files(table(spark, sf_dir, "code_symbols"), base._files(spark, sf_dir), ["repo"])


# ---- packs and rankings ------------------------------------------------------------------------
def _pack_sql(aggressive: bool) -> str:
    return f"""WITH {_LATEST}, own AS (SELECT repo, path, list_filter(coalesce(classes, []), lambda x: x IS NOT NULL) AS cl, list_filter(coalesce(functions, []), lambda x: x IS NOT NULL) AS fn, list_filter(coalesce(imports, []), lambda x: x IS NOT NULL) AS im, code_lines FROM lf WHERE path IS NOT NULL),
ea AS (SELECT repo, path, unnest(im) AS value, generate_subscripts(im, 1) AS place FROM own), sh AS (SELECT repo, value, 'I' || (row_number() OVER (PARTITION BY repo ORDER BY value) - 1) AS ref FROM (SELECT repo, value FROM ea GROUP BY 1, 2 HAVING count(*) >= 3)),
li AS (SELECT repo, path, coalesce(string_agg(value, ',' ORDER BY place) FILTER (ref IS NULL), '') AS imports, coalesce(string_agg(ref, ',' ORDER BY place) FILTER (ref IS NOT NULL), '') AS refs FROM ea LEFT JOIN sh USING (repo, value) GROUP BY 1, 2),
pr AS (SELECT repo, regexp_extract(path, '^(.*/)[^/]*$', 1) AS prefix FROM own), al AS (SELECT repo, prefix, row_number() OVER (PARTITION BY repo ORDER BY len(prefix) DESC, prefix) - 1 AS k FROM (SELECT repo, prefix FROM pr WHERE prefix <> '' GROUP BY 1, 2 HAVING count(*) >= 3)),
be AS (SELECT o.repo, o.path, arg_min(prefix, k) AS prefix, min(k) AS k FROM own o JOIN al ON al.repo = o.repo AND starts_with(o.path, al.prefix) GROUP BY 1, 2)
SELECT o.repo, o.path, coalesce('@' || CASE WHEN be.k < 26 THEN chr((be.k + 97)::INTEGER) ELSE be.k::VARCHAR END || '/' || o.path[len(be.prefix) + 1:], o.path) AS packed_path, len(cl) = 0 AND len(fn) = 0 AND coalesce(code_lines, 0) < {30 if aggressive else 10} AS collapsed,
CASE WHEN len(cl) = 0 AND len(fn) = 0 AND coalesce(code_lines, 0) < {30 if aggressive else 10} THEN '' ELSE coalesce(li.imports, '') END AS imports, CASE WHEN len(cl) = 0 AND len(fn) = 0 AND coalesce(code_lines, 0) < {30 if aggressive else 10} THEN '' ELSE coalesce(li.refs, '') END AS refs
FROM own o LEFT JOIN li USING (repo, path) LEFT JOIN be USING (repo, path)"""


def _packed(spark, sf_dir, aggressive: bool) -> DataFrame:
    files = _latest_files(spark, sf_dir, "classes", "functions", "imports", "lines", "code_lines")
    return packing_context.semantic_pack(files, ["repo"], aggressive)


@query("o96_semantic_pack", _pack_sql(False))
def o96_semantic_pack(spark, sf_dir):
    return _packed(spark, sf_dir, False).select("repo", "path", "packed_path", "collapsed", F.array_join("imports", ",").alias("imports"), F.array_join("refs", ",").alias("refs"))


@query("o96_aggressive_pack", _pack_sql(True))
def o96_aggressive_pack(spark, sf_dir):
    return _packed(spark, sf_dir, True).select("repo", "path", "packed_path", "collapsed", F.array_join("imports", ",").alias("imports"), F.array_join("refs", ",").alias("refs"))


@query("o96_pack_savings")
def o96_pack_savings(spark, sf_dir):
    return packing_context.pack_savings(_packed(spark, sf_dir, False), ["repo"])


_CRITICAL = "cs AS (SELECT repo, callee FROM call_edges WHERE callee IS NOT NULL GROUP BY 1, 2 ORDER BY count(DISTINCT caller) DESC, repo, callee LIMIT 20), cf AS (SELECT DISTINCT s.repo, s.file AS path FROM code_symbols s JOIN cs ON cs.repo = s.repo AND s.name = string_split(cs.callee, '.')[-1])"


@query(
    "o97_review_ranking",
    f"""WITH {_LATEST}, {_CRITICAL}, hi AS (SELECT repo, path, 0.8::DOUBLE AS score FROM cf SEMI JOIN lf USING (repo, path)), re AS (SELECT repo, path, least(1, code_lines / 500.0::DOUBLE) * 0.6::DOUBLE AS score FROM lf WHERE code_lines > 0 AND path IS NOT NULL AND repo NOT IN (SELECT repo FROM hi)),
u AS (SELECT repo, path, round(score, 6) AS score FROM (SELECT * FROM hi UNION ALL SELECT * FROM re)) SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY score DESC, path) AS INTEGER) AS rank FROM u QUALIFY rank <= 40""",
)
def o97_review_ranking(spark, sf_dir):
    top = base.o63_critical_symbols(spark, sf_dir).select("repo", F.element_at(F.split("callee", r"\."), -1).alias("name"))
    critical = table(spark, sf_dir, "code_symbols").join(top, ["repo", "name"], "left_semi").select("repo", F.col("file").alias("path"))
    return packing_context.review_ranking(_latest_files(spark, sf_dir, "code_lines"), critical, ["repo"])


# ---- impact, lookup, answers --------------------------------------------------------------------
_IMPACT = f"""WITH RECURSIVE {_LATEST}, {base._HUBS}, {base._CLOSURE.format(to='e.src', on='e.dst = r.node', more='')}, af AS (SELECT repo, start, node, depth FROM reach WHERE depth > 0),
ct AS (SELECT repo, start, count(*) FILTER (depth = 1) AS direct_count, count(*) FILTER (depth > 1) AS indirect_count, count(*) AS total_affected FROM af GROUP BY 1, 2), tf AS (SELECT repo, count(*) AS n FROM lf GROUP BY 1),
nm AS (SELECT repo, path AS node, array_to_string(list_filter(coalesce(classes, []) || coalesce(functions, []), lambda x: x IS NOT NULL), ' ') AS t FROM lf), ch AS (SELECT af.repo, af.start, unnest(string_split(t, '')) AS c FROM af JOIN nm USING (repo, node)), cc AS (SELECT repo, start, c, count(*)::DOUBLE AS k FROM ch WHERE c <> '' GROUP BY ALL),
he AS (SELECT repo, start, abs(round(log2(sum(k)) - sum(k * log2(k)) / sum(k), 6)) AS chaos FROM cc GROUP BY 1, 2),
im AS (SELECT h.repo, h.start, coalesce(direct_count, 0) AS direct_count, coalesce(indirect_count, 0) AS indirect_count, coalesce(total_affected, 0) AS total_affected, round(coalesce(least(1, total_affected / tf.n::DOUBLE), 0), 6) AS impact_ratio, coalesce(chaos, 0) AS chaos FROM hubs h LEFT JOIN ct USING (repo, start) LEFT JOIN tf USING (repo) LEFT JOIN he USING (repo, start)),
pu AS (SELECT *, round((1 - impact_ratio) * (1 - 0.08::DOUBLE * (chaos / 8)), 6) AS pulse FROM im), pr AS (SELECT *, round(greatest(0, 1 - pulse), 6) AS pulse_risk, greatest(CASE WHEN impact_ratio <= 0.1 THEN 0 WHEN impact_ratio <= 0.3 THEN 2 WHEN impact_ratio <= 0.5 THEN 5 ELSE 6 END, CASE WHEN chaos <= 3 THEN 0 WHEN chaos <= 5 THEN 2 WHEN chaos <= 7 THEN 5 ELSE 6 END, CASE WHEN pulse > 0.65 THEN 0 ELSE 5 END) AS k FROM pu)
SELECT repo, start, direct_count, indirect_count, total_affected, impact_ratio, chaos, pulse_risk, round(least(1, (impact_ratio + chaos + pulse_risk) / 3), 4) AS composite_risk, CASE k WHEN 0 THEN 'STABLE' WHEN 2 THEN 'WEAK' WHEN 5 THEN 'UNSTABLE' ELSE 'DEGENERATE' END AS raw_state, CASE WHEN k = 0 THEN 'SAFE_TO_CHANGE' WHEN k IN (2, 5) THEN 'CAUTION' ELSE 'HIGH_RISK' END AS verdict FROM pr"""


@query("o103_impact_report", _IMPACT)
def o103_impact_report(spark, sf_dir):
    files = _latest_files(spark, sf_dir, "classes", "functions")
    return impact.impact_report(table(spark, sf_dir, "file_deps"), base._hubs(spark, sf_dir), files, ["repo"])


def _terms(spark, sf_dir) -> DataFrame:
    """Asked terms: the ends of the names of every fiftieth symbol, and the same backwards."""
    some = table(spark, sf_dir, "code_symbols").where("symbol_id % 50 = 0 AND name IS NOT NULL")
    end = F.substring("name", F.greatest(F.length("name") - 4, F.lit(1)), F.length("name"))
    return some.select("repo", F.explode(F.array(end, F.reverse(end))).alias("term"), (F.pmod("symbol_id", F.lit(7)) / F.lit(6.0)).alias("match_ratio"))


_TERMS = "te AS (SELECT repo, unnest([name[greatest(len(name) - 4, 1):], reverse(name[greatest(len(name) - 4, 1):])]) AS term, (symbol_id % 7) / 6.0::DOUBLE AS match_ratio FROM code_symbols WHERE symbol_id % 50 = 0 AND name IS NOT NULL), lo AS (SELECT t.repo, t.term, min(s.file) AS file FROM (SELECT DISTINCT repo, term FROM te WHERE len(term) > 0) t JOIN code_symbols s ON s.repo = t.repo AND contains(lower(s.name), lower(t.term)) AND s.file IS NOT NULL GROUP BY 1, 2)"


@query("o44_symbol_lookup", f"WITH {_TERMS} SELECT * FROM lo")
def o44_symbol_lookup(spark, sf_dir):
    return impact.find_symbols(_terms(spark, sf_dir), table(spark, sf_dir, "code_symbols"), ["repo"])


@query(
    "o104_answers",
    f"WITH {_TERMS} SELECT DISTINCT te.repo, te.term, CASE WHEN match_ratio >= 0.9 THEN 'strict' ELSE 'relaxed' END AS mode, CASE WHEN match_ratio >= 0.9 AND file IS NULL THEN 0 ELSE match_ratio END AS confidence, CASE WHEN match_ratio >= 0.9 THEN coalesce('[' || te.term || '] found in: ' || file, '{impact.NOT_FOUND}') END AS answer FROM te LEFT JOIN lo USING (repo, term)",
)
def o104_answers(spark, sf_dir):
    return impact.answers(_terms(spark, sf_dir), table(spark, sf_dir, "code_symbols"), ["repo"])


# ---- matrices ---------------------------------------------------------------------------------------
def _grid_vectors(spark, sf_dir) -> DataFrame:
    """The measures of every file as the rows (repo, i, j, v) of a matrix a repository."""
    grid = base._grid(spark, sf_dir).join(base._files(spark, sf_dir).select("file_id", "repo"), "file_id")
    return grid.select("repo", F.col("file_id").alias("i"), F.posexplode(F.array("s", "c", "p")).alias("j", "v"))


_GRAM = f"WITH {base._GRID}, r AS (SELECT f.repo, g.* FROM g JOIN source_files f USING (file_id)), gm AS (SELECT repo, sum(s * s) AS a, sum(s * c) AS b, sum(s * p) AS c, sum(c * c) AS e, sum(c * p) AS f, sum(p * p) AS i FROM r GROUP BY 1)"


@query("o57_gram_matrix", _GRAM + ", l AS (SELECT repo, unnest([a, b, c, b, e, f, c, f, i]) AS v, unnest([0, 0, 0, 1, 1, 1, 2, 2, 2]) AS i, unnest([0, 1, 2, 0, 1, 2, 0, 1, 2]) AS j FROM gm) SELECT repo, i::INTEGER AS i, j::INTEGER AS j, round(v, 6) AS v FROM l")
def o57_gram_matrix(spark, sf_dir):
    x = _grid_vectors(spark, sf_dir)
    across = x.select("repo", F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return Q.matmul(across, x, ["repo"]).select("repo", "i", "j", F.round("v", 6).alias("v"))


@query(
    "o57_condition",
    _GRAM
    + """, d AS (SELECT *, a * (e * i - f * f) - b * (b * i - f * c) + c * (b * f - e * c) AS det FROM gm), n AS (SELECT repo, det, greatest(abs(a) + abs(b) + abs(c), abs(b) + abs(e) + abs(f), abs(c) + abs(f) + abs(i)) AS norm,
greatest(abs(e * i - f * f) + abs(c * f - b * i) + abs(b * f - c * e), abs(f * c - b * i) + abs(a * i - c * c) + abs(c * b - a * f), abs(b * f - e * c) + abs(b * c - a * f) + abs(a * e - b * b)) AS adj FROM d)
SELECT repo, CASE WHEN abs(det) >= 1e-9 THEN round(log10(norm * adj / abs(det)), 4) END AS log_kappa FROM n""",
)
def o57_condition(spark, sf_dir):
    gram = Q.matmul(_grid_vectors(spark, sf_dir).select("repo", F.col("j").alias("i"), F.col("i").alias("j"), "v"), _grid_vectors(spark, sf_dir), ["repo"])
    at = lambda i, j: F.coalesce(F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("v"))), F.lit(0.0)).alias(f"m{i}{j}")
    wide = gram.groupBy("repo").agg(*[at(i, j) for i in range(3) for j in range(3)])
    m = [[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)]
    return wide.select("repo", F.round(F.log10(Q.row_norm(m) * Q.row_norm(Q.inverse(m))), 4).alias("log_kappa"))


ORACLES["o100_confidence"] = """WITH m AS (SELECT 1.00::DOUBLE AS a, 0.00::DOUBLE AS b, 0.00::DOUBLE AS c, 0.75::DOUBLE AS d, 0.15::DOUBLE AS e, 0.10::DOUBLE AS f, 0.70::DOUBLE AS g, 0.10::DOUBLE AS h, 0.20::DOUBLE AS i),
k AS (SELECT greatest(abs(a) + abs(b) + abs(c), abs(d) + abs(e) + abs(f), abs(g) + abs(h) + abs(i)) * greatest(abs(e * i - f * h) + abs(c * h - b * i) + abs(b * f - c * e), abs(f * g - d * i) + abs(a * i - c * g) + abs(c * d - a * f), abs(d * h - e * g) + abs(b * g - a * h) + abs(a * e - b * d)) / abs(a * (e * i - f * h) + b * (f * g - d * i) + c * (d * h - e * g)) AS kappa FROM m)
SELECT round(kappa, 6) AS kappa, round(kappa / 2.5, 6) AS stability, round(greatest(0, least(1, 1 / (1 + log10(kappa / 2.5)))), 3) AS confidence FROM k"""


@query("o99_secret_adjustment", f"WITH r AS ({base.ORACLES['o99_secret_risk']}) SELECT file_id, CASE WHEN risk <= 0 THEN 0 ELSE greatest(-0.1::DOUBLE, -risk * 0.1::DOUBLE) END AS adjustment FROM r")
def o99_secret_adjustment(spark, sf_dir):
    return base.o99_secret_risk(spark, sf_dir).select("file_id", Q.secret_adjustment(F.col("risk")).alias("adjustment"))


# ---- watching -------------------------------------------------------------------------------------------
_FEEDBACK = """WITH RECURSIVE ev AS (SELECT coalesce(data.command, 'unknown') AS weight, coalesce(data.savings_pct, 0) AS delta, coalesce(data.success, true) AS good, row_number() OVER (PARTITION BY coalesce(data.command, 'unknown') ORDER BY received_at NULLS FIRST, data.savings_pct NULLS FIRST, coalesce(data.success, true)) AS k FROM telemetry WHERE data IS NOT NULL),
f(weight, k, value, step, healed, dead, code) AS (SELECT DISTINCT weight, 0::BIGINT, 0::DOUBLE, 0, 0, false, 0 FROM ev UNION ALL SELECT weight, k, CASE WHEN heal THEN 1e-6::DOUBLE * (1 + healed) ELSE value END, CASE WHEN heal THEN 1 ELSE step END, healed + heal::INTEGER, dead, CASE WHEN heal THEN 1 WHEN dead THEN -1 ELSE 0 END
FROM (SELECT weight, k, value, step, healed, dead OR (step >= 2 AND healed > 2) AS dead, NOT dead AND step >= 2 AND healed <= 2 AS heal FROM (SELECT ev.weight, ev.k, f.value + CASE WHEN good THEN delta * 0.001::DOUBLE ELSE 0 END AS value, CASE WHEN good OR f.dead THEN f.step ELSE least(f.step + 1, 3) END AS step, f.healed, f.dead FROM f JOIN ev ON ev.weight = f.weight AND ev.k = f.k + 1)))
SELECT weight, round(value, 6) AS value, CASE WHEN dead THEN 'DEGENERATE' ELSE ['STABLE', 'WEAK', 'UNSTABLE', 'NEG_ZERO'][step + 1] END AS state, healed AS heal_count, code FROM f QUALIFY row_number() OVER (PARTITION BY weight ORDER BY k DESC) = 1"""


@query("o102_feedback", _FEEDBACK)
def o102_feedback(spark, sf_dir):
    d = F.col("data")
    events = table(spark, sf_dir, "telemetry").where(d.isNotNull()).select(F.coalesce(d.command, F.lit("unknown")).alias("weight"), F.unix_micros(F.col("received_at").cast("timestamp")).alias("seq"), d.savings_pct.alias("delta"), F.coalesce(d.success, F.lit(True)).alias("stable"))
    return watch.feedback(events).withColumn("value", F.round("value", 6))


@query("o114_watch_health", "SELECT coalesce(data.command, 'unknown') AS name, count(*) AS runs, count(*) FILTER (NOT coalesce(data.success, true)) AS errors, max(received_at) FILTER (coalesce(data.success, true)) AS last_ok, max(received_at) FILTER (NOT coalesce(data.success, true)) AS last_error FROM telemetry WHERE data IS NOT NULL GROUP BY 1")
def o114_watch_health(spark, sf_dir):
    d = F.col("data")
    return watch.health(table(spark, sf_dir, "telemetry").where(d.isNotNull()).select(F.coalesce(d.command, F.lit("unknown")).alias("name"), F.col("received_at").alias("at"), F.coalesce(d.success, F.lit(True)).alias("ok")))


@query("o108_next_run", "WITH r AS (SELECT coalesce(data.command, 'unknown') AS name, epoch_us(received_at) // 1000000 AS sec, coalesce(data.success, true) AS ok FROM telemetry WHERE data IS NOT NULL), l AS (SELECT name, max({'sec': sec, 'ok': ok}) AS l FROM r GROUP BY 1) SELECT name, l.sec + CASE WHEN l.ok THEN 30 ELSE 300 END AS next_at FROM l")
def o108_next_run(spark, sf_dir):
    d = F.col("data")
    runs = table(spark, sf_dir, "telemetry").where(d.isNotNull()).select(F.coalesce(d.command, F.lit("unknown")).alias("name"), F.floor(F.unix_micros(F.col("received_at").cast("timestamp")) / 1_000_000).alias("at"), F.coalesce(d.success, F.lit(True)).alias("ok"))
    return watch.retry_after(runs)
