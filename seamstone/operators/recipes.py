"""Recipes: structured summaries of code, logs, JSON and documents, with their constraints."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamstone.functions import text as T
from seamstone.functions.arrowmap import map_rows

#: Allowed fields, forbidden words and compression target of each recipe.
CONSTRAINTS = {
    "code": (("classes", "functions", "imports"), ("speculative", "commentary", "guess"), 0.80),
    "log": (("counts", "patterns", "anomalies", "severity_summary"), ("comment", "cause-effect", "suggestion", "probably", "guess"), 0.90),
    "config": (("sections", "keys", "types", "defaults", "overrides"), ("suggestion", "comment", "reason", "how", "probably", "guess"), 0.90),
    "documentation": (("headers", "summary", "keywords", "links"), ("comment", "probably", "opinion"), 0.95),
}
MAX_CHARS = 1_000_000


def code_recipe(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines that define or import, counted per row; rows without lines are left out."""
    line = df.where(F.col(text_col).isNotNull()).select(id_col, F.explode(T.split_lines(F.col(text_col))).alias("line"))
    has = lambda x: F.col("line").contains(x)
    return line.groupBy(id_col).agg(F.count_if(has("class ")).alias("class_lines"), F.count_if(has("def ")).alias("def_lines"), F.count_if(has("import ") | has("from ")).alias("import_lines"))


def log_recipe(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Level counts (the first level word of a line counts) and anomalies per row, without a shuffle."""
    lines = T.split_lines(F.col(text_col))
    n = lambda level: F.size(F.filter(lines, lambda x: F.coalesce(T.log_level(x) == level, F.lit(False)))).cast("long")
    return df.where(F.col(text_col).isNotNull()).select(
        id_col, n("INFO").alias("info"), n("ERROR").alias("error"), n("WARNING").alias("warning"), n("DEBUG").alias("debug"), F.size(F.filter(lines, T.is_anomaly)).cast("long").alias("anomalies")
    )


def log_anomalies(df: DataFrame, id_col: str, text_col: str, most: int = 15, chars: int = 120) -> DataFrame:
    """``id_col, pos, anomaly``: the first ``most`` lines that name an anomaly, their first ``chars`` characters (the recipe's form)."""
    found = F.slice(F.filter(T.split_lines(F.col(text_col)), T.is_anomaly), 1, most)
    return df.select(id_col, F.posexplode(found).alias("pos", "line")).select(id_col, "pos", F.substring(F.trim("line"), 1, chars).alias("anomaly"))


def shape_of(value: object, depth: int = 0) -> object:
    """Types of a JSON value to a depth of three and five keys a level."""
    if depth > 3:
        return "..."
    if isinstance(value, dict):
        some = {k: {"type": type(v).__name__, "val": shape_of(v, depth + 1)} for k, v in list(value.items())[:5]}
        return some | ({"_etc": f"{len(value) - 5} keys"} if len(value) > 5 else {})
    if isinstance(value, list):
        return {"list_of": sorted({type(v).__name__ for v in value}), "len": len(value), "sample": shape_of(value[0], depth + 1)} if value else []
    return type(value).__name__


_CONFIG = [("sections", pa.list_(pa.string())), ("n_keys", pa.int32()), ("types", pa.string()), ("violation", pa.string())]


def config_recipe(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``id_col, sections, n_keys, types, violation`` of JSON texts; unreadable ones carry the violation output_format."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = df.schema[id_col].dataType

    def make():
        def call(rec_id, text):
            try:
                value = json.loads((text or "").strip())
            except (ValueError, RecursionError):
                yield rec_id, None, None, None, "output_format"
                return
            keys = list(value) if isinstance(value, dict) else []
            yield rec_id, keys[:50] + ["..."] * (len(keys) > 50), len(value) if isinstance(value, (dict, list)) else 0, json.dumps(shape_of(value), ensure_ascii=False), None

        return call

    return map_rows(df, [id_col, json_col], make, f"`{id_col}` {id_type.simpleString()}, sections ARRAY<STRING>, n_keys INT, types STRING, violation STRING", pa.schema([(id_col, to_arrow_type(id_type)), *_CONFIG]))


def doc_results(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, result``: the documentation recipe as a map of fields."""
    t = F.col(text_col)
    links = F.slice(F.filter(T.split_lines(t), lambda x: x.contains("http") & (x.contains("href") | x.contains("src"))), 1, 10)
    fields = F.create_map(
        F.lit("headers"), F.array_join(T.headers(t), "\n"), F.lit("summary"), F.concat(F.lit("Document length: "), F.size(T.split_lines(t)), F.lit(" lines.")), F.lit("keywords"), F.array_join(T.keywords(t), " "), F.lit("links"), F.array_join(links, "\n")
    )
    return df.where(t.isNotNull()).select(id_col, fields.alias("result"))


def _broken(recipe: str) -> Column:
    """The first constraint that ``result`` breaks: a field not allowed, a forbidden word anywhere in its text, its size."""
    allowed, forbidden, _ = CONSTRAINTS[recipe]
    text = F.lower(F.to_json("result"))
    extra = F.size(F.array_except(F.map_keys("result"), F.array(*map(F.lit, allowed)))) > 0
    words = functools.reduce(lambda a, b: a | b, [text.contains(w) for w in forbidden])
    return F.when(extra, "allowed_fields").when(words, "forbidden_content").when(F.length(text) > MAX_CHARS, "max_tokens")


def validate(results: DataFrame, id_col: str, recipe: str, determinism: str = "hard") -> DataFrame:
    """``id_col, constraint, decision``: the first constraint a result breaks, null where it keeps all.

    Hard determinism aborts, soft determinism discards.
    """
    verdict = "abort" if determinism == "hard" else "discard"
    return results.select(id_col, _broken(recipe).alias("constraint")).withColumn("decision", F.when(F.col("constraint").isNotNull(), verdict).otherwise("keep"))


def tuned_constraints(df: DataFrame, id_col: str, text_col: str, default: float = 0.8) -> DataFrame:
    """``id_col, target, determinism`` by a text's entropy; every row by itself."""
    h = F.round(T.entropy(F.col(text_col)), 6)
    return df.where(F.length(text_col) > 0).select(id_col, h.alias("h")).select(id_col, F.when(F.col("h") > 4.5, 0.65).when(F.col("h") < 2.5, 0.95).otherwise(default).alias("target"), F.when(F.col("h") > 4.5, "soft").otherwise("hard").alias("determinism"))


_FILE_MARK = re.compile(r"^--- FILE: (.*?) ---[ \t]*\r?\n", re.M)
_SCRIPT_TAG = re.compile(r"<script.*?>(.*?)</script>", re.I | re.S)


def segments_of(text: str | None) -> list[tuple[str, str, int]]:
    """(kind, body, offset) of a mixed text: marked files, or scripts and the text between them."""
    text = text or ""
    marks = list(_FILE_MARK.finditer(text))
    if marks:
        ends = [m.start() for m in marks[1:]] + [len(text)]
        return [("code" if m[1].lower().endswith((".py", ".js", ".ts", ".sql")) else "documentation", text[m.end() : end].strip(), m.start()) for m, end in zip(marks, ends)]
    out, at = [], 0
    for m in _SCRIPT_TAG.finditer(text):
        before = text[at : m.start()].strip()
        out += [("documentation", before, at)] * (len(before) > 20) + [("code", m[1].strip(), m.start())] * (len(m[1].strip()) > 10)
        at = m.end()
    rest = text[at:].strip()
    return out + [("documentation", rest, at)] * (len(rest) > 20 or not out)


def segments(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, pos, seg_type, body, start`` of every segment; null and empty texts have one empty segment."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = df.schema[id_col].dataType

    def make():
        return lambda rec_id, text: ((rec_id, pos, *s) for pos, s in enumerate(segments_of(text)))

    schema = pa.schema([(id_col, to_arrow_type(id_type)), ("pos", pa.int32()), ("seg_type", pa.string()), ("body", pa.string()), ("start", pa.int32())])
    return map_rows(df, [id_col, text_col], make, f"`{id_col}` {id_type.simpleString()}, pos INT, seg_type STRING, body STRING, start INT", schema)


def code_results(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, result``: the code recipe as a map of fields, lines joined by line ends."""
    lines = F.transform(T.split_lines(F.col(text_col)), lambda x: F.trim(x))
    some = lambda *words: F.array_join(F.filter(lines, lambda x: functools.reduce(lambda a, b: a | b, [x.contains(w) for w in words])), "\n")
    fields = F.create_map(F.lit("classes"), some("class "), F.lit("functions"), some("def "), F.lit("imports"), some("import ", "from "))
    return df.where(F.col(text_col).isNotNull()).select(*[c for c in df.columns if c != text_col], fields.alias("result"))


def pipeline(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, segments, ok, degraded, raw_chars, recipe_chars, status`` of every text.

    Every segment is put through the recipe of its type (code or
    documentation) and the result validated by that recipe's constraints; a
    segment that breaks one is degraded and counts no recipe characters.  A text is stable
    where no segment is degraded.
    """
    seg = segments(df, id_col, text_col).withColumn("_seg", F.struct(id_col, "pos"))
    done = None
    for kind, recipe, run in (("code", "code", code_results), ("documentation", "documentation", doc_results)):
        own = seg.where(F.col("seg_type") == kind).select("_seg", "body")
        made = run(own, "_seg", "body").select("_seg", "result")
        checked = made.select("_seg", _broken(recipe).alias("broken"), F.length(F.to_json("result")).alias("chars"))
        done = checked if done is None else done.unionByName(checked)
    bad = F.col("broken").isNotNull()
    per = done.groupBy(F.col(f"_seg.{id_col}").alias(id_col)).agg(F.count(F.lit(1)).alias("segments"), F.count_if(~bad).alias("ok"), F.count_if(bad).alias("degraded"), F.coalesce(F.sum(F.when(~bad, F.col("chars"))), F.lit(0)).alias("recipe_chars"))
    raw = df.select(id_col, F.length(F.coalesce(text_col, F.lit(""))).alias("raw_chars"))
    return per.join(raw, id_col).select(id_col, "segments", "ok", "degraded", "raw_chars", "recipe_chars", F.when(F.col("degraded") == 0, "stable").otherwise("degraded").alias("status"))
