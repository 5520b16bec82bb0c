"""Making a context smaller: shared imports, path aliases, collapsed files, task rankings, sampling."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamstone.functions import text as T
from seamstone.operators import graph
from seamstone.operators.ordinals import with_ordinal, with_previous

#: Relations, weights, depth and cap of each task.
TASKS = {
    "bugfix": ({"target": 1.0, "direct": 0.8, "reverse": 0.6}, 1, 15),
    "feature": ({"target": 1.0, "direct": 0.7, "indirect": 0.4}, 2, 25),
    "refactor": ({"target": 1.0, "direct": 0.8, "reverse": 0.9, "indirect": 0.5}, 3, 30),
}


def shared_values(df: DataFrame, id_col: str, list_col: str, least: int = 3) -> DataFrame:
    """``value, n`` of list elements that at least ``least`` rows hold."""
    each = df.select(id_col, F.explode(F.array_distinct(list_col)).alias("value")).where(F.col("value").isNotNull() & (F.col("value") != ""))
    return each.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def path_prefixes(df: DataFrame, path_col: str, least: int = 3) -> DataFrame:
    """``prefix, n``: folders that at least ``least`` paths begin with."""
    parts = F.split(path_col, "/")
    prefixes = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: i < F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    each = df.where(F.col(path_col).isNotNull()).select(F.explode(prefixes).alias("prefix"))
    return each.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def collapse(files: DataFrame, threshold: int = 10) -> DataFrame:
    """Add ``collapsed``: no class, no function and fewer than ``threshold`` code lines."""
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    return files.withColumn("collapsed", empty("classes") & empty("functions") & (F.coalesce("code_lines", F.lit(0)) < threshold))


def semantic_pack(files: DataFrame, within: list[str], aggressive: bool = False) -> DataFrame:
    """``within..., path, packed_path, imports, refs, collapsed, before_chars, after_chars`` of every file, all stages chained.

    ``files`` holds (within..., path, classes, functions, imports, lines,
    code_lines) with one row a path; within names one context.  Imports that
    occur three times or more in a context are replaced by references I0, I1,
    ... in their order; folders that hold three files or more by @a/, @b/, ...
    (after z by numbers), the longest folder first; files without symbols and
    with fewer than 10 code lines (30 where ``aggressive``) collapse to their
    path.  Null lists are empty, null elements are left out.  References and
    aliases are numbered by range partitions, so a context of any size needs
    no single task.
    """
    names = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())
    own = files.where(F.col("path").isNotNull()).select(*within, "path", names("classes").alias("classes"), names("functions").alias("functions"), names("imports").alias("raw"), "lines", "code_lines")
    each = own.select(*within, "path", F.posexplode("raw").alias("at", "value"))
    shared = each.groupBy(*within, "value").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").drop("n")
    index = with_ordinal(shared, within, ["value"]).select(*within, "value", F.concat(F.lit("I"), (F.col("ordinal") - 1).cast("string")).alias("ref"))
    placed = each.join(index, [*within, "value"], "left").groupBy(*within, "path").agg(F.array_sort(F.collect_list(F.struct("at", "value", "ref"))).alias("all"))
    lists = placed.select(*within, "path", F.transform(F.filter("all", lambda x: x.getField("ref").isNull()), lambda x: x.getField("value")).alias("imports"), F.transform(F.filter("all", lambda x: x.getField("ref").isNotNull()), lambda x: x.getField("ref")).alias("refs"))

    folder = F.regexp_extract("path", r"^(.*/)[^/]*$", 1)
    frequent = own.select(*within, folder.alias("prefix")).where("prefix <> ''").groupBy(*within, "prefix").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select(*within, "prefix", (-F.length("prefix")).alias("by"))
    number = F.col("ordinal").cast("int") - 1
    alias = F.concat(F.lit("@"), F.when(number < 26, F.char(number + 97)).otherwise(number.cast("string")), F.lit("/"))
    table = with_ordinal(frequent, within, ["by", "prefix"]).select(*within, "prefix", "ordinal", alias.alias("alias"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    best = own.where(F.size(parts) > 1).select(*within, "path", F.explode(above).alias("prefix")).join(table, [*within, "prefix"]).groupBy(*within, "path").agg(F.min(F.struct("ordinal", "prefix", "alias")).alias("b"))
    packed_path = F.coalesce(F.concat("b.alias", F.substring("path", F.length("b.prefix") + 1, F.length("path"))), F.col("path"))

    none = F.array().cast("array<string>")
    empty = (F.size("classes") == 0) & (F.size("functions") == 0) & (F.coalesce("code_lines", F.lit(0)) < (30 if aggressive else 10))
    out = own.join(lists, [*within, "path"], "left").join(best, [*within, "path"], "left").withColumn("packed_path", packed_path).withColumn("collapsed", empty)
    out = out.withColumn("imports", F.when(F.col("collapsed"), none).otherwise(F.coalesce("imports", none))).withColumn("refs", F.when(F.col("collapsed"), none).otherwise(F.coalesce("refs", none)))
    before = F.length(F.to_json(F.struct("path", "classes", "functions", F.col("raw").alias("imports"), "lines", "code_lines")))
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    kept = F.to_json(F.struct(F.col("packed_path").alias("path"), some("classes"), some("functions"), some("imports"), some("refs"), "lines", "code_lines"))
    after = F.when(F.col("collapsed"), F.length(F.to_json(F.struct(F.col("packed_path").alias("path"), F.lit(True).alias("_collapsed"))))).otherwise(F.length(kept))
    return out.select(*within, "path", "packed_path", "imports", "refs", "collapsed", before.alias("before_chars"), after.alias("after_chars"))


def pack_savings(packed: DataFrame, within: list[str]) -> DataFrame:
    """``within..., files, collapsed_files, before_chars, after_chars, savings_pct`` of packed contexts."""
    per = packed.groupBy(*within).agg(F.count(F.lit(1)).alias("files"), F.count_if("collapsed").alias("collapsed_files"), F.sum("before_chars").alias("before_chars"), F.sum("after_chars").alias("after_chars"))
    return per.withColumn("savings_pct", savings(F.col("before_chars"), F.col("after_chars")))


#: Weights and cap of the review of a whole context, and the code lines that count in full.
REVIEW = {"critical": 0.8, "structure": 0.6, "fallback": 0.5, "cap": 40, "full_lines": 500}


def review_ranking(files: DataFrame, critical: DataFrame, within: list[str], weight: str = "structure") -> DataFrame:
    """``within..., path, score, rank`` of the files a review looks at, where no file is the target.

    ``critical`` (within..., path) are files of much-called symbols; a context
    that has some is reviewed by them alone.  Others are ranked by their code
    lines (``weight`` fallback: where another task has no target).  The cap is the feature.
    """
    own = files.where(F.col("path").isNotNull()).select(*within, "path", "code_lines")
    high = critical.select(*within, "path").distinct().join(own.select(*within, "path").distinct(), [*within, "path"], "left_semi").withColumn("score", F.lit(REVIEW["critical"]))
    rest = own.join(high.select(*within).distinct(), within, "left_anti").where(F.col("code_lines") > 0)
    rest = rest.groupBy(*within, "path").agg(F.max(F.least(F.lit(1.0), F.col("code_lines") / REVIEW["full_lines"]) * REVIEW[weight]).alias("score"))
    scored = high.unionByName(rest).withColumn("score", F.round("score", 6))
    rank = F.row_number().over(Window.partitionBy(*within).orderBy(F.desc("score"), F.asc("path")))
    return scored.withColumn("rank", rank).where(F.col("rank") <= REVIEW["cap"])


def task_ranking(deps: DataFrame, targets: DataFrame, task: str, within: list[str]) -> DataFrame:
    """``within..., start, node, score, rank`` of the files a task needs for each target, capped as the task says.

    A file's score is its best relation; indirect files count where nothing
    nearer does.  The cap is the feature: a context has a size.
    """
    weights, depth, cap = TASKS[task]
    edges = graph.edges_of(deps, "src", "dst", within)
    start = targets.select(*within, "start").distinct()
    out = start.select(*within, "start", F.col("start").alias("node"), F.lit(weights["target"]).alias("score"))
    hop = lambda e: start.join(e.withColumnRenamed("src", "start"), [*within, "start"]).select(*within, "start", F.col("dst").alias("node"))
    if "direct" in weights:
        out = out.unionByName(hop(edges).withColumn("score", F.lit(weights["direct"])))
    if "reverse" in weights:
        out = out.unionByName(hop(graph.transpose(edges)).withColumn("score", F.lit(weights["reverse"])))
    if "indirect" in weights:
        far = graph.closure(edges, start, within, depth).select(*within, "start", "node")
        near = out.select(*within, "start", "node").distinct()
        out = out.unionByName(far.join(near, [*within, "start", "node"], "left_anti").withColumn("score", F.lit(weights["indirect"])))
    best = out.groupBy(*within, "start", "node").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(*within, "start").orderBy(F.desc("score"), F.asc("node")))
    return best.withColumn("rank", rank).where(F.col("rank") <= cap)


def changes_in_entropy(df: DataFrame, group: list[str], order: list[str], text_col: str, threshold: float = 0.4) -> DataFrame:
    """Rows whose entropy differs from that of the row before in their group by more than ``threshold`` (0 before the first)."""
    h = df.select(*group, *order, F.round(F.coalesce(T.entropy(F.col(text_col)), F.lit(0.0)), 6).alias("h"))
    placed = with_previous(with_ordinal(h, group, order), group, "h")
    return placed.withColumn("delta", F.round(F.abs(F.col("h") - F.coalesce("previous", F.lit(0.0))), 6)).where(F.col("delta") > threshold).select(*group, *order, "h", "delta")


def chunk_weights(df: DataFrame, group: list[str], order: list[str], text_col: str, chunks: int = 10) -> DataFrame:
    """``group..., chunk, n, h, weight``: chunks of equal size of every group with their entropy share.

    The size of a chunk is a tenth of its group; a chunk's entropy is the mean
    of its rows' and its weight the ratio to the largest of the group.
    """
    h = df.select(*group, *order, F.round(F.coalesce(T.entropy(F.col(text_col)), F.lit(0.0)), 6).alias("h"))
    placed = with_ordinal(h, group, order)
    size = placed.groupBy(*group).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / chunks)).alias("size"))
    per = placed.join(size, group).groupBy(*group, F.floor((F.col("ordinal") - 1) / F.col("size")).alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("h"), 4).alias("h"))
    most = per.groupBy(*group).agg(F.max("h").alias("most"))
    return per.join(most, group).select(*group, "chunk", "n", "h", F.round(F.when(F.col("most") > 0, F.col("h") / F.col("most")).otherwise(0.0), 3).alias("weight"))


def sample_budget(weights: list[tuple[int, float, float]], ratio: float) -> list[int]:
    """Rows to take of each chunk (n, entropy, weight) while a budget of ``ratio`` of all lasts."""
    total = sum(n for n, _, _ in weights)
    left, before, out = max(1, int(total * ratio)), 0.0, []
    for n, h, w in weights:
        if abs(h - before) > 0.4:
            w = min(1.5 * w, 1.0)
        before = h
        w *= 0.3 if h > 7 else 0.6 if h > 5 else 1.0
        take = min(max(1, round(n * w * ratio * 2)), left, n)
        taken = 0 if take <= 0 else min(left, len(range(0, n, max(1, n // take))))
        out.append(taken)
        left -= taken
    return out


def adaptive_sample(df: DataFrame, order: list[str], text_col: str, ratio: float = 0.1) -> DataFrame:
    """Rows taken by entropy-weighted strides over a whole ordered table (a sampling operator).

    The table is cut into about ten chunks; their few statistics are the only
    thing the driver sees.  The first and last row always come along.
    """
    one = df.withColumn("_g", F.lit(0))
    h = one.select("_g", *df.columns, F.coalesce(T.entropy(F.col(text_col)), F.lit(0.0)).alias("_h"))
    placed = with_ordinal(h, ["_g"], order, "_pos")
    n = placed.count()
    if n == 0 or n <= max(1, int(n * ratio)):
        return df
    size = max(1, n // 10)
    chunk = F.floor((F.col("_pos") - 1) / size)
    stats = [(r["n"], r["h"]) for r in placed.groupBy(chunk.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.avg("_h").alias("h")).orderBy("c").collect()]
    most = max(h for _, h in stats) or 1.0
    takes = sample_budget([(k, h, h / most) for k, h in stats], ratio)
    steps, spans = [], []
    for (k, _), take in zip(stats, takes):
        step = max(1, k // take) if take else k + 1
        steps.append(step)
        spans.append(take * step)
    at = F.pmod(F.col("_pos") - 1, F.lit(size))
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (chunk + 1).cast("int"))
    kept = ((F.pmod(at, pick(steps)) == 0) & (at < pick(spans))) | (F.col("_pos") == 1) | (F.col("_pos") == n)
    return placed.where(kept).select(*df.columns)


# ---- compact JSON -------------------------------------------------------------
def short_name(name: str, most: int = 3) -> str:
    """Short form of a field name (see ``text.shorten_field``)."""
    if len(name) <= most:
        return name
    initials = "".join(p[0] for p in name.split("_") if p)
    if "_" in name and len(initials) >= 2:
        return initials
    capitals = [c for c in name if c.isupper()]
    return "".join(capitals).lower() if len(capitals) >= 2 else name[:most]


def compacted(value: object, places: int = 2) -> object:
    """A JSON value without nulls, blanks and empty collections, with short names and rounded numbers; None where nothing is left."""
    if isinstance(value, dict):
        pairs = ((short_name(k), compacted(v, places)) for k, v in value.items())
        return {k: v for k, v in pairs if v is not None} or None
    if isinstance(value, list):
        return [c for v in value if (c := compacted(v, places)) is not None] or None
    if isinstance(value, float):
        return round(value, places)
    if isinstance(value, str):
        return value.strip() or None
    return value


def compact_json(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``id_col, compact, chars, compact_chars`` of readable JSON texts; others have null ``compact``."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = df.schema[id_col].dataType
    schema = pa.schema([(id_col, to_arrow_type(id_type)), ("compact", pa.string()), ("chars", pa.int64()), ("compact_chars", pa.int64())])

    def one(text: str | None) -> str | None:
        try:
            made = compacted(json.loads(text)) if text else None
        except (ValueError, RecursionError):
            return None
        return json.dumps({} if made is None else made, ensure_ascii=False, separators=(",", ":"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            made = [one(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string()), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([None if m is None else len(m) for m in made], pa.int64())], schema=schema)

    return df.select(id_col, json_col).mapInArrow(run, f"`{id_col}` {id_type.simpleString()}, compact STRING, chars BIGINT, compact_chars BIGINT")


def dependency_summary(deps: DataFrame, within: list[str], top: int = 5) -> DataFrame:
    """The ``top`` most depended-on files of every group (a top-k report)."""
    per = deps.groupBy(*within, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(F.desc("n"), F.asc("node")))).where(F.col("rank") <= top)


def savings(before: Column, after: Column) -> Column:
    """Saved share in percent, to one place; 0 where there was nothing."""
    return F.round(F.coalesce((1 - F.try_divide(after, before)) * 100, F.lit(0.0)), 1)
