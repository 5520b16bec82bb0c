"""Dependency and call graphs: degrees, closures, leveled radius, ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamstone.sources.checkpoints import cut_lineage, release


def edges_of(df: DataFrame, src: str, dst: str, within: Sequence[str] = ()) -> DataFrame:
    """Distinct edges without nulls and loops as (within..., src, dst)."""
    return df.select(*within, F.col(src).alias("src"), F.col(dst).alias("dst")).where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).distinct()


def transpose(edges: DataFrame) -> DataFrame:
    """The same edges turned round."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(*rest, F.col("dst").alias("src"), F.col("src").alias("dst"))


def degrees(edges: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """``within..., node, indegree, outdegree, total`` in one aggregation over both ends."""
    ends = edges.select(*within, F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy(*within, F.col("e.node").alias("node")).agg(F.sum("e.i").alias("indegree"), F.sum("e.o").alias("outdegree"), F.count(F.lit(1)).alias("total"))


#: Rounds whose tables are kept apart before they are written as one.
_COMPACT = 8


def _all_of(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _as_one(parts: list[DataFrame]) -> DataFrame:
    one = cut_lineage(_all_of(parts))
    release(*parts)
    return one


def closure(edges: DataFrame, starts: DataFrame, within: Sequence[str] = (), max_depth: int | None = None, include_start: bool = False) -> DataFrame:
    """Nodes reachable from each start with their least depth: ``within..., start, node, depth``.

    ``starts`` holds (within..., start).  A frontier of new nodes is joined
    with the edges round by round.  A round writes its frontier only; eight
    are then written as one, and eight of those again, so what is written stays
    within a few times the result.  Runs until nothing new is found or ``max_depth`` is
    reached.  A start on a cycle is only reported at depth 0
    (``include_start``).
    """
    keys = [*within, "start", "node"]
    frontier = cut_lineage(starts.select(*within, "start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct())
    done, recent, depth = [], [frontier], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.withColumnRenamed("node", "src").join(edges, [*within, "src"]).select(*within, "start", F.col("dst").alias("node")).distinct()
        new = cut_lineage(step.join(_all_of([*done, *recent]).select(*keys), keys, "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            release(new)
            break
        recent.append(new)
        frontier = new
        if len(recent) > _COMPACT:
            done.append(_as_one(recent[:-1]))
            recent = recent[-1:]
            if len(done) > _COMPACT:
                done = [_as_one(done)]
    reached = _all_of([*done, *recent])
    return reached if include_start else reached.where(F.col("depth") > 0)


def neighbourhood(edges: DataFrame, starts: DataFrame, k: int, within: Sequence[str] = ()) -> DataFrame:
    """Nodes within ``k`` steps in either direction."""
    return closure(edges.unionByName(transpose(edges)).distinct(), starts, within, k)


def levels(edges: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Topological level of every node (``within..., node, level``): 0 where it depends on nothing left.

    Every node carries how many of its dependencies are left.  A round frees
    those with none and takes them off the counts of the nodes that depend on
    them; it writes one table, the counts of what is left.  Rounds go on until
    one frees nothing; nodes on a cycle or above one have null level.
    """
    edges = edges.select(*within, "src", "dst").distinct()
    ends = edges.select(*within, F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("n")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("n")))).alias("e"))
    left = cut_lineage(ends.groupBy(*within, F.col("e.node").alias("node")).agg(F.sum("e.n").alias("left")))
    done, level = [], 0
    while True:
        free = left.where(F.col("left") == 0).select(*within, "node")
        if free.isEmpty():
            break
        freed = cut_lineage(free.withColumn("level", F.lit(level)))
        done.append(freed)
        met = freed.select(*within, F.col("node").alias("dst")).join(edges, [*within, "dst"]).groupBy(*within, F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("met"))
        after = cut_lineage(left.where(F.col("left") > 0).join(met, [*within, "node"], "left").select(*within, "node", (F.col("left") - F.coalesce("met", F.lit(0))).alias("left")))
        release(left)
        left, level = after, level + 1
        if len(done) > _COMPACT:
            done = [_as_one(done)]
    stuck = left.select(*within, "node", F.lit(None).cast("int").alias("level"))
    return _all_of([*done, stuck])


def blast_radius(calls: DataFrame, targets: DataFrame, within: Sequence[str] = (), max_depth: int = 5) -> DataFrame:
    """Callers that a change of each target touches: ``within..., start, node, depth, score, category``.

    Only internal and recursive calls count.  Scores fall with the depth
    (1, 0.75, 0.5, 0.25), a tenth more for nodes with over five callers and a
    tenth less for those without any; bands name the category.
    """
    inside = edges_of(calls.where(F.col("call_type").isin("internal", "recursive")), "caller", "callee", within)
    found = closure(transpose(inside), targets, within, max_depth, include_start=True)
    callers = inside.groupBy(*within, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("callers"))
    scored = found.join(callers, [*within, "node"], "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
    base = F.element_at(F.array(*map(F.lit, (1.0, 0.75, 0.5, 0.25))), F.least(F.col("depth"), F.lit(3)) + 1)
    factor = F.when(F.col("callers") > 5, 1.1).when((F.col("callers") == 0) & (F.col("depth") > 0), 0.9).otherwise(1.0)
    score = F.round(F.least(F.lit(1.0), base * factor), 4)
    category = F.when(F.col("score") >= 0.85, "primary").when(F.col("score") >= 0.60, "direct").when(F.col("score") >= 0.35, "indirect").otherwise("ignored")
    return scored.withColumn("score", score).withColumn("category", category).select(*within, "start", "node", "depth", "callers", "score", "category")


def call_radius(calls: DataFrame, within: Sequence[str] = (), max_depth: int | None = None) -> DataFrame:
    """``within..., start, direct_calls, total`` of every node that is called.

    ``direct_calls`` counts its internal and recursive calls (repeated ones
    too, its own not), ``total`` the nodes that call it at any depth.
    """
    inside = calls.where(F.col("call_type").isin("internal", "recursive") & F.col("caller").isNotNull() & F.col("callee").isNotNull() & (F.col("caller") != F.col("callee")))
    direct = inside.groupBy(*within, F.col("callee").alias("start")).agg(F.count(F.lit(1)).alias("direct_calls"))
    found = closure(transpose(edges_of(inside, "caller", "callee", within)), direct.select(*within, "start"), within, max_depth)
    total = found.groupBy(*within, "start").agg(F.count(F.lit(1)).alias("total"))
    return direct.join(total, [*within, "start"], "left").select(*within, "start", "direct_calls", F.coalesce("total", F.lit(0)).alias("total"))


def resolve_short(nodes: DataFrame, names: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """The best node of each short name: ``within..., short, node, candidates, score, ambiguous``.

    ``nodes`` holds (within..., node, indegree, total), ``names`` (within...,
    short).  The score is twice the calls in and half of all calls; a second
    candidate within 1.0 makes the name ambiguous.  Candidates are reduced to
    the best two by a mergeable aggregate, so a name shared by very many nodes
    needs no window in one task.
    """
    short = nodes.withColumn("short", F.element_at(F.split("node", r"\."), -1)).withColumn("score", F.col("indegree") * 2.0 + F.col("total") * 0.5)
    wanted = short.join(names.select(*within, "short").distinct(), [*within, "short"], "left_semi")
    best = wanted.groupBy(*within, "short").agg(F.min(F.struct((-F.col("score")).alias("s"), "node")).alias("a"), F.count(F.lit(1)).alias("candidates"))
    rest = wanted.join(best.select(*within, "short", F.col("a.node").alias("node")), [*within, "short", "node"], "left_anti").groupBy(*within, "short").agg(F.max("score").alias("second"))
    return (
        best.join(rest, [*within, "short"], "left")
        .withColumn("score", -F.col("a.s"))
        .select(*within, "short", F.col("a.node").alias("node"), "candidates", "score", (F.coalesce(F.col("second") > 0, F.lit(False)) & F.coalesce(F.col("score") - F.col("second") < 1.0, F.lit(False))).alias("ambiguous"))
    )


def context_decision(radius: DataFrame, within: Sequence[str] = (), most: int = 50) -> DataFrame:
    """One row a target: files analysed and selected, the reduction and whether it reaches 0.6.

    At most ``most`` nodes are selected, indirect ones cut before direct ones
    (by depth, then name): the cap is the feature, a context has a size.
    """
    order = F.when(F.col("category") == "primary", 0).when(F.col("category") == "direct", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy(*within, "start").orderBy(order, "depth", "node"))
    kept = radius.where(F.col("category") != "ignored").withColumn("_place", place).where(F.col("_place") <= most)
    selected = kept.groupBy(*within, "start").agg(F.count(F.lit(1)).alias("selected"))
    all_of = radius.groupBy(*within, "start").agg(F.count(F.lit(1)).alias("analysed"))
    ratio = F.round((F.col("analysed") - F.coalesce("selected", F.lit(0))) / F.col("analysed"), 4)
    return all_of.join(selected, [*within, "start"], "left").select(*within, "start", "analysed", F.coalesce("selected", F.lit(0)).alias("selected"), ratio.alias("reduction"), (ratio >= 0.6).alias("reaches"))


def symbol_users(symbols: DataFrame, calls: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """``within..., file, name, users``: how many other files call what a file defines under a name.

    Users are counted per name first and the file's own use is taken off, so
    files are never paired and a name that very many files define and call
    costs one row a file.
    """
    defined = symbols.where(F.col("name").isNotNull()).select(*within, "file", "name").distinct()
    used = calls.where(F.col("callee").isNotNull()).select(*within, "file", F.element_at(F.split("callee", r"\."), -1).alias("name")).distinct()
    per_name = used.groupBy(*within, "name").agg(F.count(F.lit(1)).alias("n"))
    own = used.withColumn("own", F.lit(1))
    counted = defined.join(per_name, [*within, "name"]).join(own, [*within, "file", "name"], "left").withColumn("users", F.col("n") - F.coalesce("own", F.lit(0)))
    return counted.where(F.col("users") > 0).select(*within, "file", "name", "users")
