"""What a change touches: impact reports, symbol lookup and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamstone.functions import quality as Q
from seamstone.functions import text as T
from seamstone.operators import graph

#: Verdicts by the healed state.
VERDICTS = {"STABLE": "SAFE_TO_CHANGE", "WEAK": "CAUTION"}
#: Fixed value: the answer where nothing was found.
NOT_FOUND = "Information not found in sealed context."


def impact_report(deps: DataFrame, targets: DataFrame, files: DataFrame, within: list[str], kind: str = "Patch") -> DataFrame:
    """One row a target: direct and indirect dependents, impact ratio, chaos, pulse risk, composite risk and verdict.

    ``deps`` holds (within..., src, dst), ``targets`` (within..., start),
    ``files`` (within..., path, classes, functions) with one row a path.  The
    chaos is the entropy of the names that affected files define; characters
    are counted per file first, so no target's text is ever put together.
    Targets that nothing depends on come out with zeros.
    """
    keys = [*within, "start"]
    start = targets.select(*keys).distinct()
    back = graph.transpose(graph.edges_of(deps, "src", "dst", within))
    reached = graph.closure(back, start, within)
    counted = reached.groupBy(*keys).agg(F.count_if(F.col("depth") == 1).alias("direct_count"), F.count_if(F.col("depth") > 1).alias("indirect_count"), F.count(F.lit(1)).alias("total_affected"))
    total = files.groupBy(*within).agg(F.count(F.lit(1)).alias("total_files"))
    names = F.array_join(F.concat(F.coalesce("classes", F.array().cast("array<string>")), F.coalesce("functions", F.array().cast("array<string>"))), " ")
    chars = files.select(*within, F.col("path").alias("node"), F.explode(F.split(names, "")).alias("c")).where("c <> ''").groupBy(*within, "node", "c").agg(F.count(F.lit(1)).alias("k"))
    per = reached.select(*keys, "node").join(chars, [*within, "node"]).groupBy(*keys, "c").agg(F.sum("k").alias("k"))
    # -sum(p log p) = log n - sum(k log k) / n
    chaos = per.groupBy(*keys).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log2(F.col("k"))).alias("s")).select(*keys, F.abs(F.round(F.log2("n") - F.col("s") / F.col("n"), 6)).alias("chaos"))
    made = start.join(counted, keys, "left").join(total, within, "left").join(chaos, keys, "left").na.fill(0, ["direct_count", "indirect_count", "total_affected"]).na.fill(0.0, ["chaos"])
    ratio = F.round(F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("total_affected"), F.col("total_files")), F.lit(0.0))), 6)
    pulse = F.round(Q.pulse(1 - F.col("impact_ratio"), F.col("chaos") / 8, F.lit(kind)), 6)
    made = made.withColumn("impact_ratio", ratio).withColumn("pulse", pulse).withColumn("pulse_risk", F.round(F.greatest(F.lit(0.0), 1 - F.col("pulse")), 6))
    impact_state = F.when(F.col("impact_ratio") <= 0.1, "STABLE").when(F.col("impact_ratio") <= 0.3, "WEAK").when(F.col("impact_ratio") <= 0.5, "UNSTABLE").otherwise("DEGENERATE")
    raw = Q.combine(impact_state, T.entropy_state(F.col("chaos")), F.when(F.col("pulse") > 0.65, "STABLE").otherwise("UNSTABLE"))
    composite = F.round(F.least(F.lit(1.0), (F.col("impact_ratio") + F.col("chaos") + F.col("pulse_risk")) / 3), 4)
    healed = F.when(F.col("raw_state") == "UNSTABLE", "WEAK").otherwise(F.col("raw_state"))
    verdict = F.when(healed == "STABLE", VERDICTS["STABLE"]).when(healed == "WEAK", VERDICTS["WEAK"]).otherwise("HIGH_RISK")
    return made.withColumn("raw_state", raw).select(*keys, "direct_count", "indirect_count", "total_affected", "impact_ratio", "chaos", "pulse_risk", composite.alias("composite_risk"), "raw_state", verdict.alias("verdict"))


def find_symbols(terms: DataFrame, symbols: DataFrame, within: list[str]) -> DataFrame:
    """``within..., term, file``: the first file, by path, that defines a class or function whose name holds the term.

    Case does not matter.  A term is looked up by the rarest of its pieces of
    three characters (a shorter one by itself) in an index of the pieces of
    all names, and only what is found there is compared; names are reduced to
    their first file before that.  Terms that are null or empty, or are found
    nowhere, have no row.
    """
    names = symbols.where(F.col("name").isNotNull() & F.col("file").isNotNull()).groupBy(*within, F.lower("name").alias("name")).agg(F.min("file").alias("file"))
    pieces = lambda c, k: F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.substring(c, i, F.lit(k)))
    grams = lambda c: F.array_distinct(F.concat(*[F.when(F.length(c) >= k, pieces(c, k)).otherwise(F.array().cast("array<string>")) for k in (1, 2, 3)]))
    index = names.select(*within, "name", "file", F.explode(grams("name")).alias("gram"))
    asked = terms.where(F.length("term") > 0).select(*within, "term", F.lower("term").alias("low")).distinct()
    size = F.least(F.lit(3), F.length("low"))
    own = asked.select(*within, "term", "low", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("low") - size + 1), lambda i: F.substring("low", i, size)))).alias("gram"))
    common = index.groupBy(*within, "gram").agg(F.count(F.lit(1)).alias("n"))
    # a term one of whose pieces no name has is found nowhere
    rarest = own.join(common, [*within, "gram"], "left").groupBy(*within, "term", "low").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m")).where("m.n > 0").select(*within, "term", "low", "m.gram")
    return rarest.join(index, [*within, "gram"]).where(F.col("name").contains(F.col("low"))).groupBy(*within, "term").agg(F.min("file").alias("file"))


def answers(terms: DataFrame, symbols: DataFrame, within: list[str]) -> DataFrame:
    """``within..., term, mode, confidence, answer`` of asked terms (within..., term, match_ratio).

    Strict mode (from a ratio of 0.90) answers with the file a symbol is found
    in, or that nothing was found, with no confidence; relaxed mode answers nothing.
    """
    asked = terms.select(*within, "term", "match_ratio").distinct()
    found = asked.join(find_symbols(asked, symbols, within), [*within, "term"], "left").withColumn("mode", Q.answer_mode(F.col("match_ratio")))
    strict = F.col("mode") == "strict"
    hit = F.concat(F.lit("["), F.col("term"), F.lit("] found in: "), F.col("file"))
    return found.select(*within, "term", "mode", F.when(strict & F.col("file").isNull(), 0.0).otherwise(F.col("match_ratio")).alias("confidence"), F.when(strict, F.coalesce(hit, F.lit(NOT_FOUND))).alias("answer"))
