"""Snapshots: diff, merge, freshness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str = "hash") -> DataFrame:
    """``keys, change`` (added, changed, removed, same) of every key of two snapshots with unique keys.

    A null value only equals a null value.
    """
    a = old.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_a"))
    b = new.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed").otherwise("same")
    return a.join(b, list(keys), "full_outer").select(*keys, change.alias("change"))


def merge(old: DataFrame, new: DataFrame, removed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``old`` without those removed or replaced, and all rows of ``new``."""
    gone = removed.select(*keys).unionByName(new.select(*keys)).distinct()
    return old.join(gone, list(keys), "left_anti").unionByName(new)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], first: bool = False) -> DataFrame:
    """The last (or first) row of every key by a total order, as a mergeable aggregate: no window, no sort of a key's rows."""
    rest = [c for c in df.columns if c not in keys]
    pick = (F.min if first else F.max)(F.struct(*order, *[c for c in rest if c not in order]))
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def staleness(changes: DataFrame) -> DataFrame:
    """One row: totals, stale ratio (to three places) and what it recommends."""
    n = changes.agg(
        F.count_if(F.col("change") != "added").alias("total_files"), F.count_if(F.col("change").isin("changed", "removed")).alias("stale_files"), F.count_if(F.col("change") == "added").alias("new_files")
    )
    ratio = F.round(F.coalesce(F.try_divide(F.col("stale_files"), F.col("total_files")), F.lit(0.0)), 3)
    return n.withColumn("stale_ratio", ratio).withColumn("recommendation", F.when(F.col("stale_ratio") > 0.1, "RESCAN").when(F.col("stale_ratio") == 0, "OK").otherwise("PARTIAL_RESCAN"))


def verify_hash(files: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, fresh``: whether each file's hash is the stored one; a missing file or hash is stale."""
    return stored.select(*keys, F.col("hash").alias("_stored")).join(files.select(*keys, "hash"), list(keys), "left").select(*keys, F.coalesce(F.col("hash") == F.col("_stored"), F.lit(False)).alias("fresh"))


def set_difference(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys, value, side`` of what only one of two (keys, value) relations holds: only_left or only_right."""
    tag = lambda df, n: df.select(*keys, value).where(F.col(value).isNotNull()).distinct().withColumn("_s", F.lit(n))
    both = tag(left, 1).unionByName(tag(right, 2)).groupBy(*keys, value).agg(F.sum("_s").alias("_s"))
    return both.where(F.col("_s") < 3).select(*keys, value, F.when(F.col("_s") == 1, "only_left").otherwise("only_right").alias("side"))


def stat_changes(old: DataFrame, new: DataFrame, keys: Sequence[str], tolerance: float = 0.01) -> DataFrame:
    """``keys, change`` of two (keys, mtime, size) snapshots; times within the tolerance (seconds) are equal."""
    a = old.select(*keys, F.col("mtime").alias("_m"), F.col("size").alias("_s"), F.lit(True).alias("_a"))
    b = new.select(*keys, "mtime", "size", F.lit(True).alias("_b"))
    same = F.coalesce((F.abs(F.col("_m") - F.col("mtime")) <= tolerance) & (F.col("_s") == F.col("size")), F.lit(False))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(same, "same").otherwise("changed")
    return a.join(b, list(keys), "full_outer").select(*keys, change.alias("change"))


def diff_summary(changes: DataFrame) -> DataFrame:
    """One row of text: how many keys were added, modified and removed."""
    n = lambda k: F.count_if(F.col("change") == k).cast("string")
    return changes.agg(F.concat_ws(", ", F.concat(n("added"), F.lit(" added")), F.concat(n("changed"), F.lit(" modified")), F.concat(n("removed"), F.lit(" removed"))).alias("summary"))
