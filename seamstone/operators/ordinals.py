"""Positions within groups of any size, without a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamstone.sources.checkpoints import cut_lineage


def with_ordinal(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """Add the 1-based position of every row in its group.

    Rows are range-partitioned by group and order, numbered within their
    partition, and moved on by what the group has in earlier partitions.  The
    second window runs over one row per (group, partition).  ``order`` must be
    total within a group; nulls come first.
    """
    keys = [*group, *order]
    ranged = cut_lineage(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy("_part", *group).orderBy(*order)
    counts = ranged.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = ranged.withColumn("_local", F.row_number().over(local)).alias("r")
    same = F.col("r._part") == F.col("o._part")
    for g in group:
        same = same & F.col(f"r.{g}").eqNullSafe(F.col(f"o.{g}"))
    joined = numbered.join(offsets.alias("o"), same)
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], (F.col("r._local") + F.col("o._before")).alias(name))


def with_previous(df: DataFrame, group: Sequence[str], value: str, ordinal: str = "ordinal", name: str = "previous") -> DataFrame:
    """Add the value at the position before, by an equi-join on the position (null at the first)."""
    before = df.select(*[F.col(g).alias(f"_{g}") for g in group], (F.col(ordinal) + 1).alias("_at"), F.col(value).alias(name))
    same = F.col(ordinal) == F.col("_at")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return df.join(before, same, "left").drop("_at", *[f"_{g}" for g in group])
