"""Weights kept between runs: a small table of (i, j, value, state, heal_count)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "i INT, j INT, value DOUBLE, state STRING, heal_count INT"


def save_weights(weights: DataFrame, path: str) -> None:
    """Write the weights as JSON lines, all or nothing."""
    weights.select("i", "j", "value", "state", "heal_count").coalesce(1).write.mode("overwrite").json(path)


def load_weights(spark: SparkSession, path: str, n: int = 3) -> DataFrame:
    """The saved weights; an ``n`` x ``n`` matrix of stable zeros where none were saved."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(SCHEMA).json(path)
    return spark.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j"), F.lit(0.0).alias("value"), F.lit("STABLE").alias("state"), F.lit(0).alias("heal_count"))
