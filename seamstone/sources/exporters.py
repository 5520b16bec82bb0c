"""Rendering of file structure for other tools, one text per file, and its writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most classes and functions that each format shows of a file.
LIMITS = {"markdown": (5, 10), "yaml": (3, 5), "xml": (3, 5), "text": (5, 10), "json": (10, 20)}


def render(files: DataFrame, style: str) -> DataFrame:
    """``repo, path, body`` of every file in one of the styles of ``LIMITS``; names are sorted, null lists are empty."""
    n_classes, n_functions = LIMITS[style]
    some = lambda c, n: F.slice(F.array_sort(F.array_distinct(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull()))), 1, n)
    cls, fns = some("classes", n_classes), some("functions", n_functions)
    if style == "json":
        body = F.to_json(F.struct("path", cls.alias("classes"), fns.alias("functions")))
    elif style == "markdown":
        body = F.concat(F.lit("- **"), F.col("path"), F.lit("**: "), F.array_join(cls, ", "), F.lit("; "), F.array_join(fns, ", "))
    elif style == "yaml":
        body = F.concat(F.lit("- path: "), F.col("path"), F.lit("\n  classes: ["), F.array_join(cls, ", "), F.lit("]\n  functions: ["), F.array_join(fns, ", "), F.lit("]"))
    elif style == "xml":
        body = F.concat(F.lit('<file path="'), F.col("path"), F.lit('"><classes>'), F.array_join(cls, ","), F.lit("</classes><functions>"), F.array_join(fns, ","), F.lit("</functions></file>"))
    else:
        body = F.concat_ws(" | ", "path", F.array_join(cls, " "), F.array_join(fns, " "))
    return files.select("repo", "path", body.alias("body"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write JSON lines by Spark's commit protocol: readers see all files of a job or none."""
    df.write.mode(mode).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_index(df: DataFrame, path: str, id_col: str, buckets: int = 64) -> None:
    """Write a fingerprint index in hash buckets of its ids."""
    df.withColumn("bucket", F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
