"""Sources: project trees, JSON lines, contexts, indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamstone.functions import text as T

#: Extensions that are scanned, and folders that never are.
EXTENSIONS = ("py", "md", "json", "js", "jsx", "ts", "tsx", "html", "css", "sql", "rs", "go", "c", "cpp", "h", "hpp", "java", "cs", "php", "rb", "swift", "kt")
PRUNED = ("node_modules", ".venv", "venv", "dist", "build", ".git", "__pycache__", "target", "coverage", ".gradle", ".idea", ".vscode", ".cursor", ".gemini", ".claude", ".next", ".turbo", ".cache", "tmp", "logs")


def in_scope(path: Column, extensions: tuple[str, ...] = EXTENSIONS, pruned: tuple[str, ...] = PRUNED) -> Column:
    """Whether a path has a scanned extension and lies in no pruned folder."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return T.extension(path).isin(*extensions) & ~F.arrays_overlap(folders, F.array(*map(F.lit, pruned)))


def _relative(root: str) -> Column:
    return F.regexp_replace("path", r"^file:/*" + root.strip("/").replace(".", r"\.") + "/", "")


def scan_project(spark: SparkSession, root: str, max_files: int | None = None, pruned: tuple[str, ...] = PRUNED) -> DataFrame:
    """``path, size, lines, code_lines, hash, content`` of a tree's files; undecodable ones are left out.

    All files are scanned unless ``max_files`` limits the scan to the first
    ones by path; these are chosen without reading contents.  ``pruned`` are
    the folders left out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).withColumn("path", _relative(root)).where(in_scope(F.col("path"), pruned=pruned))
    if max_files is not None:
        raw = raw.join(raw.select("path").orderBy("path").limit(max_files), "path", "left_semi")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    decoded = raw.select("path", F.sha2("content", 256).alias("hash"), text.alias("content")).where(F.col("content").isNotNull())
    c = F.col("content")
    return decoded.select("path", F.length(c).cast("long").alias("size"), F.size(T.split_lines(c)).alias("lines"), T.code_lines(c).alias("code_lines"), "hash", "content")


def stat_scan(spark: SparkSession, root: str) -> DataFrame:
    """``path, mtime, size`` without reading contents."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return raw.select(_relative(root).alias("path"), F.unix_micros("modificationTime").alias("mtime"), F.col("length").alias("size")).where(in_scope(F.col("path")))


def hash_scan(spark: SparkSession, root: str) -> DataFrame:
    """``path, hash`` of a tree's files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return raw.select(_relative(root).alias("path"), F.sha2("content", 256).alias("hash")).where(in_scope(F.col("path")))


EVENT_SCHEMA = "ts STRING, event STRING, data STRUCT<command: STRING, duration_sec: DOUBLE, files: INT, tokens_saved: INT, savings_pct: DOUBLE, success: BOOLEAN, mode: STRING>, session STRING"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry lines; unreadable ones are dropped."""
    return spark.read.schema(EVENT_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def project_type(files: DataFrame, indicators: DataFrame) -> DataFrame:
    """The project type whose indicators (type, pattern) score most: 2 for a file name, 1 for a suffix; ties by type.

    ``indicators`` is a fixed list of some dozen rows.
    """
    name = F.element_at(F.split("path", "/"), -1)
    named = files.select(name.alias("pattern")).distinct().withColumn("score", F.lit(2))
    suffixed = files.select(F.concat(F.lit("."), T.extension(F.col("path"))).alias("pattern")).distinct().withColumn("score", F.lit(1))
    hits = indicators.join(named.unionByName(suffixed), "pattern")
    return hits.groupBy("type").agg(F.sum("score").alias("score")).orderBy(F.desc("score"), "type").limit(1)
