"""Cutting lineage with tables written to the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; an own one only where none is set (local tests)."""
    sc = spark.sparkContext
    given = sc._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    folder = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="seamstone-checkpoint-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession) -> str:
    """A new path in the shared folder; it is removed when the program ends."""
    if not _own:
        atexit.register(_remove_all)
    path = f"{shared_folder(spark)}/seamstone-{uuid.uuid4().hex}"
    _own[path] = spark
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared folder and read on from there.

    A lost executor costs the tasks it ran, not what came before; the size of
    the written table is known to the planner.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._seamstone_folder = path
    return made


def release(*tables: DataFrame) -> None:
    """Remove tables of ``cut_lineage`` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_seamstone_folder", None)
        spark = _own.pop(path, None)
        if spark is not None:
            remove_folder(spark, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of any file system, if it is there."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _remove_all() -> None:
    for path, spark in list(_own.items()):
        try:
            remove_folder(spark, path)
        except Exception:  # the session may be gone before the program ends
            return
