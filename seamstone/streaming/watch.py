"""Streams: watched files, telemetry, debounced changes and running counters.

Processing-time loops become file streams.  A watermark is only set where
state has to be evicted, and each function says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seamstone.functions.arrowmap import OUT_ROWS, to_batch
from seamstone.operators import incremental
from seamstone.sources.checkpoints import remove_folder
from seamstone.sources.scan import EVENT_SCHEMA


def telemetry_stream(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry lines as they are appended."""
    return spark.readStream.schema(EVENT_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def session_counters(events: DataFrame) -> DataFrame:
    """Running counters of every session (update mode; one row of state a session)."""
    d = F.col("data")
    return events.where(F.col("session").isNotNull()).groupBy("session").agg(F.count(F.lit(1)).alias("events"), F.sum(F.coalesce(d.files.cast("long"), F.lit(0))).alias("files"), F.sum(F.coalesce(d.tokens_saved.cast("long"), F.lit(0))).alias("tokens_saved"))


def quiet_periods(events: DataFrame, key: str, ts: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Bursts of a key that end with a quiet gap.  The watermark ``late`` lets state go; later events are dropped."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("first_ts"), "n")


def _debounce(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values("at")
    kept = []
    for at in rows["at"].tolist():
        if last is None or at - last >= 1_000_000:
            kept.append((key[0], at))
            last = at
    state.update((last,))
    yield pd.DataFrame(kept, columns=["path", "at"])


def debounced(changes: DataFrame) -> DataFrame:
    """Changes (path, at in microseconds) that come a second or more after the last kept one of the same path."""
    return changes.groupBy("path").applyInPandasWithState(_debounce, "path STRING, at BIGINT", "last BIGINT", "append", GroupStateTimeout.NoTimeout)


def watch(stream: DataFrame, snapshot: str, out: str, checkpoint: str, seconds: int | None = 30, full: DataFrame | None = None) -> StreamingQuery:
    """Diff each batch of (path, hash) against the stored snapshot, append the changes and store the merged snapshot.

    Within a batch the row with the greatest hash stands for a path, whatever
    the order they come in.  File streams show no deletions: where ``full``
    names the present files (path), those missing from it come out as removed.
    The snapshot goes to one folder per batch, so a batch that is run again
    gives the same result, and the one before the last is removed.  Only the
    first batch has no snapshot; that one cannot be read later on is an error.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        new = batch.groupBy("path").agg(F.max("hash").alias("hash"))
        old = new.limit(0) if number == 0 else spark.read.schema(new.schema).parquet(f"{snapshot}/{number - 1}")
        gone = old.select("path").limit(0)
        if full is not None:
            gone = old.select("path").join(full.select("path").unionByName(new.select("path")), "path", "left_anti")
        changes = incremental.diff(old, new, ["path"]).where(F.col("change").isin("added", "changed"))
        changes.unionByName(gone.withColumn("change", F.lit("removed"))).write.mode("overwrite").parquet(f"{out}/batch={number}")
        incremental.merge(old, new, gone, ["path"]).write.mode("overwrite").parquet(f"{snapshot}/{number}")
        if number > 1:
            remove_folder(spark, f"{snapshot}/{number - 2}")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def retry_after(runs: DataFrame, freshness: int = 30, backoff: int = 300) -> DataFrame:
    """``name, next_at`` of watch runs (name, at in seconds, ok): ``freshness`` after a good last run, ``backoff`` after a failed one."""
    last = runs.groupBy("name").agg(F.max(F.struct("at", "ok")).alias("last"))
    return last.select("name", (F.col("last.at") + F.when(F.col("last.ok"), F.greatest(F.lit(5), F.lit(freshness))).otherwise(F.greatest(F.lit(30), F.lit(backoff)))).alias("next_at"))


def health(events: DataFrame) -> DataFrame:
    """``name, runs, errors, last_ok, last_error`` of watch runs (name, at, ok)."""
    return events.groupBy("name").agg(F.count(F.lit(1)).alias("runs"), F.count_if(~F.col("ok")).alias("errors"), F.max(F.when(F.col("ok"), F.col("at"))).alias("last_ok"), F.max(F.when(~F.col("ok"), F.col("at"))).alias("last_error"))


#: States a weight steps down through, and how often one is healed.
LADDER = ("STABLE", "WEAK", "UNSTABLE", "NEG_ZERO")
HEAL_LIMIT = 2


class Weight:
    """One weight under feedback."""

    def __init__(self, rate: float, budget: int | None) -> None:
        self.rate, self.left = rate, budget
        self.value, self.at, self.healed, self.dead, self.code = 0.0, 0, 0, False, 0

    def take(self, delta: float | None, stable: bool | None) -> None:
        self.code = 0
        if stable:
            self.value += (delta or 0.0) * self.rate
        elif not self.dead:
            self.at = min(self.at + 1, len(LADDER) - 1)
        if not (self.dead or self.at >= 2):
            return
        if self.left is not None and self.left <= 0:
            self.code = -2
            return
        self.left = None if self.left is None else self.left - 1
        if self.dead or self.healed > HEAL_LIMIT:
            self.dead, self.code = True, -1
            return
        self.value, self.at, self.code = 1e-6 * (1 + self.healed), LADDER.index("WEAK"), 1
        self.healed += 1

    def row(self, name: object) -> tuple:
        return name, self.value, "DEGENERATE" if self.dead else LADDER[self.at], self.healed, self.code


def feedback(events: DataFrame, rate: float = 0.001, budget: int | None = None) -> DataFrame:
    """``weight, value, state, heal_count, code`` of every weight after its ordered feedback (weight, seq, delta, stable).

    Stable feedback adds ``delta * rate``; other feedback steps the state down.
    What then is unstable is healed to WEAK with a small value, at most
    HEAL_LIMIT times and once more, and while the weight's ``budget`` lasts;
    after that it is DEGENERATE.  ``code`` is that of the last feedback: 1
    healed, 0 nothing to heal, -1 healed too often, -2 no budget left.  Null
    weights are left out, a null delta counts as 0 and null stable as false.
    Feedback is sorted by the shuffle (which spills) and streamed: a task holds
    one weight's state, never its events.
    """
    schema = pa.schema([("weight", pa.string()), ("value", pa.float64()), ("state", pa.string()), ("heal_count", pa.int32()), ("code", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, weight, rows = None, None, []
        for batch in batches:
            for key, delta, stable in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if key != name or weight is None:
                    if weight is not None:
                        rows.append(weight.row(name))
                    name, weight = key, Weight(rate, budget)
                weight.take(delta, stable)
            if len(rows) >= OUT_ROWS:
                yield to_batch(rows, schema)
                rows = []
        if weight is not None:
            yield to_batch([*rows, weight.row(name)], schema)

    ordered = events.where(F.col("weight").isNotNull()).select(F.col("weight").cast("string"), F.col("delta").cast("double"), F.col("stable").cast("boolean"), "seq")
    return ordered.repartition("weight").sortWithinPartitions("weight", "seq", "delta", "stable").select("weight", "delta", "stable").mapInArrow(run, "weight STRING, value DOUBLE, state STRING, heal_count INT, code INT")
