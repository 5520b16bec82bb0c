"""Aggregates over telemetry events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_ts(ts: Column) -> Column:
    """Event time of the known text formats; unreadable text gives null."""
    return F.coalesce(
        F.try_to_timestamp(ts, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
        F.try_to_timestamp(ts, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(ts, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")),
        F.try_to_timestamp(ts, F.lit("dd.MM.yyyy HH:mm:ss")),
        F.try_to_timestamp(ts, F.lit("yyyy/MM/dd HH:mm:ss")),
    )


def by_command(events: DataFrame) -> DataFrame:
    """``command, count, total_sec, avg_sec, tokens_saved, files, success_rate`` of command events.

    Rows with null ``data`` are no command events; a null command counts as
    unknown, null numbers as 0, null success as success; negative durations
    count as 0.
    """
    d = F.col("data")
    sec = F.greatest(F.coalesce(d.duration_sec, F.lit(0.0)), F.lit(0.0))
    return (
        events.where(d.isNotNull())
        .groupBy(F.coalesce(d.command, F.lit("unknown")).alias("command"))
        .agg(
            F.count(F.lit(1)).alias("count"), F.round(F.sum(sec), 3).alias("total_sec"), F.round(F.sum(sec) / F.count(F.lit(1)), 3).alias("avg_sec"), F.sum(F.coalesce(d.tokens_saved.cast("long"), F.lit(0))).alias("tokens_saved"),
            F.sum(F.coalesce(d.files.cast("long"), F.lit(0))).alias("files"), F.round(F.count_if(F.coalesce(d.success, F.lit(True))) * 100.0 / F.count(F.lit(1)), 1).alias("success_rate"),
        )
    )


def recent(events: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` events by arrival (a top-k report)."""
    return events.where(F.col("data").isNotNull()).select("received_at", "ts", "event", F.col("data.command").alias("command"), "session").orderBy(F.desc_nulls_last("received_at"), F.asc("ts"), F.asc("event"), F.asc("command"), F.asc("session")).limit(n)


def by_session(events: DataFrame) -> DataFrame:
    """Counters of every session: events, files, tokens saved, last event by arrival."""
    d = F.col("data")
    return events.where(F.col("session").isNotNull()).groupBy("session").agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.coalesce(d.files.cast("long"), F.lit(0))).alias("files"), F.sum(F.coalesce(d.tokens_saved.cast("long"), F.lit(0))).alias("tokens_saved"),
        F.max(F.struct("received_at", "event")).getField("event").alias("last_event"),
    )


def quiet_periods(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Bursts of events of a key that end with a quiet ``gap``: ``key, n, first_ts, last_ts``."""
    return (
        events.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
        .groupBy(key, F.session_window(ts, gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
        .select(key, "n", "first_ts", "last_ts")
    )


def efficiency(events: DataFrame) -> DataFrame:
    """``session, tokens_used, tokens_saved, efficiency`` with the saved share in percent; used tokens come from the savings rate."""
    d = F.col("data")
    saved, pct = F.coalesce(d.tokens_saved.cast("double"), F.lit(0.0)), F.greatest(F.coalesce(d.savings_pct, F.lit(0.0)), F.lit(0.0))
    used = F.when(pct > 0, saved * (100 - F.least(pct, F.lit(100.0))) / pct).otherwise(0.0)
    per = events.where(F.col("session").isNotNull() & d.isNotNull()).groupBy("session").agg(F.round(F.sum(used), 2).alias("tokens_used"), F.sum(saved).alias("tokens_saved"))
    return per.withColumn("efficiency", F.round(F.coalesce(F.try_divide(F.col("tokens_saved") * 100, F.col("tokens_saved") + F.col("tokens_used")), F.lit(0.0)), 1))
