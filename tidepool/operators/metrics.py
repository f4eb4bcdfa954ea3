"""Metric roll-ups over a metrics log: A7 counter, A8 gauge, A9 latency,
A10 throughput, A11 report.  All are grouped aggregates with map-side
partial aggregation; ``as_of`` replaces the reference's wall clock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions.timeutil import literal_epoch_micros


def counter(log: DataFrame) -> DataFrame:
    """Sum of increments per name (missing value = increment of 1)."""
    return log.groupBy("name").agg(F.sum(F.coalesce("value", F.lit(1))).cast("long").alias("counter"))


def gauge(log: DataFrame) -> DataFrame:
    """Last value set per name, by ``(ts, event_id)``.

    Two hash aggregates with primitive buffers instead of one sort-based
    aggregate over a struct ordering: the latest timestamp per name, then
    among the rows at that timestamp the value of the greatest event id.
    """
    keyed = log.select("name", F.unix_micros("ts").alias("__t"), "event_id", "value")
    last_t = keyed.groupBy("name").agg(F.max("__t").alias("__last"))
    at_last = keyed.join(last_t, (keyed["name"] == last_t["name"]) & (keyed["__t"] == last_t["__last"]), "left_semi")
    return at_last.groupBy("name").agg(F.max_by("value", "event_id").cast("long").alias("gauge"))


def latency(log: DataFrame) -> DataFrame:
    """Count, sum, min, max, avg of microsecond values per name."""
    return log.groupBy("name").agg(
        F.count("value").cast("long").alias("count"),
        F.sum("value").cast("long").alias("sum_us"),
        F.min("value").cast("long").alias("min_us"),
        F.max("value").cast("long").alias("max_us"),
        F.avg("value").alias("avg_us"),
    ).where(F.col("count") > 0)


def throughput(log: DataFrame, as_of_ts: str) -> DataFrame:
    """A10: bytes / whole seconds since the first non-zero record; 0 below 1 s or without bytes."""
    g = log.groupBy("name").agg(
        F.sum("value").cast("long").alias("total_bytes"),
        F.min(F.when(F.col("value") > 0, F.col("ts"))).alias("start_ts"),
    )
    secs = F.floor(
        (literal_epoch_micros(as_of_ts) - F.unix_micros("start_ts")) / F.lit(1000000)
    ).cast("long")
    bps = F.when((F.col("total_bytes") > 0) & (secs > 0), F.col("total_bytes") / secs).otherwise(F.lit(0.0))
    return g.select("name", "total_bytes", secs.alias("elapsed_s"), bps.alias("bytes_per_sec"))


def metrics_report(log: DataFrame, as_of_ts: str) -> DataFrame:
    """All four families in long form ``(kind, name, stat, value)``; MB/s = B/s / 1024^2.

    Every statistic but the gauge comes out of one hash aggregate; the gauge
    (A8) is joined per name; a per-name ``explode`` turns it into rows.
    """
    g = log.groupBy("name").agg(
        F.sum(F.coalesce("value", F.lit(1))).cast("double").alias("counter"),
        F.count("value").cast("double").alias("count"),
        F.avg("value").alias("avg"),
        F.min("value").cast("double").alias("min"),
        F.max("value").cast("double").alias("max"),
        F.sum("value").alias("__bytes"),
        F.min(F.when(F.col("value") > 0, F.col("ts"))).alias("__start"),
    ).join(gauge(log).select("name", F.col("gauge").cast("double").alias("gauge")), "name", "left")
    secs = F.floor(
        (literal_epoch_micros(as_of_ts) - F.unix_micros("__start")) / F.lit(1000000)
    ).cast("long")
    bps = F.when((F.col("__bytes") > 0) & (secs > 0), F.col("__bytes") / secs).otherwise(F.lit(0.0))
    item = lambda kind, stat, v: F.struct(F.lit(kind).alias("kind"), F.lit(stat).alias("stat"), v.alias("value"))
    rows = F.array(
        item("counter", "value", F.col("counter")),
        item("gauge", "value", F.col("gauge")),
        item("latency", "count", F.col("count")),
        item("latency", "avg", F.col("avg")),
        item("latency", "min", F.col("min")),
        item("latency", "max", F.col("max")),
        item("throughput", "mb_per_sec", bps / F.lit(1024.0) / F.lit(1024.0)),
    )
    return g.select("name", F.explode(rows).alias("r")).select("r.kind", "name", "r.stat", "r.value")
