"""Streaming forms of depth and gap operators: extensions, as the pipeline itself is a batch one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, ts: str, key: str, gap: str) -> DataFrame:
    """key, first, n of runs of events with less than gap between them; for batches and, with a watermark, streams."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    return timed.groupBy(key, F.session_window("_ts", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("first"), "n")


def windowed_depth(events: DataFrame, ts: str, by: list[str], value: str, *, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """by, window start, n, mean and an approximate p75 of each tumbling window; rows later than late are left out."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    out = timed.groupBy(*by, F.window("_ts", length).alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.percentile_approx(value, 0.75).alias("p75"))
    return out.select(*by, F.col("w.start").alias("start"), "n", "mean", "p75")


def paired(records: DataFrame, *, ts: str, key: str, late: str = "10 minutes") -> DataFrame:
    """Mates as a stream-stream join: first and second records of a key within the watermark; state is dropped beyond it."""
    timed = records.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    side = lambda bit, name: timed.filter(F.col("flag").bitwiseAND(F.lit(bit)) != 0).select(F.col(key).alias(f"{name}_key"), F.col("_ts").alias(f"{name}_ts"), F.struct(*records.columns).alias(name))
    a, b = side(64, "first"), side(128, "second")
    near = (F.col("first_ts") >= F.col("second_ts") - F.expr(f"interval {late}")) & (F.col("first_ts") <= F.col("second_ts") + F.expr(f"interval {late}"))
    return a.join(b, (F.col("first_key") == F.col("second_key")) & near).select(F.col("first_key").alias(key), "first", "second")
