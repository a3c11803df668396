"""Streams: claims against static tables, and daily counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.verify import Tables, verify_facts


def daily_events(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, event_type, n, total) by event time; works on a stream (with a watermark) and on a table."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    day = F.window("ts", "1 day")
    grouped = rows.groupBy(day.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("s"))
    return grouped.select(F.to_date("w.start").alias("day"), "event_type", "n", F.round(F.col("s").cast("double"), 4).alias("total"))


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, start, end, n): sessions by inactivity."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    s = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def verify_stream(facts: DataFrame, tables: Tables, path: str, checkpoint: str):
    """A query that verifies a stream of facts batch by batch and appends results to Parquet at path.

    A batch is verified as a whole, so the claims of one batch share each look-up; its id names its
    folder, which makes a repeated batch replace itself.
    """

    def batch(df: DataFrame, number: int) -> None:
        verify_facts(tables, df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return facts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(rows: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """What a streaming aggregation gives for all that its source holds now, from Parquet below path.

    With complete mode a batch replaces the one before; with append mode every batch has a folder of its own, and groups come
    when the watermark has passed them. The checkpoint lies beside, so a run that broke off goes on where it was.
    """

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={number}")

    rows.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
