"""Streaming forms: counts by source, and a gate that holds leaking texts back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tracelight.operators import leaks
from tracelight.sources.files import scratch_dir


def stream_source_counts(stream: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Tumbling counts by source; rows later than the watermark are dropped. Works on a batch
    table too, where nothing is late."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", window).alias("w"), "source").agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("window_start"), "source", "events")


def gate(df: DataFrame) -> DataFrame:
    """Leak flags and redacted text of each row."""
    return leaks.redact(leaks.leak_flags(df))


def stream_leak_gate(stream: DataFrame, clean: Callable[[DataFrame, int], None], flagged: Callable[[DataFrame, int], None], checkpoint: str, id_col: str = "doc_id", delay: str = "10 minutes") -> StreamingQuery:
    """Send clean rows to one sink and redacted flagged rows to the other, each id once within
    the watermark. The sinks get the batch number, to make a repeated batch harmless."""
    once = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark([id_col])

    def split(batch: DataFrame, number: int) -> None:
        batch = gate(batch).persist()
        try:
            clean(batch.filter(~F.col("any_leak")), number)
            flagged(batch.filter("any_leak").drop("text"), number)
        finally:
            batch.unpersist()

    return once.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted(stream: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Run stream_source_counts() over what a stream has now, append its closed windows to a table
    in the shared folder, and read that. Windows that the watermark has not passed stay open."""
    spark = stream.sparkSession
    path, checkpoint = scratch_dir(spark), scratch_dir(spark)
    counts = stream_source_counts(stream, window, delay)
    run = counts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(counts.schema).parquet(path)


def gated(stream: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Run stream_leak_gate() over what a stream has now: the clean rows and the redacted ones. A
    batch writes a folder of its own, so one that runs again after a failure replaces itself."""
    spark = stream.sparkSession
    schema = gate(spark.createDataFrame([], stream.schema).withColumn("ts", F.col("ts").cast("timestamp"))).schema
    schemas, paths = [schema, StructType([f for f in schema if f.name != "text"])], [scratch_dir(spark), scratch_dir(spark)]
    for kind, path in zip(schemas, paths, strict=True):
        spark.createDataFrame([], kind).write.parquet(f"{path}/batch=-1")

    def sink(at: int) -> Callable[[DataFrame, int], None]:
        return lambda batch, number: batch.write.mode("overwrite").parquet(f"{paths[at]}/batch={number}")

    stream_leak_gate(stream, sink(0), sink(1), scratch_dir(spark), id_col).awaitTermination()
    clean, flagged = (spark.read.schema(kind).parquet(path) for kind, path in zip(schemas, paths, strict=True))
    return clean.drop("batch"), flagged.drop("batch")


def stream_source_status(stream: DataFrame, beats: DataFrame, expected: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(window_start, source, row_count, reason) for each window that holds a beat of an expected
    source. beats (ts, source) is a stream of heartbeats, one for each source and window, that
    count for nothing themselves: a source that says nothing has its row all the same. expected
    (source, negative_evidence) is a short table, which decides what silence means. Rows of other
    sources are left out."""
    rows = stream.select(F.col("ts").cast("timestamp").alias("ts"), "source", F.lit(1).cast("long").alias("n"))
    rows = rows.unionByName(beats.select(F.col("ts").cast("timestamp").alias("ts"), "source", F.lit(0).cast("long").alias("n"))).withWatermark("ts", delay)
    counts = rows.groupBy(F.window("ts", window).alias("w"), "source").agg(F.sum("n").alias("row_count"))
    reason = F.when(F.col("row_count") > 0, "rows found").when(F.col("negative_evidence"), "no rows: supports negative evidence").otherwise("no rows: limitation")
    return counts.join(F.broadcast(expected), "source").select(F.col("w.start").alias("window_start"), "source", "row_count", reason.alias("reason"))


def beats_of(expected: DataFrame, start: str, end: str, window: str = "1 hour") -> DataFrame:
    """A heartbeat for each expected source and window from start to end, as a table."""
    ticks = F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr(f"INTERVAL {window}"))
    return expected.select("source", F.explode(ticks).alias("ts"))


def status_of_sources(stream: DataFrame, beats: DataFrame, expected: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> tuple[DataFrame, int]:
    """Run stream_source_status() over what both streams have now: the rows of the windows that are
    closed, and how many late groups (a window and source of one batch) the watermark turned away, as
    the progress of the last batches tells (spark.sql.streaming.numRecentProgressUpdates of them)."""
    spark = stream.sparkSession
    path, checkpoint = scratch_dir(spark), scratch_dir(spark)
    told = stream_source_status(stream, beats, expected, window, delay)
    run = told.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    late = sum(int(o.get("numRowsDroppedByWatermark", 0)) for p in run.recentProgress for o in p["stateOperators"])
    return spark.read.schema(told.schema).parquet(path), late
