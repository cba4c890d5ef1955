"""Structured Streaming over event envelopes; every operator has a batch twin."""

from __future__ import annotations

from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def ingest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files of a folder as a stream."""
    return spark.readStream.schema(schema).json(path)


def deduplicated(events: DataFrame, key: list[str], late: str = "1 day") -> DataFrame:
    """Each id once, state kept for the watermark's time. In a batch: each id once."""
    if not events.isStreaming:
        return events.dropDuplicates(key)
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def route(batch: DataFrame, valid, good: str, bad: str) -> None:
    """For ``foreachBatch``: valid rows by topic, others to the dead letters. The batch
    is kept while it is written twice."""
    batch = batch.withColumn("_ok", F.coalesce(valid, F.lit(False))).persist()
    batch.filter("_ok").drop("_ok").write.mode("append").partitionBy("topic").json(good)
    batch.filter("NOT _ok").drop("_ok").write.mode("append").json(bad)
    batch.unpersist()


def route_stream(events: DataFrame, valid, path: str):
    """T3 as a stream that ends: ``good`` by topic and ``bad`` below ``path``. Every batch
    has a folder of its own that a repeated batch overwrites, so each row is kept once."""

    def one(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("_ok", F.coalesce(F.expr(valid), F.lit(False))).persist()
        marked.filter("_ok").drop("_ok").write.mode("overwrite").partitionBy("topic").json(f"{path}/good/batch={number}")
        marked.filter("NOT _ok").drop("_ok").write.mode("overwrite").json(f"{path}/bad/batch={number}")
        marked.unpersist()

    return events.writeStream.foreachBatch(one).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def unfinished(starts: DataFrame, ends: DataFrame, key: str, within: str, late: str = "10 minutes") -> DataFrame:
    """T4: starts with their end within the time, null once it has passed: an outer
    interval join, whose state is bounded by watermark and interval."""
    a = starts.withWatermark("ts", late).alias("a")
    b = ends.withColumnRenamed("ts", "end_ts").withWatermark("end_ts", late).alias("b")
    inside = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("end_ts") > F.col("ts")) & (F.col("end_ts") <= F.col("ts") + F.expr(f"interval {within}"))
    return a.join(b, inside, "leftOuter").select(F.col(f"a.{key}").alias(key), "ts", "end_ts")


def throughput(events: DataFrame, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events and rejects by window and topic, and the 95th percentile of latency
    (the smallest with 95 % at or below it, exact; a group keeps a count a value)."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", every).alias("w"), "topic").agg(F.count("*").alias("n"), F.count_if("rejected").alias("rejects"), F.expr("percentile_disc(0.95) within group (order by latency)").alias("p95")).select(F.col("w.start").alias("start"), "topic", "n", "rejects", "p95")


def hot_spots(events: DataFrame, length: str = "30 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts by sliding window."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", length, slide).alias("w"), "topic").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "topic", "n")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of events of a key with no gap of that length."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def replay(history: DataFrame, since) -> DataFrame:
    """The history from a time on, for the same transformations."""
    return history.filter(F.col("ts") >= F.lit(since))


def to_history(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream to a history by day, then ends; late rows are dropped by
    the watermark and counted in the query's progress."""
    out = stream.withColumn("date", F.to_date("ts")).writeStream.format("parquet").partitionBy("date")
    return out.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is and returns what it wrote."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


class LateRows(StreamingQueryListener):
    """Adds up, over every batch of one query, the rows that came after the watermark."""

    def __init__(self) -> None:
        self.query, self.late, self.ended = None, {}, Event()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.late.setdefault(str(p.runId), {})[p.batchId] = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if self.query is None or str(event.runId) == self.query:
            self.ended.set()


def run_counted(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over what there is and returns, in one row, how many rows it wrote
    this time and how many came too late for the watermark, in all batches: the progress
    that a query itself remembers ends after some."""
    seen, streams = LateRows(), stream.sparkSession.streams
    streams.addListener(seen)
    try:
        query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
        seen.query = str(query.runId)
        query.awaitTermination()
        seen.ended.wait(60)  # events come after the batches
        late = sum(seen.late.get(seen.query, {}).values())
    finally:
        streams.removeListener(seen)
    kept = stream.sparkSession.read.schema(stream.schema).parquet(path).agg(F.count("*").alias("kept"))
    return kept.select("kept", F.lit(late).cast("long").alias("late"))
