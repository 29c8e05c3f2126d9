"""Incremental counting, deduplication, upsert, late data and alerts with Structured Streaming.

A run reads what is new in a folder of event files (``availableNow``) and returns its
sink as a DataFrame. State and sink live in folders that the caller names, on a
cluster in shared storage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions.scans import shared_folder
from panelyard.streaming.sinks import BucketTable

WEEK = ("7 days", "7 days", "4 days")  # weeks begin on Monday; time begins on a Thursday
#: How long after a key's first event its repeats are known to the state; later ones meet the sink.
KNOWN_FOR = "14 days"


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; a local one only where that is unset and the master is local."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, path: str, glob: str = "events.parquet", files: int | None = None) -> DataFrame:
    """New event files as a stream, ``ts`` as a timestamp; ``files``: at most so many a batch, the oldest first."""
    schema = spark.read.parquet(f"{path}/{glob}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def drain(writer, where: str):
    """Run a stream over all that is there, then stop; returns the query, for its progress."""
    query = writer.option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def to_table(stream: DataFrame, where: str, mode: str = "append") -> DataFrame:
    """Append a stream to Parquet files and read them."""
    drain(stream.writeStream.format("parquet").option("path", f"{where}/out").outputMode(mode), where)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{where}/out")


def weekly_counts(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Events, and the sum of values, for each type and Monday-based week."""
    week = F.window("ts", *WEEK)
    return stream.withWatermark("ts", delay).groupBy("event_type", week.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").cast("date").alias("week_start"), "n", "total")


def latest(keys: list[str], values: list[str], by: list[str]) -> Callable[[DataFrame], DataFrame]:
    """One row a key: the one with the largest ``by``."""
    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*by)).alias("r")).select(*keys, "r.*")

    return merge


def stream_weekly_counts(spark: SparkSession, path: str, where: str, glob: str = "events.parquet", files: int | None = None) -> DataFrame:
    """Counts kept up to date: a batch replaces the weeks that it changed; closed weeks leave the state."""
    counts = weekly_counts(event_stream(spark, path, glob, files))
    # counts of a week only grow, so the largest is the latest
    table = BucketTable(spark, f"{where}/out", ["event_type", "week_start"], latest(["event_type", "week_start"], ["n", "total"], ["n"]), counts.schema)
    drain(counts.writeStream.outputMode("update").foreachBatch(table.apply), where)
    return table.read()


def first_seen(stream: DataFrame, keys: tuple[str, ...], known_for: str) -> DataFrame:
    """Events whose key the state does not know; it forgets a key ``known_for`` after the event that made it known."""
    return stream.withWatermark("ts", known_for).dropDuplicatesWithinWatermark(list(keys)).select(*keys, "ts")


def stream_dedup(spark: SparkSession, path: str, where: str, keys: tuple[str, ...] = ("user_id", "event_type"), known_for: str = KNOWN_FOR, glob: str = "events.parquet", files: int | None = None) -> DataFrame:
    """Each key once. State ends with the watermark; a key that comes back after that meets its row in the sink."""
    stream = first_seen(event_stream(spark, path, glob, files), keys, known_for)
    earliest = lambda rows: rows.groupBy(*keys).agg(F.min("ts").alias("ts"))
    table = BucketTable(spark, f"{where}/out", keys, earliest, stream.schema)
    drain(stream.writeStream.outputMode("append").foreachBatch(table.apply), where)
    return table.read().select(*keys)


def stream_upsert(spark: SparkSession, path: str, where: str, glob: str = "events.parquet", files: int | None = None) -> DataFrame:
    """One row for each user, the latest: a batch merges its own latest rows into the buckets of their users."""
    stream = event_stream(spark, path, glob, files).select("user_id", "ts", "event_id", "value")
    table = BucketTable(spark, f"{where}/out", ["user_id"], latest(["user_id"], ["ts", "event_id", "value"], ["ts", "event_id"]), stream.schema)
    drain(stream.writeStream.outputMode("append").foreachBatch(table.apply), where)
    return table.read()


def replay(spark: SparkSession, path: str, where: str, chunk: Column, chunks: int) -> str:
    """Events as files that arrive one after the other: file k holds the rows of chunk k, and is written after file k - 1. Returns their folder."""
    events = spark.read.parquet(f"{path}/events.parquet").withColumn("_chunk", chunk)
    for k in range(chunks):
        # a name that sorts like the arrival, for stores whose times are coarse
        events.where(F.col("_chunk") == k).drop("_chunk").coalesce(1).write.mode("append").parquet(f"{where}/arrived/{k:05d}")
    return f"{where}/arrived"


def stream_late_data(spark: SparkSession, path: str, where: str, chunk: Column | None = None, chunks: int = 6, delays: tuple[str, ...] = ("1 hour", "3 days", "14 days")) -> DataFrame:
    """(delay, weeks, events, dropped): what each watermark delay counts when events arrive chunk by chunk, and what comes too late for it.

    A row is too late if its week ended before the watermark, which is the latest time of
    all earlier chunks less the delay. ``chunk``: the number of the file in which an event
    arrives, 0 to ``chunks`` - 1; by default a part of the events comes one to three files late.
    """
    if chunk is None:
        chunk = arrival(chunks)
    folder = replay(spark, path, where, chunk, chunks)
    total = spark.read.parquet(f"{path}/events.parquet").agg(F.count("*").alias("all"))
    out = None
    for delay in delays:
        own = f"{where}/{delay.replace(' ', '-')}"
        schema = spark.read.parquet(f"{path}/events.parquet").schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
        counts = weekly_counts(stream, delay)
        table = BucketTable(spark, f"{own}/out", ["event_type", "week_start"], latest(["event_type", "week_start"], ["n", "total"], ["n"]), counts.schema)
        drain(counts.writeStream.outputMode("update").foreachBatch(table.apply), own)
        row = table.read().agg(F.lit(delay).alias("delay"), F.countDistinct("week_start").alias("weeks"), F.coalesce(F.sum("n"), F.lit(0)).alias("events"))
        row = row.crossJoin(F.broadcast(total)).select("delay", "weeks", "events", (F.col("all") - F.col("events")).alias("dropped"))
        out = row if out is None else out.unionByName(row)
    return out


def arrival(chunks: int) -> Column:
    """The file of an event: by its hour of the month in even parts, every fifth event up to three files later."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    own = F.least(F.floor(F.pmod(day, F.lit(30)) * chunks / 30), F.lit(chunks - 1))
    late = F.when(F.col("event_id") % 5 == 0, F.pmod(F.floor(F.col("event_id") / 5), F.lit(4))).otherwise(0)
    return F.least(own + late, F.lit(chunks - 1)).cast("int")


def stream_alerts(spark: SparkSession, path: str, where: str, alert: Column) -> DataFrame:
    """Rows of each batch that meet the alert expression of the batch queries."""
    def append(batch: DataFrame, number: int) -> None:
        batch.where(alert).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{where}/out/batch={number}")

    drain(event_stream(spark, path).select("event_id", "event_type", "value").writeStream.foreachBatch(append), where)
    return spark.read.schema("event_id long, event_type string, value double").parquet(f"{where}/out/*")
