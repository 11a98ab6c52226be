"""Streams of documents and events: daily counts, duplicate removal, re-judged days."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch


def parquet_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files at the path (a folder or one file), with time columns that watermarks accept."""
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        x = source.parquet(path)
    else:
        x = source.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return x.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def daily_counts(events: DataFrame, time: str, *keys: str, late: str = "1 day") -> DataFrame:
    """Per UTC day and key: events and the sum of values. A day is final once the watermark has passed it."""
    w = F.window(time, "1 day")
    return events.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.to_date("window.start").alias("date"), *keys, "n", "total")


def sliding_counts(events: DataFrame, time: str, *keys: str, days: int = 7, late: str = "1 day") -> DataFrame:
    """Per trailing window of days (ending each day) and key: events."""
    w = F.window(time, f"{days} days", "1 day")
    return events.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.date_sub(F.to_date("window.end"), 1).alias("date"), *keys, "n")


def sessions(events: DataFrame, time: str, user: str, gap: str, late: str = "1 day") -> DataFrame:
    """Runs of a user's events without a gap."""
    w = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(w, user).agg(F.count("*").alias("n")).select(user, F.col("session_window.start").alias("start"), "n")


def first_by_hash(documents: DataFrame, time: str, key: str, late: str = "1 day") -> DataFrame:
    """The first document of each hash that comes within the watermark; older state is dropped."""
    return documents.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def touched_days(stream: DataFrame, date: str, recompute: Callable[[DataFrame, list[str]], None], checkpoint: str):
    """Starts a query that hands each batch's days, once each, to `recompute`: late evidence is judged in the window of its own day."""

    def batch(df: DataFrame, _id: int) -> None:
        days = [r[0] for r in df.select(F.col(date).cast("string")).distinct().orderBy(date).collect()]  # days of one batch
        if days:
            recompute(df, days)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, name: str, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs the stream over what is there into Parquet in the shared folder, and reads that. Checkpoints lie beside it.

    Each batch writes a folder of its own, so that a batch that is run again replaces its rows. In update mode the last
    row of each key is the result, so that state that the watermark has passed can go; in complete mode the last batch.
    """
    spark = stream.sparkSession
    path, last = scratch(spark, name), []

    def batch(df: DataFrame, k: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/rows/batch={k}")
        last.append(k)

    q = stream.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{path}/rows/batch={max(last)}")
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    if mode == "update":
        values = F.struct(*[F.col(c) for c in stream.columns if c not in keys])
        rows = rows.groupBy(*keys).agg(F.max_by(values, "batch").alias("v")).select(*keys, "v.*")
    return rows.select(*stream.columns)
