"""A trailing-window series that follows its evidence: late rows change the windows that hold them and no other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import window_ends
from ..sources.sinks import DayTable


class WindowView:
    """Distinct members of the trailing windows of `days` days, kept as a table of days that batches of evidence update.

    evidence: rows with a key, a date, the columns of `by` and those of `members`; each key is stored once. series: a row
    for every group of `by` and every window end with a member: date, by, a count of distinct values for each of `members`,
    rows. Windows end on any day up to `last`.

    A batch is first added to the stored evidence, whose keys make that repeatable; then the windows that hold a day
    of the batch are computed anew from the stored days they span and replace their day's rows. So a batch that is run
    again, after a failure at whatever point or out of order, leaves the same table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, by: Sequence[str], members: dict[str, str], days: int, last: str) -> None:
        self.key, self.by, self.members, self.days, self.last = key, list(by), members, days, last
        self.evidence = DayTable(spark, f"{path}/evidence", schema, "date")
        kinds = dict(spark.createDataFrame([], schema).dtypes)
        columns = [f"{b} {kinds[b]}" for b in self.by] + [f"{m} bigint" for m in members] + ["rows bigint", "date date"]
        self.series = DayTable(spark, f"{path}/series", ", ".join(columns), "date")

    def absorb(self, batch: DataFrame, _id: int = 0) -> None:
        """Adds a batch of evidence; for foreachBatch."""
        self.evidence.insert_ignore(batch, [self.key])
        reach = batch.select(F.explode(F.sequence("date", F.least(F.date_add("date", self.days - 1), F.to_date(F.lit(self.last))))).alias("d"))
        ends = [r[0] for r in reach.select(F.col("d").cast("string").alias("d")).distinct().orderBy("d").collect()]  # a calendar
        if ends:
            self.series.replace_days(self._windows(ends), ends)

    def _windows(self, ends: list[str]) -> DataFrame:
        """The windows that end on the given days, from the days they span."""
        spark = self.evidence.spark
        ended = spark.createDataFrame([(e,) for e in ends], "d string").select(F.to_date("d").alias("end_date"))
        spanned = ended.select(F.explode(F.sequence(F.date_sub("end_date", self.days - 1), F.col("end_date"))).alias("d")).select(F.col("d").cast("string").alias("d"))
        there = set(self.evidence.days())
        days = sorted(there & {r[0] for r in spanned.distinct().collect()})
        rows = self.evidence.read(days).groupBy(*self.by, *dict.fromkeys(self.members.values()), "date").agg(F.count("*").alias("rows"))
        held = window_ends(rows, self.days).join(F.broadcast(ended), "end_date", "left_semi")  # a calendar
        counts = [F.count_distinct(c).alias(m) for m, c in self.members.items()]
        return held.groupBy(*self.by, F.col("end_date").alias("date")).agg(*counts, F.sum("rows").alias("rows"))

    def follow(self, stream: DataFrame, checkpoint: str):
        """Starts a query that absorbs the stream."""
        return stream.writeStream.foreachBatch(self.absorb).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
