"""Writes that keep natural keys unique on plain Parquet: one writer per table.

`Table` is a folder of versions; a small numbered file names the current one and comes into being by a rename, so
readers see one swap and never an empty pointer. `DayTable` is a folder of day partitions; a write touches the days that
change and no other.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written


class Table:
    """A versioned Parquet table."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _at(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[str]:
        p, fs = self._at("CURRENT-*")
        return sorted(s.getPath().getName() for s in fs.globStatus(p) or [])

    def version(self) -> str | None:
        """The current version; a pointer file is whole once it has its name."""
        names = self._pointers()
        return self.spark.read.text(f"{self.path}/{names[-1]}").first()[0] if names else None

    def read(self) -> DataFrame:
        v = self.version()
        return self.spark.createDataFrame([], self.schema) if v is None else self.spark.read.schema(self.schema).parquet(f"{self.path}/{v}")

    def replace(self, df: DataFrame) -> None:
        """Writes the rows as a new version, then points to it. A second writer that was faster is an error."""
        names = self._pointers()
        v = f"v-{uuid.uuid4().hex}"
        df.select(*[F.col(c) for c in self.spark.createDataFrame([], self.schema).columns]).write.parquet(f"{self.path}/{v}")
        made, fs = self._at(f".pointer-{v}")
        out = fs.create(made, False)
        out.write(bytearray(v.encode()))
        out.close()
        number = int(names[-1].split("-")[1]) + 1 if names else 0
        if not fs.rename(made, self._at(f"CURRENT-{number:012d}")[0]):
            raise RuntimeError(f"another writer has changed {self.path}")

    def insert_ignore(self, rows: DataFrame, keys: Sequence[str]) -> int:
        """Adds the rows whose keys are not there; returns how many."""
        new = rows.dropDuplicates(list(keys)).join(self.read().select(*keys), list(keys), "left_anti")
        n = new.count()
        if n:
            self.replace(self.read().unionByName(new.select(*self.read().columns)))
        return n

    def upsert(self, rows: DataFrame, keys: Sequence[str]) -> int:
        """Rows by key: new ones are added, differing ones overwritten, equal ones left; returns how many changed."""
        merged = merge(self.read(), rows, keys)
        n = merged.where("__changed").count()
        if n:
            self.replace(merged.drop("__changed"))
        return n

    def replace_days(self, rows: DataFrame, column: str, days: Sequence[str]) -> None:
        """The rows of the given days are those given."""
        self.replace(self.read().where(~F.col(column).cast("string").isin(*days)).unionByName(rows))

    def delete_obsolete(self, staged: DataFrame, keys: Sequence[str], column: str, first: str, last: str) -> int:
        """Removes rows of [first, last] that are not staged; returns how many."""
        now = self.read()
        gone = now.where(F.col(column).between(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).join(staged.select(*keys), list(keys), "left_anti")
        n = gone.count()
        if n:
            self.replace(now.join(gone.select(*keys), list(keys), "left_anti"))
        return n

    def prune(self, column: str, before: str) -> int:
        now = self.read()
        n = now.where(F.col(column) < F.to_date(F.lit(before))).count()
        if n:
            self.replace(now.where(F.col(column) >= F.to_date(F.lit(before))))
        return n


class DayTable:
    """Parquet partitioned by a date column. Files of days that a write doesn't change keep their names.

    Days are overwritten by Spark's dynamic partition overwrite: rows are staged beside the table and moved into
    their days when the job has ended, so a job that fails leaves the table as it was. Days are never null.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, day: str) -> None:
        self.spark, self.path, self.schema, self.day = spark, path.rstrip("/"), schema, day
        self.columns = spark.createDataFrame([], schema).columns

    def _at(self, name: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path + name)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def days(self) -> list[str]:
        """The days that have rows, in order."""
        p, fs = self._at(f"/{self.day}=*")
        return sorted(s.getPath().getName().split("=", 1)[1] for s in fs.globStatus(p) or [])

    def read(self, days: Sequence[str] | None = None) -> DataFrame:
        """The rows, of the given days if some are given: other days are not opened."""
        if not self.days():
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(self.path).select(*self.columns)
        return rows if days is None else rows.where(F.col(self.day).isin(*[F.to_date(F.lit(d)) for d in days]))

    def _days_of(self, rows: DataFrame) -> list[str]:
        return [r[0] for r in rows.select(F.col(self.day).cast("string").alias("d")).distinct().orderBy("d").collect()]  # a calendar

    def _write(self, rows: DataFrame, mode: str) -> None:
        dealt = rows.select(*self.columns).hint("rebalance", self.day)
        dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(self.day).parquet(self.path)

    def _drop(self, days: Sequence[str]) -> None:
        for d in days:
            p, fs = self._at(f"/{self.day}={d}")
            fs.delete(p, True)

    def insert_ignore(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Adds the rows whose keys are not there, to new files; returns the rows that were added."""
        new = written(rows.select(*self.columns).dropDuplicates(list(keys)).join(self.read().select(*keys), list(keys), "left_anti").select(*self.columns), "inserted")
        self._write(new, "append")
        return new

    def replace_days(self, rows: DataFrame, days: Sequence[str]) -> None:
        """The rows of the given days are those of `rows` that fall on them; days without rows vanish."""
        rows = written(rows.select(*self.columns).where(F.col(self.day).cast("string").isin(*days)), "replaced")
        there = self._days_of(rows)
        if there:
            self._write(rows, "overwrite")
        self._drop(sorted(set(days) & set(self.days()) - set(there)))

    def upsert(self, rows: DataFrame, keys: Sequence[str]) -> int:
        """Rows by key, which holds the day: only days in which a row is new or differs are written; returns how many
        rows changed."""
        if self.day not in keys:
            raise ValueError("the key must hold the day")
        rows = written(rows.select(*self.columns), "staged")
        merged = written(merge(self.read(self._days_of(rows)), rows, keys), "merged")
        changed = {str(r[self.day]): r["count"] for r in merged.where("__changed").groupBy(self.day).count().collect()}  # a calendar
        if changed:
            self._write(merged.where(F.col(self.day).cast("string").isin(*changed)), "overwrite")
        return sum(changed.values())

    def delete_obsolete(self, staged: DataFrame, keys: Sequence[str], first: str, last: str) -> int:
        """Removes rows of [first, last] that are not staged, from the days that have some; returns how many."""
        days = [d for d in self.days() if first <= d <= last]
        if not days:
            return 0
        marked = self.read(days).join(staged.select(*keys).distinct().withColumn("__kept", F.lit(True)), list(keys), "left")
        marked = written(marked.withColumn("__kept", F.coalesce("__kept", F.lit(False))), "obsolete")
        gone = {str(r[self.day]): r["count"] for r in marked.where("NOT __kept").groupBy(self.day).count().collect()}
        if gone:
            self.replace_days(marked.where("__kept"), sorted(gone))
        return sum(gone.values())

    def prune(self, before: str) -> int:
        """Removes the days before the given one, whole; returns how many rows they had."""
        days = [d for d in self.days() if d < before]
        n = self.read(days).count() if days else 0
        self._drop(days)
        return n


def merge(current: DataFrame, staged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of both by key, staged first, with __changed where a row is new or differs."""
    values = [c for c in current.columns if c not in keys]
    s = staged.select(*keys, F.struct(*values).alias("__s"))
    c = current.select(*keys, F.struct(*values).alias("__c"))
    both = c.join(s, list(keys), "full_outer")
    changed = F.col("__s").isNotNull() & ~F.col("__s").eqNullSafe(F.col("__c"))
    return both.withColumn("__v", F.coalesce("__s", "__c")).select(*keys, *[F.col(f"__v.{v}").alias(v) for v in values], changed.alias("__changed"))


def difference(current: DataFrame, staged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, action: insert, update or keep for staged rows, delete for rows that are not staged."""
    values = [c for c in current.columns if c not in keys]
    s = staged.select(*keys, F.struct(*values).alias("__s"))
    c = current.select(*keys, F.struct(*values).alias("__c"))
    action = F.when(F.col("__c").isNull(), "insert").when(F.col("__s").isNull(), "delete").when(F.col("__s").eqNullSafe(F.col("__c")), "keep").otherwise("update")
    return c.join(s, list(keys), "full_outer").select(*keys, action.alias("action"))


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
