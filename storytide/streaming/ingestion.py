"""Documents as they arrive: the first writer of a text stays, a full text takes the place of its preview."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.relational import first_per
from ..session import ship

ARRIVAL = "document_id string, at timestamp, content string, hash string, text string"
#: What became of an arrival: a new document, a preview's full text, or a further text under an id that is taken.
STORED = "stored_id string, action string, document_id string, at timestamp, content string, hash string, text string"


def _ms(t: datetime.datetime) -> int:
    return int(t.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)


class _Kept(StatefulProcessor):
    """One value a key, which is forgotten when the watermark has passed its event time by `keep` milliseconds."""

    def __init__(self, schema: str, keep: int) -> None:
        self.schema, self.keep = schema, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.value = handle, handle.getValueState("value", self.schema)

    def hold(self, value: tuple, at: datetime.datetime) -> None:
        self.value.update(value)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(_ms(at) + self.keep)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.value.clear()
        yield from ()

    def close(self) -> None:
        pass


class FirstWriter(_Kept):
    """Of all arrivals of a text, by its hash: the earliest of the first batch that has it, then by id."""

    def __init__(self, keep: int) -> None:
        super().__init__("at timestamp", keep)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = min(rows, key=lambda r: (r.at, r.document_id or ""))
        if not self.value.exists():
            self.hold((first.at,), first.at)
            yield first


class PreviewUpgrade(_Kept):
    """What the arrivals of one id do: the first is stored, the first full text after a preview takes its place, any
    other text is stored under an id of its own (`<id>:rev:<begin of the hash>`)."""

    def __init__(self, keep: int) -> None:
        super().__init__("content string", keep)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.value.get()[0] if self.value.exists() else None
        for r in sorted(rows, key=lambda r: (r.at, r.hash or "")):
            if held is None or (held == "preview" and r.content == "full"):
                action = "insert" if held is None else "upgrade"
                held = r.content
                self.hold((held,), r.at)
                yield Row(stored_id=r.document_id, action=action, **r.asDict())
            else:
                yield Row(stored_id=f"{r.document_id}:rev:{r.hash[:8]}", action="revision", **r.asDict())


def ingested(arrivals: DataFrame, keep_days: int = 120, late: str = "1 day") -> DataFrame:
    """STORED rows of a stream of ARRIVAL rows: each text once, with what it does to the store.

    A text and an id are known for `keep_days` of event time, then forgotten, so that state is bounded by the arrivals of
    that time; arrivals later than `late` are dropped. A preview that comes again after its full text has taken its place
    is a text that was seen.
    """
    spark = arrivals.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keep = keep_days * 86_400_000
    rows = arrivals.select(*[c.split()[0] for c in ARRIVAL.split(", ")]).withWatermark("at", late)
    first = rows.groupBy("hash").transformWithState(FirstWriter(keep), ARRIVAL, "Append", "EventTime", eventTimeColumnName="at")
    return first.groupBy("document_id").transformWithState(PreviewUpgrade(keep), STORED, "Append", "EventTime", eventTimeColumnName="at")


def store(changes: DataFrame) -> DataFrame:
    """The documents that STORED rows leave behind: the upgrade of an id, else what was stored first."""
    rank = F.when(F.col("action") == "upgrade", 0).otherwise(1)
    return first_per(changes, ["stored_id"], rank.asc(), F.asc("at"), F.asc("hash"))


def _files(spark: SparkSession, path: str) -> list:
    """The data files of a folder, as Hadoop names them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return [f.getPath() for f in found if not f.getPath().getName().startswith(("_", "."))]


def written_in_order(df: DataFrame, path: str, part: str, parts: int) -> None:
    """Writes the rows as files that a stream reads one part after the other: parts 0 .. parts - 1 of the column.

    Each part has a folder and, with empty files for what its tasks left out, as many files as df has partitions, so that
    a stream knows a part by their number and no task reads or writes a part alone.
    """
    spark, n = df.sparkSession, df.rdd.getNumPartitions()
    for k in range(parts):
        rows, to = df.where(F.col(part) == k).drop(part).coalesce(n), f"{path}/{k}"
        rows.write.parquet(to)
        there = _files(spark, to)
        if len(there) < n:
            one = f"{path}-empty-{k}"
            spark.createDataFrame([], rows.schema).coalesce(1).write.parquet(one)
            empty, conf = _files(spark, one)[0], spark._jsc.hadoopConfiguration()
            files = empty.getFileSystem(conf)
            for i in range(n - len(there)):
                copy = spark._jvm.org.apache.hadoop.fs.Path(f"{to}/part-empty-{i:05d}.parquet")
                spark._jvm.org.apache.hadoop.fs.FileUtil.copy(files, empty, copy.getFileSystem(conf), copy, False, conf)


def arrivals_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of what `written_in_order` wrote, a batch a part."""
    return spark.readStream.schema(spark.read.parquet(f"{path}/0").schema).option("maxFilesPerTrigger", len(_files(spark, f"{path}/0"))).parquet(f"{path}/*")
