"""Makes the package known to executors; the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers of the session, once; they need no install of it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):  # else it runs from an archive that was sent already
        folder = tempfile.mkdtemp(prefix="storytide-package-")
        path = os.path.join(folder, "storytide.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for at, _, names in os.walk(root):
                for n in sorted(names):
                    if n.endswith(".py"):
                        z.write(os.path.join(at, n), os.path.join("storytide", os.path.relpath(os.path.join(at, n), root)))
        spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which the driver and all executors share, or the warehouse where that is unset. A warehouse on
    a machine's own disk will do for a local master alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    folder = spark.conf.get("spark.sql.warehouse.dir")
    own = folder.startswith("file:") or "://" not in folder
    if own and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/")


_roots: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, in a folder of this application, which `clear` removes, at the latest when
    the driver's Python ends."""
    root = f"{shared_folder(spark)}/storytide/{spark.sparkContext.applicationId}"
    if not _roots:
        atexit.register(_clear_all)
    _roots[root] = spark
    return f"{root}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_published: dict[tuple, DataFrame] = {}


def published(spark: SparkSession, sources: list[str], name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of make(), written once for the application and these sources as they are, and read by all that ask by name.

    sources: paths of what make reads; a file that is added, removed or written anew is another source.
    """
    stamps = []
    for path in sources:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
        stamps.append((path, *sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found)))
    key = (spark.sparkContext.applicationId, name, *stamps)
    if key not in _published:
        _published[key] = written(make(), "published")
    return _published[key]


def clear(spark: SparkSession) -> None:
    """Removes the application's scratch tables. Frames that read them can't be used any more."""
    for key in [k for k in _published if k[0] == spark.sparkContext.applicationId]:
        del _published[key]
    for root in [r for r, s in _roots.items() if s is spark or s.sparkContext.applicationId == spark.sparkContext.applicationId]:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        del _roots[root]


def _clear_all() -> None:
    for spark in list(_roots.values()):
        try:
            clear(spark)
        except Exception:  # the session has ended; its folder stays
            _roots.clear()
            return
