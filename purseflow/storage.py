"""Where intermediate tables go: the folder that the cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
#: Spark's own setting to delete an execution's shuffle files when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN: dict[str, str] = {}
#: Where each table of ``materialize`` lies.
_PATHS: WeakKeyDictionary = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only where the session names none (tests in
    local mode) is a folder of our own made, once for each application."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/purseflow/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back. This cuts
    the lineage, and the copy survives the loss of any executor. The shuffles that it was made with go once it is written:
    nothing reads them again, and else they stay on disk until the driver happens to collect its garbage."""
    return gather([df], name)


def gather(parts: Iterable[DataFrame], name: str = "table") -> DataFrame:
    """``materialize`` for parts of one schema, one at least: each is written in its turn, all as one table, so that
    the shuffles of one part at a time are on disk, and what reads them all is one scan."""
    path = None
    for df in parts:
        spark = df.sparkSession
        path = path or new_path(spark, name)
        before = spark.conf.get(_CLEANUP)
        spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("append").option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads any more: neither they nor what
    was derived from them without being written. Other tables and None are passed over."""
    for table in tables:
        path = None if table is None else _PATHS.pop(table, None)
        if path is not None:
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
