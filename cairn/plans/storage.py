"""Intermediate tables in the folder that the driver and all executors share.

A written table cuts lineage, survives the loss of executors, and is computed once.  What is written inside a
``scratch`` is deleted at its end.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_inside = threading.local()
_writes, _lock = [0, None], threading.Lock()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="cairn-"))
    return _own[0]


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows, written as Parquet to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if opened := _opened():
        opened[-1].tables.append(out)
    return out


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a write go at its end, not when the driver happens to collect its garbage."""

    def put(value: str | None) -> None:
        try:
            spark.conf.set(_CLEANUP, value) if value is not None else spark.conf.unset(_CLEANUP)
        except PySparkException:  # a Spark without the setting
            pass

    with _lock:
        _writes[0] += 1
        if _writes[0] == 1:
            _writes[1] = spark.conf.getAll.get(_CLEANUP)
            put("true")
    try:
        yield
    finally:
        with _lock:
            _writes[0] -= 1
            if not _writes[0]:
                put(_writes[1])


def _opened() -> list[Scratch]:
    if not hasattr(_inside, "stack"):
        _inside.stack = []
    return _inside.stack


class Scratch:
    """Collects the tables that are stored while a thread is inside, until ``close`` deletes them."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    @contextmanager
    def entered(self) -> Iterator[Scratch]:
        _opened().append(self)
        try:
            yield self
        finally:
            _opened().pop()

    def run(self, f, *args):
        """f(*args) inside, in whatever thread."""
        with self.entered():
            return f(*args)

    def keep(self, *tables: DataFrame) -> None:
        """Leave tables to the scratch around this one, if any."""
        kept = {t._stored_at for t in tables if is_stored(t)}
        if outer := _opened()[-2:-1]:
            outer[0].tables.extend(t for t in self.tables if t._stored_at in kept)
        self.tables = [t for t in self.tables if t._stored_at not in kept]

    def close(self) -> None:
        while self.tables:
            dropped(self.tables.pop())


@contextmanager
def scratch() -> Iterator[Scratch]:
    """What is stored inside is deleted at the end, but for what is kept."""
    own = Scratch()
    try:
        with own.entered():
            yield own
    finally:
        own.close()


def is_stored(df: DataFrame) -> bool:
    """Whether the table was made by ``stored``, so that reading it again computes nothing."""
    return hasattr(df, "_stored_at")


def dropped(df: DataFrame) -> None:
    """Delete a table made by ``stored``; nothing that reads it may run afterwards."""
    path = getattr(df, "_stored_at", None)
    if path:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
