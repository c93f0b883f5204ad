"""Tables staged as Parquet in the folder that driver and executors share, so that no later job depends on an executor's disk."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Removes a query's shuffle files when it ends: a staged table needs none of them any more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_open: list[list[Workspace]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session that names none (a test) gets a temporary folder; on a cluster its absence is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Tables below this many rows often are one row group of one file, which one task would read.
FEW_ROWS = 200_000


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt over all cores if it is small, before work that costs far more than moving its rows."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if df.count() < FEW_ROWS else df


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold for the jobs started inside."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


class Workspace:
    """A folder of staged tables. Whoever consumes the result removes it: by :func:`scratch`, or at the end of the process."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        if _open:
            _open[-1].append(self)
        else:
            atexit.register(self.remove)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Writes ``df`` once and reads it back; its lineage and its shuffle files end here."""
        with settings(self.spark, {CLEANUP: "true"}):
            df.write.options(**options).mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Removes staged tables that no returned frame reads any more."""
        for name in names:
            self._delete(self.path(name))

    def remove(self) -> None:
        """Removes the folder, if the session still runs."""
        if self.spark.getActiveSession() is not None or self.spark._instantiatedSession is self.spark:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)

    def _delete(self, path: str) -> None:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Removes, at its end, every folder of staged tables that was made inside: for results that are written by then."""
    _open.append([])
    try:
        yield
    finally:
        for work in _open.pop():
            work.remove()
