"""Resumable enrichment as a structured stream: new files in, results appended once, what has been seen kept as keyed state.

The batch form of the same step is ``operators.ordered.pending``. Windows by event time are an addition of this library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Keeps state on disk beside the task that owns it, and its changes in the checkpoint: a batch costs what it changes.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_writers(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key over all batches of a stream: of the first batch that has the key, the one of the least ``order``.

    Later batches' rows of a known key are dropped. The state holds a mark for each key, so a batch never reads earlier
    results.
    """
    schema = T.StructType([rows.schema[key], *[f for f in rows.schema.fields if f.name != key]])

    def judge(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            return
        best = None
        for frame in frames:
            first = frame if best is None else pd.concat([best, frame])
            best = first.sort_values(order, kind="stable", na_position="last").head(1)
        state.update((True,))
        if best is not None:
            yield best[schema.names]

    return rows.groupBy(key).applyInPandasWithState(judge, schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def _started(spark: SparkSession, writer) -> StreamingQuery:
    """The query takes the session's settings when it starts; the session's own stay as they were."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        return writer.start()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def enrich(spark: SparkSession, source: str, schema: T.StructType | str, sink: str, checkpoint: str, key: str, step: Callable[[DataFrame], DataFrame], files_per_batch: int = 25, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Runs ``step`` over the rows of new files whose ``key`` no earlier row had, until no file is left.

    ``step`` is a projection or filter, as any stream takes. ``prepare``, a cheap projection that keeps the key, runs
    on all rows before keys are looked up, so that wide columns that ``step`` needs only a part of aren't shuffled. The keys seen are state in the checkpoint and the sink keeps a
    log of its files, so a batch that runs again after a failure appends nothing twice, and no batch reads the sink.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    fresh = step((prepare(rows) if prepare else rows).dropDuplicates([key]))
    return _started(spark, fresh.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True))


def register_first(spark: SparkSession, source: str, schema: T.StructType | str, sink: str, checkpoint: str, key: str, order: str, files_per_batch: int = 25) -> StreamingQuery:
    """A registry that ignores later writers, from files as they come: :func:`first_writers` into a Parquet sink."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    found = first_writers(rows, key, order)
    return _started(spark, found.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True))


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums per event type and window; works on batches and streams alike."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
