"""Products of matrices in long form, tile by tile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and columns of a tile.
TILE = 256


def tiles(long: DataFrame, size: int = TILE) -> DataFrame:
    """``row, col, data``: the tiles of a matrix ``i, k, value`` that hold an entry, each dense; indexes count from 0, repeated entries add up."""

    def fill(table: pa.Table) -> pa.Table:
        tile = np.zeros((size, size))
        np.add.at(tile, (table["i"].to_numpy() % size, table["k"].to_numpy() % size), table["value"].to_numpy())
        return pa.table({"row": table["row"][:1], "col": table["col"][:1], "data": pa.array([tile.tobytes()], pa.binary())})

    placed = long.where("value is not null").select(F.floor(F.col("i") / size).alias("row"), F.floor(F.col("k") / size).alias("col"), F.col("i").cast("long").alias("i"), F.col("k").cast("long").alias("k"), F.col("value").cast("double").alias("value"))
    return placed.groupBy("row", "col").applyInArrow(fill, "row long, col long, data binary")


def matmul(a: DataFrame, b: DataFrame, f=lambda v: v, size: int = TILE) -> DataFrame:
    """``i, j, value`` of the product of two matrices ``i, k, value``, both of any shape and counted from 0; entries of 0 are absent.

    A tile of ``a`` goes to every column of tiles of ``b`` and one of ``b`` to every row of tiles of ``a``, where each pair meets
    under a key of its own: the work is dealt by output tile and inner tile, however few values the inner index has. A task
    adds up the products that it holds of an output tile before they are summed over tasks.
    """
    left, right = tiles(a, size), tiles(b, size)
    rows, columns = (df.agg(F.floor(F.max(c) / size)).first()[0] for df, c in ((a, "i"), (b, "k")))
    spread = lambda last: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-1 if last is None else last).cast("long"), F.lit(1).cast("long")))
    if rows is None or columns is None:
        return a.limit(0).select(F.col("i").cast("long").alias("i"), F.col("k").cast("long").alias("j"), F.col("value").cast("double").alias("value"))
    ours = left.select("row", F.col("col").alias("inner"), F.col("data").alias("x"), spread(columns).alias("col"))
    theirs = right.select(F.col("row").alias("inner"), "col", F.col("data").alias("y"), spread(rows).alias("row"))
    met = ours.join(theirs, ["row", "col", "inner"]).sortWithinPartitions("row", "col").select("row", "col", "x", "y")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros((size, size))

        def entries() -> pa.RecordBatch:
            i, j = np.nonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(i + at[0] * size), pa.array(j + at[1] * size), pa.array(total[i, j])], names=["i", "j", "value"])

        for batch in batches:
            for row, col, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (row, col):
                    if at is not None:
                        yield entries()
                    at, total = (row, col), np.zeros((size, size))
                total += np.frombuffer(x).reshape(size, size) @ np.frombuffer(y).reshape(size, size)
        if at is not None:
            yield entries()

    return met.mapInArrow(multiply, "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).withColumn("value", f(F.col("value")))
