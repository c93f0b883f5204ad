"""Joins that keep hot keys from one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of the rows of a table, the share that makes a key hot: at most as many keys as its inverse are.
HOT = 1 / 1000


def hub_join(left: DataFrame, right: DataFrame, on: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has a row for each key and in ``weight`` how many rows of ``left`` have it.

    Keys of more than ``HOT`` of ``total`` rows are few, so their rows of ``right`` are broadcast and no task gets all rows of
    such a key; the others meet by a shuffle, and rows without a key meet nothing. ``how`` is inner or left.
    """
    columns = [c for c in right.columns if c not in (on, weight)]
    hot = F.broadcast(right.where(F.col(weight) > max(1.0, HOT * total)).select(on, *columns))
    cold = right.where(F.col(weight) <= max(1.0, HOT * total)).select(on, *columns)
    keyed = left.where(F.col(on).isNotNull())
    out = keyed.join(hot, on).unionByName(keyed.join(hot.select(on), on, "left_anti").join(cold, on, how))
    if how == "left":
        out = out.unionByName(left.where(F.col(on).isNull()), allowMissingColumns=True)
    return out
