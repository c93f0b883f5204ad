"""Connected components of large graphs, and union-find over arrays inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Workspace


def union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i] in place; every set's root is its least place."""

    def root(x: np.ndarray) -> np.ndarray:
        while True:
            up = parent[x]
            if (up == x).all():
                return x
            parent[x] = parent[up]
            x = parent[up]

    while len(a):
        a, b = root(a), root(b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def roots(parent: np.ndarray) -> np.ndarray:
    while (parent[parent] != parent).any():
        parent = parent[parent]
    return parent


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


def connected_components(work: Workspace, edges: DataFrame, name: str = "edges") -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``) but the roots; a root is its component's least node.

    Stars are contracted in turn at their larger and smaller nodes until nothing changes. Minima per node are
    aggregated before the shuffle, and those of hubs are broadcast, so a hub's edges never meet in one
    task; each round is staged in the shared folder.
    """
    pair = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    sign = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    state = work.table(pair(edges), f"{name}0")
    before, turn = sign(state), 0
    while before[0]:
        turn += 1
        ends = F.array(F.struct(F.col("lo").alias("u"), F.col("hi").alias("v"), F.lit(1).alias("n")), F.struct(F.col("hi").alias("u"), F.col("lo").alias("v"), F.lit(0).alias("n")))
        least = state.select(F.inline(ends)).groupBy("u").agg(F.least("u", F.min("v")).alias("b"), F.sum("n").alias("n"))
        large = hub_join(state.withColumnRenamed("lo", "u"), least.where("n > 0"), "u", "n", before[0]).select(F.col("hi").alias("a"), "b")
        large = work.table(pair(large), f"{name}large{turn}")
        least = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("b"), F.count(F.lit(1)).alias("n"))
        joined = hub_join(large.withColumnRenamed("hi", "u"), least, "u", "n", before[0]).select(F.col("lo").alias("a"), "b")
        state = work.table(pair(joined.union(least.select(F.col("u").alias("a"), "b"))), f"{name}{turn}")
        work.drop(f"{name}{turn - 1}", f"{name}large{turn}")
        now = sign(state)
        if now == before:
            break
        before = now
    return state.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
