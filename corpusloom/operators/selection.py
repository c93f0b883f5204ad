"""Exact medians by key, whatever share of the rows a key holds.

Keys of few rows go through one aggregation. For the others a quantile sketch, merged from all tasks, brackets the
middle; rows are counted below the bracket and, by value, inside it, so only distinct values of the bracket are ever
sorted. Where these are still many, the bracket is narrowed by another sketch of the values inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.staging import Workspace

#: Rows from which a key's median is selected, a sketch's accuracy, and distinct values that are sorted together.
MANY, ACCURACY, SORTED = 200_000, 10_000, 1_000_000


def medians(df: DataFrame, keys: list[str], many: int = MANY, accuracy: int = ACCURACY, most: int = SORTED, **values: Column) -> DataFrame:
    """``keys`` and, by the names of ``values``, the exact median of each key's values as a double, null where it has none.

    The median of an even number of values is the mean of the middle two. Nulls don't count; NaN is the largest
    value; null keys are keys of their own; an empty table gives no row.
    """
    slim = df.select(*keys, *[c.cast("double").alias(name) for name, c in values.items()])
    counts = slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    work = Workspace(df.sparkSession, "medians")
    counts = work.table(counts, "counts")
    # at most one key in ``many`` rows is large, so this side stays small beside the rows it is joined to
    large = counts.where(F.col("_n") > many).drop("_n")
    if large.isEmpty():
        return slim.groupBy(*keys).agg(*[F.median(name).alias(name) for name in values])
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    few = slim.join(F.broadcast(large), same(slim, large), "left_anti").groupBy(*keys).agg(*[F.median(name).alias(name) for name in values])
    hot = slim.join(F.broadcast(large), same(slim, large), "left_semi")
    names = F.array(*[F.struct(F.lit(name).alias("_name"), F.col(name).alias("_value")) for name in values])
    long = work.table(hot.select(*keys, F.inline(names)).where("_value is not null"), "long")
    found = _selected(work, long, [*keys, "_name"], accuracy, most)
    picked = large
    for name in values:
        one = found.where(F.col("_name") == name).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_median").alias(name))
        picked = picked.join(one, [picked[k].eqNullSafe(one[f"_{k}"]) for k in keys], "left").drop(*[f"_{k}" for k in keys])
    return few.unionByName(picked.select(*keys, *values))


def _selected(work: Workspace, long: DataFrame, keys: list[str], accuracy: int, most: int) -> DataFrame:
    """``keys, _median`` of the column ``_value`` of ``long``; a row for each key, of which there are few."""
    share = 2.0 / accuracy
    wanted = work.table(long.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "wanted").select(*keys, F.floor((F.col("_n") + 1) / 2).alias("_k1"), (F.floor(F.col("_n") / 2) + 1).alias("_k2"))
    # ``_below`` rows lie under all that is left of a key; its ranks ``_k1`` and ``_k2`` are counted from 1 over all its rows
    state = work.table(wanted.withColumn("_below", F.lit(0).cast("long")), "state0")
    rows, turn, before = long, 0, None
    on = lambda a, b: [a[k].eqNullSafe(b[f"_s{k}"]) for k in keys]
    renamed = lambda s: s.select(*[F.col(k).alias(f"_s{k}") for k in keys], *[c for c in s.columns if c not in keys])
    while True:
        turn += 1
        size = renamed(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_left")))
        at = F.array((F.col("_k1") - F.col("_below")) / F.col("_left") - share, (F.col("_k2") - F.col("_below")) / F.col("_left") + share)
        bounds = state.join(size, on(state, size)).select(*state.columns, "_left", F.greatest(F.lit(0.0), at[0]).alias("_p"), F.least(F.lit(1.0), at[1]).alias("_q"))
        # a sketch takes constant percentages, so it gives a hundred quantiles and the bracket lies between two of them
        grid = [i / 1000 for i in range(1001)]
        sketch = rows.groupBy(*keys).agg(F.percentile_approx("_value", grid, accuracy).alias("_grid"))
        low = F.element_at("_grid", F.greatest(F.lit(1), (F.floor(F.col("_p") * 1000)).cast("int") + 1))
        high = F.element_at("_grid", F.least(F.lit(1001), (F.ceil(F.col("_q") * 1000)).cast("int") + 1))
        r = renamed(sketch)
        bracket = work.table(bounds.join(r, on(bounds, r)).select(*state.columns, low.alias("_low"), high.alias("_high")), f"bracket{turn}")
        b = renamed(bracket)
        inside = rows.join(F.broadcast(b), on(rows, b)).select(*keys, "_value", "_k1", "_k2", "_below", (F.col("_value") < F.col("_low")).alias("_under"), (F.col("_value") <= F.col("_high")).alias("_in"))
        under = inside.where("_under").groupBy(*keys).agg(F.count(F.lit(1)).alias("_more"))
        u = renamed(under)
        state = work.table(bracket.join(u, on(bracket, u), "left").select(*keys, "_k1", "_k2", (F.col("_below") + F.coalesce("_more", F.lit(0))).alias("_below")), f"state{turn}")
        rows = work.table(inside.where("not _under and _in").select(*keys, "_value"), f"rows{turn}")
        distinct = work.table(rows.groupBy(*keys, "_value").agg(F.count(F.lit(1)).alias("_times")), f"distinct{turn}")
        largest = distinct.groupBy(*keys).count().agg(F.max("count")).first()[0]
        if largest is None or largest <= most or largest == before:
            break
        before = largest
    upto = F.sum("_times").over(Window.partitionBy(*keys).orderBy("_value").rowsBetween(Window.unboundedPreceding, 0))
    s = renamed(state)
    placed = distinct.withColumn("_upto", upto).join(F.broadcast(s), on(distinct, s)).withColumn("_upto", F.col("_upto") + F.col("_below"))
    first = lambda k: F.min(F.when(F.col("_upto") >= F.col(k), F.col("_value")))
    return placed.groupBy(*keys).agg((first("_k1") * 0.5 + first("_k2") * 0.5).alias("_median"))
