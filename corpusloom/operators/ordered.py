"""Order-sensitive operators: ranks, returns, advantages, streaks, audits of positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.staging import Workspace


def ranked(df: DataFrame, family: str, *order: Column | str) -> DataFrame:
    """Adds ``ordinal``: the place of a row in its family, from 1."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(family).orderBy(*order)))


def nested_subsets(df: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """Adds ``in_n`` for each size: nested, since all follow from one rank."""
    return df.withColumns({f"in_{n}": F.col("ordinal") <= n for n in sizes})


def round_robin(df: DataFrame, workers: int, *order: Column | str) -> DataFrame:
    """Adds ``worker`` by the place of a row in the whole order; places come from sorted ranges, not from one task.

    The range of a row is staged with it, so counting and numbering see the same ranges however often they are
    planned. Rows that ``order`` does not tell apart are numbered by their other columns' hash, then in any order.
    """
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    ranged = df.withColumn("_tie", tie).repartitionByRange(*order, "_tie").withColumn("_part", F.spark_partition_id())
    staged = Workspace(df.sparkSession, "places").table(ranged, "ranges")
    counts = staged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order, "_tie")) - 1 + F.col("_before")
    placed = staged.join(before, "_part").withColumn("place", place)
    return placed.withColumn("worker", F.pmod("place", F.lit(workers))).drop("_part", "_before", "_tie")


def discounted_returns(scores: DataFrame, gamma: float) -> DataFrame:
    """``task_id, trajectory, turn, score, raw_return``: each turn's score and the discounted ones after it."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "score")))
    step = lambda acc, x: F.concat(F.array(F.struct(x["turn"].alias("turn"), x["score"].alias("score"), (x["score"] + F.lit(gamma) * F.coalesce(F.try_element_at(acc, F.lit(1))["raw_return"], F.lit(0.0))).alias("raw_return"))), acc)
    kind = dict(scores.dtypes)["turn"]
    folded = F.aggregate(F.reverse("turns"), F.array().cast(f"array<struct<turn:{kind},score:double,raw_return:double>>"), step)
    return scores.groupBy("task_id", "trajectory").agg(turns.alias("turns")).select("task_id", "trajectory", F.inline(folded))


def group_advantages(returns: DataFrame) -> DataFrame:
    """Adds ``advantage`` and ``trainable``: returns normalized over all turns of a task; a constant task teaches nothing."""
    stats = returns.groupBy("task_id").agg(F.avg("raw_return").alias("_mean"), F.stddev_pop("raw_return").alias("_deviation"), F.min("raw_return").alias("_low"), F.max("raw_return").alias("_high"))
    constant = F.col("_low") == F.col("_high")
    advantage = F.when(constant, 0.0).otherwise((F.col("raw_return") - F.col("_mean")) / F.col("_deviation"))
    return returns.join(stats, "task_id").withColumn("advantage", advantage).withColumn("trainable", ~constant).drop("_mean", "_deviation", "_low", "_high")


def centered_advantages(rewards: DataFrame, group: str, reward: str) -> DataFrame:
    """Rewards less their group's mean; groups in which that is always zero are dropped."""
    stats = rewards.groupBy(group).agg(F.avg(reward).alias("_mean"), F.min(reward).alias("_low"), F.max(reward).alias("_high")).where("_low < _high")
    return rewards.join(stats, group).withColumn("advantage", F.col(reward) - F.col("_mean")).drop("_mean", "_low", "_high")


def first_streak(steps: DataFrame, key: str, step: str, idle: Column, length: int) -> DataFrame:
    """``key, stop_step``: where ``length`` idle steps in a row first end."""
    order = Window.partitionBy(key).orderBy(step)
    busy = F.sum((~idle).cast("long")).over(order)
    run = steps.withColumn("_idle", idle).withColumn("_run", busy).where("_idle")
    streak = run.withColumn("_length", F.row_number().over(Window.partitionBy(key, "_run").orderBy(step)))
    return streak.where(F.col("_length") == length).groupBy(key).agg(F.min(step).alias("stop_step"))


def until_success(rounds: DataFrame, key: str, order: str, success: Column, most: int) -> DataFrame:
    """Rounds up to the first success, ``most`` at the utmost."""
    w = Window.partitionBy(key).orderBy(order)
    numbered = rounds.withColumn("round", F.row_number().over(w)).withColumn("_won", F.min(F.when(success, F.col(order))).over(Window.partitionBy(key)))
    return numbered.where((F.col("round") <= most) & (F.col("_won").isNull() | (F.col(order) <= F.col("_won")))).drop("_won")


def supervision_audit(weights: DataFrame, key: str, position: str, weight: str) -> DataFrame:
    """Per row whether the positively weighted positions are contiguous and reach the end."""
    on = F.col(weight) > 0
    spans = weights.groupBy(key).agg(F.count_if(on).alias("supervised"), F.min(F.when(on, F.col(position))).alias("first"), F.max(F.when(on, F.col(position))).alias("last"), F.max(position).alias("end"))
    return spans.select(key, "supervised", F.coalesce(F.col("last") - F.col("first") + 1 == F.col("supervised"), F.lit(False)).alias("contiguous"), F.coalesce(F.col("last") == F.col("end"), F.lit(False)).alias("reaches_end"))


def pending(rows: DataFrame, done: DataFrame, keys: list[str], eligible: Column) -> DataFrame:
    """Eligible rows for which no result with the same keys exists."""
    return rows.where(eligible).join(done, keys, "left_anti")
