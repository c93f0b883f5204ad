"""Fixed-length packing of concatenated rows, and lane-balanced schedules of packs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.staging import Workspace

#: Rows of a group, or packs of a lane, whose running sums are made in one task.
RANGE_ROWS = 4096


def running_offsets(rows: DataFrame, group: list[str], size: str, key: str, seed: str = "pack") -> DataFrame:
    """Adds ``start`` (what precedes a row in its group) and ``total``, rows in the order of a keyed hash.

    A group is cut into ranges of the hash, as many as its rows ask for: sums are made per range and then over the
    ranges, so no task holds a group.
    """
    keyed = rows.withColumn("_key", F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256))
    sizes = Workspace(rows.sparkSession, "offsets").table(rows.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / RANGE_ROWS).alias("_ranges"), F.sum(size).alias("total")), "sizes")
    place = F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    ranged = keyed.join(sizes, group).withColumn("_range", F.floor(place * F.col("_ranges"))).drop("_ranges")
    sums = ranged.groupBy(*group, "_range").agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*group, "_range").orderBy("_key", key).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(offsets, [*group, "_range"]).withColumn("start", F.col("_before") + F.coalesce(F.sum(size).over(within), F.lit(0))).drop("_key", "_range", "_before")


def pack_pieces(rows: DataFrame, group: list[str], key: str, size: str, length: int) -> DataFrame:
    """``group.., key, pack, offset, tokens``: the part of each row in each pack of ``length`` tokens.

    A last pack of one token takes another from the pack before it.
    """
    placed = running_offsets(rows, group, size, key).where(F.col(size) > 0)
    short = (F.col("total") % length == 1) & (F.col("total") > length)
    last = F.ceil(F.col("total") / length) - 1
    pack_of = lambda x: F.when(short & (x >= F.col("total") - 2), last).otherwise(F.floor(x / length))
    begin = F.when(short & (F.col("pack") == last), F.col("total") - 2).otherwise(F.col("pack") * length)
    end = F.when(short & (F.col("pack") == last - 1), F.col("total") - 2).otherwise(F.least((F.col("pack") + 1) * length, F.col("total")))
    pieces = placed.withColumn("pack", F.explode(F.sequence(pack_of(F.col("start")), pack_of(F.col("start") + F.col(size) - 1))))
    low, high = F.greatest("start", begin), F.least(F.col("start") + F.col(size), end)
    return pieces.select(*group, key, "pack", (low - begin).alias("offset"), (high - low).alias("tokens")).where("tokens > 0")


def packs(pieces: DataFrame, group: list[str], key: str) -> DataFrame:
    """Per pack its tokens and the rows it comes from, in order."""
    sources = F.transform(F.array_sort(F.collect_list(F.struct("offset", F.col(key).alias("row")))), lambda x: x["row"])
    return pieces.groupBy(*group, "pack").agg(F.sum("tokens").alias("token_count"), F.array_distinct(sources).alias("source_row_ids"))


def lane_schedule(packed: DataFrame, weights: Mapping[str, float], batch: int) -> DataFrame:
    """``slot, lane, pack``: lanes are read in cycles until each has its share of tokens, and interleaved by position.

    The share of a lane is its weight of the total at which the lane that is largest for its weight is read once. The
    order is filled up to whole batches with its own beginning. A lane is summed in ranges of its packs, and the slot
    of a pack follows from its position and the lanes' lengths, so no task holds a lane.
    """
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("lane"))
    ranged = packed.withColumn("_range", F.floor(F.col("pack") / RANGE_ROWS))
    sums = ranged.groupBy("lane", "_range").agg(F.sum("token_count").alias("_tokens"), F.count(F.lit(1)).alias("_packs"))
    earlier = Window.partitionBy("lane").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    behind = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    offsets = sums.select("lane", "_range", behind("_tokens").alias("_before"), behind("_packs").alias("_first"))
    lanes = sums.groupBy("lane").agg(F.sum("_tokens").alias("lane_tokens"), F.sum("_packs").alias("lane_packs"))
    targets = lanes.withColumn("target", F.max(F.col("lane_tokens") / weight).over(Window.partitionBy()) * weight)
    within = Window.partitionBy("lane", "_range").orderBy("pack")
    upto = F.col("_before") + F.sum("token_count").over(within) - F.col("token_count")
    place = F.col("_first") + F.row_number().over(within) - 1
    ordered = ranged.join(offsets, ["lane", "_range"]).join(targets, "lane").withColumn("_upto", upto).withColumn("_place", place)
    last = F.greatest(F.ceil(F.col("target") / F.col("lane_tokens")), F.lit(1)) - 1
    cycles = ordered.withColumn("_cycle", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    kept = cycles.where(F.col("_cycle") * F.col("lane_tokens") + F.col("_upto") < F.col("target"))
    placed = kept.select("lane", "pack", (F.col("_cycle") * F.col("lane_packs") + F.col("_place")).alias("position"))
    lengths = placed.groupBy("lane").agg((F.max("position") + 1).alias("n"))
    known = lengths.agg(F.collect_list(F.struct("lane", "n")).alias("_lanes"), F.sum("n").alias("_all"))  # a row per lane
    here = lambda x: F.least(x["n"], F.col("position") + (x["lane"] < F.col("lane")).cast("long"))
    slot = F.aggregate(F.transform("_lanes", here), F.lit(0).cast("long"), lambda a, b: a + b)
    order = placed.join(known).select(slot.alias("slot"), "lane", "pack", "_all")
    filled = order.where(F.col("slot") < F.pmod(-F.col("_all"), F.lit(batch))).select(F.col("_all") + F.col("slot"), "lane", "pack")
    return order.drop("_all").union(filled)
