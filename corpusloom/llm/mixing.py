"""Mixing sources to target weights along a time-varying curriculum; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import Workspace, read_table

#: Fixed by the contract: a word, the weights by rank of the source, the mix's share of all words, the cap.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2
#: A source's weight at time t of the run is its mean weight times 1 + slope * (2 t - 1), by rank.
SLOPES = (-0.5, 0.0, 0.5)
ROWS_PER_RANGE = 4096


def source_targets(sizes: DataFrame) -> DataFrame:
    """Per source: rank, weight, slope, ``source_size``, ``target``.

    Targets share ``SHARE`` of all words by weight and stop at ``CAP`` times the source's words. Sources are
    filled in the order of words per weight; the first rank whose share of what is left stays under its cap
    ends the capped ones, so no iteration is needed. The frame has a row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1

    def cycle(values) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(F.col("rank"), F.lit(len(values))) + 1)

    by_fill = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_fill.rowsBetween(0, Window.unboundedFollowing)
    ranked = by_source.withColumn("rank", rank.cast("int")).withColumn("weight", cycle(WEIGHTS)).withColumn("slope", cycle(SLOPES))
    level = (F.lit(SHARE) * F.sum("source_size").over(Window.partitionBy()) - F.lit(float(CAP)) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(from_here)
    filled = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.lit(float(CAP)) * F.col("source_size"))
    settled = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(Window.partitionBy().orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.coalesce(settled, F.lit(0.0)) * F.col("weight") <= F.lit(float(CAP)) * F.col("source_size"), settled * F.col("weight")).otherwise(F.lit(float(CAP)) * F.col("source_size"))
    return filled.withColumn("target", F.coalesce(target, F.lit(0.0))).select("source", "rank", "weight", "slope", "source_size", "source_docs", "target")


#: What :func:`mix_sources` adds.
ADDED = ("size", "source_size", "target", "taken", "position", "positions")


def mix_sources(docs: DataFrame, seed: str = "mix", prefix: str = "", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Adds ``size, source_size, target, taken, position, positions`` to every row of ``docs``, or to its columns ``keep``.

    Each source is a stream of its documents in the order of a keyed hash of ``doc_id``, read again from the start
    when it ends, of which the mix takes ``floor(target)`` words; ``taken`` counts the words taken of a document over
    both passes, and only the last document of a stream can be taken in part. ``position`` (0 to 1, null if
    nothing is taken) is the time at which the integral of the source's weight schedule reaches the words
    before the document's first taking, ``positions`` has this for each taking: sort by it to get the training order.

    A null text or one of white space has size 0 and is taken 0 words; a null source is a source of its own,
    the last; a source without words has target 0; repeated rows and ids are rows of their own; an empty table gives
    no row. The added columns' names begin with ``prefix``; columns of these names in ``docs`` are replaced, others are kept.
    """
    names = {c: prefix + c for c in ADDED}
    columns = [c for c in (keep or docs.columns) if c not in names.values()]
    work = Workspace(docs.sparkSession, "mix")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0))
    own = {"_size": size, "_key": key, "_tie": F.xxhash64("text"), "_from": F.col("source")}
    # words are counted once: later steps read numbers, and the columns to keep only at the end
    clash = {c: f"_own_{k}" for k, c in enumerate(columns)}
    keyed = work.table(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in clash.items()], *[v.alias(k) for k, v in own.items()]), "sized")
    # Staged, so that the planner knows its size and broadcasts it only where it is small.
    wanted = source_targets(keyed.select(F.col("_from").alias("source"), F.col("_size").alias("size")))
    targets = work.table(wanted.toDF("_source", "_rank", "_weight", "_slope", "_source_size", "_docs", "_target"), "targets")
    # A hot source is cut into ranges of the hash, so that no window holds more than some thousand rows of it.
    ranges = F.ceil(F.col("_docs") / F.lit(ROWS_PER_RANGE))
    place = F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") * ranges / F.lit(4294967296.0))
    placed = keyed.join(targets, keyed["_from"].eqNullSafe(targets["_source"])).withColumn("_range", place)
    totals = placed.groupBy("_rank", "_range").agg(F.sum("_size").alias("_words"))
    earlier = Window.partitionBy("_rank").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_rank").alias("_r"), F.col("_range").alias("_g"), F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_offset"))
    order = Window.partitionBy("_rank", "_range").orderBy("_key", "_size", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumn("_within", F.sum("_size").over(order)).join(offsets, (F.col("_rank") == F.col("_r")) & (F.col("_range") == F.col("_g")))
    start = F.col("_offset") + F.col("_within") - F.col("_size")
    words = F.floor("_target").cast("long")
    passes = F.when(F.col("_source_size") > 0, F.floor(words / F.col("_source_size"))).otherwise(0)
    rest = words - passes * F.col("_source_size")
    taken = F.col("_size") * passes + F.least(F.col("_size"), F.greatest(rest - start, F.lit(0)))
    # integral of target * (1 - s + 2 s t) from 0 to t is target * ((1 - s) t + s t^2)
    slope = F.col("_slope")

    def time(words_before: Column) -> Column:
        share = F.least(words_before / F.col("_target"), F.lit(1.0))
        curve = (F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope)
        return F.round(F.when(slope == 0, share).otherwise(curve), 6)

    takings = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_taken") / F.col("_size")).cast("int"), F.lit(1)) - 1)
    times = F.transform(takings, lambda k: time(start + k * F.col("_source_size")))
    positions = F.when(F.col("_taken") > 0, times).otherwise(F.array().cast("array<double>"))
    mixed = summed.withColumn("_taken", taken.cast("long")).withColumn("_positions", positions)
    mixed = mixed.withColumn("_position", F.try_element_at("_positions", F.lit(1)))
    return mixed.select(*[F.col(n).alias(c) for c, n in clash.items()], *[F.col(f"_{c}").alias(n) for c, n in names.items()])


def training_order(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, range-sorted by position.

    Documents stay whole: the one that ends a source's stream is taken once more if at least half of its words
    are, so a source's words differ from its target by at most half a document. A document without words is never
    taken; repeated rows are documents of their own; all columns come back as they were, whatever their names; an
    empty table gives no row.
    """
    mixed = mix_sources(docs, seed, "_mix_")
    times = F.when(F.col("_mix_size") > 0, F.round(F.col("_mix_taken") / F.col("_mix_size"))).otherwise(0).cast("int")
    at = F.explode(F.slice("_mix_positions", F.lit(1), times))
    placed = mixed.withColumn("_mix_at", at).withColumn("_mix_key", F.xxhash64(F.lit(seed), "doc_id"))
    return placed.repartitionByRange("_mix_at", "_mix_key").sortWithinPartitions("_mix_at", "_mix_key").select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs, keep=("doc_id",)).select("doc_id", "size", "source_size", "target", "taken", "position").orderBy("position", "doc_id")
