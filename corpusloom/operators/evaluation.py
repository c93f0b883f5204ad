"""Roll-ups of evaluation cells: pass rates, pairs, transitions, timings, curves, audits of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.ordered import round_robin
from corpusloom.operators.selection import medians

#: Stages that a verified result must have passed.
STAGES = ("source", "compile", "correctness", "profile")


def guarded_rate(n: Column, d: Column, digits: int = 6) -> Column:
    """A rounded rate, null on an empty denominator."""
    return F.round(F.try_divide(n, d), digits)


def rate_or_zero(n: Column, d: Column) -> Column:
    return F.coalesce(F.try_divide(n, d), F.lit(0.0))


def tri_state(stages: Column, infrastructure: Column) -> Column:
    """-1 for an infrastructure error, 1 if all mandatory stages passed, else 0."""
    passed = F.forall(F.array(*map(F.lit, STAGES)), lambda s: F.coalesce(F.try_element_at(stages, s), F.lit(False)))
    return F.when(infrastructure, -1).when(passed, 1).otherwise(0)


def verified_score(passed: Column, stages: Column, infrastructure: Column, speedup: Column, bonus: float = 0.3) -> Column:
    """-1, 0, or the bonus plus a finite positive speedup of a fully verified result."""
    every = F.forall(F.array(*map(F.lit, STAGES)), lambda s: F.coalesce(F.try_element_at(stages, s), F.lit(False)))
    usable = speedup.isNotNull() & ~F.isnan(speedup) & (speedup > 0) & (speedup < float("inf"))
    return F.when(infrastructure, -1.0).when(passed & every & usable, F.lit(bonus) + speedup).otherwise(0.0)


def clipped_reward(correct: Column, fast: Column, speedup: Column) -> Column:
    """0.3 for correct, 0.3 more for at least the baseline's speed, and up to 0.4 for a speedup from one to two."""
    extra = F.greatest(F.least(speedup - 1.0, F.lit(1.0)), F.lit(0.0))
    return F.when(~correct, 0.0).otherwise(0.3 + F.when(fast, 0.3 + 0.4 * extra).otherwise(0.0))


#: What a process leaves behind when the candidate broke it, and what makes a device unsafe to use again.
CANDIDATE_MARKERS = ("aborted", "check failed", "dma", "out of bounds", "segmentation fault", "sigabrt")
POISON_MARKERS = ("core halted", "device halted", "dma.hbm_to_vmem", "dma.vmem_to_hbm", "sigabrt", "segmentation fault")
CANDIDATE_CODES, POISON_CODES = (124, 134, 137, 139), (134, 137, 139)
#: The stages that a candidate has passed when its process fails, and those it has not.
PASSED_STAGES = ("artifact_contract", "pallas_api", "tpu_compile")
OPEN_STAGES = ("full_shape_correctness", "normal_lowering", "runtime_safety", "profile")


def _any_marker(text: Column, markers: Sequence[str]) -> Column:
    folded, found = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for m in markers:
        found = found | F.contains(folded, F.lit(m))
    return found


def needs_recovery(code: Column, stderr: Column, error: Column) -> Column:
    """Whether a failure may leave the device unsafe to use again: killed, aborted, or a marker in what it wrote."""
    return F.coalesce((code < 0) | code.isin(*POISON_CODES), F.lit(False)) | _any_marker(stderr, POISON_MARKERS) | _any_marker(error, POISON_MARKERS)


def process_failure(code: Column, stderr: Column, timed_out: Column) -> Column:
    """A struct ``passed, stage, error, infrastructure_error, worker_recovery_required, stages`` of a process that failed.

    Timeouts, signals and what the markers tell are the candidate's failure in ``runtime_safety``, the rest the verifier's.
    ``stages`` is null where nothing is known of the candidate.
    """
    out = F.coalesce(timed_out, F.lit(False))
    candidate = out | F.coalesce((code < 0) | code.isin(*CANDIDATE_CODES), F.lit(False)) | _any_marker(stderr, CANDIDATE_MARKERS)
    number = code.cast("string")
    error = F.when(out, F.lit("CANDIDATE_PROCESS_TIMEOUT")).when(candidate, F.concat(F.lit("CANDIDATE_PROCESS_EXIT_"), number)).otherwise(F.concat(F.lit("VERIFIER_PROCESS_EXIT_"), number))
    stages = F.create_map(*[F.lit(x) for name in (*PASSED_STAGES, *OPEN_STAGES) for x in (name, name in PASSED_STAGES)])
    return F.struct(
        F.lit(False).alias("passed"),
        F.when(candidate, F.lit("runtime_safety")).otherwise(F.lit("infrastructure")).alias("stage"),
        error.alias("error"),
        (~candidate).alias("infrastructure_error"),
        candidate.alias("worker_recovery_required"),
        F.when(candidate, stages).alias("stages"),
    )


def _counted(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """``key`` and a map from each value to its rows, in the order of the values; rows whose value is null don't count."""
    counts = rows.select(key, value.cast("string").alias("_v")).where("_v is not null").groupBy(key, "_v").agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_v", "_c")))).alias(name))


def model_summary(cells: DataFrame, headroom: float = 1.05) -> DataFrame:
    """Per model: pass rate, verified speedups (median, least, largest, above one, at least ``headroom``), failures by stage and family, halts.

    ``cells`` has ``model_id, reward, speedup, stage, family, worker_recovery_required``. A failed cell without a stage
    counts as ``unknown``. :func:`verified_speedups` lists the speedups themselves, a row each; :func:`stage_means` has
    the shares of passed stages.
    """
    verified = F.col("reward") == 1
    speedup, failed = F.when(verified, F.col("speedup")), cells.where(~verified)
    summed = cells.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(verified).alias("n_verified"),
        guarded_rate(F.count_if(verified), F.count(F.lit(1))).alias("pass_rate"),
        F.round(F.min(speedup), 6).alias("least_speedup"),
        F.round(F.max(speedup), 6).alias("best_speedup"),
        F.count_if(speedup > 1.0).alias("n_faster"),
        F.count_if(speedup >= headroom).alias("n_headroom"),
        F.count_if(F.col("worker_recovery_required")).alias("n_halts"),
    )
    middle = medians(cells, ["model_id"], median_speedup=speedup).withColumn("median_speedup", F.round("median_speedup", 6))
    stages = _counted(failed, "model_id", F.coalesce("stage", F.lit("unknown")), "failure_stages")
    families = _counted(failed, "model_id", F.col("family"), "failure_families")
    none = F.create_map().cast("map<string,bigint>")
    joined = summed.join(middle, "model_id").join(stages, "model_id", "left").join(families, "model_id", "left")
    return joined.withColumns({c: F.coalesce(c, none) for c in ("failure_stages", "failure_families")})


def verified_speedups(cells: DataFrame) -> DataFrame:
    """``model_id, rank, speedup``: the speedups of each model's verified cells in order, from 1.

    Ranks come from ranges of the whole order, so a model with most of the cells is numbered by all tasks.
    """
    rows = cells.where((F.col("reward") == 1) & F.col("speedup").isNotNull()).select("model_id", "speedup")
    placed = round_robin(rows, 1, "model_id", "speedup")
    first = placed.groupBy("model_id").agg(F.min("place").alias("_first"))
    return placed.join(first, "model_id").select("model_id", (F.col("place") - F.col("_first") + 1).alias("rank"), "speedup")


def stage_means(cells: DataFrame, stages: Sequence[str], fractions: str = "fractions") -> DataFrame:
    """Per model and stage the mean fraction, a missing one counting as 0."""
    each = cells.select("model_id", F.explode(F.array(*map(F.lit, stages))).alias("stage"), fractions)
    return each.groupBy("model_id", "stage").agg(F.round(F.avg(F.coalesce(F.try_element_at(F.col(fractions), F.col("stage")), F.lit(0.0))), 9).alias("mean_fraction"))


def family_pivot(cells: DataFrame, before: str, after: str) -> DataFrame:
    """Per family the verified cells of two models and whether the second fell behind."""
    count = lambda m: F.count_if((F.col("model_id") == m) & (F.col("reward") == 1))
    return cells.groupBy("family").agg(count(before).alias("before"), count(after).alias("after")).withColumn("regressed", F.col("after") < F.col("before"))


def pairs(cells: DataFrame, before: str, after: str, key: Sequence[str]) -> DataFrame:
    """The cells of two models side by side by ``key``; a cell of one alone has null on the other side."""
    value = lambda m: F.max(F.when(F.col("model_id") == m, F.col("reward")))
    return cells.where(F.col("model_id").isin(before, after)).groupBy(*key).agg(value(before).alias("before"), value(after).alias("after"))


def win_tie_loss(paired: DataFrame) -> DataFrame:
    delta = F.col("after") - F.col("before")
    return paired.agg(F.count_if(delta > 0).alias("wins"), F.count_if(delta == 0).alias("ties"), F.count_if(delta < 0).alias("losses"), F.sum(delta.cast("long")).alias("sum_delta"), F.round(F.avg(delta), 9).alias("mean_delta"), F.count_if(delta.isNull()).alias("incomplete"))


def transitions(paired: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of the four transitions between failing and passing, zeros included."""
    before, after = F.col("before") == 1, F.col("after") == 1
    counts = [F.count_if(before & after).alias("pass_pass"), F.count_if(before & ~after).alias("pass_fail"), F.count_if(~before & after).alias("fail_pass"), F.count_if(~before & ~after).alias("fail_fail")]
    return paired.groupBy(*by).agg(*counts)


def three_grains(cells: DataFrame) -> DataFrame:
    """Pass rates overall, by seed and by workload, from one aggregation over grouping sets."""
    grouped = cells.groupingSets([[], ["seed"], ["workload"]], "seed", "workload")
    rate = guarded_rate(F.count_if(F.col("reward") == 1), F.count_if(F.col("reward") >= 0))
    return grouped.agg(F.grouping_id().cast("int").alias("grain"), F.count(F.lit(1)).alias("n"), rate.alias("pass_rate"))


def seed_consistency(cells: DataFrame) -> DataFrame:
    """Tasks that pass with any and with all seeds, and the spread of the seeds' pass rates."""
    by_task = cells.groupBy("task_id").agg(F.max("reward").alias("best"), F.min("reward").alias("worst"))
    tasks = by_task.agg(F.count_if(F.col("best") == 1).alias("any_seed"), F.count_if(F.col("worst") == 1).alias("all_seeds"))
    rates = cells.groupBy("seed").agg(guarded_rate(F.count_if(F.col("reward") == 1), F.count(F.lit(1))).alias("rate"))
    return tasks.join(rates.agg(F.round(F.max("rate") - F.min("rate"), 6).alias("rate_range")))


def timing_evidence(samples: DataFrame, key: str, value: str, minimum: int = 3, largest_cv: float = 0.1) -> DataFrame:
    """Median and coefficient of variation (population) of each key's samples, and whether they are stable.

    The last digits of a deviation depend on the order in which samples are added, so it is taken to 13 places: one
    that is the largest allowed, or halfway between two roundings, is treated as such in any order.
    """
    cv = F.round(F.stddev_pop(value) / F.avg(value), 13)
    stable = (F.count(value) >= minimum) & (F.coalesce(cv, F.lit(float("inf"))) <= largest_cv)
    summed = samples.groupBy(key).agg(F.count(value).alias("runs"), F.round(cv, 6).alias("cv"), stable.alias("stable"))
    middle = medians(samples, [key], median=F.col(value)).select(F.col(key).alias("_key"), F.round("median", 6).alias("median"))
    return summed.join(middle, F.col(key).eqNullSafe(F.col("_key"))).select(key, "runs", "median", "cv", "stable")


def speedups(samples: DataFrame, key: str, value: str, side: str) -> DataFrame:
    """The ratio of the baseline's median to the candidate's."""
    of = lambda s: F.when(F.col(side) == s, F.col(value))
    both = medians(samples, [key], _baseline=of("baseline"), _candidate=of("candidate"))
    return both.select(key, F.round(F.try_divide("_baseline", "_candidate"), 6).alias("speedup"))


def learning_curve(cells: DataFrame) -> DataFrame:
    """Per training count the mean, population deviation and range of scores, and the step from the count before.

    On every row ``slope``, the mean step from the first count to the last (null for a single one), and ``monotonic``,
    whether no step of the whole curve falls. Counts are few, so one task orders them.
    """
    by_count = cells.groupBy("n_train").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("deviation"), F.min("score").alias("least"), F.max("score").alias("largest"))
    step = F.col("mean") - F.lag("mean").over(Window.orderBy("n_train"))
    every = Window.orderBy("n_train").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rise = (F.last("mean").over(every) - F.first("mean").over(every)) / F.nullif(F.count(F.lit(1)).over(every) - 1, F.lit(0))
    told = by_count.withColumn("_step", step).withColumn("rising", F.coalesce(F.col("_step") >= 0, F.lit(True)))
    told = told.withColumn("slope", F.round(rise, 6)).withColumn("monotonic", F.bool_and("rising").over(every))
    return told.select("n_train", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), "least", "largest", F.round("_step", 6).alias("step"), "rising", "slope", "monotonic")


def confusion(cells: DataFrame, truth: Column, said: Column) -> DataFrame:
    """True and false positives and negatives, and their rates with 0 on an empty denominator."""
    counts = cells.agg(F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"), F.count_if(~truth & ~said).alias("tn"))
    return counts.withColumn("fp_rate", F.round(rate_or_zero(F.col("fp"), F.col("fp") + F.col("tn")), 9)).withColumn("fn_rate", F.round(rate_or_zero(F.col("fn"), F.col("fn") + F.col("tp")), 9))


def weighted_loss(rows: DataFrame) -> DataFrame:
    """Token-weighted mean loss per lane and in total (lane null)."""
    mean = F.sum(F.col("tokens") * F.col("nll")) / F.sum("tokens")
    return rows.rollup("lane").agg(F.sum("tokens").alias("tokens"), F.round(mean, 6).alias("mean_nll"))


def prior_deltas(rungs: DataFrame) -> DataFrame:
    """Each rung's rate less that of the rung it names."""
    prior = rungs.select(F.col("id").alias("delta_vs"), F.col("rate").alias("prior_rate"))
    return rungs.join(prior, "delta_vs", "left").select("id", "delta_vs", "rate", F.round(F.col("rate") - F.col("prior_rate"), 6).alias("delta"))


def fan_out(work: DataFrame, key: Sequence[str]) -> DataFrame:
    """Equal work is done once: each row learns its representative and whether it was a hit."""
    first = work.groupBy(*key).agg(F.min("unit_id").alias("source_unit"))
    return work.join(first, list(key)).select("unit_id", "source_unit", (F.col("unit_id") != F.col("source_unit")).alias("cache_hit"))


def verdict_lattice(rows: DataFrame, copy_threshold: float = 0.90, headline: float = 1.05, need_lowering: bool = False) -> DataFrame:
    """Adds ``scorable, copied, credited, kernel_credited, headline, no_credit_reasons`` (in order, each once).

    ``rows`` has ``context`` (``spec``, or ``baseline`` where the prompt showed the reference), ``compiled, correct,
    similarity`` (null if unknown), ``verbatim, authentic, inspection`` (the reasons against authenticity), ``stable``
    (null if unknown), ``lowering`` (null if there is no evidence) and ``speedup``. A copy counts only where the prompt showed
    the reference; unstable timing costs the headline alone.
    """
    known = lambda c: F.coalesce(F.col(c), F.lit(False))
    scorable = F.coalesce(F.col("context") == "spec", F.lit(False))
    near = known("verbatim") | F.coalesce(F.col("similarity") >= copy_threshold, F.lit(False))
    copied = F.coalesce(F.col("context") == "baseline", F.lit(False)) & near
    compiled, correct, authentic, lowered = known("compiled"), known("correct"), known("authentic"), known("lowering")
    asked = F.lit(need_lowering) & compiled & correct & authentic & ~lowered
    reasons = F.concat(
        F.array(
            F.when(~scorable, F.lit("DIAGNOSTIC_PROMPT_CONTEXT")),
            F.when(~compiled, F.lit("TPU_COMPILE_FAILED")),
            F.when(~correct, F.lit("CORRECTNESS_FAILED")),
            F.when(copied, F.lit("REFERENCE_COPY")),
        ),
        F.coalesce("inspection", F.array().cast("array<string>")),
        F.array(
            F.when(F.col("stable") == F.lit(False), F.lit("TIMING_UNSTABLE")),
            F.when(asked & F.col("lowering").isNotNull(), F.lit("LOWERING_EVIDENCE_FAILED")).when(asked, F.lit("LOWERING_EVIDENCE_MISSING")),
        ),
    )
    credited = scorable & correct & ~copied
    kernel = credited & compiled & authentic & (lowered if need_lowering else F.lit(True))
    fast = kernel & known("stable") & F.coalesce(F.col("speedup") >= headline, F.lit(False))
    return rows.withColumns({"scorable": scorable, "copied": copied, "credited": credited, "kernel_credited": kernel, "headline": fast, "no_credit_reasons": F.array_distinct(F.array_compact(reasons))})


def roofline(rows: DataFrame, flops_per_s: float, bytes_per_s: float) -> DataFrame:
    """The time that arithmetic and memory allow at best, which of them binds, and the share that was reached."""
    compute, memory = F.col("flops") / flops_per_s, F.col("bytes") / bytes_per_s
    floor = F.greatest(compute, memory)
    return rows.withColumn("floor_us", F.round(floor * 1e6, 6)).withColumn("bound", F.when(compute >= memory, "compute").otherwise("memory")).withColumn("efficiency", F.round(floor * 1e6 / F.col("measured_us"), 9))


def unequal_task_sets(cells: DataFrame) -> DataFrame:
    """Tasks that some model lacks, from counts per task and the number of models."""
    models = cells.agg(F.count_distinct("model_id").alias("models"))
    by_task = cells.groupBy("task_id").agg(F.count_distinct("model_id").alias("n"))
    return by_task.join(models).where(F.col("n") < F.col("models")).select("task_id", "n")


#: Models and seeds that a plan may name: configured lists, not data.
MOST_PLANNED = 10_000


def planned(tasks: DataFrame, models: DataFrame, seeds: DataFrame) -> DataFrame:
    """``task_id, model_id, seed``: every task with every model and seed. A row of ``tasks`` unfolds by itself, whatever their number.

    Models times seeds may be ``MOST_PLANNED`` at most; more is an error, not a longer list.
    """
    held = {name: [r[0] for r in df.select(name).distinct().limit(MOST_PLANNED + 1).collect()] for name, df in (("model_id", models), ("seed", seeds))}
    if len(held["model_id"]) * len(held["seed"]) > MOST_PLANNED:
        raise ValueError(f"more than {MOST_PLANNED} models and seeds")
    if not held["model_id"] or not held["seed"]:
        return tasks.limit(0).select("task_id", F.lit(None).cast(dict(models.dtypes)["model_id"]).alias("model_id"), F.lit(None).cast(dict(seeds.dtypes)["seed"]).alias("seed"))
    every = lambda name, df: F.explode(F.array(*[F.lit(x).cast(dict(df.dtypes)[name]) for x in held[name]])).alias(name)
    return tasks.select("task_id", every("model_id", models)).select("task_id", "model_id", every("seed", seeds))
