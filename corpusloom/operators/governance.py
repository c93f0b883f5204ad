"""Gates, rights, rescoring, stream merges and roll-ups of run logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import canonical_digest


def upload_gate(slices: DataFrame, providers: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """``slice, allowed, reasons``: what stands against the upload of each slice, in the order of the rules.

    ``slices`` has ``slice, provider, source_found, manifest_found, rights_cleared, secrets_scrubbed, scrub_hits,
    canaries_lost``; without its source or its rights manifest nothing else of a slice is looked at. ``providers`` has
    ``provider, upload_approved, retention_reviewed``. With a ``ledger`` (``provider, usd_remaining``) there must be money left;
    a provider without a row of it has no ledger.
    """
    known = lambda c: F.coalesce(F.col(c), F.lit(False))
    joined = slices.join(providers, "provider", "left")
    if ledger is not None:
        joined = joined.join(ledger.withColumn("_ledger", F.lit(True)), "provider", "left")
    money = [F.when(F.col("_ledger").isNull(), F.lit("SPEND_LEDGER_MISSING")).when(F.coalesce(F.col("usd_remaining"), F.lit(0.0)) <= 0, F.lit("SPEND_HEADROOM_EXHAUSTED"))] if ledger is not None else []
    rules = F.array(
        F.when(~(known("upload_approved") & known("retention_reviewed")), F.lit("PROVIDER_NOT_APPROVED")),
        F.when(~(known("rights_cleared") & known("secrets_scrubbed")), F.lit("SLICE_NOT_CLEARED")),
        *money,
        F.when(F.col("scrub_hits") > 0, F.lit("SCRUB_HITS_PRESENT")),
        F.when(F.size("canaries_lost") > 0, F.concat(F.lit("CANARY_EMBED_FAILED:"), F.array_join("canaries_lost", ","))),
    )
    reasons = F.when(~known("source_found"), F.array(F.lit("SOURCE_MISSING"))).when(~known("manifest_found"), F.array(F.lit("RIGHTS_MANIFEST_MISSING"))).otherwise(F.array_compact(rules))
    return joined.select("slice", (F.size(reasons) == 0).alias("allowed"), reasons.alias("reasons"))


def first_rows(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group, numbered by ``k`` from 1. Tasks keep ``n`` rows of a group each before any meet."""
    from pyspark.sql.window import Window

    place = lambda *by: F.row_number().over(Window.partitionBy(group, *by).orderBy(order))
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64(order), F.lit(256)))
    early = dealt.withColumn("_k", place("_deal")).where(F.col("_k") <= n).drop("_deal", "_k")
    return early.withColumn("k", place()).where(F.col("k") <= n)


def preflight(rows: DataFrame, group: str, forbidden: Sequence[str], canaries: Sequence[str]) -> DataFrame:
    """Per group how many rows show a forbidden marker or a canary; both lists are short and configured."""
    holds = lambda words: F.greatest(F.lit(False), *[F.contains("text", F.lit(w)) for w in words])
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(holds(forbidden)).alias("n_forbidden"), F.count_if(holds(canaries)).alias("n_canaries"))
    return counts.withColumn("clear", (F.col("n_forbidden") == 0) & (F.col("n_canaries") == 0))


def rights_of(manifests: DataFrame) -> DataFrame:
    """``path, provider, approved`` from the rows of the Markdown tables in ``content``."""
    line = F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\|\s*([^|\n]+?)\s*\|\s*(yes|no|pending)\s*\|"), F.lit(0)))
    rows = manifests.select("path", line.alias("line"))
    part = lambda k: F.regexp_extract("line", r"^\|\s*([^|\n]+?)\s*\|\s*(yes|no|pending)\s*\|", k)
    return rows.select("path", part(1).alias("provider"), (part(2) == "yes").alias("approved"))


def rescored(stored: DataFrame, current: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Violations of stored rows against what the rules give now: one row per fault, by code."""
    now = current.select(*keys, *[F.col(c).alias(f"_now_{c}") for c in columns], F.lit(True).alias("_present"))
    joined = stored.withColumn("_stored", F.lit(True)).join(now, list(keys), "full_outer")
    faults = [F.when(F.col("_present").isNull(), F.lit("UNKNOWN_ROW")), F.when(F.col("_stored").isNull(), F.lit("MISSING_ROW"))]
    both = F.col("_present") & F.col("_stored")
    faults += [F.when(both & ~F.col(c).eqNullSafe(F.col(f"_now_{c}")), F.lit(f"{c.upper()}_DIFFERS")) for c in columns]
    return joined.select(*keys, F.explode(F.array_compact(F.array(*faults))).alias("code"))


def merged_streams(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two sorted streams holds."""
    a, b = left.select(key, F.lit(True).alias("_l")), right.select(key, F.lit(True).alias("_r"))
    side = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only")
    return a.join(b, key, "full_outer").select(key, side.alias("side")).where("side IS NOT NULL")


def signature_overlaps(tasks: DataFrame, training: DataFrame, **fields: Column) -> DataFrame:
    """``signature, n``: task signatures that repeat or that training holds."""
    signed = tasks.withColumn("signature", canonical_digest(**fields))
    known = training.withColumn("signature", canonical_digest(**fields)).select("signature").distinct()
    counts = signed.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    in_training = counts.join(known, "signature", "left_semi").select("signature", "n")
    return counts.where("n > 1").union(in_training).distinct()


def recovered(outcomes: DataFrame) -> DataFrame:
    """Successes that a failure preceded count as recoveries."""
    relabelled = F.when((F.col("outcome") == "success") & F.col("had_failure"), "recovery").otherwise(F.col("outcome"))
    return outcomes.withColumn("outcome", relabelled)


def run_log(steps: DataFrame, run: str) -> DataFrame:
    """Per run the sums of its steps and its rewards in the order of the steps."""
    curve = F.transform(F.array_sort(F.collect_list(F.struct("step", "reward"))), lambda x: x["reward"])
    return steps.groupBy(run).agg(F.count(F.lit(1)).alias("steps"), F.sum("tokens").alias("tokens"), F.count_if("trained").alias("trained_steps"), curve.alias("rewards"))


def nested_counts(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """``outer, counts``: a map of inner values to their counts."""
    counts = rows.groupBy(outer, inner).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(outer).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(inner, "n")))).alias("counts"))


def unbalanced(rows: DataFrame, family: str, each: int) -> DataFrame:
    """Families that don't have exactly ``each`` rows."""
    return rows.groupBy(family).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != each)


def task_documents(rows: DataFrame, **fields: Column) -> DataFrame:
    """The fields of each task document and ``task_sha256``, the digest of all of them."""
    return rows.select(*[f.alias(name) for name, f in fields.items()], canonical_digest(**fields).alias("task_sha256"))


def arm_deltas(rows: DataFrame, arm: str, before, after, tier: str, flags: Sequence[str]) -> DataFrame:
    """Per tier, and overall, the rows of two arms and by how many rows more the second arm meets each flag."""
    first, second = F.col(arm) == F.lit(before), F.col(arm) == F.lit(after)
    deltas = [(F.count_if(second & F.col(f)) - F.count_if(first & F.col(f))).alias(f) for f in flags]
    return rows.rollup(tier).agg((F.grouping(tier) == 1).alias("overall"), F.count_if(first).alias("n_before"), F.count_if(second).alias("n_after"), *deltas)
