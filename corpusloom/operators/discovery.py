"""Source discovery: signals by location, family scores, categories, rubric scores and ranks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Signal:
    id: str
    pattern: str
    family: str
    weight: int


def signal_matches(df: DataFrame, key: str, locations: dict[str, Column], signals: Sequence[Signal]) -> DataFrame:
    """``key, signal_id, family, weight, locations``: the sorted places in which each signal occurs, in lower case.

    Signals are a short configured list, so each row is tested for all of them in one pass.
    """
    texts = {name: F.lower(F.coalesce(column, F.lit(""))) for name, column in locations.items()}
    found = []
    for s in signals:
        places = F.array_sort(F.array_compact(F.array(*[F.when(F.contains(t, F.lit(s.pattern)), F.lit(name)) for name, t in texts.items()])))
        found.append(F.struct(F.lit(s.id).alias("signal_id"), F.lit(s.family).alias("family"), F.lit(s.weight).cast("long").alias("weight"), places.alias("locations")))
    matched = F.filter(F.array(*found), lambda m: F.size(m["locations"]) > 0)
    return df.select(key, F.explode(matched).alias("m")).select(key, "m.*")


def family_scores(matches: DataFrame, key: str) -> DataFrame:
    """``key, scores, score``: the summed weights by family, and of all."""
    by_family = matches.groupBy(key, "family").agg(F.sum("weight").alias("w"))
    entries = F.array_sort(F.collect_list(F.struct("family", "w")))
    return by_family.groupBy(key).agg(F.map_from_entries(entries).alias("scores"), F.sum("w").alias("score"))


#: Tags, parts of names and a pattern of names that tell a benchmark.
BENCHMARK_TAGS = ("benchmark", "benchmarks", "evaluation", "kernel-benchmark", "kernelbench", "pallasbench", "llm-evaluation")
BENCHMARK_NAMES = ("kernelbench", "pallasbench", "jaxbench")
BENCHMARK_ID = r"(?:^|[-_/])(?:eval|evaluation|benchmark|bench|test)(?:$|[-_/])"


def is_benchmark(scores: Column, tags: Column, name: Column) -> Column:
    """Whether a source is a benchmark or an evaluation set by its signals, its tags (of any case) or its name."""
    folded, lower = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(t)), F.lower(F.coalesce(name, F.lit("")))
    found = F.coalesce(F.try_element_at(scores, F.lit("benchmark")) > 0, F.lit(False)) | F.coalesce(F.arrays_overlap(folded, F.array(*map(F.lit, BENCHMARK_TAGS))), F.lit(False)) | lower.rlike(BENCHMARK_ID)
    for part in BENCHMARK_NAMES:
        found = found | F.contains(lower, F.lit(part))
    return found


def source_risks(revision: Column, licence: Column, **flags: Column) -> Column:
    """Risk flags of a source, sorted: revision not pinned, licence not verified, and those of ``flags`` that hold (``private, gated, disabled``)."""
    rules = [F.when(~F.coalesce(revision.rlike("^[0-9a-f]{40}$"), F.lit(False)), F.lit("SOURCE_REVISION_UNPINNED"))]
    rules.append(F.when(F.coalesce((licence == "unverified") | licence.startswith("multiple:"), F.lit(True)), F.lit("SOURCE_LICENSE_UNVERIFIED")))
    rules += [F.when(F.coalesce(held, F.lit(False)), F.lit(f"SOURCE_{name.upper()}")) for name, held in flags.items()]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*rules))))


def classify(scored: DataFrame, domain: str, others: Sequence[str], threshold: int) -> DataFrame:
    """The decision on each source, as columns added to ``scored``: the domain wins ties against the other families.

    ``scored`` has ``scores, score`` and, as far as known, ``tags, name, risk_flags, signals`` (the matched signals). Added are ``category, source_role,
    benchmark, status, training_policy, objectives, decision_reasons`` (sorted); ``risk_flags`` gain that of a benchmark.
    """
    of = lambda f: F.coalesce(F.try_element_at("scores", F.lit(f)), F.lit(0).cast("long"))
    strongest = F.greatest(F.lit(0).cast("long"), *[of(f) for f in others]) if others else F.lit(0)
    known = of(domain) > 0
    for f in others:
        known = known | (of(f) > 0)
    unknown = {"tags": "array<string>", "name": "string", "risk_flags": "array<string>", "signals": "array<string>"}
    scored = scored.withColumns({c: F.array().cast(kind) if kind != "string" else F.lit(None).cast(kind) for c, kind in unknown.items() if c not in scored.columns})
    benchmark = is_benchmark(F.col("scores"), F.col("tags"), F.col("name"))
    category = F.when((F.col("score") < threshold) | ~known, "irrelevant_or_ambiguous").when(of(domain) >= strongest, "main_domain").when(of("trace") > 0, "agent_trace").otherwise("cross_domain")
    judged = scored.withColumn("benchmark", benchmark).withColumn("category", category)
    relevant = F.col("category") != "irrelevant_or_ambiguous"
    policy = F.when(~relevant, "rejected").when(F.col("benchmark"), "forbidden").otherwise("discovery_only")
    repair = (F.col("category") == "agent_trace") | F.col("benchmark")
    objectives = F.when(relevant, F.array_compact(F.array(F.lit("dapt_candidate"), F.when(repair, F.lit("repair_candidate"))))).otherwise(F.array().cast("array<string>"))
    risks = F.array_sort(F.array_distinct(F.concat("risk_flags", F.when(relevant & F.col("benchmark"), F.array(F.lit("BENCHMARK_CONTAMINATION"))).otherwise(F.array().cast("array<string>")))))
    return judged.withColumns(
        {
            "training_policy": policy,
            "status": F.when(relevant, "candidate").otherwise("rejected"),
            "source_role": F.when(F.col("benchmark"), "benchmark_or_evaluation").otherwise("domain_source"),
            "objectives": objectives,
            "risk_flags": risks,
            "decision_reasons": F.array_sort("signals"),
        }
    )


def format_score(suffixes: Column) -> Column:
    """2 for records and code, 0 for archives, 1 for the rest."""
    lists = lambda *x: F.array(*map(F.lit, x))
    folded = F.transform(suffixes, lambda s: F.lower(s))
    return F.when(F.arrays_overlap(folded, lists(".parquet", ".json", ".jsonl", ".csv", ".py", ".cu", ".cuh")), 2).when(F.arrays_overlap(folded, lists(".tar", ".gz", ".zip")), 0).otherwise(1)


def rubric_total(licence: Column, pinned: Column, formats: Column, score: Column, accessible: Column, forbidden: Column) -> Column:
    points = lambda rule, n: F.when(rule, n).otherwise(0)
    return (points(licence, 3) + points(pinned, 2) + formats + F.least(F.lit(4), F.floor(score / 6)) + points(accessible, 2) - points(forbidden, 20)).cast("long")


def first_writer(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, pre-aggregated before the shuffle."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r"))
    return best.select(key, "r.*")


def preferred_files(files: DataFrame, dataset: str, most: int) -> DataFrame:
    """At most ``most`` files of a dataset: readme first, then small ones, then by path."""
    readme = F.when(F.lower("path").contains("readme"), 0).otherwise(1)
    rank = F.row_number().over(Window.partitionBy(dataset).orderBy(readme, "size", "path"))
    return files.withColumn("rank", rank).where(F.col("rank") <= most)
