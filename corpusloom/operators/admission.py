"""Admission, splits, readiness, lane and reference checks, releases."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.operators.dedup import contained_passages
from corpusloom.operators.similarity import THRESHOLD, least_classes, shingle_sets
from corpusloom.staging import Workspace

#: Short bodies that a text is searched for at once, and the first letters by which more of them are found.
FEW_BODIES, LETTERS = 1000, 8
#: Digests that are hashed together.
FAN = 4096


def admit(rows: DataFrame, base: DataFrame, key: str, source: str, minimum_tokens: int, signals: Sequence[str], validation: float, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``lexical_tokens, reasons, status, split, sampling_weight``.

    A row is held against ``base``: the first base row that equals it, equals it but for white space, or resembles it
    gives the reason. Weights share one among the admitted rows of a source; splits follow a hash of the source.
    """
    hashed = rows.withColumn("_exact", t.digest(F.col("text"))).withColumn("_normal", t.digest(t.squeeze(F.col("text"))))
    theirs = base.select(F.col(key).alias("base_id"), t.digest(F.col("text")).alias("_exact"), t.digest(t.squeeze(F.col("text"))).alias("_normal"))
    exact = theirs.groupBy("_exact").agg(F.min("base_id").alias("base_id"))
    normal = theirs.groupBy("_normal").agg(F.min("base_id").alias("base_id"))
    ours, sets = shingle_sets(rows, key), shingle_sets(base, key)
    firsts = sets.rows.groupBy("cls").agg(F.min(key).alias("first"))
    near = ours.rows.select(key, "cls").join(least_classes(ours, sets, firsts, threshold), "cls").select(key, F.col("first").alias("base_id"), F.lit(2).alias("p"))
    found = hashed.join(exact, "_exact").select(key, "base_id", F.lit(0).alias("p")).union(hashed.join(normal, "_normal").select(key, "base_id", F.lit(1).alias("p"))).union(near)
    first = found.groupBy(key).agg(F.min(F.struct("base_id", "p")).alias("match"))
    kind = F.element_at(F.array(*map(F.lit, ("EXACT", "NORMALIZED", "NEAR"))), F.col("match.p") + 1)
    # what is asked of a text is found before its row is joined, so a caller that takes no texts has none shuffled
    asked = rows.withColumn("lexical_tokens", t.token_count(F.col("text"))).withColumn("_signals", t.contains_any(F.col("text"), signals))
    joined = asked.join(first, key, "left")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("lexical_tokens") < minimum_tokens, F.lit("CONTENT_BELOW_TOKEN_THRESHOLD")),
            F.when(~F.col("_signals"), F.lit("KERNEL_STRUCTURE_MISSING")),
            F.when(F.col("match").isNotNull(), F.concat(F.lit("BASE_DAPT_"), kind, F.lit("_DUPLICATE:"), F.col("match.base_id"))),
        )
    )
    judged = joined.withColumn("reasons", F.array_sort(reasons)).withColumn("status", F.when(F.size("reasons") == 0, F.lit("authorized")).otherwise(F.lit("rejected")))
    admitted = judged.where("status = 'authorized'").groupBy(source).agg(F.count(F.lit(1)).alias("_n"))
    weight = F.when(F.col("status") == "authorized", 1.0 / F.col("_n")).otherwise(0.0)
    return judged.join(admitted, source, "left").withColumn("split", t.hash_split(F.col(source), validation)).withColumn("sampling_weight", weight).drop("match", "_n", "_signals")


def yields(judged: DataFrame, sources: DataFrame) -> DataFrame:
    """``source, gross, curated, rejected`` for every known source."""
    counts = judged.groupBy("source").agg(F.count(F.lit(1)).alias("gross"), F.count_if(F.size("reasons") == 0).alias("curated"), F.count_if(F.size("reasons") > 0).alias("rejected"))
    return sources.join(counts, "source", "left").na.fill(0, ["gross", "curated", "rejected"])


@dataclass(frozen=True)
class Policy:
    rows: int
    families: int
    sources: int
    rows_per_family: int
    source_share: float
    family_share: float


def readiness(rows: DataFrame, source: str, family: str, policy: Policy, contamination: DataFrame | None = None) -> DataFrame:
    """One row: what was observed, which rules fail, in the order of the rules, and whether none does.

    ``contamination`` has a row for each row that held-out text was found in: any of them fails. ``source_counts`` and
    ``family_counts`` are maps in the order of their keys; sources and families are few beside rows.
    """

    def shares(key: str, name: str) -> DataFrame:
        counts = rows.groupBy(key).count()
        entries = F.array_sort(F.collect_list(F.when(F.col(key).isNotNull(), F.struct(F.col(key).cast("string").alias("k"), F.col("count").alias("v")))))
        return counts.agg(F.count(F.lit(1)).alias(f"{name}_count"), F.coalesce(F.max("count") / F.sum("count"), F.lit(0.0)).alias(f"max_{name}"), F.min("count").alias(f"least_{name}"), F.coalesce(F.sum("count"), F.lit(0)).alias(f"rows_{name}"), F.map_from_entries(entries).alias(f"{name}_counts"))

    one = lambda df: df.withColumn("one", F.lit(1))
    seen = one(shares(source, "source")).join(one(shares(family, "family")), "one")
    held = contamination.agg(F.count(F.lit(1)).alias("holdout_contamination")) if contamination is not None else None
    seen = seen.join(one(held), "one") if held is not None else seen.withColumn("holdout_contamination", F.lit(0).cast("long"))
    failing = F.array_compact(
        F.array(
            F.when(F.col("rows_family") < policy.rows, F.lit("VERIFIED_ROWS_INSUFFICIENT")),
            F.when(F.col("family_count") < policy.families, F.lit("FAMILY_DIVERSITY_INSUFFICIENT")),
            F.when(F.col("source_count") < policy.sources, F.lit("SOURCE_DIVERSITY_INSUFFICIENT")),
            F.when(F.col("least_family") < policy.rows_per_family, F.lit("FAMILY_DEPTH_INSUFFICIENT")),
            F.when(F.col("max_source") > policy.source_share, F.lit("SOURCE_CONCENTRATION_EXCEEDED")),
            F.when(F.col("max_family") > policy.family_share, F.lit("FAMILY_CONCENTRATION_EXCEEDED")),
            F.when(F.col("holdout_contamination") > 0, F.lit("HOLDOUT_CONTAMINATION_PRESENT")),
        )
    )
    return seen.select(F.col("rows_family").alias("verified_rows"), "family_count", "source_count", "family_counts", "source_counts", F.round("max_source", 9).alias("max_source"), F.round("max_family", 9).alias("max_family"), "holdout_contamination", F.array_join(failing, "|").alias("reasons"), (F.size(failing) == 0).alias("authorized"))


def leaking(splits: DataFrame, key: str) -> DataFrame:
    return splits.groupBy(key).agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def overlaps(splits: DataFrame, key: str, names: Sequence[str] = ("report", "sealed", "train", "validation")) -> DataFrame:
    """``first_split, second_split, n``: keys in both of two splits; a row per key and pair of its splits is summed at once."""
    held = splits.groupBy(key).agg(*[F.max((F.col("split") == s).cast("int")).alias(s) for s in names])
    sums = held.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}:{b}") for a, b in combinations(sorted(names), 2)])
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("first_split"), F.lit(b).alias("second_split"), F.col(f"{a}:{b}").alias("n")) for a, b in combinations(sorted(names), 2)]))
    return sums.select(pairs.alias("p")).select("p.*").where("n > 0")


def reference_faults(rows: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Keys without a reference, and references without a row."""
    missing = rows.join(references, key, "left_anti").select(key, F.lit("missing").alias("side"))
    return missing.union(references.join(rows, key, "left_anti").select(key, F.lit("unknown")))


def lane_faults(lanes: dict[str, DataFrame], key: str, content: str) -> DataFrame:
    """Ids that lanes repeat and contents that several lanes hold."""
    whole = None
    for name, rows in lanes.items():
        tagged = rows.select(F.lit(name).alias("lane"), key, content)
        whole = tagged if whole is None else whole.unionByName(tagged)
    ids = whole.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("id").alias("fault"), F.col(key).cast("string").alias("value"), "n")
    texts = whole.groupBy(content).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lane").alias("lanes")).where("lanes > 1")
    return ids.union(texts.select(F.lit("content"), content, "n"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New values win where they are not null; rows of either side stay."""
    renamed = new.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in new.columns if c != key])
    joined = old.join(renamed, key, "full_outer")
    return joined.select(key, *[F.coalesce(f"_new_{c}", c).alias(c) if f"_new_{c}" in joined.columns else F.col(c) for c in old.columns if c != key])


def containing(df: DataFrame, key: str, bodies: DataFrame, body_key: str) -> DataFrame:
    """``key, body_key`` where a row's text contains a body's.

    A body inside a text shares all of its inner shingles with it, so pairs are proposed by shingles (edge tokens may be
    cut by their surroundings) and the substring test follows. Bodies of fewer than 8 tokens have too few of them: while there
    are few such bodies, each text is searched for all of them at once; otherwise pairs are proposed by the body's first letters.
    """
    size = F.size(t.tokens(F.col("text")))
    long, short = bodies.where(size >= 8), bodies.where(size < 8).select(body_key, F.col("text").alias("_body"))
    seq = t.tokens(F.col("text"))
    inner = long.select(body_key, F.array_join(F.slice(seq, F.lit(2), F.size(seq) - 2), " ").alias("text"))
    proposed = Workspace(df.sparkSession, "containing").table(contained_passages(df, key, inner, body_key, 1.0).select(key, body_key), "proposed")
    texts = df.select(key, F.col("text").alias("_text"))
    verified = proposed.join(texts, key).join(long.select(body_key, F.col("text").alias("_body")), body_key)
    found = verified.where(F.contains("_text", F.col("_body"))).select(key, body_key)
    few = short.limit(FEW_BODIES + 1).collect()
    if not few:
        return found
    if len(few) <= FEW_BODIES:
        known = F.array(*[F.struct(F.lit(r[0]).alias("id"), F.lit(r[1]).alias("body")) for r in few])
        hits = F.filter(known, lambda b: F.contains("_text", b["body"]))
        return found.union(texts.select(key, F.explode(hits).alias("hit")).select(key, F.col("hit.id").alias(body_key)))
    for n in range(1, LETTERS + 1):
        own = short.where(F.least(F.length("_body"), F.lit(LETTERS)) == n).withColumn("_start", F.substring("_body", 1, n))
        grams = F.array_distinct(F.regexp_extract_all("_text", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))
        pairs = texts.select(key, F.explode(grams).alias("_start")).join(own, "_start").select(key, body_key, "_body")
        found = found.union(pairs.join(texts, key).where(F.contains("_text", F.col("_body"))).select(key, body_key))
    return found.union(texts.join(short.where("_body = ''")).where("_text is not null").select(key, body_key))


def manifest(rows: DataFrame, artifact: str, key: str) -> DataFrame:
    """Counts and a digest of the rows: ``FAN`` consecutive keys at a time, then as many of these digests, then all of those.

    ``key`` is a whole number, 0 or more, that tells rows apart; rows are hashed in its order, and no group is larger than
    ``FAN`` until 68 billion keys are passed.
    """
    level = rows.select(F.col(key).alias("_at"), F.sha2("text", 256).alias("_sha"), F.lit(1).cast("long").alias("_n"), F.col("n_chars").alias("_chars"))
    for group in (F.floor(F.col("_at") / FAN), F.floor(F.col("_at") / FAN), F.lit(0)):
        shas = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_sha"))), lambda x: x["_sha"])
        level = level.groupBy(group.alias("_group")).agg(F.sha2(F.array_join(shas, ""), 256).alias("_sha"), F.sum("_n").alias("_n"), F.sum("_chars").alias("_chars")).withColumnRenamed("_group", "_at")
    return level.select(F.lit(artifact).alias("artifact"), F.col("_n").alias("n_rows"), F.col("_chars").alias("n_chars"), F.col("_sha").alias("content_sha256"))
