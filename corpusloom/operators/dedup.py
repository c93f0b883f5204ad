"""Duplicate and contamination policies with explainable reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import digest, squeeze, tokens
from corpusloom.operators.joins import hub_join
from corpusloom.operators.similarity import THRESHOLD, ShingleSets, earlier_classes, least_classes, shingle_sets, shingles
from corpusloom.staging import Workspace, spread


def first_seen(df: DataFrame, key: str, *group: str) -> DataFrame:
    """``group, first``: the least ``key`` of each group, pre-aggregated before the shuffle."""
    return df.groupBy(*group).agg(F.min(key).alias("first"))


def hashed_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``content_sha256`` and ``normalized_sha256``, that of the text but for white space."""
    return df.withColumn("content_sha256", digest(F.col(text))).withColumn("normalized_sha256", digest(squeeze(F.col(text))))


def _with_first(df: DataFrame, key: str, objective: str, content: str, name: str, total: int) -> DataFrame:
    """Adds the least ``key`` of each objective and content; one that holds many rows of the table doesn't meet in a task."""
    on = F.when(F.col(content).isNotNull(), F.struct(F.col(objective), F.col(content)))
    keyed = df.withColumn("_on", on)
    firsts = keyed.where("_on is not null").groupBy("_on").agg(F.min(key).alias(name), F.count(F.lit(1)).alias("_n"))
    return hub_join(keyed, firsts, "_on", "_n", total, "left").drop("_on")


def exact_and_normalized(df: DataFrame, key: str, objective: str, text: str = "text") -> DataFrame:
    """Adds ``content_sha256, normalized_sha256, exact_of, normalized_of``; columns of these names that ``df`` has already are taken.

    ``exact_of`` is the first row of the same objective and text, where that is an earlier one; ``normalized_of`` that of
    the same text but for white space, only for rows that are no exact duplicates. Null objectives are one.
    """
    hashed = df if "normalized_sha256" in df.columns else hashed_texts(df, text)
    total = hashed.count()
    joined = _with_first(_with_first(hashed, key, objective, "content_sha256", "_exact", total), key, objective, "normalized_sha256", "_normal", total)
    exact_of = F.when(F.col("_exact") < F.col(key), F.col("_exact"))
    normal_of = F.when(exact_of.isNull() & (F.col("_normal") < F.col(key)), F.col("_normal"))
    return joined.withColumn("exact_of", exact_of).withColumn("normalized_of", normal_of).drop("_exact", "_normal")


def nearest_earlier(df: DataFrame, key: str, objective: str, threshold: float = THRESHOLD, text: str = "text", sets: ShingleSets | None = None) -> DataFrame:
    """``key, near_of, similarity``: for each row the most similar earlier row of its objective, the first of equals.

    Rows are compared by class of equal tokens: what counts of a class is its first row of the objective. A row that is
    not the first of its shingle set resembles that first one most of all; the others have their class's best.
    ``sets`` are those of ``df``, if they are made already.
    """
    sets = sets or shingle_sets(df, key, text)
    work = Workspace(df.sparkSession, "nearest")
    rows = work.table(sets.rows.where("some").join(df.select(key, F.col(objective).alias("grp")), key), "rows")
    firsts = work.table(rows.groupBy("cls", "grp").agg(F.min(key).alias("first")), "firsts")
    best = earlier_classes(sets, firsts.where("grp is not null"), threshold)
    mate = best.withColumnRenamed("first", "near")
    told = firsts.where("grp is not null").join(mate, ["cls", "grp"], "left").select("cls", "grp", "near", "similarity", F.when(F.col("similarity") == 1, F.col("near")).otherwise(F.col("first")).alias("equal"))
    joined = rows.join(work.table(told, "told"), ["cls", "grp"])
    copy = F.col("equal") < F.col(key)
    found = joined.select(key, F.when(copy, F.col("equal")).otherwise(F.col("near")).alias("near_of"), F.when(copy, 1.0).otherwise(F.col("similarity")).alias("similarity"))
    return found.where("near_of is not null")


def first_forbidden(df: DataFrame, key: str, forbidden: DataFrame, forbidden_key: str, threshold: float = THRESHOLD, text: str = "text", sets: ShingleSets | None = None) -> DataFrame:
    """``key, document, exact, similarity``: the first forbidden document that a row equals or resembles. A column ``content_sha256`` of
    ``df`` is taken for the digest of its text, then ``sets`` must be given."""
    ours, theirs = sets or shingle_sets(df, key, text), shingle_sets(forbidden, forbidden_key)
    documents = theirs.rows.groupBy("cls").agg(F.min(forbidden_key).alias("first"))
    best = least_classes(ours, theirs, documents, threshold)
    sealed = forbidden.select(F.col(forbidden_key).alias("document"), digest(F.col("text")).alias("sha"))
    sha = F.col("content_sha256") if "content_sha256" in df.columns else digest(F.col(text))
    exact = df.select(key, sha.alias("sha")).join(sealed, "sha").select(key, "document", F.lit(True).alias("exact"), F.lit(1.0).alias("similarity"))
    near = ours.rows.select(key, "cls").join(best, "cls").select(key, F.col("first").alias("document"), F.lit(False).alias("exact"), "similarity")
    found = exact.union(near).groupBy(key, "document").agg(F.max("exact").alias("exact"), F.max("similarity").alias("similarity"))
    return found.groupBy(key).agg(F.min_by(F.struct("document", "exact", "similarity"), "document").alias("f")).select(key, "f.*")


def corpus_policy(df: DataFrame, key: str, objective: str, forbidden: DataFrame, forbidden_key: str, threshold: float = THRESHOLD, unverified: Sequence[str] = ("sft",)) -> DataFrame:
    """The columns of ``df`` but for its text, and ``reasons`` (sorted) and ``status``: duplicates against all earlier rows of the
    objective, and held-out text. A row without reasons is ``eligible``, or ``verification_required`` where its objective is one of
    ``unverified``. Texts are read twice, for their digests and their shingles."""
    hashed = Workspace(df.sparkSession, "policy").table(hashed_texts(spread(df)).drop("text"), "hashed")
    marked = exact_and_normalized(hashed, key, objective)
    sets = shingle_sets(df, key)
    near = nearest_earlier(hashed, key, objective, threshold, sets=sets)
    held = first_forbidden(hashed, key, forbidden, forbidden_key, threshold, sets=sets).withColumnRenamed("similarity", "held_similarity")
    joined = marked.join(near, key, "left").join(held, key, "left")
    reason = F.array_compact(
        F.array(
            F.when(F.col("exact_of").isNotNull(), F.concat(F.lit("EXACT_DUPLICATE:"), F.col("exact_of"))),
            F.when(F.col("normalized_of").isNotNull(), F.concat(F.lit("NORMALIZED_DUPLICATE:"), F.col("normalized_of"))),
            F.when(F.col("near_of").isNotNull(), F.concat(F.lit("NEAR_DUPLICATE:"), F.col("near_of"), F.format_string(":%.6f", "similarity"))),
            F.when(F.col("exact"), F.concat(F.lit("HOLDOUT_EXACT_MATCH:"), F.col("document"))).when(F.col("document").isNotNull(), F.concat(F.lit("HOLDOUT_NEAR_MATCH:"), F.col("document"), F.format_string(":%.6f", "held_similarity"))),
        )
    )
    asked = F.coalesce(F.col(objective).isin(*unverified), F.lit(False)) if unverified else F.lit(False)
    status = F.when(F.size("reasons") > 0, F.lit("rejected")).when(asked, F.lit("verification_required")).otherwise(F.lit("eligible"))
    return joined.withColumn("reasons", F.array_sort(reason)).withColumn("status", status)


def accepted_first(sets: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """``key, near_of``: rows taken one after the other, each rejected if it resembles an accepted earlier one.

    Each round decides every row whose linked earlier rows are all decided, until none is left: the earliest open
    row can always be decided, so rounds end, usual groups in two or three and a chain of n rows in n. A round
    reads only the links of open rows, and is staged. ``links`` has ``key`` and the earlier ``other``.
    """
    work = Workspace(sets.sparkSession, "accepted")
    edges = work.table(links.select(key, "other", F.lit(False).alias("sure")).distinct(), "edges0")
    alone = sets.select(key).distinct().join(edges.select(key), key, "left_anti")
    latest = work.table(alone.withColumn("near_of", F.lit(None).cast(dict(sets.dtypes)[key])), "decided0")
    done, turn = latest, 0
    while not edges.isEmpty():
        turn += 1
        verdict = latest.select(F.col(key).alias("other"), F.col("near_of").isNull().alias("accepted"))
        told = edges.join(verdict, "other", "left").select(key, "other", (F.col("sure") | F.coalesce("accepted", F.lit(False))).alias("sure"), "accepted")
        marked = work.table(told, f"marked{turn}")
        waits = F.bool_or(~F.col("sure") & F.col("accepted").isNull())
        state = marked.groupBy(key).agg(waits.alias("waits"), F.min(F.when(F.col("sure"), F.col("other"))).alias("near_of"))
        latest = work.table(state.where("not waits").select(key, "near_of"), f"decided{turn}")
        left = marked.where("sure or accepted is null").join(latest, key, "left_anti")
        edges = work.table(left.select(key, "other", "sure"), f"edges{turn}")
        work.drop(f"edges{turn - 1}", f"marked{turn}")
        done = done.union(latest)
    return done


def contained_passages(df: DataFrame, key: str, passages: DataFrame, passage_key: str, share: float = 0.9, text: str = "text") -> DataFrame:
    """``key, passage_key, share``: passages of which at least ``share`` of the shingles stand in a row.

    An extension beside whole-document similarity, which misses passages inside longer documents. Only shingles of
    passages are joined; a row per document and passage is counted before the shuffle. Each text is read and cut where it
    is, so neither texts nor shingles of documents are staged or travel while the passages' are few.
    """
    theirs = shingle_sets(passages, passage_key)
    asked = theirs.classes.where("n > 0").select("cls", F.col("n").alias("total"), F.explode("shingles").alias("shingle"))
    asked = Workspace(df.sparkSession, "asked").table(asked, "asked")
    ours = spread(df.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))).select(key, F.explode(shingles(tokens(F.col("text")))).alias("shingle"))
    hits = ours.join(asked, "shingle").groupBy(key, "cls", "total").agg(F.count(F.lit(1)).alias("common"))
    found = hits.where(F.col("common") >= share * F.col("total")).join(theirs.rows.select("cls", passage_key), "cls")
    return found.select(key, passage_key, (F.col("common") / F.col("total")).alias("share"))


def newest_first(df: DataFrame, partition: list[str], order: list[Column]) -> DataFrame:
    """The first row of each partition in the given order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where("_rank = 1").drop("_rank")
