"""Long-form conversations: roles, collapse of runs, budgets, prefixes, single turns, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from corpusloom.staging import Workspace


#: Turns that one task scans together: a conversation of more is cut into ranges of its turn numbers.
RANGE = 4096


def _ranged(turns: DataFrame, size: int) -> DataFrame:
    return turns.withColumn("_range", F.floor(F.col("turn") / size))


def _within() -> WindowSpec:
    return Window.partitionBy("conv_id", "_range").orderBy("turn")


def _carried(ranges: DataFrame, later: bool = False, **carried: Column) -> DataFrame:
    """``conv_id, _range`` and what the ranges before it (or ``later`` ones) sum up to, for all ranges but the first.

    ``ranges`` has a row for each range, so a conversation of n turns has n / ``RANGE`` here; one of a single range has
    no row, and ordinary conversations pass by without.
    """
    order = F.col("_range").desc() if later else F.col("_range").asc()
    whole, before = Window.partitionBy("conv_id").orderBy(order), Window.partitionBy("conv_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranges.withColumn("_place", F.row_number().over(whole)).withColumns({k: c.over(before) for k, c in carried.items()})
    return summed.where("_place > 1").select("conv_id", "_range", *carried)


def _with_carried(turns: DataFrame, carried: DataFrame) -> DataFrame:
    names = [c for c in carried.columns if c not in ("conv_id", "_range")]
    keys = carried.select(F.col("conv_id").alias("_conv"), F.col("_range").alias("_at"), *names)
    return turns.join(keys, turns["conv_id"].eqNullSafe(F.col("_conv")) & turns["_range"].eqNullSafe(F.col("_at")), "left").drop("_conv", "_at")


def collapse_runs(turns: DataFrame, roles: Sequence[str] = ("user", "assistant"), separator: str = "\n\n", size: int = RANGE) -> DataFrame:
    """Consecutive messages of one of the ``roles`` become one, numbered by the first message's turn.

    Ranges of a conversation are scanned apart: a range's summary is its first and last role and how many runs begin in
    it; a first run that goes on from the range before takes that one's number.
    """
    same = lambda before, after: F.coalesce(before.eqNullSafe(after) & after.isin(*roles), F.lit(False)).cast("int")
    ranged = _ranged(turns, size)
    begins = F.when(F.row_number().over(_within()) == 1, 1).otherwise(1 - same(F.lag("role").over(_within()), F.col("role")))
    marked = ranged.withColumn("_begin", begins).withColumn("_run", F.sum("_begin").over(_within()))
    ends = marked.groupBy("conv_id", "_range").agg(F.sum("_begin").alias("_runs"), F.min_by(F.struct("role"), "turn").alias("_first"), F.max_by(F.struct("role"), "turn").alias("_last"))
    order = Window.partitionBy("conv_id").orderBy("_range")
    goes_on = F.coalesce(same(F.lag("_last").over(order)["role"], F.col("_first.role")) * (F.row_number().over(order) > 1).cast("int"), F.lit(0))
    ends = ends.withColumn("_goes_on", goes_on)
    carried = _carried(ends, _offset=F.sum(F.col("_runs") - F.col("_goes_on")))
    joins = ends.where("_goes_on = 1").select("conv_id", "_range", "_goes_on")
    numbered = _with_carried(_with_carried(marked, carried), joins)
    runs = numbered.withColumn("_run", F.col("_run") + F.coalesce("_offset", F.lit(0)) - F.coalesce("_goes_on", F.lit(0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), separator)
    return runs.groupBy("conv_id", "_run").agg(F.min("turn").alias("turn"), F.min_by("role", "turn").alias("role"), F.count(F.lit(1)).alias("n_merged"), joined.alias("text")).drop("_run")


def newest_within(turns: DataFrame, budget: int, size: int = RANGE) -> DataFrame:
    """The newest messages within ``budget`` characters; the one on the boundary keeps its tail. A range carries its length."""
    ranged = _ranged(turns, size)
    lengths = ranged.groupBy("conv_id", "_range").agg(F.sum(F.length("text")).alias("_chars"))
    placed = _with_carried(ranged, _carried(lengths, later=True, _later=F.sum("_chars")))
    newest = Window.partitionBy("conv_id", "_range").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    used = F.coalesce("_later", F.lit(0)) + F.coalesce(F.sum(F.length("text")).over(newest), F.lit(0)) - F.length("text")
    kept = placed.withColumn("_used", used).where(F.col("_used") < budget)
    left = F.lit(budget) - F.col("_used")
    return kept.withColumn("text", F.when(F.length("text") > left, F.right("text", left)).otherwise(F.col("text"))).select(*turns.columns)


def prefixes(turns: DataFrame, size: int = RANGE) -> DataFrame:
    """For every message, the roles and total length of all messages up to it.

    A range carries its roles and length; what a row holds of its own range grows, what it holds of earlier ones is shared
    by the whole range until the row is made.
    """
    ranged = _ranged(turns, size)
    listed = F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]))
    roles = F.when(F.size(listed) > 0, F.array_join(listed, ">"))
    held = ranged.groupBy("conv_id", "_range").agg(roles.alias("_roles"), F.sum(F.length("text").cast("long")).alias("_chars"))
    placed = _with_carried(ranged, _carried(held, _before=F.collect_list(F.struct("_range", "_roles")), _earlier=F.sum("_chars")))
    upto = _within().rowsBetween(Window.unboundedPreceding, 0)
    before = F.transform(F.array_sort("_before"), lambda x: x["_roles"])
    own = F.collect_list("role").over(upto)
    here = F.sum(F.length("text").cast("long")).over(upto)
    chars = F.coalesce(here + F.col("_earlier"), here, F.col("_earlier"))
    return placed.select("conv_id", "turn", F.array_join(F.concat(F.coalesce(before, F.array().cast("array<string>")), own), ">").alias("roles"), chars.alias("n_chars"))


def single_turns(turns: DataFrame, system: str = "You are a helpful assistant.", orphan: str = "Continue.", size: int = RANGE) -> DataFrame:
    """A row per assistant message with the last user message before it, or a synthetic one. A range carries its last user message."""
    ranged, asked = _ranged(turns, size), F.when(F.col("role") == "user", F.col("text"))
    last = ranged.where(F.col("role").eqNullSafe("user") & F.col("text").isNotNull()).groupBy("conv_id", "_range").agg(F.max_by("text", "turn").alias("_user"))
    every = ranged.groupBy("conv_id", "_range").agg(F.count(F.lit(1)).alias("_n"))
    carried = _carried(_with_carried(every, last), _earlier=F.last("_user", ignorenulls=True))
    user = F.last(asked, ignorenulls=True).over(_within().rowsBetween(Window.unboundedPreceding, -1))
    found = _with_carried(ranged, carried).withColumn("user", F.coalesce(user, F.col("_earlier"), F.lit(orphan))).where("role = 'assistant'")
    return found.select("conv_id", "turn", F.lit(system).alias("system"), "user", F.col("text").alias("assistant"))


def led_by_user(turns: DataFrame, text: str = "Continue.") -> DataFrame:
    """Conversations that an assistant begins get a synthetic user message in front."""
    first = turns.groupBy("conv_id").agg(F.min_by("role", "turn").alias("role"), F.min("turn").alias("turn")).where("role = 'assistant'")
    return turns.select("conv_id", "turn", "role", "text").union(first.select("conv_id", F.col("turn") - 1, F.lit("user"), F.lit(text)))


def flags(turns: DataFrame, project_marker: str, forbidden: Sequence[str], minimum_turns: int) -> DataFrame:
    """Per conversation: counts, both roles present, tool use, and the first reason to drop it."""
    marked = F.lit(False)
    for word in forbidden:
        marked = marked | F.contains("text", F.lit(word))
    out = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.count_if(F.col("role") == "user").alias("n_user"),
        F.count_if(F.col("role") == "assistant").alias("n_assistant"),
        F.bool_or((F.col("role") == "tool") | F.contains("text", F.lit("tool_call"))).alias("tool_use"),
        F.bool_or(F.contains("text", F.lit(project_marker))).alias("in_project"),
        F.bool_or(marked).alias("forbidden"),
        F.sum(F.length("text").cast("long")).alias("n_chars"),
    )
    reason = F.when(~F.col("in_project"), "project").when(F.col("forbidden"), "forbidden_marker").when(F.col("n_user") + F.col("n_assistant") < minimum_turns, "too_few_turns").when(F.col("n_assistant") == 0, "no_assistant").when(F.col("n_chars") < 40, "too_short")
    complete = (F.col("n_messages") >= 2) & (F.col("n_user") > 0) & (F.col("n_assistant") > 0)
    return out.withColumn("complete", complete).withColumn("drop_reason", reason)


def audit(turns: DataFrame) -> DataFrame:
    """One row of counts over all conversations; duplicates are conversations with equal roles and texts."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit("\x01"), x["text"])), "\x02")
    each = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("role") == "user").alias("users"), F.count_if(F.col("role") == "assistant").alias("assistants"), F.sum(F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).cast("long")).alias("words"), F.sha2(whole, 256).alias("content"))
    total = each.agg(
        F.count(F.lit(1)).alias("trajectories"),
        F.sum("messages").alias("messages"),
        F.sum("words").alias("words"),
        F.count_if((F.col("users") > 0) & (F.col("assistants") > 0)).alias("complete"),
        (F.count(F.lit(1)) - F.count_distinct("content")).alias("duplicates"),
        F.max("messages").alias("longest"),
    )
    return total


def _get(path: str, kind: str, of: Column | str = "v") -> Column:
    return F.try_variant_get(F.col(of) if isinstance(of, str) else of, path, kind)


def _says(path: str, of: Column | str = "v") -> Column:
    """Whether a field holds anything: no null, false, zero, empty text, list or object."""
    kind, text = F.schema_of_variant(_get(path, "variant", of)), _get(path, "string", of)
    empty = F.when(kind == "STRING", text == "").when(kind == "BOOLEAN", text == "false").when(kind.rlike("^(ARRAY|OBJECT)"), text.isin("[]", "{}")).otherwise(_get(path, "double", of) == 0)
    return F.coalesce((kind != "VOID") & ~F.coalesce(empty, F.lit(False)), F.lit(False))


def _first_said(*paths: str) -> Column:
    """The first of the fields that hold anything, as text; truth is written as Python writes it."""
    text = lambda p: F.when(F.schema_of_variant(_get(p, "variant")) == "BOOLEAN", F.initcap(_get(p, "string"))).otherwise(_get(p, "string"))
    return F.coalesce(*[F.when(_says(p), text(p)) for p in paths])


def record_facts(lines: DataFrame, value: str = "value") -> DataFrame:
    """What an audit asks of each line that isn't blank: ``fault`` (``json``, ``non_object``), else ``content`` (a digest that key order
    and spacing don't change), ``complete, tool_use, assistants, words, outcome, recovery, license``."""
    held = lines.select(F.trim(F.col(value)).alias("line")).where("line <> ''").withColumn("v", F.try_parse_json("line"))
    kind = F.schema_of_variant("v")
    held = held.withColumn("fault", F.when(F.col("v").isNull(), F.lit("json")).when(~kind.startswith("OBJECT"), F.lit("non_object")))
    none = F.array().cast("array<variant>")
    messages = F.when(_says("$.messages"), F.coalesce(_get("$.messages", "array<variant>"), none)).otherwise(F.coalesce(_get("$.conversation", "array<variant>"), none))
    held = held.withColumn("messages", F.filter(messages, lambda m: F.coalesce(F.schema_of_variant(m).startswith("OBJECT"), F.lit(False))))
    role = lambda m: _get("$.role", "string", m)
    is_text = lambda m: F.schema_of_variant(_get("$.content", "variant", m)) == "STRING"
    part = lambda p: F.coalesce(_get("$.text", "string", p), p.cast("string"))
    content = lambda m: F.when(is_text(m), _get("$.content", "string", m)).otherwise(F.array_join(F.transform(F.coalesce(_get("$.content", "array<variant>", m), none), part), " "))
    tooled = lambda m: _says("$.tool_calls", m) | F.coalesce(role(m).isin("tool", "function"), F.lit(False)) | F.coalesce(is_text(m) & content(m).rlike("tool_call|<tool"), F.lit(False))
    words = lambda m: F.coalesce(F.regexp_count(content(m), F.lit(r"\S+")), F.lit(0)).cast("long")
    said = F.filter("messages", lambda m: F.coalesce(role(m) == "assistant", F.lit(False)))
    both = (F.size("messages") >= 2) & F.exists("messages", lambda m: F.coalesce(role(m) == "user", F.lit(False))) & (F.size(said) > 0)
    return held.select(
        "fault",
        F.sha2(F.to_json("v"), 256).alias("content"),
        (F.coalesce(_get("$.complete", "boolean"), F.lit(False)) | both).alias("complete"),
        (_says("$.tool_calls") | _says("$.tools") | F.exists("messages", tooled)).alias("tool_use"),
        F.size(said).cast("long").alias("assistants"),
        F.aggregate(F.transform(said, words), F.lit(0).cast("long"), lambda a, b: a + b).alias("words"),
        F.coalesce(_first_said("$.outcome", "$.label"), F.lit("unknown")).alias("outcome"),
        (_says("$.recovery") | _says("$.repaired") | _says("$.is_recovery")).alias("recovery"),
        _first_said("$.license", "$.license_tag").alias("license"),
    )


def audit_records(lines: DataFrame, value: str = "value") -> DataFrame:
    """One row over the lines of record files: eleven counts, four of them maps in the order of their keys.

    ``n_records, complete_trajectories, with_tool_use, assistant_messages, approx_assistant_tokens, outcome_counts,
    duplicate_hashes, recovery_segments, license_tags, missing_fields``; lines that are no JSON or no object count as missing
    ``json`` and ``non_object``, records without both roles as missing ``complete``, without a licence ``license``.
    """
    facts = Workspace(lines.sparkSession, "audit").table(record_facts(lines, value), "facts")
    good, one = facts.where("fault is null"), lambda df: df.withColumn("_one", F.lit(1))

    def counted(df: DataFrame, key: Column, name: str) -> DataFrame:
        counts = df.select(key.alias("k")).where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        return one(counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name)))

    faults = F.array_compact(F.array(F.col("fault"), F.when(F.col("fault").isNull() & ~F.col("complete"), F.lit("complete")), F.when(F.col("fault").isNull() & F.col("license").isNull(), F.lit("license"))))
    copies = one(good.groupBy("content").agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_hashes")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = one(
        facts.agg(
            F.count(F.lit(1)).alias("n_records"),
            F.count_if(F.col("fault").isNull() & F.col("complete")).alias("complete_trajectories"),
            F.count_if(F.col("fault").isNull() & F.col("tool_use")).alias("with_tool_use"),
            zero(F.sum(F.when(F.col("fault").isNull(), F.col("assistants")))).alias("assistant_messages"),
            zero(F.sum(F.when(F.col("fault").isNull(), F.col("words")))).alias("approx_assistant_tokens"),
            F.count_if(F.col("fault").isNull() & F.col("recovery")).alias("recovery_segments"),
        )
    )
    for other in (copies, counted(good, F.col("outcome"), "outcome_counts"), counted(good, F.col("license"), "license_tags"), counted(facts, F.explode(faults), "missing_fields")):
        sums = sums.join(other, "_one")
    return sums.drop("_one")


def reproduced(turns: DataFrame, other: DataFrame, first: int = 3) -> DataFrame:
    """``conv_id, equal``: whether the first assistant messages of both runs are the same."""

    def heads(df: DataFrame, name: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
        top = df.where("role = 'assistant'").withColumn("_rank", rank).where(F.col("_rank") <= first)
        return top.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "text"))), lambda x: x["text"]).alias(name))

    return heads(turns, "_a").join(heads(other, "_b"), "conv_id").select("conv_id", (F.col("_a") == F.col("_b")).alias("equal"))


HEADER = r"(?m)^## (User|Assistant|System|Tool)[^\n]*\n"


def markdown_turns(files: DataFrame) -> DataFrame:
    """``path, turn, role, text`` of Markdown sessions with a header per message; system and empty messages go.

    ``files`` has ``path, content``. The parts between headers and the headers themselves come in equal numbers.
    """
    bodies = F.slice(F.split("content", HEADER, -1), F.lit(2), F.size(F.split("content", HEADER, -1)))
    roles = F.regexp_extract_all("content", F.lit(HEADER), F.lit(1))
    parts = files.select("path", F.posexplode(F.arrays_zip(roles.alias("role"), bodies.alias("body"))).alias("turn", "m"))
    return parts.select("path", "turn", F.lower("m.role").alias("role"), F.regexp_replace("m.body", r"^\s+|\s+$", "").alias("text")).where("role <> 'system' AND text <> ''")
