"""Queries over the conversations table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import conversations as c
from corpusloom.operators import table_functions
from corpusloom.plans.registry import query, table

#: Every third role is folded onto the one before, so that runs exist.
_RUNS = "runs AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'assistant' ELSE role END AS role, text FROM conversations)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("role", F.when(F.col("turn") % 3 == 2, F.lit("assistant")).otherwise(F.col("role")))


@query(f"""
WITH {_RUNS}, b AS (SELECT *, CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role AND role IN ('user', 'assistant') THEN 0 ELSE 1 END AS begins FROM runs WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, sum(begins) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM b)
SELECT conv_id, min(turn) AS turn, min(role) AS role, count(*) AS n_merged, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM i GROUP BY conv_id, run""")
def collapsed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.collapse_runs(_runs(spark, sf_dir))


@query("""
WITH u AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM conversations)
SELECT conv_id, turn, role, CASE WHEN length(text) > 800 - used THEN right(text, CAST(800 - used AS BIGINT)) ELSE text END AS text FROM u WHERE used < 800""")
def newest_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.newest_within(table(spark, sf_dir, "conversations"), 800)


@query("""
SELECT conv_id, turn, string_agg(role, '>') OVER w AS roles, CAST(sum(length(text)) OVER w AS BIGINT) AS n_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def conversation_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.prefixes(table(spark, sf_dir, "conversations"))


@query("""
WITH u AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM conversations)
SELECT conv_id, turn, 'You are a helpful assistant.' AS system, coalesce(q, 'Continue.') AS user, text AS assistant FROM u WHERE role = 'assistant'""")
def single_turn_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.single_turns(table(spark, sf_dir, "conversations"))


@query("""
WITH u AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM conversations)
SELECT conv_id, turn, 'Answer.' AS system, coalesce(q, 'Go on.') AS user, text AS assistant FROM u WHERE role = 'assistant'""")
def flattened_by_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``single_turn_rows`` as SQL users write it."""
    table_functions.register(spark)
    return spark.sql("SELECT * FROM flatten_turns(TABLE({turns}), 'Answer.', 'Go on.')", turns=table(spark, sf_dir, "conversations"))


@query("""
WITH r AS (SELECT lang AS grp, doc_id AS key, n_chars // 4 AS size, CAST(sum(n_chars // 4) OVER (PARTITION BY lang ORDER BY doc_id) AS BIGINT) AS upto FROM documents),
p AS (SELECT grp, key, upto - size AS lo, upto AS hi, unnest(range((upto - size) // 1000, (upto - 1) // 1000 + 1)) AS pack FROM r WHERE size > 0)
SELECT grp, key, pack, greatest(lo, pack * 1000) - pack * 1000 AS offset, least(hi, (pack + 1) * 1000) - greatest(lo, pack * 1000) AS tokens FROM p""")
def packed_by_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_functions.register(spark)
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("grp"), F.col("doc_id").alias("key"), F.floor(F.col("n_chars") / 4).alias("size"))
    return spark.sql("SELECT * FROM pack_rows(TABLE({rows}), 1000)", rows=rows)


@query("""
WITH c AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 AND role IN ('user', 'system') THEN 'assistant' ELSE role END AS role, text FROM conversations),
f AS (SELECT conv_id, arg_min(role, turn) AS role, min(turn) AS turn FROM c GROUP BY conv_id)
SELECT conv_id, turn, role, text FROM c UNION ALL SELECT conv_id, turn - 1, 'user', 'Continue.' FROM f WHERE role = 'assistant'""")
def user_led_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns; every third conversation has its first roles renamed, so that an assistant leads some."""
    led = (F.col("conv_id") % 3 == 0) & F.col("role").isin("user", "system")
    return c.led_by_user(table(spark, sf_dir, "conversations").withColumn("role", F.when(led, F.lit("assistant")).otherwise(F.col("role"))))


@query("""
WITH a AS (SELECT conv_id, count(*) AS n_messages, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant, bool_or(role = 'tool' OR contains(text, 'tool_call')) AS tool_use,
  bool_or(contains(text, 'e')) AS in_project, bool_or(contains(text, 'zzz') OR contains(text, 'ction')) AS forbidden, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id)
SELECT *, n_messages >= 2 AND n_user > 0 AND n_assistant > 0 AS complete,
  CASE WHEN NOT in_project THEN 'project' WHEN forbidden THEN 'forbidden_marker' WHEN n_user + n_assistant < 4 THEN 'too_few_turns' WHEN n_assistant = 0 THEN 'no_assistant' WHEN n_chars < 40 THEN 'too_short' END AS drop_reason FROM a""")
def conversation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.flags(table(spark, sf_dir, "conversations"), "e", ("zzz", "ction"), 4)


@query(r"""
WITH e AS (SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant') AS assistants, sum(len(regexp_extract_all(text, '\S+'))) AS words,
  string_agg(role || chr(1) || text, chr(2) ORDER BY turn) AS content FROM conversations GROUP BY conv_id)
SELECT count(*) AS trajectories, CAST(sum(messages) AS BIGINT) AS messages, CAST(sum(words) AS BIGINT) AS words, count(*) FILTER (users > 0 AND assistants > 0) AS complete, count(*) - count(DISTINCT content) AS duplicates, max(messages) AS longest FROM e""")
def conversation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.audit(table(spark, sf_dir, "conversations"))


@query(r"""
WITH e AS (SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant') AS assistants, bool_or(role IN ('tool', 'function') OR regexp_matches(text, 'tool_call|<tool')) AS tool_use,
  coalesce(sum(len(regexp_extract_all(text, '\S+'))) FILTER (role = 'assistant'), 0) AS words, string_agg(role || chr(1) || text, chr(2) ORDER BY turn) AS content,
  CASE conv_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'failure' WHEN 2 THEN 'ok' ELSE 'unknown' END AS outcome, ['MIT', 'apache-2.0', NULL][1 + conv_id % 3] AS license, conv_id % 5 = 0 AS recovery FROM conversations GROUP BY conv_id),
g AS (SELECT *, messages >= 2 AND users > 0 AND assistants > 0 AS complete FROM e WHERE conv_id % 17 <> 0 AND conv_id % 19 <> 0),
o AS (SELECT string_agg(outcome || '=' || n, ',' ORDER BY outcome) AS outcome_counts FROM (SELECT outcome, count(*) AS n FROM g GROUP BY outcome)),
l AS (SELECT string_agg(license || '=' || n, ',' ORDER BY license) AS license_tags FROM (SELECT license, count(*) AS n FROM g WHERE license IS NOT NULL GROUP BY license)),
m AS (SELECT string_agg(k || '=' || n, ',' ORDER BY k) AS missing_fields FROM (SELECT k, count(*) AS n FROM (SELECT 'complete' AS k FROM g WHERE NOT complete UNION ALL SELECT 'license' FROM g WHERE license IS NULL
  UNION ALL SELECT 'json' FROM e WHERE conv_id % 17 = 0 UNION ALL SELECT 'non_object' FROM e WHERE conv_id % 19 = 0 AND conv_id % 17 <> 0) GROUP BY k))
SELECT (SELECT count(*) FROM e) AS n_records, count(*) FILTER (complete) AS complete_trajectories, count(*) FILTER (tool_use) AS with_tool_use, CAST(sum(assistants) AS BIGINT) AS assistant_messages, CAST(sum(words) AS BIGINT) AS approx_assistant_tokens,
  count(*) FILTER (recovery) AS recovery_segments, count(*) - count(DISTINCT content || outcome || coalesce(license, '-') || recovery) AS duplicate_hashes, (SELECT outcome_counts FROM o) AS outcome_counts, (SELECT license_tags FROM l) AS license_tags, (SELECT missing_fields FROM m) AS missing_fields FROM g""")
def trajectory_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a line of a record file, some of them broken, with outcome, licence and recovery under several names."""
    n = F.col("conv_id")
    messages = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    fields = [
        F.when(n % 4 == 0, F.lit("success")).when(n % 4 == 1, F.lit("failure")).alias("outcome"),
        F.when(n % 4 == 2, F.lit("ok")).alias("label"),
        F.when(n % 3 == 0, F.lit("MIT")).alias("license"),
        F.when(n % 3 == 1, F.lit("apache-2.0")).alias("license_tag"),
        (n % 5 == 0).alias("repaired"),
    ]
    records = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(messages.alias("messages"))
    line = F.when(n % 17 == 0, F.lit('{"messages": [')).when(n % 19 == 0, F.lit("[1, 2]")).otherwise(F.to_json(F.struct("messages", *fields)))
    found = c.audit_records(records.select(line.alias("value")))
    shown = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return found.withColumns({m: shown(m) for m in ("outcome_counts", "license_tags", "missing_fields")})


@query("SELECT role, count(*) AS n FROM conversations GROUP BY role")
def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH r AS (SELECT conv_id, text, CASE WHEN conv_id % 5 = 0 THEN text || '!' ELSE text END AS other, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'assistant')
SELECT conv_id, list(text ORDER BY k) = list(other ORDER BY k) AS equal FROM r WHERE k <= 3 GROUP BY conv_id""")
def reproduced_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    other = turns.withColumn("text", F.when(F.col("conv_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return c.reproduced(turns, other)


_MD = "string_agg('## ' || upper(role[1]) || role[2:] || ' turn' || chr(10) || text || chr(10), '' ORDER BY turn)"


@query("SELECT 'conv-' || conv_id || '.md' AS path, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS turn, role, text FROM conversations QUALIFY role <> 'system'")
def markdown_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as Markdown and parsed again."""
    turns = table(spark, sf_dir, "conversations")
    block = F.concat(F.lit("## "), F.initcap("role"), F.lit(" turn\n"), "text", F.lit("\n"))
    files = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "").alias("content"))
    return c.markdown_turns(files.select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), "content"))


@query("""
WITH w AS (SELECT doc_id, source, n_chars, CASE WHEN n_chars BETWEEN 200 AND 5000 THEN 1 ELSE 0 END AS band FROM documents)
SELECT doc_id, source, n_chars FROM w WHERE band = 1 ORDER BY n_chars DESC, doc_id LIMIT 150""")
def selected_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 150 largest within a band of lengths, by length then id."""
    return table(spark, sf_dir, "documents").where(F.col("n_chars").between(200, 5000)).orderBy(F.desc("n_chars"), "doc_id").limit(150).select("doc_id", "source", "n_chars")


@query("""
WITH k AS (SELECT conv_id, arg_min(text, turn) AS q FROM conversations WHERE role = 'user' GROUP BY conv_id ORDER BY conv_id LIMIT 3)
SELECT string_agg('Example ' || conv_id || ': ' || q, chr(10) ORDER BY conv_id) AS prompt FROM k""")
def few_shot_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("q")).orderBy("conv_id").limit(3)
    line = F.concat(F.lit("Example "), F.col("conv_id").cast("string"), F.lit(": "), "q")
    return first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("prompt"))
