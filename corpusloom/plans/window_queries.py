"""Ranks, returns, streaks, packing and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import word_count
from corpusloom.operators import dedup, ordered, packing
from corpusloom.plans.registry import query, table


@query("""SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1""")
def last_event_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.newest_first(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.asc("event_id")]).select("user_id", "event_id", "event_type")


@query("""WITH r AS (SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS INTEGER) AS ordinal FROM documents)
SELECT *, ordinal <= 8 AS in_8, ordinal <= 16 AS in_16, ordinal <= 32 AS in_32 FROM r WHERE ordinal <= 32""")
def nested_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordered.ranked(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", "n_chars", "doc_id")
    return ordered.nested_subsets(rows, (8, 16, 32)).where("ordinal <= 32").drop("n_chars")


@query("""SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS place, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) % 7 AS worker FROM documents""")
def round_robin_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.round_robin(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), 7, "n_chars", "doc_id").select("doc_id", "place", "worker")


_RETURNS = """s AS (SELECT l_partkey % 50 AS task_id, l_orderkey AS trajectory, l_linenumber AS turn, sum(floor(l_quantity)) AS score FROM lineitem GROUP BY ALL),
g AS (SELECT a.task_id, a.trajectory, a.turn, any_value(a.score) AS score, sum(b.score * power(0.4, b.k - a.k)) AS raw_return FROM (SELECT *, row_number() OVER (PARTITION BY task_id, trajectory ORDER BY turn) AS k FROM s) a JOIN (SELECT *, row_number() OVER (PARTITION BY task_id, trajectory ORDER BY turn) AS k FROM s) b ON a.task_id = b.task_id AND a.trajectory = b.trajectory AND b.k >= a.k GROUP BY ALL)"""


@query(f"""WITH {_RETURNS}, m AS (SELECT task_id, avg(raw_return) AS mean, stddev_pop(raw_return) AS deviation, min(raw_return) AS low, max(raw_return) AS high FROM g GROUP BY task_id)
SELECT task_id, trajectory, turn, score, round(raw_return, 6) AS raw_return, CASE WHEN low = high THEN 0.0 ELSE round((raw_return - mean) / deviation, 6) END AS advantage, low <> high AS trainable FROM g JOIN m USING (task_id)""")
def group_advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 50).alias("task_id"), F.col("l_orderkey").alias("trajectory"), F.col("l_linenumber").alias("turn")).agg(F.sum(F.floor("l_quantity")).cast("double").alias("score"))
    out = ordered.group_advantages(ordered.discounted_returns(scores, 0.4))
    return out.withColumn("raw_return", F.round("raw_return", 6)).withColumn("advantage", F.round("advantage", 6))


@query("""WITH r AS (SELECT event_id, user_id, CAST(floor(value) AS BIGINT) % 3 AS reward FROM events), m AS (SELECT user_id, avg(reward) AS mean FROM r GROUP BY user_id HAVING min(reward) < max(reward))
SELECT event_id, user_id, reward, round(reward - mean, 9) AS advantage FROM r JOIN m USING (user_id)""")
def centered_advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rewards = table(spark, sf_dir, "events").select("event_id", "user_id", (F.floor("value") % 3).alias("reward"))
    return ordered.centered_advantages(rewards, "user_id", "reward").withColumn("advantage", F.round("advantage", 9))


@query("""WITH e AS (SELECT user_id, event_id, value < 30 AS idle FROM events), b AS (SELECT *, sum(CASE WHEN idle THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e),
s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS k FROM b WHERE idle) SELECT user_id, min(event_id) AS stop_step FROM s WHERE k = 3 GROUP BY user_id""")
def saturation_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.first_streak(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", F.col("value") < 30, 3)


@query("""WITH r AS (SELECT user_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS round, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id) AS won FROM events)
SELECT user_id, event_id, event_type, round FROM r WHERE round <= 5 AND (won IS NULL OR event_id <= won)""")
def refinement_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.until_success(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type") == "purchase", 5)


@query("""WITH w AS (SELECT l_orderkey, l_linenumber AS p, l_discount > 0.02 AS w FROM lineitem), s AS (SELECT l_orderkey, count(*) FILTER (w) AS supervised, min(CASE WHEN w THEN p END) AS f, max(CASE WHEN w THEN p END) AS l, max(p) AS e FROM w GROUP BY l_orderkey)
SELECT l_orderkey, supervised, coalesce(l - f + 1 = supervised, false) AS contiguous, coalesce(l = e, false) AS reaches_end FROM s""")
def supervision_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") > 0.02, 1.0).otherwise(0.0).alias("weight"))
    return ordered.supervision_audit(weights, "l_orderkey", "l_linenumber", "weight")


@query("""SELECT event_id, user_id FROM events e WHERE value > 50 AND NOT EXISTS (SELECT 1 FROM events d WHERE d.event_id % 3 = 0 AND d.event_id = e.event_id AND d.event_type = e.event_type)""")
def pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    done = events.where("event_id % 3 = 0").select("event_id", "event_type")
    return ordered.pending(events.select("event_id", "event_type", "user_id", "value"), done, ["event_id", "event_type"], F.col("value") > 50).select("event_id", "user_id")


_PIECES = r"""r AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split, CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS lane, len(regexp_extract_all(text, '\S+')) + 1 AS n, sha256('pack:' || doc_id) AS k FROM documents),
o AS (SELECT *, sum(n) OVER (PARTITION BY split, lane ORDER BY k) - n AS start, sum(n) OVER (PARTITION BY split, lane) AS total FROM r),
b AS (SELECT split, lane, any_value(total) AS total, total % 512 = 1 AND total > 512 AS short FROM o GROUP BY split, lane, total),
p AS (SELECT split, lane, i AS pack, CASE WHEN short AND i = (total - 1) // 512 THEN total - 2 ELSE i * 512 END AS low,
  CASE WHEN short AND i = (total - 1) // 512 - 1 THEN total - 2 ELSE least((i + 1) * 512, total) END AS high FROM b, unnest(range(CAST((total + 511) // 512 AS BIGINT))) u(i)),
pieces AS (SELECT o.split, o.lane, o.doc_id, p.pack, CAST(greatest(start, low) - low AS BIGINT) AS "offset", CAST(least(start + n, high) - greatest(start, low) AS BIGINT) AS tokens FROM o JOIN p ON o.split = p.split AND o.lane = p.lane AND start < high AND start + n > low)"""


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("doc_id") % 5 == 0, F.lit("validation")).otherwise(F.lit("train"))
    lane = F.when(F.col("lang") == "en", F.lit("en")).otherwise(F.lit("other"))
    rows = table(spark, sf_dir, "documents").select("doc_id", split.alias("split"), lane.alias("lane"), (word_count(F.col("text")) + 1).alias("n"))
    return packing.pack_pieces(rows, ["split", "lane"], "doc_id", "n", 512)


@query(f"WITH {_PIECES} SELECT * FROM pieces")
def packed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


@query(f"""WITH {_PIECES} SELECT split, lane, pack, CAST(sum(tokens) AS BIGINT) AS token_count, string_agg(doc_id, ',' ORDER BY "offset") AS source_row_ids FROM pieces GROUP BY split, lane, pack""")
def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.packs(_pieces(spark, sf_dir), ["split", "lane"], "doc_id")
    return found.withColumn("source_row_ids", F.array_join(F.transform("source_row_ids", lambda x: x.cast("string")), ","))


@query(f"""WITH {_PIECES}, k AS (SELECT lane, pack, CAST(sum(tokens) AS BIGINT) AS t FROM pieces WHERE split = 'train' GROUP BY lane, pack),
l AS (SELECT lane, sum(t) AS lt, count(*) AS lp FROM k GROUP BY lane), g AS (SELECT lane, lt, lp, (SELECT max(lt / 0.5) FROM l) * 0.5 AS target FROM l),
c AS (SELECT k.lane, k.pack, c * lp + row_number() OVER (PARTITION BY k.lane, c ORDER BY pack) - 1 AS position, c * lt + sum(t) OVER (PARTITION BY k.lane, c ORDER BY pack) - t AS upto, target FROM k JOIN g USING (lane), unnest(range(100)) u(c)),
s AS (SELECT row_number() OVER (ORDER BY position, lane) - 1 AS slot, lane, pack FROM c WHERE upto < target), n AS (SELECT count(*) AS n FROM s)
SELECT slot, lane, pack FROM s UNION ALL SELECT n + slot, lane, pack FROM s, n WHERE slot < (8 - n % 8) % 8""")
def lane_balanced_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.packs(_pieces(spark, sf_dir).where("split = 'train'"), ["split", "lane"], "doc_id")
    return packing.lane_schedule(packed.select("lane", "pack", "token_count"), {"en": 0.5, "other": 0.5}, 8)
