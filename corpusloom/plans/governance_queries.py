"""Gates, rescoring, stream merges and run logs over the test tables."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import governance as g
from corpusloom.operators import verifying
from corpusloom.plans.registry import query, table


_CARRIED = "'CANARY-' || substr(sha256(provider || ':' || slice || ':' || k), 1, 16)"


@query(f"""WITH p AS (SELECT DISTINCT 'p' || length(source) % 3 AS provider, length(source) % 3 <> 1 AS approved, length(source) % 3 <> 2 AS reviewed FROM documents WHERE source IS NOT NULL),
l AS (SELECT DISTINCT 'p' || length(source) % 3 AS provider, 100.0 - 100 * (length(source) % 3 // 2) AS usd_remaining FROM documents WHERE length(source) % 3 <> 1),
d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE source IS NOT NULL),
s AS (SELECT source AS slice, 'p' || length(source) % 3 AS provider, source <> 'src7' AS cleared, sum(n_chars) % 7 <> 0 AS manifest_found, sum(n_chars) % 11 <> 0 AS source_found, count(*) FILTER (contains(text, '@')) AS hits FROM documents WHERE source IS NOT NULL GROUP BY source),
c AS (SELECT slice, {_CARRIED} AS canary, k FROM s, unnest(range(1, 4)) u(k)),
f AS (SELECT c.slice, string_agg(canary, ',' ORDER BY c.k) FILTER (d.doc_id IS NULL) AS lost FROM c LEFT JOIN d ON d.source = c.slice AND d.k = c.k AND d.text IS NOT NULL GROUP BY c.slice),
r AS (SELECT s.slice, CASE WHEN NOT source_found THEN ['SOURCE_MISSING'] WHEN NOT manifest_found THEN ['RIGHTS_MANIFEST_MISSING'] ELSE list_filter([CASE WHEN NOT (coalesce(approved, false) AND coalesce(reviewed, false)) THEN 'PROVIDER_NOT_APPROVED' END, CASE WHEN NOT cleared THEN 'SLICE_NOT_CLEARED' END,
  CASE WHEN l.provider IS NULL THEN 'SPEND_LEDGER_MISSING' WHEN usd_remaining <= 0 THEN 'SPEND_HEADROOM_EXHAUSTED' END, CASE WHEN hits > 0 THEN 'SCRUB_HITS_PRESENT' END, CASE WHEN lost IS NOT NULL THEN 'CANARY_EMBED_FAILED:' || lost END], lambda x: x IS NOT NULL) END AS reasons
  FROM s LEFT JOIN p USING (provider) LEFT JOIN l USING (provider) LEFT JOIN f USING (slice))
SELECT slice, len(reasons) = 0 AS allowed, array_to_string(reasons, '|') AS reasons FROM r""")
def upload_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as slices: providers and ledgers follow from their names, the k-th canary of a slice goes into its k-th document
    (those of documents without text, or of slices with fewer, are lost)."""
    docs = table(spark, sf_dir, "documents").where("source is not null")
    kind = F.length("source") % 3
    provider = F.concat(F.lit("p"), kind.cast("string"))
    each = docs.groupBy(F.col("source").alias("slice")).agg(F.sum("n_chars").alias("chars"), F.count_if(F.contains("text", F.lit("@"))).alias("scrub_hits"))
    named = each.withColumn("source", F.col("slice")).withColumn("provider", provider).drop("source")
    canary = lambda k: F.concat(F.lit("CANARY-"), F.substring(F.sha2(F.concat("provider", F.lit(":"), "slice", F.lit(":"), k.cast("string")), 256), 1, 16))
    sown = named.select("slice", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"), "provider").select("slice", "k", canary(F.col("k")).alias("canary"))
    carriers = g.first_rows(docs.select("source", "doc_id", "text"), "source", "doc_id", 3)
    held = sown.join(carriers.withColumnRenamed("source", "slice"), ["slice", "k"], "left").withColumn("sent", F.concat("text", F.lit("\n"), "canary"))
    lost = held.groupBy("slice").agg(F.transform(F.array_sort(F.collect_list(F.when(~F.coalesce(F.contains("sent", F.col("canary")), F.lit(False)), F.struct("k", "canary")))), lambda x: x["canary"]).alias("canaries_lost"))
    slices = named.join(lost, "slice").withColumns({"source_found": F.col("chars") % 11 != 0, "manifest_found": F.col("chars") % 7 != 0, "rights_cleared": F.col("slice") != "src7", "secrets_scrubbed": F.lit(True)})
    providers = docs.select(provider.alias("provider"), (kind != 1).alias("upload_approved"), (kind != 2).alias("retention_reviewed")).distinct()
    ledger = docs.where(kind != 1).select(provider.alias("provider"), (100.0 - 100 * F.floor(kind / 2)).alias("usd_remaining")).distinct()
    return g.upload_gate(slices, providers, ledger).withColumn("reasons", F.array_join("reasons", "|"))


@query("""SELECT source, count(*) AS n, count(*) FILTER (contains(text, 'license') OR contains(text, 'zzz')) AS n_forbidden, count(*) FILTER (contains(text, 'example.com')) AS n_canaries,
  count(*) FILTER (contains(text, 'license') OR contains(text, 'zzz')) = 0 AND count(*) FILTER (contains(text, 'example.com')) = 0 AS clear FROM documents GROUP BY source""")
def preflight_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.preflight(table(spark, sf_dir, "documents"), "source", ("license", "zzz"), ("example.com",))


@query("""SELECT 'm' || conv_id AS path, role AS provider, turn % 2 = 0 AS approved FROM conversations""")
def rights_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rights written as Markdown tables, a file per conversation, and read again."""
    line = F.concat(F.lit("| "), "role", F.lit(" | "), F.when(F.col("turn") % 2 == 0, F.lit("yes")).otherwise(F.lit("no")), F.lit(" |"))
    files = table(spark, sf_dir, "conversations").groupBy(F.concat(F.lit("m"), F.col("conv_id").cast("string")).alias("path")).agg(F.concat(F.lit("# Rights\n| who | ok |\n|---|---|\n"), F.array_join(F.collect_list(line), "\n")).alias("content"))
    return g.rights_of(files)


@query("""WITH s AS (SELECT doc_id, n_chars // 100 AS score, lang FROM documents WHERE doc_id % 10 <> 1), c AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE n_chars // 100 END AS score, CASE WHEN doc_id % 11 = 0 THEN 'xx' ELSE lang END AS lang FROM documents WHERE doc_id % 10 <> 2)
SELECT doc_id, 'UNKNOWN_ROW' AS code FROM s WHERE doc_id NOT IN (SELECT doc_id FROM c) UNION ALL SELECT doc_id, 'MISSING_ROW' FROM c WHERE doc_id NOT IN (SELECT doc_id FROM s)
UNION ALL SELECT doc_id, 'SCORE_DIFFERS' FROM s JOIN c USING (doc_id) WHERE s.score <> c.score UNION ALL SELECT doc_id, 'LANG_DIFFERS' FROM s JOIN c USING (doc_id) WHERE s.lang <> c.lang""")
def rescored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, score = table(spark, sf_dir, "documents"), F.floor(F.col("n_chars") / 100)
    stored = docs.where("doc_id % 10 <> 1").select("doc_id", score.alias("score"), "lang")
    changed = docs.where("doc_id % 10 <> 2").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit(-1).cast("long")).otherwise(score).alias("score"), F.when(F.col("doc_id") % 11 == 0, F.lit("xx")).otherwise(F.col("lang")).alias("lang"))
    return g.rescored(stored, changed, ("doc_id",), ("score", "lang"))


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'left_only' ELSE 'right_only' END AS side FROM (SELECT doc_id FROM documents WHERE lang = 'en' OR n_chars < 2000) a FULL JOIN (SELECT doc_id FROM documents WHERE lang IS DISTINCT FROM 'en') b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL""")
def stream_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams that together hold every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return g.merged_streams(docs.where("lang = 'en' or n_chars < 2000"), docs.where("not lang <=> 'en'"), "doc_id")


@query("""WITH t AS (SELECT sha256('{"brand":"' || p_brand || '","size":' || p_size || '}') AS signature, p_partkey FROM part), c AS (SELECT signature, count(*) AS n FROM t WHERE p_partkey % 2 = 0 GROUP BY signature)
SELECT signature, n FROM c WHERE n > 1 UNION SELECT signature, n FROM c WHERE signature IN (SELECT signature FROM t WHERE p_partkey % 2 = 1)""")
def repeated_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return g.signature_overlaps(parts.where("p_partkey % 2 = 0"), parts.where("p_partkey % 2 = 1"), brand=F.col("p_brand"), size=F.col("p_size"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN 'recovery' WHEN o_orderstatus = 'F' THEN 'success' ELSE 'failure' END AS outcome FROM orders""")
def recovered_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("o_orderstatus") == "F", "success").otherwise("failure")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", outcome.alias("outcome"), (F.col("o_orderkey") % 4 == 0).alias("had_failure"))
    return g.recovered(rows).select("o_orderkey", "outcome")


@query("""SELECT user_id, count(*) AS steps, CAST(sum(length(event_type)) AS BIGINT) AS tokens, count(*) FILTER (value > 50) AS trained_steps, string_agg(CAST(floor(value) AS BIGINT), ',' ORDER BY event_id) AS rewards FROM events GROUP BY user_id""")
def run_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("step"), F.floor("value").alias("reward"), F.length("event_type").cast("long").alias("tokens"), (F.col("value") > 50).alias("trained"))
    return g.run_log(steps, "user_id").withColumn("rewards", F.array_join(F.transform("rewards", lambda x: x.cast("string")), ","))


@query("""WITH c AS (SELECT user_id % 10 AS call, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT call, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM c GROUP BY call""")
def commands_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("call"), "event_type")
    return g.nested_counts(rows, "call", "event_type").withColumn("counts", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


@query("""SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey HAVING count(*) <> 4 UNION ALL SELECT c_nationkey, count(*) FROM customer GROUP BY c_nationkey HAVING count(*) <> 4""")
def unbalanced_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = g.unbalanced(table(spark, sf_dir, "nation"), "n_regionkey", 4)
    return nations.union(g.unbalanced(table(spark, sf_dir, "customer"), "c_nationkey", 4))


@query("""SELECT lang || ':' || source AS key, count(*) AS n FROM documents GROUP BY ALL""")
def two_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.concat_ws(":", "lang", "source").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderpriority AS tier, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS passed, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS accuracy FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def accuracy_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = F.count_if(F.col("o_orderstatus") == "F")
    return table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "tier").rollup("tier").agg(F.count(F.lit(1)).alias("n"), passed.alias("passed"), F.round(passed / F.count(F.lit(1)), 6).alias("accuracy"))


@query("""WITH h AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0) SELECT c_mktsegment AS segment, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS passed FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey IN (SELECT c_custkey FROM h) GROUP BY c_mktsegment""")
def headroom_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the subset of tasks with headroom performs: a semi-join, then counts."""
    customers = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders").join(customers.where("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("passed"))


@query("""SELECT doc_id, lang, NULL AS extra FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, NULL, source FROM documents WHERE lang <> 'en' OR lang IS NULL""")
def united_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a prior and a new release whose columns differ: together the whole table."""
    docs = table(spark, sf_dir, "documents")
    old = docs.where("lang = 'en'").select("doc_id", "lang")
    return old.unionByName(docs.where("lang <> 'en' or lang is null").select("doc_id", F.col("source").alias("extra")), allowMissingColumns=True)


@query("""SELECT p.page_id, regexp_extract(p.url, '^https?://([^/]+)', 1) AS host, d.source, d.n_chars FROM pages p JOIN documents d ON p.page_id = d.doc_id WHERE d.n_chars BETWEEN 300 AND 9000 AND d.lang = 'en'""")
def metadata_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files joined with their metadata and filtered by band and language."""
    meta = table(spark, sf_dir, "documents").where(F.col("n_chars").between(300, 9000) & (F.col("lang") == "en")).select(F.col("doc_id").alias("page_id"), "source", "n_chars")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).join(meta, "page_id")


@query("""SELECT 'part-' || p_partkey AS task_id, 'Describe ' || p_name AS instruction, CAST(p_size AS BIGINT) AS size, 3 AS max_attempts,
  sha256('{"instruction":"Describe ' || p_name || '","max_attempts":3,"size":' || p_size || ',"task_id":"part-' || p_partkey || '"}') AS task_sha256 FROM part""")
def task_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.task_documents(
        table(spark, sf_dir, "part"),
        task_id=F.concat(F.lit("part-"), F.col("p_partkey").cast("string")),
        instruction=F.concat(F.lit("Describe "), "p_name"),
        size=F.col("p_size").cast("long"),
        max_attempts=F.lit(3),
    )


@query("""WITH f AS (SELECT doc_id % 2 AS arm, lang AS tier, contains(text, 'license') AS licensed, n_chars > 1000 AS long_text FROM documents)
SELECT tier, grouping(tier) = 1 AS overall, count(*) FILTER (arm = 0) AS n_before, count(*) FILTER (arm = 1) AS n_after, count(*) FILTER (arm = 1 AND licensed) - count(*) FILTER (arm = 0 AND licensed) AS licensed,
  count(*) FILTER (arm = 1 AND long_text) - count(*) FILTER (arm = 0 AND long_text) AS long_text FROM f GROUP BY ROLLUP (tier)""")
def arm_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select((F.col("doc_id") % 2).alias("arm"), F.col("lang").alias("tier"), F.contains("text", F.lit("license")).alias("licensed"), (F.col("n_chars") > 1000).alias("long_text"))
    return g.arm_deltas(rows, "arm", 0, 1, "tier", ("licensed", "long_text"))


class _ShortLines:
    """Passes a text without a run of marks; tells how many it has."""

    schema = "marks long, passed boolean"

    def verify(self, batch):
        counts = pc.count_substring(pc.fill_null(batch.column("text"), ""), "###").cast(pa.int64())
        return [counts, pc.equal(counts, 0)]


@query("""
WITH d AS (SELECT doc_id, text, length(text) - length(replace(text, '###', '##')) AS n FROM documents)
SELECT doc_id, CASE WHEN n = 0 THEN text ELSE replace(text, '###', '') END AS text, CAST(CASE WHEN n = 0 THEN 0 ELSE 1 END AS INTEGER) AS attempts, NOT contains(CASE WHEN n = 0 THEN text ELSE replace(text, '###', '') END, '###') AS passed FROM d""")
def repaired_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pluggable verifier over Arrow batches, and one round of repair for what it rejects."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fix = lambda rows: rows.withColumn("text", F.replace("text", F.lit("###"), F.lit("")))
    return verifying.repaired(docs, "doc_id", lambda rows: verifying.verified(rows, _ShortLines()).drop("marks"), fix, 1)
