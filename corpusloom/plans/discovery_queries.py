"""Signals, categories and ranks over pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import discovery as d
from corpusloom.plans.registry import query, table

SIGNALS = (
    d.Signal("s1", "tion", "english", 2),
    d.Signal("s2", "eaux", "french", 3),
    d.Signal("s3", "keit", "german", 3),
    d.Signal("s4", "/en/", "english", 1),
    d.Signal("s5", "test", "benchmark", 5),
    d.Signal("s6", "track", "trace", 1),
    d.Signal("s7", "nicht", "german", 2),
)
_SIGNALS = "(VALUES " + ", ".join(f"('{s.id}', '{s.pattern}', '{s.family}', {s.weight})" for s in SIGNALS) + ") sig(signal_id, pattern, family, weight)"
_MATCHES = f"""places AS (SELECT page_id, 'url' AS place, lower(url) AS t FROM pages UNION ALL SELECT page_id, 'title', lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) FROM pages UNION ALL SELECT page_id, 'html', lower(html) FROM pages),
matches AS (SELECT page_id, signal_id, family, CAST(weight AS BIGINT) AS weight, string_agg(place, ',' ORDER BY place) AS locations FROM places JOIN {_SIGNALS} ON contains(t, pattern) GROUP BY ALL)"""
#: What a registry says of a page: tags, a revision, a licence, who may read it.
_META = """meta AS (SELECT page_id, lower(url) AS name, CASE WHEN page_id % 13 = 0 THEN ['Text', 'LLM-Evaluation'] WHEN page_id % 7 <> 0 THEN ['text'] END AS tags, CASE WHEN page_id % 5 <> 0 THEN substr(sha256(url), 1, 40) ELSE 'main' END AS revision,
  CASE page_id % 3 WHEN 0 THEN 'mit' WHEN 1 THEN 'unverified' ELSE 'multiple:mit,gpl' END AS licence, page_id % 9 = 0 AS private, page_id % 10 = 0 AS gated FROM pages),
flagged AS (SELECT *, list_filter([CASE WHEN gated THEN 'SOURCE_GATED' END, CASE WHEN licence <> 'mit' THEN 'SOURCE_LICENSE_UNVERIFIED' END, CASE WHEN private THEN 'SOURCE_PRIVATE' END, CASE WHEN revision = 'main' THEN 'SOURCE_REVISION_UNPINNED' END], lambda r: r IS NOT NULL) AS risks,
  list_has_any(list_transform(coalesce(tags, []), lambda t: lower(t)), ['benchmark', 'benchmarks', 'evaluation', 'kernel-benchmark', 'kernelbench', 'pallasbench', 'llm-evaluation']) OR regexp_matches(name, '(?:^|[-_/])(?:eval|evaluation|benchmark|bench|test)(?:$|[-_/])') OR regexp_matches(name, 'kernelbench|pallasbench|jaxbench') AS named FROM meta)"""
_SCORED = f"""{_MATCHES}, {_META}, fam AS (SELECT page_id, family, sum(weight) AS w FROM matches GROUP BY ALL),
sums AS (SELECT page_id, string_agg(family || '=' || w, ',' ORDER BY family) AS scores, CAST(sum(w) AS BIGINT) AS score, coalesce(max(w) FILTER (family = 'english'), 0) AS en, coalesce(max(w) FILTER (family = 'french'), 0) AS fr, coalesce(max(w) FILTER (family = 'german'), 0) AS de,
  coalesce(max(w) FILTER (family = 'trace'), 0) AS tr, coalesce(max(w) FILTER (family = 'benchmark'), 0) AS be FROM fam GROUP BY page_id),
why AS (SELECT page_id, string_agg(signal_id, ',' ORDER BY signal_id) AS decision_reasons FROM matches GROUP BY page_id),
scored AS (SELECT f.page_id, coalesce(scores, '') AS scores, coalesce(score, 0) AS score, coalesce(en, 0) AS en, coalesce(fr, 0) AS fr, coalesce(de, 0) AS de, coalesce(tr, 0) AS tr, coalesce(be, 0) > 0 OR named AS benchmark, risks, coalesce(decision_reasons, '') AS decision_reasons FROM flagged f LEFT JOIN sums USING (page_id) LEFT JOIN why USING (page_id)),
cat AS (SELECT *, CASE WHEN score < 4 OR (en = 0 AND fr = 0 AND de = 0) THEN 'irrelevant_or_ambiguous' WHEN en >= greatest(fr, de) THEN 'main_domain' WHEN tr > 0 THEN 'agent_trace' ELSE 'cross_domain' END AS category FROM scored),
pol AS (SELECT *, CASE WHEN category = 'irrelevant_or_ambiguous' THEN 'rejected' WHEN benchmark THEN 'forbidden' ELSE 'discovery_only' END AS training_policy FROM cat)"""


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = {"url": F.col("url"), "title": F.regexp_extract("html", "<title>([^<]*)</title>", 1), "html": F.col("html")}
    return d.signal_matches(table(spark, sf_dir, "pages"), "page_id", places, SIGNALS)


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a source, with what its registry says; pages without a signal have no score."""
    n, matches = F.col("page_id"), _matches(spark, sf_dir)
    tags = F.when(n % 13 == 0, F.array(F.lit("Text"), F.lit("LLM-Evaluation"))).when(n % 7 != 0, F.array(F.lit("text")))
    revision = F.when(n % 5 != 0, F.substring(F.sha2("url", 256), 1, 40)).otherwise(F.lit("main"))
    licence = F.element_at(F.array(F.lit("mit"), F.lit("unverified"), F.lit("multiple:mit,gpl")), (n % 3 + 1).cast("int"))
    risks = d.source_risks(revision, licence, private=n % 9 == 0, gated=n % 10 == 0)
    found = table(spark, sf_dir, "pages").select("page_id", tags.alias("tags"), F.col("url").alias("name"), risks.alias("risk_flags"))
    signals = matches.groupBy("page_id").agg(F.array_sort(F.collect_set("signal_id")).alias("signals"))
    scored = found.join(d.family_scores(matches, "page_id"), "page_id", "left").join(signals, "page_id", "left")
    none = F.array().cast("array<string>")
    filled = scored.withColumns({"scores": F.coalesce("scores", F.create_map().cast("map<string,bigint>")), "score": F.coalesce("score", F.lit(0)), "signals": F.coalesce("signals", none)})
    return d.classify(filled, "english", ("french", "german"), 4)


@query(f"WITH {_MATCHES} SELECT * FROM matches")
def signal_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).withColumn("locations", F.array_join("locations", ","))


@query(f"""WITH {_SCORED} SELECT page_id, scores, score, category, training_policy, CASE WHEN benchmark THEN 'benchmark_or_evaluation' ELSE 'domain_source' END AS source_role, benchmark, CASE WHEN category = 'irrelevant_or_ambiguous' THEN 'rejected' ELSE 'candidate' END AS status,
  CASE WHEN category = 'irrelevant_or_ambiguous' THEN '' WHEN category = 'agent_trace' OR benchmark THEN 'dapt_candidate,repair_candidate' ELSE 'dapt_candidate' END AS objectives,
  array_to_string(list_sort(list_concat(risks, CASE WHEN category <> 'irrelevant_or_ambiguous' AND benchmark THEN ['BENCHMARK_CONTAMINATION'] ELSE [] END)), ',') AS risk_flags, decision_reasons FROM pol""")
def source_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.array_join(F.transform(F.map_entries("scores"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    listed = {c: F.array_join(c, ",") for c in ("objectives", "risk_flags", "decision_reasons")}
    return _classified(spark, sf_dir).withColumns({"scores": scores, **listed}).select("page_id", "scores", "score", "category", "training_policy", "source_role", "benchmark", "status", *listed)


@query(f"""WITH {_SCORED}, f AS (SELECT page_id, ['.parquet', '.zip', '.txt'][1 + page_id % 3] AS suffix, page_id % 2 = 0 AS permissive, page_id % 5 <> 0 AS pinned, page_id % 4 <> 0 AS accessible FROM pages),
t AS (SELECT page_id, CAST((CASE WHEN permissive THEN 3 ELSE 0 END) + (CASE WHEN pinned THEN 2 ELSE 0 END) + (CASE suffix WHEN '.parquet' THEN 2 WHEN '.zip' THEN 0 ELSE 1 END) + least(4, score // 6) + (CASE WHEN accessible THEN 2 ELSE 0 END) - (CASE WHEN training_policy = 'forbidden' THEN 20 ELSE 0 END) AS BIGINT) AS total FROM pol JOIN f USING (page_id) WHERE score > 0)
SELECT page_id, total FROM t ORDER BY total DESC, page_id""")
def ranked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = _classified(spark, sf_dir).where("score > 0"), F.col("page_id")
    suffix = F.element_at(F.array(*map(F.lit, (".parquet", ".zip", ".txt"))), (n % 3 + 1).cast("int"))
    total = d.rubric_total(n % 2 == 0, n % 5 != 0, d.format_score(F.array(suffix)), F.col("score"), n % 4 != 0, F.col("training_policy") == "forbidden")
    return rows.select("page_id", total.alias("total")).orderBy(F.desc("total"), "page_id")


@query("""WITH r AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, page_id, length(html) AS size FROM pages) SELECT host, min(page_id) AS page_id, arg_min(size, page_id) AS size FROM r GROUP BY host""")
def registered_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each host: what a registry that ignores later writers keeps."""
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), "page_id", F.length("html").cast("long").alias("size"))
    return d.first_writer(rows, "host", "page_id")


@query("""WITH f AS (SELECT source AS dataset, CASE WHEN doc_id % 11 = 0 THEN 'README-' ELSE 'data-' END || doc_id AS path, n_chars AS size FROM documents)
SELECT dataset, path, size, CAST(row_number() OVER (PARTITION BY dataset ORDER BY CASE WHEN contains(lower(path), 'readme') THEN 0 ELSE 1 END, size, path) AS INTEGER) AS rank FROM f QUALIFY rank <= 5""")
def preferred_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.when(F.col("doc_id") % 11 == 0, F.lit("README-")).otherwise(F.lit("data-")), F.col("doc_id").cast("string"))
    files = table(spark, sf_dir, "documents").select(F.col("source").alias("dataset"), path.alias("path"), F.col("n_chars").alias("size"))
    return d.preferred_files(files, "dataset", 5)


@query("""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line, doc_id FROM documents) SELECT line, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM l WHERE line <> '' GROUP BY line HAVING count(*) >= 5""")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs")).where("n >= 5")
