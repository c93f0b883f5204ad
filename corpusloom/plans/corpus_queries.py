"""Duplicates, contamination, admission, splits and releases over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import admission, dedup, similarity
from corpusloom.plans.registry import query, table

_SEQ = r"regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|\d+|[^\s]')"


def shingle_sql(name: str, source: str, key: str) -> str:
    """CTEs: ``name`` has a row per row and distinct shingle, ``name``_n the number of shingles and the class."""
    return f"""
{name}_seq AS (SELECT {key} AS id, {_SEQ} AS t FROM {source}),
{name} AS (SELECT DISTINCT id, array_to_string(t[i:i + 4], chr(1)) AS s FROM {name}_seq, unnest(range(1, greatest(len(t) - 3, 2))) r(i) WHERE len(t) > 0),
{name}_n AS (SELECT id, count(*) AS n FROM {name} GROUP BY id)"""


PAIRS_SQL = f"""{shingle_sql("sh", "documents", "doc_id")},
pairs AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.id < b.id GROUP BY ALL),
sims AS (SELECT a, b, c / (x.n + y.n - c) AS similarity FROM pairs JOIN sh_n x ON x.id = a JOIN sh_n y ON y.id = b WHERE c / (x.n + y.n - c) >= 0.8)"""
HELD_SQL = f"""{shingle_sql("bs", "benchmark", "item_id")},
held AS (SELECT a.id AS doc_id, b.id AS item_id, count(*) AS c FROM sh a JOIN bs b ON a.s = b.s GROUP BY ALL),
held_near AS (SELECT doc_id, item_id, c / (x.n + y.n - c) AS similarity FROM held JOIN sh_n x ON x.id = doc_id JOIN bs_n y ON y.id = item_id WHERE c / (x.n + y.n - c) >= 0.8),
held_exact AS (SELECT doc_id, item_id FROM documents d JOIN benchmark b ON sha256(d.text) = sha256(b.text)),
held_first AS (SELECT doc_id, min(item_id) AS item_id FROM (SELECT doc_id, item_id FROM held_near UNION SELECT doc_id, item_id FROM held_exact) GROUP BY doc_id)"""
POLICY_SQL = f"""{PAIRS_SQL}, {HELD_SQL},
h AS (SELECT doc_id, lang, sha256(text) AS e, sha256(array_to_string(regexp_extract_all(text, '\\S+'), ' ')) AS z FROM documents),
f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, e) AS fe, min(doc_id) OVER (PARTITION BY lang, z) AS fz FROM h),
near AS (SELECT b AS doc_id, arg_min(a, [-similarity, a]) AS near_of, max(similarity) AS similarity FROM sims JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b WHERE x.lang = y.lang GROUP BY b),
policy AS (SELECT f.doc_id, list_sort(list_filter([
  CASE WHEN fe < f.doc_id THEN 'EXACT_DUPLICATE:' || fe END, CASE WHEN fe = f.doc_id AND fz < f.doc_id THEN 'NORMALIZED_DUPLICATE:' || fz END,
  CASE WHEN near_of IS NOT NULL THEN 'NEAR_DUPLICATE:' || near_of || printf(':%.6f', near.similarity) END,
  CASE WHEN x.doc_id IS NOT NULL THEN 'HOLDOUT_EXACT_MATCH:' || hf.item_id WHEN hf.item_id IS NOT NULL THEN 'HOLDOUT_NEAR_MATCH:' || hf.item_id || printf(':%.6f', hn.similarity) END], lambda r: r IS NOT NULL)) AS reasons
  FROM f LEFT JOIN near USING (doc_id) LEFT JOIN held_first hf USING (doc_id) LEFT JOIN held_exact x ON x.doc_id = f.doc_id AND x.item_id = hf.item_id LEFT JOIN held_near hn ON hn.doc_id = f.doc_id AND hn.item_id = hf.item_id)"""


def _policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return dedup.corpus_policy(docs, "doc_id", "lang", table(spark, sf_dir, "benchmark"), "item_id").select("doc_id", "reasons", "status")


@query(f"WITH {POLICY_SQL} SELECT doc_id, array_to_string(reasons, '|') AS reasons, CASE WHEN len(reasons) > 0 THEN 'rejected' ELSE 'eligible' END AS status FROM policy")
def corpus_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy(spark, sf_dir).withColumn("reasons", F.array_join("reasons", "|"))


@query(f"""WITH {POLICY_SQL}, tagged AS (SELECT CASE WHEN len(reasons) > 0 THEN 'rejected' ELSE 'eligible' END AS status, CASE WHEN len(reasons) > 0 THEN reasons ELSE [''] END AS reasons FROM policy)
SELECT status, split_part(r, ':', 1) AS reason, count(*) AS n FROM (SELECT status, unnest(reasons) AS r FROM tagged) GROUP BY ALL""")
def corpus_policy_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by status and reason, without what follows a reason's first colon."""
    every = F.explode(F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit(""))))
    return _policy(spark, sf_dir).select("status", every.alias("r")).groupBy("status", F.substring_index("r", ":", 1).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT sha256(text) AS content_sha256, count(*) AS n, count(*) - 1 AS extra, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY text HAVING count(*) > 1""")
def exact_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select("doc_id", text.digest(F.col("text")).alias("content_sha256"))
    groups = hashed.groupBy("content_sha256").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - 1).alias("extra"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    return groups.where("n > 1")


@query(f"""
WITH {PAIRS_SQL}, cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY array_to_string({_SEQ}, chr(1))) AS rep FROM documents)
SELECT a, b, round(similarity, 6) AS similarity FROM sims WHERE a IN (SELECT rep FROM cls) AND b IN (SELECT rep FROM cls)""")
def near_duplicate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the first documents of all classes of equal tokens."""
    sets = similarity.shingle_sets(table(spark, sf_dir, "documents"), "doc_id")
    first = sets.rows.groupBy("cls").agg(F.min("doc_id").alias("first"))
    links = similarity.class_links(sets).join(first.toDF("a", "fa"), "a").join(first.toDF("b", "fb"), "b")
    return links.select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b"), F.round("similarity", 6).alias("similarity"))


@query(f"SELECT doc_id, min(doc_id) OVER (PARTITION BY array_to_string({_SEQ}, chr(1))) AS class_id FROM documents")
def token_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The membership that belongs to ``near_duplicate_links``."""
    sets = similarity.shingle_sets(table(spark, sf_dir, "documents"), "doc_id").rows.select("doc_id", "cls")
    return sets.join(sets.groupBy("cls").agg(F.min("doc_id").alias("class_id")), "cls").select("doc_id", "class_id")


@query()
def accepted_rows_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of accepted earlier documents only: decided in rounds, so SQL has no plain form of it."""
    docs = table(spark, sf_dir, "documents")
    sets = similarity.shingle_sets(docs, "doc_id")
    first = sets.rows.groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    ordered = similarity.class_links(sets).join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select(F.greatest("x", "y").alias("doc_id"), F.least("x", "y").alias("other"))
    decided = dedup.accepted_first(first, "doc_id", ordered).withColumnRenamed("doc_id", "first_id")
    return sets.rows.join(first.withColumnRenamed("doc_id", "first_id"), "cls").join(decided, "first_id").select("doc_id", F.when(F.col("doc_id") != F.col("first_id"), F.col("first_id")).otherwise(F.col("near_of")).alias("duplicate_of"))


@query(f"""
WITH {shingle_sql("sh", "documents", "doc_id")}, {shingle_sql("bs", "benchmark", "item_id")}
SELECT a.id AS doc_id, b.id AS item_id, round(count(*) / n.n, 6) AS share FROM sh a JOIN bs b ON a.s = b.s JOIN bs_n n ON n.id = b.id GROUP BY a.id, b.id, n.n HAVING count(*) >= 0.9 * n.n""")
def benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.contained_passages(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "benchmark"), "item_id")
    return found.select("doc_id", "item_id", F.round("share", 6).alias("share"))


@query("""
WITH sealed AS (SELECT item_id, text FROM benchmark WHERE length(text) >= 40)
SELECT d.doc_id, s.item_id FROM documents d JOIN sealed s ON contains(d.text, s.text)""")
def sealed_bodies_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed bodies as substrings: proposed by the shingles they share, so documents never meet all bodies."""
    return admission.containing(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "benchmark").where(F.length("text") >= 40), "item_id")


ADMISSION_SQL = f"""{PAIRS_SQL},
h AS (SELECT doc_id, source, text, sha256(text) AS e, sha256(array_to_string(regexp_extract_all(text, '\\S+'), ' ')) AS z FROM documents),
m AS (SELECT c.doc_id, b.doc_id AS base_id, 0 AS p FROM h c JOIN h b ON c.e = b.e UNION ALL SELECT c.doc_id, b.doc_id, 1 FROM h c JOIN h b ON c.z = b.z
      UNION ALL SELECT b, a, 2 FROM sims UNION ALL SELECT a, b, 2 FROM sims),
m1 AS (SELECT doc_id, arg_min(base_id * 10 + p, base_id * 10 + p) AS k FROM m WHERE base_id % 10 = 0 AND doc_id % 10 <> 0 GROUP BY doc_id),
admission AS (SELECT h.doc_id, h.source, len({_SEQ}) AS lexical_tokens, list_sort(list_filter([
  CASE WHEN len({_SEQ}) < 60 THEN 'CONTENT_BELOW_TOKEN_THRESHOLD' END, CASE WHEN NOT (contains(text, 'tion') OR contains(text, 'ung')) THEN 'KERNEL_STRUCTURE_MISSING' END,
  CASE WHEN k IS NOT NULL THEN ['BASE_DAPT_EXACT_DUPLICATE:', 'BASE_DAPT_NORMALIZED_DUPLICATE:', 'BASE_DAPT_NEAR_DUPLICATE:'][k % 10 + 1] || k // 10 END], lambda r: r IS NOT NULL)) AS reasons
  FROM h LEFT JOIN m1 USING (doc_id) WHERE h.doc_id % 10 <> 0)"""


def _admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return admission.admit(docs.where("doc_id % 10 <> 0"), docs.where("doc_id % 10 = 0"), "doc_id", "source", 60, ("tion", "ung"), 0.3)


@query(f"""WITH {ADMISSION_SQL}
SELECT doc_id, source, CAST(lexical_tokens AS BIGINT) AS lexical_tokens, array_to_string(reasons, '|') AS reasons, CASE WHEN len(reasons) = 0 THEN 'authorized' ELSE 'rejected' END AS status,
  CASE WHEN CAST(('0x' || substr(sha256(source), 1, 8)) AS BIGINT) / 4294967295.0 < 0.3 THEN 'validation' ELSE 'train' END AS split,
  CASE WHEN len(reasons) = 0 THEN round(1.0 / sum(CASE WHEN len(reasons) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source), 9) ELSE 0.0 END AS sampling_weight
FROM admission""")
def admitted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _admission(spark, sf_dir).select("doc_id", "source", "lexical_tokens", F.array_join("reasons", "|").alias("reasons"), "status", "split", F.round("sampling_weight", 9).alias("sampling_weight"))


@query(f"""WITH {ADMISSION_SQL}
SELECT k.source, count(a.doc_id) AS gross, count(a.doc_id) FILTER (len(reasons) = 0) AS curated, count(a.doc_id) FILTER (len(reasons) > 0) AS rejected
FROM (SELECT DISTINCT source FROM documents UNION ALL SELECT 'src_empty') k LEFT JOIN admission a USING (source) GROUP BY k.source""")
def source_yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows found, kept and rejected per source; a source without rows has zeros."""
    known = table(spark, sf_dir, "documents").select("source").distinct().union(spark.range(1).select(F.lit("src_empty")))
    return admission.yields(_admission(spark, sf_dir), known)


@query(f"""
WITH {shingle_sql("sh", "documents", "doc_id")}, {HELD_SQL},
r AS (SELECT d.doc_id, d.source, d.lang FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1),
s AS (SELECT source, count(*) AS n FROM r GROUP BY source), f AS (SELECT lang, count(*) AS n FROM r GROUP BY lang),
o AS (SELECT (SELECT count(*) FROM r) AS verified_rows, (SELECT count(*) FROM f) AS family_count, (SELECT count(*) FROM s) AS source_count, (SELECT string_agg(source || '=' || n, ',' ORDER BY source) FROM s) AS source_counts, (SELECT string_agg(lang || '=' || n, ',' ORDER BY lang) FROM f) AS family_counts,
  (SELECT max(n) / sum(n) FROM s) AS max_source, (SELECT max(n) / sum(n) FROM f) AS max_family, (SELECT min(n) FROM f) AS least_family, (SELECT count(*) FROM r WHERE doc_id IN (SELECT doc_id FROM held_first)) AS holdout_contamination),
w AS (SELECT *, list_filter([CASE WHEN verified_rows < 500 THEN 'VERIFIED_ROWS_INSUFFICIENT' END, CASE WHEN family_count < 4 THEN 'FAMILY_DIVERSITY_INSUFFICIENT' END,
  CASE WHEN source_count < 25 THEN 'SOURCE_DIVERSITY_INSUFFICIENT' END, CASE WHEN least_family < 20 THEN 'FAMILY_DEPTH_INSUFFICIENT' END,
  CASE WHEN max_source > 0.2 THEN 'SOURCE_CONCENTRATION_EXCEEDED' END, CASE WHEN max_family > 0.5 THEN 'FAMILY_CONCENTRATION_EXCEEDED' END, CASE WHEN holdout_contamination > 0 THEN 'HOLDOUT_CONTAMINATION_PRESENT' END], lambda r: r IS NOT NULL) AS why FROM o)
SELECT verified_rows, family_count, source_count, family_counts, source_counts, round(max_source, 9) AS max_source, round(max_family, 9) AS max_family, holdout_contamination, array_to_string(why, '|') AS reasons, len(why) = 0 AS authorized FROM w""")
def readiness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The admitted rows, and how many of them held-out text was found in."""
    docs = table(spark, sf_dir, "documents")
    good = docs.join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")
    held = dedup.first_forbidden(good.select("doc_id", "text"), "doc_id", table(spark, sf_dir, "benchmark"), "item_id")
    found = admission.readiness(good, "source", "lang", admission.Policy(500, 4, 25, 20, 0.2, 0.5), held)
    shown = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return found.withColumns({m: shown(m) for m in ("family_counts", "source_counts")})


@query("""
WITH s AS (SELECT source, doc_id, ['train', 'validation', 'sealed', 'report'][1 + (doc_id // 7) % 4] AS split FROM documents)
SELECT source, count(DISTINCT split) AS n_splits FROM s GROUP BY source HAVING count(DISTINCT split) > 1""")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.leaking(_splits(spark, sf_dir), "source")


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ("train", "validation", "sealed", "report"))), (F.floor(F.col("doc_id") / 7) % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("content"), name.alias("split"))


@query("""
WITH s AS (SELECT DISTINCT sha256(text) AS content, ['train', 'validation', 'sealed', 'report'][1 + (doc_id // 7) % 4] AS split FROM documents)
SELECT a.split AS first_split, b.split AS second_split, count(*) AS n FROM s a JOIN s b ON a.content = b.content AND a.split < b.split GROUP BY ALL""")
def split_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that two splits share: from the set of splits of each text, at most four, never from pairs of rows."""
    return admission.overlaps(_splits(spark, sf_dir), "content")


@query("""
WITH s AS (SELECT doc_id, sha256(text) AS content, ['train', 'validation', 'sealed', 'report'][1 + (doc_id // 7) % 4] AS split FROM documents)
SELECT doc_id FROM s WHERE split = 'train' AND content IN (SELECT content FROM s WHERE split IN ('sealed', 'report'))""")
def contaminated_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = _splits(spark, sf_dir)
    return splits.where("split = 'train'").join(splits.where(F.col("split").isin("sealed", "report")), "content", "left_semi").select("doc_id")


@query("""
SELECT doc_id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unknown' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def label_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.reference_faults(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("""
SELECT d.doc_id, d.lang, l.quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)""")
def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select("doc_id", "lang", "quality", F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query("""
WITH lanes AS (SELECT 'a' AS lane, doc_id, sha256(text) AS content FROM documents WHERE lang = 'en' OR n_chars < 2000 UNION ALL SELECT 'b', doc_id, sha256(text) FROM documents WHERE lang IS DISTINCT FROM 'en')
SELECT 'id' AS fault, CAST(doc_id AS VARCHAR) AS value, count(*) AS n FROM lanes GROUP BY doc_id HAVING count(*) > 1
UNION ALL SELECT 'content', content, count(*) FROM lanes GROUP BY content HAVING count(DISTINCT lane) > 1""")
def lane_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lanes that together hold every document, some of them both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content"), "lang", "n_chars")
    return admission.lane_faults({"a": docs.where("lang = 'en' or n_chars < 2000"), "b": docs.where("not lang <=> 'en'")}, "doc_id", "content")


@query("""
SELECT coalesce(n.id, o.id) AS id, coalesce(n.lang, o.lang) AS lang, coalesce(n.note, o.note) AS note FROM
 (SELECT doc_id AS id, lang, 'old' AS note FROM documents WHERE lang = 'en' OR n_chars < 2000) o FULL JOIN (SELECT doc_id AS id, CASE WHEN n_chars < 500 THEN NULL ELSE 'xx' END AS lang, 'new' AS note FROM documents WHERE lang IS DISTINCT FROM 'en') n ON o.id = n.id""")
def upserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new rows that together are every document; short new ones bring no language."""
    docs = table(spark, sf_dir, "documents")
    old = docs.where("lang = 'en' or n_chars < 2000").select(F.col("doc_id").alias("id"), "lang", F.lit("old").alias("note"))
    new = docs.where("not lang <=> 'en'").select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") >= 500, F.lit("xx")).alias("lang"), F.lit("new").alias("note"))
    return admission.upsert(old, new, "id")


@query("""
WITH a AS (SELECT doc_id // 4096 AS g, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS sha, count(*) AS n, sum(n_chars) AS c FROM documents GROUP BY 1),
b AS (SELECT g // 4096 AS g, sha256(string_agg(sha, '' ORDER BY g)) AS sha, sum(n) AS n, sum(c) AS c FROM a GROUP BY g // 4096)
SELECT 'documents' AS artifact, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(c) AS BIGINT) AS n_chars, sha256(string_agg(sha, '' ORDER BY g)) AS content_sha256 FROM b""")
def release_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.manifest(table(spark, sf_dir, "documents"), "documents", "doc_id")
