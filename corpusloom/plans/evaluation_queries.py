"""Evaluation roll-ups over deterministic cells: a row per line item, named by the remainders of its keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import evaluation as ev
from corpusloom.plans.registry import query, table

_CELLS = """cells AS (SELECT 'm' || l_linenumber % 3 AS model_id, 't' || l_partkey % 40 AS task_id, CAST(l_suppkey % 4 AS INTEGER) AS seed, 'w' || l_partkey % 5 AS workload, 'f' || l_partkey % 7 AS family,
  CASE l_orderkey % 5 WHEN 0 THEN -1 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS reward, l_extendedprice / l_quantity / 1000 AS speedup, ['compile', 'correctness', 'profile'][1 + l_orderkey % 3] AS stage, l_orderkey % 11 = 0 AS worker_recovery_required,
  CAST(floor(l_quantity) AS BIGINT) AS q, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, l_tax FROM lineitem)"""
_ONE = f"""{_CELLS}, one AS (SELECT model_id, task_id, seed, family, max(reward) AS reward FROM cells GROUP BY ALL)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda letter, key, n: F.concat(F.lit(letter), (F.col(key) % n).cast("string"))
    kind = F.col("l_orderkey") % 5
    return table(spark, sf_dir, "lineitem").select(
        tag("m", "l_linenumber", 3).alias("model_id"), tag("t", "l_partkey", 40).alias("task_id"), (F.col("l_suppkey") % 4).cast("int").alias("seed"), tag("w", "l_partkey", 5).alias("workload"), tag("f", "l_partkey", 7).alias("family"),
        F.when(kind == 0, -1).when(kind.isin(1, 2), 1).otherwise(0).alias("reward"), (F.col("l_extendedprice") / F.col("l_quantity") / 1000).alias("speedup"),
        F.element_at(F.array(*map(F.lit, ("compile", "correctness", "profile"))), (F.col("l_orderkey") % 3 + 1).cast("int")).alias("stage"), (F.col("l_orderkey") % 11 == 0).alias("worker_recovery_required"),
        F.floor("l_quantity").alias("q"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax",
    )


def _one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).groupBy("model_id", "task_id", "seed", "family").agg(F.max("reward").alias("reward"))


@query(f"""
WITH {_CELLS}, f AS (SELECT model_id, CASE WHEN l_linenumber = 1 THEN NULL ELSE stage END AS stage, family FROM cells WHERE reward <> 1),
st AS (SELECT model_id, string_agg(k || '=' || c, ',' ORDER BY k) AS failure_stages FROM (SELECT model_id, coalesce(stage, 'unknown') AS k, count(*) AS c FROM f GROUP BY ALL) GROUP BY model_id),
fa AS (SELECT model_id, string_agg(k || '=' || c, ',' ORDER BY k) AS failure_families FROM (SELECT model_id, family AS k, count(*) AS c FROM f GROUP BY ALL) GROUP BY model_id),
s AS (SELECT model_id, count(*) AS n, count(*) FILTER (reward = 1) AS n_verified, round(count(*) FILTER (reward = 1) / count(*), 6) AS pass_rate,
  round(median(CASE WHEN reward = 1 THEN speedup END), 6) AS median_speedup, round(min(CASE WHEN reward = 1 THEN speedup END), 6) AS least_speedup, round(max(CASE WHEN reward = 1 THEN speedup END), 6) AS best_speedup,
  count(*) FILTER (reward = 1 AND speedup > 1.0) AS n_faster, count(*) FILTER (reward = 1 AND speedup >= 1.05) AS n_headroom, count(*) FILTER (worker_recovery_required) AS n_halts FROM cells GROUP BY model_id)
SELECT * FROM s JOIN st USING (model_id) JOIN fa USING (model_id)""")
def model_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of an order has no stage, so that some failures are unknown."""
    cells = _cells(spark, sf_dir).withColumn("stage", F.when(F.col("l_linenumber") != 1, F.col("stage")))
    shown = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return ev.model_summary(cells).withColumns({m: shown(m) for m in ("failure_stages", "failure_families")})


@query(f"""WITH {_CELLS} SELECT model_id, row_number() OVER (PARTITION BY model_id ORDER BY speedup) AS rank, speedup FROM cells WHERE reward = 1 AND speedup IS NOT NULL""")
def verified_speedups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.verified_speedups(_cells(spark, sf_dir))


@query(f"""
WITH {_CELLS} SELECT model_id, s AS stage, round(avg(CASE WHEN s = stage THEN CAST(q AS DOUBLE) ELSE 0.0 END), 9) AS mean_fraction FROM cells, unnest(['compile', 'correctness', 'profile', 'source']) u(s) GROUP BY ALL""")
def stage_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).withColumn("fractions", F.create_map("stage", F.col("q").cast("double")))
    return ev.stage_means(cells, ("compile", "correctness", "profile", "source"))


@query(f"WITH {_ONE} SELECT family, count(*) FILTER (model_id = 'm0' AND reward = 1) AS before, count(*) FILTER (model_id = 'm1' AND reward = 1) AS after, count(*) FILTER (model_id = 'm1' AND reward = 1) < count(*) FILTER (model_id = 'm0' AND reward = 1) AS regressed FROM one GROUP BY family")
def family_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.family_pivot(_one(spark, sf_dir), "m0", "m1")


_PAIRS = f"{_ONE}, paired AS (SELECT task_id, seed, family, max(CASE WHEN model_id = 'm0' THEN reward END) AS before, max(CASE WHEN model_id = 'm1' THEN reward END) AS after FROM one WHERE model_id IN ('m0', 'm1') GROUP BY ALL)"


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.pairs(_one(spark, sf_dir), "m0", "m1", ("task_id", "seed", "family"))


@query(f"""WITH {_PAIRS} SELECT count(*) FILTER (after > before) AS wins, count(*) FILTER (after = before) AS ties, count(*) FILTER (after < before) AS losses, CAST(sum(after - before) AS BIGINT) AS sum_delta, round(avg(after - before), 9) AS mean_delta, count(*) FILTER (after - before IS NULL) AS incomplete FROM paired""")
def paired_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.win_tie_loss(_paired(spark, sf_dir))


@query(f"""WITH {_PAIRS} SELECT family, count(*) FILTER (before = 1 AND after = 1) AS pass_pass, count(*) FILTER (before = 1 AND after <> 1) AS pass_fail, count(*) FILTER (before <> 1 AND after = 1) AS fail_pass, count(*) FILTER (before <> 1 AND after <> 1) AS fail_fail FROM paired GROUP BY family""")
def paired_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.transitions(_paired(spark, sf_dir), ("family",))


@query(f"""WITH {_CELLS} SELECT seed, workload, CAST(grouping(seed, workload) AS INTEGER) AS grain, count(*) AS n, round(count(*) FILTER (reward = 1) / nullif(count(*) FILTER (reward >= 0), 0), 6) AS pass_rate FROM cells GROUP BY GROUPING SETS ((), (seed), (workload))""")
def rates_at_three_grains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.three_grains(_cells(spark, sf_dir))


@query(f"""WITH {_CELLS}, t AS (SELECT task_id, max(reward) AS best, min(reward) AS worst FROM cells GROUP BY task_id),
s AS (SELECT seed, round(count(*) FILTER (reward = 1) / count(*), 6) AS rate FROM cells GROUP BY seed)
SELECT (SELECT count(*) FROM t WHERE best = 1) AS any_seed, (SELECT count(*) FROM t WHERE worst = 1) AS all_seeds, (SELECT round(max(rate) - min(rate), 6) FROM s) AS rate_range""")
def seeds_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.seed_consistency(_cells(spark, sf_dir))


@query("""SELECT l_partkey AS unit, count(l_quantity) AS runs, round(median(l_quantity), 6) AS median, round(stddev_pop(l_quantity) / avg(l_quantity), 6) AS cv, count(l_quantity) >= 3 AND coalesce(stddev_pop(l_quantity) / avg(l_quantity), CAST('inf' AS DOUBLE)) <= 0.5 AS stable FROM lineitem GROUP BY l_partkey""")
def timing_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.timing_evidence(table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "unit"), "unit", "l_quantity", 3, 0.5)


@query("""SELECT l_partkey AS unit, round(median(CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice END) / nullif(median(CASE WHEN l_linenumber % 2 = 1 THEN l_extendedprice END), 0), 6) AS speedup FROM lineitem GROUP BY l_partkey""")
def median_speedups(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("l_linenumber") % 2 == 0, F.lit("baseline")).otherwise(F.lit("candidate"))
    return ev.speedups(table(spark, sf_dir, "lineitem").withColumn("side", side).withColumnRenamed("l_partkey", "unit"), "unit", "l_extendedprice", "side")


@query("""WITH c AS (SELECT 8 * (1 + l_linenumber) AS n_train, CAST(floor(l_quantity) AS BIGINT) AS score FROM lineitem), g AS (SELECT n_train, avg(score) AS mean, stddev_pop(score) AS deviation, min(score) AS least, max(score) AS largest FROM c GROUP BY n_train),
w AS (SELECT *, mean - lag(mean) OVER (ORDER BY n_train) AS step FROM g)
SELECT n_train, round(mean, 6) AS mean, round(deviation, 6) AS deviation, least, largest, round(step, 6) AS step, coalesce(step >= 0, true) AS rising,
  round((last_value(mean) OVER e - first_value(mean) OVER e) / nullif(count(*) OVER e - 1, 0), 6) AS slope, bool_and(coalesce(step >= 0, true)) OVER e AS monotonic FROM w WINDOW e AS (ORDER BY n_train ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select((8 * (1 + F.col("l_linenumber"))).alias("n_train"), F.floor("l_quantity").alias("score"))
    return ev.learning_curve(cells)


@query("""WITH c AS (SELECT l.quality = 1 AS truth, d.n_chars > 1000 AS said FROM documents d JOIN labels l USING (doc_id)),
k AS (SELECT count(*) FILTER (truth AND said) AS tp, count(*) FILTER (NOT truth AND said) AS fp, count(*) FILTER (truth AND NOT said) AS fn, count(*) FILTER (NOT truth AND NOT said) AS tn FROM c)
SELECT *, round(coalesce(fp / nullif(fp + tn, 0), 0.0), 9) AS fp_rate, round(coalesce(fn / nullif(fn + tp, 0), 0.0), 9) AS fn_rate FROM k""")
def verifier_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return ev.confusion(rows, F.col("quality") == 1, F.col("n_chars") > 1000)


@query("""WITH r AS (SELECT lang AS lane, n_chars // 4 AS tokens, CAST(doc_id % 100 AS BIGINT) AS nll FROM documents) SELECT lane, CAST(sum(tokens) AS BIGINT) AS tokens, round(CAST(sum(tokens * nll) AS BIGINT) / CAST(sum(tokens) AS BIGINT), 6) AS mean_nll FROM r GROUP BY ROLLUP (lane)""")
def lane_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("lane"), F.floor(F.col("n_chars") / 4).alias("tokens"), (F.col("doc_id") % 100).alias("nll"))
    return ev.weighted_loss(rows)


@query("""WITH r AS (SELECT 's' || row_number() OVER (ORDER BY source) AS id, 's' || (row_number() OVER (ORDER BY source) - 1) AS delta_vs, round(avg(n_chars), 6) AS rate FROM documents GROUP BY source)
SELECT a.id, a.delta_vs, a.rate, round(a.rate - b.rate, 6) AS delta FROM r a LEFT JOIN r b ON b.id = a.delta_vs""")
def ladder_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    by_source = table(spark, sf_dir, "documents").groupBy("source").agg(F.round(F.avg("n_chars"), 6).alias("rate"))
    n = F.row_number().over(Window.orderBy("source"))
    rungs = by_source.select(F.concat(F.lit("s"), n.cast("string")).alias("id"), F.concat(F.lit("s"), (n - 1).cast("string")).alias("delta_vs"), "rate")
    return ev.prior_deltas(rungs)


@query("""SELECT doc_id AS unit_id, min(doc_id) OVER (PARTITION BY sha256(text), lang) AS source_unit, doc_id <> min(doc_id) OVER (PARTITION BY sha256(text), lang) AS cache_hit FROM documents""")
def deduplicated_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit_id"), F.sha2("text", 256).alias("kernel_sha"), "lang")
    return ev.fan_out(work, ("kernel_sha", "lang"))


_VERDICTS = f"""{_CELLS}, v AS (SELECT model_id, l_orderkey, l_linenumber, CASE WHEN l_partkey % 4 = 0 THEN 'baseline' ELSE 'spec' END AS context, l_suppkey % 8 <> 0 AS compiled, reward = 1 AS correct, CASE WHEN l_partkey % 6 <> 0 THEN l_discount * 10 + 0.1 END AS similarity, l_orderkey % 13 = 0 AS verbatim,
  q % 9 <> 0 AS authentic, CASE WHEN q % 9 = 0 THEN ['PALLAS_CALL_MISSING', 'PALLAS_RESULT_UNUSED'] ELSE [] END AS inspection, CASE WHEN l_partkey % 10 <> 0 THEN l_tax < 0.07 END AS stable, CASE l_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS lowering, speedup FROM cells),
w AS (SELECT *, context = 'spec' AS scorable, context = 'baseline' AND (verbatim OR coalesce(similarity >= 0.9, false)) AS copied FROM v),
x AS (SELECT *, scorable AND correct AND NOT copied AS credited, scorable AND correct AND NOT copied AND compiled AND authentic AND coalesce(lowering, false) AS kernel_credited,
  list_filter(list_concat([CASE WHEN NOT scorable THEN 'DIAGNOSTIC_PROMPT_CONTEXT' END, CASE WHEN NOT compiled THEN 'TPU_COMPILE_FAILED' END, CASE WHEN NOT correct THEN 'CORRECTNESS_FAILED' END, CASE WHEN copied THEN 'REFERENCE_COPY' END], inspection,
    [CASE WHEN NOT stable THEN 'TIMING_UNSTABLE' END, CASE WHEN compiled AND correct AND authentic AND lowering IS DISTINCT FROM true THEN CASE WHEN lowering IS NULL THEN 'LOWERING_EVIDENCE_MISSING' ELSE 'LOWERING_EVIDENCE_FAILED' END END]), lambda r: r IS NOT NULL) AS why FROM w)"""


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with all evidence that a verdict asks for, some of it unknown."""
    part, supp, false = F.col("l_partkey"), F.col("l_suppkey"), F.col("q") % 9 == 0
    rows = _cells(spark, sf_dir).select(
        "model_id", "l_orderkey", "l_linenumber", F.when(part % 4 == 0, F.lit("baseline")).otherwise(F.lit("spec")).alias("context"), (supp % 8 != 0).alias("compiled"), (F.col("reward") == 1).alias("correct"),
        F.when(part % 6 != 0, F.col("l_discount") * 10 + 0.1).alias("similarity"), (F.col("l_orderkey") % 13 == 0).alias("verbatim"), (~false).alias("authentic"),
        F.when(false, F.array(F.lit("PALLAS_CALL_MISSING"), F.lit("PALLAS_RESULT_UNUSED"))).otherwise(F.array().cast("array<string>")).alias("inspection"),
        F.when(part % 10 != 0, F.col("l_tax") < 0.07).alias("stable"), F.when(supp % 3 == 0, F.lit(True)).when(supp % 3 == 1, F.lit(False)).alias("lowering"), "speedup",
    )
    return ev.verdict_lattice(rows, need_lowering=True)


@query(f"""WITH {_VERDICTS} SELECT l_orderkey, l_linenumber, array_to_string(why, '|') AS no_credit_reasons, scorable, copied, credited, kernel_credited, kernel_credited AND coalesce(stable, false) AND coalesce(speedup >= 1.05, false) AS headline FROM x""")
def credit_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).select("l_orderkey", "l_linenumber", F.array_join("no_credit_reasons", "|").alias("no_credit_reasons"), "scorable", "copied", "credited", "kernel_credited", "headline")


@query(f"""WITH {_VERDICTS} SELECT model_id, count(*) AS n, count(*) FILTER (copied) AS copied, count(*) FILTER (credited) AS credited, round(max(CASE WHEN kernel_credited AND stable THEN speedup END), 6) AS best_stable_speedup FROM x GROUP BY model_id""")
def verdict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("copied").alias("copied"), F.count_if("credited").alias("credited"), F.round(F.max(F.when(F.col("kernel_credited") & F.col("stable"), F.col("speedup"))), 6).alias("best_stable_speedup"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity * 1e9 AS flops, l_extendedprice * 1e6 AS bytes, l_extendedprice AS measured_us FROM lineitem)
SELECT l_orderkey, l_linenumber, round(greatest(flops / 1e14, bytes / 8e11) * 1e6, 6) AS floor_us, CASE WHEN flops / 1e14 >= bytes / 8e11 THEN 'compute' ELSE 'memory' END AS bound, round(greatest(flops / 1e14, bytes / 8e11) * 1e6 / measured_us, 9) AS efficiency FROM r""")
def roofline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 1e9).alias("flops"), (F.col("l_extendedprice") * 1e6).alias("bytes"), F.col("l_extendedprice").alias("measured_us"))
    return ev.roofline(rows, 1e14, 8e11).select("l_orderkey", "l_linenumber", "floor_us", "bound", "efficiency")


_STDERR = ("", "Aborted (core dumped)", "runner configuration missing", "Check failed: x", "Core halted unexpectedly during dma.hbm_to_vmem", "DEVICE HALTED", "index out of bounds")
_CODES = (2, 134, 139, -9, 1, 124, 137)


@query(f"""WITH e AS (SELECT event_id, {list(_STDERR)}[1 + event_id % 7] AS stderr, {list(_CODES)}[1 + user_id % 7] AS code, event_id % 17 = 0 AS timed_out, {list(_STDERR)}[1 + user_id % 5] AS error FROM events),
c AS (SELECT *, timed_out OR code < 0 OR code IN (124, 134, 137, 139) OR regexp_matches(lower(stderr), 'aborted|check failed|dma|out of bounds|segmentation fault|sigabrt') AS candidate FROM e)
SELECT event_id, false AS passed, CASE WHEN candidate THEN 'runtime_safety' ELSE 'infrastructure' END AS stage, CASE WHEN timed_out THEN 'CANDIDATE_PROCESS_TIMEOUT' WHEN candidate THEN 'CANDIDATE_PROCESS_EXIT_' || code ELSE 'VERIFIER_PROCESS_EXIT_' || code END AS error, NOT candidate AS infrastructure_error, candidate AS worker_recovery_required,
  CASE WHEN candidate THEN 'artifact_contract,pallas_api,tpu_compile' END AS stages_passed, code < 0 OR code IN (134, 137, 139) OR regexp_matches(lower(stderr || chr(10) || error), 'core halted|device halted|dma[.]hbm_to_vmem|dma[.]vmem_to_hbm|sigabrt|segmentation fault') AS unsafe FROM c""")
def process_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, key, n: F.element_at(F.array(*map(F.lit, values)), (F.col(key) % n + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", pick(_STDERR, "event_id", 7).alias("stderr"), pick(_CODES, "user_id", 7).alias("code"), (F.col("event_id") % 17 == 0).alias("timed_out"), pick(_STDERR, "user_id", 5).alias("said"))
    told = rows.select("event_id", ev.process_failure(F.col("code"), F.col("stderr"), F.col("timed_out")).alias("f"), ev.needs_recovery(F.col("code"), F.col("stderr"), F.col("said")).alias("unsafe"))
    passed = F.array_join(F.array_sort(F.map_keys(F.map_filter("f.stages", lambda _, ok: ok))), ",").alias("stages_passed")
    return told.select("event_id", "f.passed", "f.stage", "f.error", "f.infrastructure_error", "f.worker_recovery_required", passed, "unsafe")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_returnflag <> 'R' AS profile, l_linestatus = 'O' AS correctness, l_orderkey % 7 = 0 AS infra, CASE WHEN l_quantity > 45 THEN CAST('nan' AS DOUBLE) ELSE l_quantity / 10 END AS speedup FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN infra THEN -1 WHEN profile AND correctness THEN 1 ELSE 0 END AS reward, round(CASE WHEN infra THEN -1.0 WHEN profile AND correctness AND NOT isnan(speedup) THEN 0.3 + speedup ELSE 0.0 END, 9) AS score,
  round(CASE WHEN NOT correctness THEN 0.0 WHEN isnan(speedup) OR speedup < 1 THEN 0.3 ELSE 0.6 + 0.4 * least(speedup - 1, 1.0) END, 9) AS clipped FROM s""")
def verified_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    profile, correct, infra = F.col("l_returnflag") != "R", F.col("l_linestatus") == "O", F.col("l_orderkey") % 7 == 0
    speedup = F.when(F.col("l_quantity") > 45, F.lit(float("nan"))).otherwise(F.col("l_quantity") / 10)
    stages = F.create_map(F.lit("source"), F.lit(True), F.lit("compile"), F.lit(True), F.lit("correctness"), correct, F.lit("profile"), profile)
    usable = F.nanvl(speedup, F.lit(0.0))
    return items.select("l_orderkey", "l_linenumber", ev.tri_state(stages, infra).alias("reward"), F.round(ev.verified_score(F.lit(True), stages, infra, speedup), 9).alias("score"), F.round(ev.clipped_reward(correct, usable >= 1, usable), 9).alias("clipped"))


@query(f"""WITH {_CELLS}, k AS (SELECT DISTINCT model_id, task_id FROM cells WHERE NOT (model_id = 'm1' AND task_id IN ('t3', 't5'))) SELECT task_id, count(*) AS n FROM k GROUP BY task_id HAVING count(*) < (SELECT count(DISTINCT model_id) FROM k)""")
def unequal_task_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.unequal_task_sets(_cells(spark, sf_dir).where("NOT (model_id = 'm1' AND task_id IN ('t3', 't5'))"))


@query(f"""WITH {_CELLS}, m AS (SELECT DISTINCT model_id FROM cells), t AS (SELECT DISTINCT 'p' || l_partkey AS task_id FROM lineitem), s AS (SELECT DISTINCT seed FROM cells)
SELECT model_id, task_id, CAST(seed AS BIGINT) AS seed, 1000 + CAST(seed AS BIGINT) * 7 AS retry_seed FROM m, t, s""")
def planned_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every task of the table with every model and seed that occurs there; models and seeds are few."""
    items, cells = table(spark, sf_dir, "lineitem"), _cells(spark, sf_dir)
    tasks = items.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("task_id")).distinct()
    planned = ev.planned(tasks, cells.select("model_id").distinct(), cells.select(F.col("seed").cast("long").alias("seed")).distinct())
    return planned.select("model_id", "task_id", "seed", (1000 + F.col("seed") * 7).alias("retry_seed"))


@query("""SELECT event_type AS name, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, name LIMIT 100""")
def event_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(100)


@query("""WITH e AS (SELECT user_id % 20 AS step, CAST(floor(value) AS BIGINT) AS v, event_type FROM events) SELECT step, count(*) AS n, round(avg(v), 6) AS mean_value, max(v) AS most, min(v) AS least, count(*) FILTER (event_type = 'purchase') AS n_verified FROM e GROUP BY step""")
def step_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("step"), F.floor("value").alias("v"), "event_type")
    return rows.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean_value"), F.max("v").alias("most"), F.min("v").alias("least"), F.count_if(F.col("event_type") == "purchase").alias("n_verified"))


@query("""WITH b AS (SELECT lang, avg(n_chars) AS v FROM documents WHERE doc_id % 2 = 0 GROUP BY lang), a AS (SELECT lang, avg(n_chars) AS v FROM documents WHERE doc_id % 2 = 1 GROUP BY lang)
SELECT lang, round(a.v - b.v, 6) AS delta, round((a.v - b.v) / b.v * 100, 6) AS percent FROM a JOIN b USING (lang)""")
def before_and_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mean = lambda r: F.avg(F.when(F.col("doc_id") % 2 == r, F.col("n_chars")))
    both = docs.groupBy("lang").agg(mean(0).alias("b"), mean(1).alias("a")).where("a IS NOT NULL AND b IS NOT NULL")
    return both.select("lang", F.round(F.col("a") - F.col("b"), 6).alias("delta"), F.round((F.col("a") - F.col("b")) / F.col("b") * 100, 6).alias("percent"))
