"""Operators that cut hot groups, against plain versions on small cuts."""

import json
import random
import statistics
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import admission, conversations, dedup, discovery, evaluation, governance, joins, packing, selection, similarity, table_functions, tiles
from corpusloom.sources import archives, artifacts
from corpusloom.streaming import enrich


def near_texts(n, seed=1):
    rng, base = random.Random(seed), [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(60)] = f"v{rng.randrange(30)}"
        rows.append((i, rng.choice("op"), " ".join(words) if rng.random() < 0.9 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))))
    return rows


def sets_of(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


@pytest.mark.parametrize("block,dense", [(2048, 0.25), (7, 0.25), (7, 1e9), (40, 0.0)])
def test_clusters_equal_all_pairs(spark, block, dense, monkeypatch):
    """Most similar earlier row, first forbidden row and all links, whatever the blocks and whichever way pairs are compared."""
    monkeypatch.setattr(similarity, "BLOCK_CLASSES", block)
    monkeypatch.setattr(similarity, "_DENSE", dense)
    rows = near_texts(90)
    df = spark.createDataFrame(rows, "doc_id int, lang string, text string")
    shingles = [sets_of(r[2]) for r in rows]
    share = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    got = {r.doc_id: (r.near_of, round(r.similarity, 9)) for r in dedup.nearest_earlier(df, "doc_id", "lang").collect()}
    for j, (_, lang, _) in enumerate(rows):
        found = [(share(shingles[i], shingles[j]), -i) for i in range(j) if rows[i][1] == lang]
        best = max(found, default=(0.0, 0))
        assert got.get(j) == ((-best[1], round(best[0], 9)) if best[0] >= 0.8 else None)
    held = near_texts(25, 2)
    sealed = spark.createDataFrame([(100 + i, t) for i, _, t in held], "item_id int, text string")
    first = {r.doc_id: (r.document, r.exact, round(r.similarity, 9)) for r in dedup.first_forbidden(df, "doc_id", sealed, "item_id").collect()}
    for j, (_, _, text) in enumerate(rows):
        near = [(100 + i, text == t, share(sets_of(t), shingles[j])) for i, _, t in held if text == t or share(sets_of(t), shingles[j]) >= 0.8]
        want = min(near, default=None)
        assert first.get(j) == (None if want is None else (want[0], want[1], round(1.0 if want[1] else want[2], 9)))
    texts = sorted({r[2]: s for r, s in zip(rows, shingles, strict=True)}.items())
    pairs = sum(share(a, b) >= 0.8 for i, (_, a) in enumerate(texts) for _, b in texts[:i])
    assert similarity.class_links(similarity.shingle_sets(df, "doc_id")).count() == pairs > 50


def test_hot_texts_have_their_first_row(spark):
    rows = [(i, "o" if i % 3 else None, "same" if i % 2 else f"t{i % 40}") for i in range(3000)]
    got = {r.doc_id: r.exact_of for r in dedup.exact_and_normalized(spark.createDataFrame(rows, "doc_id int, lang string, text string"), "doc_id", "lang").collect()}
    first = {}
    for i, lang, text in rows:
        first.setdefault((lang, text), i)
    assert got == {i: (None if first[lang, text] == i else first[lang, text]) for i, lang, text in rows}
    left, right = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int"), spark.createDataFrame([(1, 2, "a")], "k int, n long, v string")
    assert sorted((r.k or 0, r.v or "") for r in joins.hub_join(left, right, "k", "n", 4, "left").collect()) == [(0, ""), (1, "a"), (1, "a"), (2, "")]


def plain_turns(rows):
    by_conv = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        by_conv.setdefault(conv, []).append((turn, role, text))
    return by_conv


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_scans_in_ranges(spark, size):
    """Ranges of any size give what one scan over the whole conversation gives."""
    rng = random.Random(size)
    rows = [(c, 2 * t, rng.choice(["user", "user", "assistant", "tool", None]), None if rng.random() < 0.05 else f"m{c}.{t}" * rng.randint(0, 3)) for c in range(12) for t in range(rng.randint(1, 40))]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(3)
    runs, newest, upto, singles = set(), set(), set(), set()
    for conv, turns in plain_turns(rows).items():
        groups = []
        for turn, role, text in turns:
            if groups and role in ("user", "assistant") and groups[-1][1] == role:
                groups[-1][2].append(text)
            else:
                groups.append([turn, role, [text]])
        runs |= {(conv, t, r, len(x), "\n\n".join(y for y in x if y is not None)) for t, r, x in groups}
        used = 0
        for turn, role, text in reversed(turns):
            if text is not None and used < 20:
                newest.add((conv, turn, role, text[-(20 - used) :] if len(text) > 20 - used else text))
            used += len(text or "")
        user = None
        for k, (turn, role, text) in enumerate(turns):
            upto.add((conv, turn, ">".join(r for _, r, _ in turns[: k + 1] if r is not None), sum(len(x or "") for _, _, x in turns[: k + 1])))
            if role == "assistant":
                singles.add((conv, turn, "Continue." if user is None else user, text))
            if role == "user" and text is not None:
                user = text
    assert {tuple(r) for r in conversations.collapse_runs(df, size=size).select("conv_id", "turn", "role", "n_merged", "text").collect()} == runs
    assert {tuple(r) for r in conversations.newest_within(df, 20, size).select("conv_id", "turn", "role", "text").collect() if r.text is not None} == newest
    got = {tuple(r) for r in conversations.prefixes(df, size).collect()}
    assert {(c, t, r, n or 0) for c, t, r, n in got} == upto
    assert {tuple(r) for r in conversations.single_turns(df, size=size).select("conv_id", "turn", "user", "assistant").collect()} == singles
    table_functions.register(spark)
    by_sql = spark.sql("SELECT conv_id, turn, user, assistant FROM flatten_turns(TABLE({df}))", df=df)
    assert {tuple(r) for r in by_sql.collect()} == singles


def test_table_functions_refuse_other_tables(spark):
    table_functions.register(spark)
    with pytest.raises(Exception, match="no column turn"):
        spark.sql("SELECT * FROM flatten_turns(TABLE(SELECT 1 AS conv_id, 'user' AS role, 'x' AS text))").collect()
    with pytest.raises(Exception, match="at least 1"):
        spark.sql("SELECT * FROM pack_rows(TABLE(SELECT 1 AS grp, 1 AS key, 5 AS size), 0)").collect()
    rows = spark.sql("SELECT * FROM pack_rows(TABLE(SELECT 1 AS grp, id AS key, CAST(id * 3 AS INT) AS size FROM range(5)), 4)").collect()
    assert sorted((r.key, r["pack"], r.offset, r.tokens) for r in rows) == [(1, 0, 0, 3), (2, 0, 3, 1), (2, 1, 0, 4), (2, 2, 0, 1), (3, 2, 1, 3), (3, 3, 0, 4), (3, 4, 0, 2), (4, 4, 2, 2), (4, 5, 0, 4), (4, 6, 0, 4), (4, 7, 0, 2)]


@pytest.mark.parametrize("most", [5, 1_000_000])
def test_medians_of_hot_keys(spark, most):
    """Selected medians equal sorted ones: ties, odd and even counts, nulls, infinities, null keys, few and many rows."""
    rng = random.Random(most)
    rows = [("hot", rng.gauss(0, 1) ** 9, float(rng.randint(0, 3))) for _ in range(3001)] + [(None, rng.choice([1.0, 2.0, float("inf")]), None) for _ in range(2000)]
    rows += [("few", None, 3.0), ("few", 4.0, 4.0), ("none", None, None)] + [("same", 7.0, float(i)) for i in range(1500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, a double, b double").repartition(5)
    got = {r.k: (r.x, r.y) for r in selection.medians(df, ["k"], many=1000, accuracy=200, most=most, x=F.col("a"), y=F.col("b")).collect()}
    for key in ("hot", None, "few", "none", "same"):
        own = [[v for k, *v2 in rows if k == key for v in [v2[c]] if v is not None] for c in (0, 1)]
        assert got[key] == tuple(statistics.median(x) if x else None for x in own)
    assert selection.medians(df.limit(0), ["k"], x=F.col("a")).count() == 0


def test_tiles_multiply_any_shape(spark):
    rng = random.Random(0)
    a = [[rng.randint(-3, 3) for _ in range(13)] for _ in range(9)]
    b = [[rng.randint(-3, 3) for _ in range(5)] for _ in range(13)]
    long = lambda m: spark.createDataFrame([(i, k, float(v)) for i, row in enumerate(m) for k, v in enumerate(row)], "i long, k long, value double").repartition(4)
    want = {(i, j): float(sum(a[i][k] * b[k][j] for k in range(13))) for i in range(9) for j in range(5)}
    for size in (2, 4, 256):
        got = {(r.i, r.j): r.value for r in tiles.matmul(long(a), long(b), size=size).collect()}
        assert {k: v for k, v in want.items() if v} == {k: v for k, v in got.items() if v}
    assert tiles.matmul(long(a).limit(0), long(b)).count() == 0


def test_running_offsets_in_few_and_many_ranges(spark, monkeypatch):
    df = spark.createDataFrame([("g" if i % 3 else "h", i, i % 5) for i in range(200)], "g string, id int, n int")
    whole = {(r.g, r.id): (r.start, r.total) for r in packing.running_offsets(df, ["g"], "n", "id").collect()}
    monkeypatch.setattr(packing, "RANGE_ROWS", 7)
    assert {(r.g, r.id): (r.start, r.total) for r in packing.running_offsets(df, ["g"], "n", "id").collect()} == whole and len(whole) == 200


def test_members_are_read_in_runs(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(40):
            z.writestr(f"d/{i:02d}.md", f"text {i} " * 50)
        z.writestr("d/", "")
        z.writestr("other.txt", "x")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("é.md", b"\xff\xfe")
    found = archives.zip_members(spark, str(tmp_path), "*.md", splitBytes=100, batchBytes=500)
    assert found.rdd.getNumPartitions() > 5
    assert sorted((r.member, bytes(r.content)) for r in found.collect()) == sorted([(f"d/{i:02d}.md", (f"text {i} " * 50).encode()) for i in range(40)] + [("é.md", b"\xff\xfe")])
    assert archives.zip_members(spark, str(tmp_path / "a.zip"), "*.txt").count() == 1 and archives.zip_members(spark, str(tmp_path), "*.none").count() == 0


def test_artifacts_are_visible_by_manifest_only(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(20).select("id", F.when(F.col("id") % 2 == 0, F.lit("é")).alias("b"), F.array_compact(F.array(F.lit("all"), F.when(F.col("id") % 5 == 0, F.lit("fives")))).alias("artifact")).repartition(3)
    made = artifacts.write_artifacts(rows, path, note="first")
    assert made["version"] == 1 and made["rows"] == {"all": 20, "fives": 4} and made["note"] == "first"
    assert sorted((r.id, r.b) for r in artifacts.read_artifact(spark, path, "fives", "id long, b string").collect()) == [(0, "é"), (5, None), (10, "é"), (15, None)]
    line = next((tmp_path / "out" / "data" / "all").iterdir()).read_text().splitlines()[0]
    assert list(json.loads(line)) == ["b", "id"]

    @F.udf("long")
    def breaks(x):
        if x == 19:
            raise ValueError("killed")
        return x

    with pytest.raises(Exception, match="killed"):
        artifacts.write_artifacts(rows.withColumn("id", breaks("id")), path)
    (tmp_path / "out" / "data" / "all" / "left-by-a-killed-task.jsonl").write_text('{"id": 99}\n')
    assert artifacts.read_artifact(spark, path, "all", "id long").count() == 20
    artifacts.write_artifacts(rows.limit(3), path)
    assert artifacts.read_artifact(spark, path, "all", "id long").count() == 23 and len(artifacts.manifests(path)) == 2
    artifacts.write_artifacts(spark.createDataFrame([(1, "all"), (2, None)], "id long, artifact string"), path, "overwrite")
    assert artifacts.read_artifact(spark, path, "all", "id long").count() == 1 and artifacts.read_artifact(spark, path, "fives", "id long").count() == 0


def test_first_writer_stays_over_runs(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda: enrich.register_first(spark, source, "k string, n int, v string", sink, str(tmp_path / "ck"), "k", "n").awaitTermination()
    batches = [[("a", 2, "late"), ("a", 1, "early"), ("b", 5, "b")], [("a", 0, "later run"), ("c", 1, "c")], [("c", 0, "no"), ("b", 1, "no"), ("d", 9, "d")]]
    for rows in batches:
        spark.createDataFrame(rows, "k string, n int, v string").coalesce(1).write.mode("append").parquet(source)
        run()
    run()
    assert sorted(tuple(r) for r in spark.read.parquet(sink).collect()) == [("a", 1, "early"), ("b", 5, "b"), ("c", 1, "c"), ("d", 9, "d")]


def test_process_failures(spark):
    rows = [(134, "Aborted", False, ""), (124, "", True, ""), (2, "runner configuration missing", False, ""), (2, "", False, "Accelerator device halted during dma.hbm_to_vmem"), (2, "", False, "values differ"), (-6, None, None, None), (0, "Core halted", False, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, code int, stderr string, out boolean, error string")
    got = df.select("i", evaluation.process_failure(F.col("code"), F.col("stderr"), F.col("out")).alias("f"), evaluation.needs_recovery(F.col("code"), F.col("stderr"), F.col("error")).alias("unsafe")).orderBy("i").collect()
    assert [(r.f.stage, r.f.error, r.f.infrastructure_error, r.f.worker_recovery_required) for r in got[:3]] == [("runtime_safety", "CANDIDATE_PROCESS_EXIT_134", False, True), ("runtime_safety", "CANDIDATE_PROCESS_TIMEOUT", False, True), ("infrastructure", "VERIFIER_PROCESS_EXIT_2", True, False)]
    assert [r.unsafe for r in got] == [True, False, False, True, False, True, True]
    assert got[0].f.stages["tpu_compile"] and not got[0].f.stages["profile"] and got[2].f.stages is None and got[5].f.stage == "runtime_safety"


def verdict(spark, need=False, **changes):
    facts = {"context": "spec", "compiled": True, "correct": True, "similarity": 0.1, "verbatim": False, "authentic": True, "inspection": [], "stable": True, "lowering": None, "speedup": 1.2} | changes
    schema = "context string, compiled boolean, correct boolean, similarity double, verbatim boolean, authentic boolean, inspection array<string>, stable boolean, lowering boolean, speedup double"
    return evaluation.verdict_lattice(spark.createDataFrame([tuple(facts.values())], schema), need_lowering=need).first()


def test_verdicts(spark):
    r = verdict(spark)
    assert r.credited and r.kernel_credited and r.headline and r.no_credit_reasons == []
    r = verdict(spark, need=True)
    assert r.credited and not r.kernel_credited and not r.headline and r.no_credit_reasons == ["LOWERING_EVIDENCE_MISSING"]
    assert verdict(spark, need=True, lowering=True).headline and verdict(spark, need=True, lowering=False).no_credit_reasons == ["LOWERING_EVIDENCE_FAILED"]
    r = verdict(spark, stable=False)
    assert r.kernel_credited and not r.headline and r.no_credit_reasons == ["TIMING_UNSTABLE"]
    r = verdict(spark, correct=False, speedup=5.0)
    assert not r.credited and not r.headline and r.no_credit_reasons == ["CORRECTNESS_FAILED"]
    r = verdict(spark, context="baseline", verbatim=True, similarity=None)
    assert r.copied and not r.scorable and r.no_credit_reasons == ["DIAGNOSTIC_PROMPT_CONTEXT", "REFERENCE_COPY"]
    r = verdict(spark, similarity=0.99, authentic=False, inspection=["A", "B", "A"], compiled=False, stable=None)
    assert not r.copied and r.credited and not r.kernel_credited and r.no_credit_reasons == ["TPU_COMPILE_FAILED", "A", "B"]


def test_model_summary_and_curve(spark):
    cells = spark.createDataFrame([("m", 1, 1.1, None, "activation", False), ("m", 0, None, "runtime_safety", "matmul", True), ("m", -1, None, None, "matmul", None), ("n", 0, 3.0, "a", "b", False)], "model_id string, reward int, speedup double, stage string, family string, worker_recovery_required boolean")
    got = {r.model_id: r for r in evaluation.model_summary(cells).collect()}
    m = got["m"]
    assert (m.n, m.n_verified, m.median_speedup, m.n_faster, m.n_headroom, m.n_halts) == (3, 1, 1.1, 1, 1, 1)
    assert m.failure_stages == {"runtime_safety": 1, "unknown": 1} and m.failure_families == {"matmul": 2} and got["n"].median_speedup is None
    assert [tuple(r) for r in evaluation.verified_speedups(cells).collect()] == [("m", 1, 1.1)]
    curve = spark.createDataFrame([(8, 0.1), (8, 0.3), (16, 0.5), (32, 0.4)], "n_train int, score double")
    rows = evaluation.learning_curve(curve).orderBy("n_train").collect()
    assert [r.slope for r in rows] == [0.1] * 3 and not any(r.monotonic for r in rows) and [r.rising for r in rows] == [True, True, False]
    assert evaluation.learning_curve(curve.where("n_train = 8")).first().slope is None


def test_record_audit(spark):
    record = {"messages": [{"role": "user", "content": "fix it"}, {"role": "assistant", "content": "done now", "tool_calls": [{}]}], "outcome": "success", "license": "MIT", "recovery": True}
    swapped = dict(reversed(record.items()))
    others = [{"messages": [], "conversation": [{"role": "assistant", "content": [{"text": "a b"}, {"x": 1}]}], "label": "ok", "license_tag": "Apache"}, {"complete": True, "outcome": "", "tools": [], "is_recovery": 0}, {"messages": [{"role": "function"}, 5], "outcome": True}]
    lines = [json.dumps(record), json.dumps(swapped, indent=1).replace("\n", " "), *map(json.dumps, others), "", "  ", "[1]", "{broken"]
    r = conversations.audit_records(spark.createDataFrame([(x,) for x in lines], "value string")).first()
    assert (r.n_records, r.complete_trajectories, r.with_tool_use, r.assistant_messages, r.duplicate_hashes, r.recovery_segments) == (7, 3, 3, 3, 1, 2)
    assert r.outcome_counts == {"success": 2, "ok": 1, "unknown": 1, "True": 1} and r.license_tags == {"MIT": 2, "Apache": 1}
    assert r.missing_fields == {"json": 1, "non_object": 1, "complete": 2, "license": 2} and r.approx_assistant_tokens == 2 + 2 + 2 + len('{"x":1}'.split())


def test_readiness_gate_and_sources(spark):
    rows = spark.createDataFrame([("s1", "f1"), ("s1", "f2"), ("s2", "f1"), (None, "f1")], "source string, lang string")
    policy = admission.Policy(2, 2, 2, 1, 0.9, 0.9)
    r = admission.readiness(rows, "source", "lang", policy).first()
    assert r.authorized and r.family_counts == {"f1": 3, "f2": 1} and r.source_counts == {"s1": 2, "s2": 1} and r.holdout_contamination == 0
    r = admission.readiness(rows, "source", "lang", policy, rows.limit(1)).first()
    assert not r.authorized and r.reasons == "HOLDOUT_CONTAMINATION_PRESENT"
    assert not admission.readiness(rows.limit(0), "source", "lang", policy).first().authorized
    schema = "slice string, provider string, source_found boolean, manifest_found boolean, rights_cleared boolean, secrets_scrubbed boolean, scrub_hits long, canaries_lost array<string>"
    slices = spark.createDataFrame([("a", "p", True, True, True, True, 0, []), ("b", "p", False, False, True, True, 0, []), ("c", "p", True, False, True, True, 0, []), ("d", "q", True, True, True, False, 2, ["c1"])], schema)
    providers = spark.createDataFrame([("p", True, True), ("q", True, False)], "provider string, upload_approved boolean, retention_reviewed boolean")
    ledger = spark.createDataFrame([("p", 1.0)], "provider string, usd_remaining double")
    got = {r.slice: r.reasons for r in governance.upload_gate(slices, providers, ledger).collect()}
    assert got == {"a": [], "b": ["SOURCE_MISSING"], "c": ["RIGHTS_MANIFEST_MISSING"], "d": ["PROVIDER_NOT_APPROVED", "SLICE_NOT_CLEARED", "SPEND_LEDGER_MISSING", "SCRUB_HITS_PRESENT", "CANARY_EMBED_FAILED:c1"]}
    sources = spark.createDataFrame([("a/kernelbench-traces", {"main": 3, "trace": 1}, 4, ["x"], ["R"], ["s2", "s1"]), ("a/b", {"other": 5, "trace": 1}, 6, ["Evaluation"], [], ["s3"]), ("a/c", {"other": 5}, 5, None, [], []), ("a/d", {"trace": 9}, 9, None, ["R"], [])], "name string, scores map<string,bigint>, score long, tags array<string>, risk_flags array<string>, signals array<string>")
    got = {r.name[2:]: r for r in discovery.classify(sources, "main", ("other",), 3).collect()}
    assert got["kernelbench-traces"].training_policy == "forbidden" and got["kernelbench-traces"].objectives == ["dapt_candidate", "repair_candidate"] and got["kernelbench-traces"].risk_flags == ["BENCHMARK_CONTAMINATION", "R"]
    assert (got["b"].category, got["b"].source_role, got["b"].status) == ("agent_trace", "benchmark_or_evaluation", "candidate") and got["kernelbench-traces"].decision_reasons == ["s1", "s2"]
    assert got["c"].objectives == ["dapt_candidate"] and got["c"].training_policy == "discovery_only" and (got["d"].status, got["d"].objectives, got["d"].risk_flags) == ("rejected", [], ["R"])


def test_rows_that_need_verification(spark):
    df = spark.createDataFrame([(1, "sft", "some words that stand alone here"), (2, "dapt", "other words that nobody has written"), (3, "sft", "some words that stand alone here")], "doc_id int, lang string, text string")
    held = spark.createDataFrame([(9, "nothing of the kind")], "item_id int, text string")
    got = {r.doc_id: (r.status, r.reasons) for r in dedup.corpus_policy(df, "doc_id", "lang", held, "item_id").collect()}
    assert got[1] == ("verification_required", []) and got[2] == ("eligible", []) and got[3][0] == "rejected" and got[3][1][0] == "EXACT_DUPLICATE:1"
