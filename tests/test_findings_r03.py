"""Cases of the third round's findings."""

from __future__ import annotations

import difflib
import glob
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom import staging
from corpusloom.functions import code
from corpusloom.operators import admission, dedup, evaluation, similarity
from corpusloom.sources import artifacts

WORDS = [f"w{k}" for k in range(40)]


def _texts(n: int) -> list[tuple[int, str]]:
    rows = []
    for k in range(n):
        words = [WORDS[(k // 3 * 7 + i * i) % 40] for i in range(20 + k % 5)]
        if k % 3:
            words[k % 20] = f"x{k % 4}"
        rows.append((k, " ".join(words)))
    return [*rows, (n, ""), (n + 1, None), (n + 2, "one two"), (n + 3, "one two")]


@pytest.mark.parametrize("two", [False, True])
def test_shingles_meet_in_lists(spark, monkeypatch, two):
    """As many lists travel as there are buckets and tasks, not a row for each shingle, and nodes are those of plain counting."""
    monkeypatch.setattr(similarity, "BUCKET_SHINGLES", 400)
    monkeypatch.setattr(similarity, "DEALT_SHINGLES", 300)
    sets = similarity.shingle_sets(spark.createDataFrame(_texts(90), "doc_id long, text string"), "doc_id")
    left, right = (sets.classes.where("cid % 2 = 0"), sets.classes.where("cid % 2 = 1")) if two else (sets.classes, None)
    held = [{r.cid: (r.n, r.shingles) for r in x.collect()} for x in ((left, right) if two else (left,))]
    counts = [Counter(s for _, found in side.values() for s in found) for side in held]
    total = sum(counts, Counter())
    shared = set(counts[0]) & set(counts[1]) if two else {s for s, n in total.items() if n > 1}
    want = {}
    for k, side in enumerate(held):
        for cid, (n, found) in side.items():
            codes = sorted((s for s in found if s in shared), key=lambda s: (total[s], s))
            if codes and len(codes) - math.ceil(0.8 * n - 1e-9) + 1 > 0:
                want[bool(k), cid] = (n, codes, len(codes) - math.ceil(0.8 * n - 1e-9) + 1)
    got = similarity._nodes(left, right, 0.8)
    assert {(r.right, r.cid): (r.n, r.codes, r.prefix) for r in got.collect()} == want and want
    assert "Generate" not in got._jdf.queryExecution().toString()
    assert sets.rows.where("not some").count() == 2 and sets.classes.count() < sets.rows.count()


def test_two_large_sides_give_the_links_of_small_ones(spark, monkeypatch):
    """A right of many shingles is not sifted by; blocks that can't reach the threshold don't meet."""
    rows = [(k, " ".join([*(f"v{(k // 6 * 31 + i * (k // 6 + 3)) % 97}" for i in range(60 - k % 2)), f"x{k}"])) for k in range(60)]
    sets = [similarity.shingle_sets(spark.createDataFrame([r for r in rows if r[0] % 6 % 4 // 2 == k], "doc_id long, text string"), "doc_id") for k in (0, 1)]
    texts = [{r.cls: set(r.shingles) for r in x.classes.where("n > 0").collect()} for x in sets]
    want = {(a, b) for a, x in texts[0].items() for b, y in texts[1].items() if len(x & y) / len(x | y) >= 0.8}
    for few in (250_000, 0):
        monkeypatch.setattr(similarity, "FEW_SHINGLES", few)
        for classes in (2048, 4):
            monkeypatch.setattr(similarity, "BLOCK_CLASSES", classes)
            got = [(r.a, r.b) for r in similarity.class_links(*sets).select("a", "b").collect()]
            assert len(got) == len(set(got)) and set(got) == want and len(want) > 10


def test_deviation_at_the_limit_is_stable_in_any_order(spark):
    """Samples whose deviation is exactly half of their mean, in many orders: sums of doubles put some of them above it."""
    draw, rows, wanted = random.Random(1), [], 0
    while wanted < 60:
        some = [draw.randint(1, 50) for _ in range(draw.randint(8, 24))]
        if 4 * (len(some) * sum(x * x for x in some) - sum(some) ** 2) == sum(some) ** 2:
            for _ in range(5):
                draw.shuffle(some)
                rows += [(wanted, float(x)) for x in some]
                wanted += 1
    df = spark.createDataFrame(rows, "unit long, x double")
    got = evaluation.timing_evidence(df, "unit", "x", 3, 0.5).collect()
    assert len(got) == wanted and all(r.stable and r.cv == 0.5 for r in got)
    over = evaluation.timing_evidence(df.withColumn("x", F.when(F.col("x") >= 30, F.col("x") + 0.01).otherwise(F.col("x"))), "unit", "x", 3, 0.5).collect()
    assert not all(r.stable for r in over)


def test_ratios_without_counting_letters(spark, monkeypatch):
    """Ratios are those of difflib, which isn't asked for short sources; one pass gives what three functions give."""
    draw, pairs = random.Random(2), [("", ""), ("", "a"), ("aab", "aab")]
    pairs += [tuple("".join(draw.choice("abc ") for _ in range(draw.randrange(30))) for _ in "ab") for _ in range(500)]
    want = [difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in pairs]
    with monkeypatch.context() as m:
        m.setattr(code.difflib, "SequenceMatcher", None)
        assert [code._ratio(a, b) for a, b in pairs] == want
    sources = ["x = 1", "x = y", "def f(x):\n    return x + 1 if x < 3 else 2", "not python", "", "x = " + "9" * 5000]
    rows = [(k, s) for k, s in enumerate(sources)] + [(6, None)]
    df = spark.createDataFrame(rows, "id long, source string").withColumn("m", code.mutation("source", "id"))
    for r in df.collect():
        if r.source is None:
            assert r.m.mutated is None and r.m.spec is None and r.m.similarity is None
            continue
        changed = code._mutate(r.source, r.id)
        assert (r.m.mutated, r.m.spec) == (changed, code._spec(r.source))
        assert r.m.similarity == (None if changed is None else difflib.SequenceMatcher(None, code._normal(r.source), code._normal(changed), autojunk=False).ratio())


def test_gzipped_artifacts_take_the_fastest_level(spark, tmp_path):
    rows = [(k, f"text {k} " + "letters and words " * (k % 50), ["all", "even"] if k % 2 == 0 else ["all"]) for k in range(500)]
    path = f"file://{tmp_path}/out"
    written = artifacts.write_artifacts(spark.createDataFrame(rows, "id long, text string, artifact array<string>").coalesce(2), path, compression="gzip")
    files = glob.glob(f"{tmp_path}/out/data/*/*.gz")
    # a header's ninth byte is 4 for the fastest level, 2 for the slowest
    assert len(files) == len(written["files"]) > 1 and all(open(f, "rb").read(10)[8] == 4 for f in files)
    assert written["rows"] == {"all": 500, "even": 250}
    for name, step in (("all", 1), ("even", 2)):
        assert sorted((r.id, r.text) for r in artifacts.read_artifact(spark, path, name, "id long, text string").collect()) == [(k, t) for k, t, _ in rows[::step]]


def _linked(sets, other=None, threshold=0.8):
    texts = [{r.cls: set(r.shingles) for r in x.classes.where("n > 0").collect()} for x in (sets, other or sets)]
    return {(a, b) for a, x in texts[0].items() for b, y in texts[1].items() if (other or a < b) and len(x & y) / len(x | y) >= threshold}


def _mixed(n: int) -> list[tuple[int, str]]:
    """Groups of texts that differ in a word or in length, between texts that are alone; copies, and texts of a few words."""
    draw, rows = random.Random(3), []
    for k in range(n):
        words = [f"u{draw.randrange(3000)}" for _ in range(draw.randint(1, 70))]
        rows.append(words)
        for _ in range(draw.choice((0, 0, 0, 1, 3))):
            changed = list(words)
            for _ in range(draw.randrange(3)):
                changed[draw.randrange(len(changed))] = f"y{draw.randrange(9)}"
            rows.append(changed[: len(changed) - draw.choice((0, 0, 1, 5))] or ["end"])
    return [*((k, " ".join(r)) for k, r in enumerate(rows)), (len(rows), ""), (len(rows) + 1, None)]


@pytest.mark.parametrize("threshold", [0.8, 0.5, 0.1])
def test_only_classes_that_may_have_a_link_are_staged(spark, monkeypatch, threshold):
    """A part of the shingles tells which classes go on; shingles of the others are never staged, and no link is lost."""
    monkeypatch.setattr(similarity, "SIFTED_TOKENS", 0)
    df = spark.createDataFrame(_mixed(150), "doc_id long, text string").repartition(3)
    plain, sets = similarity.shingle_sets(df, "doc_id"), similarity.shingle_sets(df, "doc_id")
    want = _linked(plain, threshold=threshold)
    got = [(r.a, r.b) for r in similarity.class_links(sets, None, threshold).select("a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 25
    assert "classes" not in sets.__dict__
    held = sets.some(similarity._kept(sets, None, threshold)).select("cls")
    assert {c for link in want for c in link} <= {r.cls for r in held.collect()}
    assert threshold < 0.8 or held.count() < plain.classes.count() * 0.8


@pytest.mark.parametrize("few", [250_000, 0])
def test_two_sides_are_sifted_without_losing_a_link(spark, monkeypatch, few):
    monkeypatch.setattr(similarity, "SIFTED_TOKENS", 0)
    monkeypatch.setattr(similarity, "FEW_SHINGLES", few)
    rows = _mixed(150)
    ours, theirs = (spark.createDataFrame([r for r in rows if (r[0] % 3 > 0) == own or r[0] % 10 == 0], "doc_id long, text string") for own in (True, False))
    sets = [similarity.shingle_sets(x, "doc_id") for x in (ours, theirs)]
    got = [(r.a, r.b) for r in similarity.class_links(*sets).select("a", "b").collect()]
    assert "classes" not in sets[0].__dict__
    want = _linked(*sets)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 5
    firsts = sets[1].rows.groupBy("cls").agg(F.min("doc_id").alias("first"))
    least = {r.cls: r.first for r in similarity.least_classes(*sets, firsts).collect()}
    first = {r.cls: r.first for r in firsts.collect()}
    assert least == {a: min(first[y] for x, y in want if x == a) for a, _ in want}


def _shuffles(df) -> list[str]:
    plan = df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return [x for x in df._jdf.queryExecution().explainString(plan).split("\n\n") if "Exchange" in x.strip().split("\n")[0]]


def test_admission_shuffles_no_texts(spark):
    rows = spark.createDataFrame([(k, f"s{k % 2}", f"a station and its lung {k // 2} " + "word " * k) for k in range(2, 12)] + [(12, "s0", None)], "doc_id long, source string, text string")
    base = spark.createDataFrame([(1, "s0", "a station and its lung 1  word word ")], "doc_id long, source string, text string")
    judged = admission.admit(rows, base, "doc_id", "source", 8, ("tion", "ung"), 0.3)
    assert judged.columns == ["source", "doc_id", "text", "lexical_tokens", "reasons", "status", "split", "sampling_weight"]
    told = {r.doc_id: (r.lexical_tokens, r.reasons) for r in judged.drop("text").collect()}
    assert told[2] == (8, ["BASE_DAPT_NORMALIZED_DUPLICATE:1"]) and told[3] == (9, ["BASE_DAPT_NEAR_DUPLICATE:1"]) and told[11] == (17, [])
    with_texts, without = _shuffles(judged), _shuffles(judged.drop("text"))
    assert any("text#" in x for x in with_texts) and without and not any("text#" in x for x in without)


def test_passages_are_found_without_staging_documents(spark, tmp_path):
    """Shingles of passages are staged, those of documents aren't; copies have their rows, and a document without a key word none."""
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(k, f"before {k} {passage} behind" if k % 3 == 0 else f"other {k} text " * 20) for k in range(40)] + [(k, f"before 0 {passage} behind") for k in (40, 41)] + [(42, None), (43, "")]
    made = []
    with pytest.MonkeyPatch.context() as m:
        table = staging.Workspace.table
        m.setattr(staging.Workspace, "table", lambda self, df, name, **o: (made.append((name, table(self, df, name, **o))), made[-1][1])[1])
        found = dedup.contained_passages(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", spark.createDataFrame([(7, passage), (8, "not there at all " * 5)], "item_id long, text string"), "item_id", 1.0)
        got = {(r.doc_id, r.item_id, r.share) for r in found.collect()}
    assert got == {(k, 7, 1.0) for k in range(42) if k % 3 == 0 or k > 39}
    assert made and all(x.count() <= 60 and "doc_id" not in x.columns for _, x in made)
    assert sum(x.count() for name, x in made if name == "classes") == 2
