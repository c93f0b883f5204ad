import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mixing, topk

from .odd import ROWS, no_docs, odd_docs


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    """Shares by weight, again and again, until no source is above its cap."""
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    capped, total = {}, 1.5 * sum(sizes.values())
    while True:
        left = total - sum(capped.values())
        open_ = [s for s in names if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 2.0 * sizes[s] for s in over}


@pytest.mark.parametrize("name", ["odd", "sf0.001", "sf0.01"])
def test_mix(spark, name):
    docs = odd_docs(spark) if name == "odd" else spark.read.parquet(f"/root/testdata/{name}/documents.parquet")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == docs.count()
    sizes = {}
    for r in got:
        assert r["size"] == size(r.text)
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    targets = brute_targets(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]}
        assert all(abs(r.target - targets[s]) <= 1e-6 * max(1, targets[s]) for r in mine)
        assert abs(sum(r.taken for r in mine) - targets[s]) < 1 and all(0 <= r.taken <= 2 * r["size"] for r in mine)
    assert all((r.position is None) == (r.taken == 0) and all(0 <= p <= 1 for p in r.positions) for r in got)
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert sorted((repr(r.doc_id), r.taken, r.position or -1) for r in got) == sorted((repr(r.doc_id), r.taken, r.position or -1) for r in again)


def test_schedules_integrate_to_targets(spark):
    """In each tenth of the run a source's words follow the integral of its schedule."""
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.element_at(F.array(*map(F.lit, "xyz")), (F.col("id") % 3 + 1).cast("int")).alias("source"))
    taken = mixing.mix_sources(docs).select("source", "target", F.explode("positions").alias("p")).groupBy("source", "target", F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("tenth")).count().collect()
    slopes = dict(zip("xyz", mixing.SLOPES, strict=True))
    for r in taken:
        s, t = slopes[r.source], np.array([r.tenth, r.tenth + 1]) / 10
        share = np.diff((1 - s) * t + s * t * t)[0]
        assert abs(3 * r["count"] - share * r.target) < 0.03 * r.target


def test_ranges_do_not_change_the_mix(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = sorted((r.doc_id, r.taken, r.position or -1) for r in mixing.mix_sources(docs).collect())
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 2)
    assert sorted((r.doc_id, r.taken, r.position or -1) for r in mixing.mix_sources(docs).collect()) == whole


def test_training_order_takes_whole_documents(spark):
    docs = odd_docs(spark)
    mixed = mixing.training_order(docs)
    assert mixed.columns == docs.columns and {r.text for r in mixed.collect()} <= {r[1] for r in ROWS}
    assert mixing.training_order(no_docs(spark)).count() == 0 and mixing.mix_sources(no_docs(spark)).count() == 0


def test_training_order_leaves_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"some words {i}", "ab"[i % 2], i, float(i), [i]) for i in range(30)], "doc_id long, text string, source string, size long, position double, positions array<long>")
    docs = docs.withColumn("taken", F.lit("t")).withColumn("target", F.lit(None).cast("int")).withColumn("source_size", F.lit(7))
    got = mixing.training_order(docs).collect()
    assert len(got) > 30 and all((r.size, r.position, r.positions, r.taken, r.target, r.source_size) == (r.doc_id, float(r.doc_id), [r.doc_id], "t", None, 7) for r in got)


def brute_top(vectors, k=20, every=20):
    """Rows that share an id are queries and candidates on their own."""
    out = []
    for row, (q, x) in enumerate(vectors):
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), v) for other, (v, y) in enumerate(vectors) if other != row)
            out += [(q, i + 1, v, -s) for i, (s, v) in enumerate(scores[:k])]
    return sorted(out)


def as_ints(x):
    return [int(np.floor(64.0 * float(np.float32(v)))) for v in x]


@pytest.mark.parametrize("shard,few,held,levels", [(16384, 200, 256, 12), (17, 1, 2, 12), (40, 1, 3, 2), (17, 0, 256, 40)])
def test_top_k(spark, monkeypatch, shard, few, held, levels):
    for name, value in {"SHARD": shard, "BLOCK": 3, "FEW": few, "HELD": held}.items():
        monkeypatch.setattr(topk, name, value)
    monkeypatch.setattr(topk.impact_index, "__defaults__", (levels,))
    rng = np.random.default_rng(1)
    vectors = [(int(i), (rng.standard_normal(8) * rng.choice([0.01, 1, 30])).tolist()) for i in range(150)]
    vectors += [(i, vectors[3][1]) for i in range(150, 200)] + [(200, [0.0] * 8), (220, [1.0, 2.0]), (200, [0.0] * 8), (40, vectors[60][1]), (21, vectors[21][1])]
    bad = [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, x, 1) for i, x in vectors + bad], "vec_id long, embedding array<float>, score int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.exact_top_k(df).collect())
    assert got == brute_top([(i, as_ints(x)) for i, x in vectors])
    assert topk.exact_top_k(df.limit(0)).count() == 0 and topk.exact_top_k(df.where("vec_id = 20")).count() == 0


def test_segments_come_by_impact_and_bound_what_is_left():
    v = np.random.default_rng(2).integers(-500, 500, (50, 6))
    v[7] = 0
    segments, rest = topk.impact_index(v)
    impacts = [[abs(s.impact) for s in level] for level in segments]
    assert all(min(a) > max(b) for a, b in zip(impacts[:-1], impacts[1:], strict=True) if a and b)
    assert sum(len(s.places) for level in segments for s in level) == np.count_nonzero(v)
    left = v.astype(float)
    for level, norms in zip(segments, rest, strict=True):
        for s in level:
            left[s.places, s.dim] -= s.impact
        assert (np.sqrt((left**2).sum(1)) <= norms).all() and np.allclose(np.sqrt((left**2).sum(1)), norms, atol=0.01)


def test_a_query_stops_before_the_last_segment(monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.integers(-40, 40, (3000, 16))
    q = v[:8] * 1
    shard = topk.Vectors(np.arange(3000), np.arange(3000), v, np.zeros(0))
    asked = topk.Vectors(np.arange(8), np.arange(8), q, np.zeros(0))
    segments, rest = topk.impact_index(v)
    broken = [*segments[:-1], [topk.Segment(0, float("nan"), np.arange(3000))]]  # the last level is never read
    monkeypatch.setattr(topk, "FEW", 2990)
    got = topk.score_at_a_time(asked, shard, 20, (broken, rest))
    want = topk.score_at_a_time(asked, shard, 20, (segments, rest))
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
