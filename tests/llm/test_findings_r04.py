import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import suffix_dedup, topk


def test_answers_do_not_grow_with_pairs_of_blocks():
    """Names that as many pairs of blocks share take a few bytes each, and both blocks of a pair list the same ones."""
    rng, n_blocks = np.random.default_rng(4), 400
    drawn = [np.repeat(rng.integers(0, 1 << 62, n, dtype=np.uint64), times) for n, times in ((20_000, 2), (500, 30))]
    both = np.unique(np.stack([rng.integers(0, n_blocks, sum(map(len, drawn))).astype(np.uint64), np.concatenate(drawn)]), axis=1)
    held = {int(k // 7 << 32 | k % 7): both[1][both[0] == k] for k in range(n_blocks)}
    own = {k: suffix_dedup.Distinct(names, 1, 64) for k, names in held.items()}
    sent = [row for k, x in own.items() for batch in x.sent(k) for row in batch.to_pylist()]
    answers = suffix_dedup._merge(False, True)(suffix_dedup._table([tuple(r.values()) for r in sent], suffix_dedup.SENT))
    assert answers.nbytes < 8 * both.shape[1]
    told = {k: [] for k in held}
    for row in answers.to_pylist():
        told[row["block"]].append(row)
    want, last = {}, {}
    for k in sorted(held):
        for name in held[k].tolist():
            if name in last:
                want.setdefault((last[name], k), []).append(name)
            last[name] = k
    behind = {(k, other): own[k].names[places].tolist() for k in held for other, places in own[k].shared(told[k], "behind").items()}
    before = {(other, k): own[k].names[places].tolist() for k in held for other, places in own[k].shared(told[k], "before").items()}
    assert behind == before == want and len(want) > 15_000


def test_a_task_of_many_blocks_holds_one_at_a_time(spark, monkeypatch):
    """All blocks of one task: a batch that goes to Python holds few of them, and staged blocks are row groups of their own."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 20_000)
    monkeypatch.setattr(suffix_dedup, "BATCHES", {key: "20000" for key in suffix_dedup.BATCHES})
    rows, groups, table = [], [], suffix_dedup.Workspace.table

    def watched(work, df, name, **options):
        out = table(work, df, name, **options)
        if name == "blocks":
            files = [p for p in Path(work.path(name).removeprefix("file://")).iterdir() if p.suffix == ".parquet"]
            groups.extend(g for p in files for f in [pq.ParquetFile(p).metadata] for g in [f.row_group(i).num_rows for i in range(f.num_row_groups)])
            rows.extend(r.n for r in out.coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect())
        return out

    monkeypatch.setattr(suffix_dedup.Workspace, "table", watched)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 30).alias("text")).coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    assert suffix_dedup.remove_repeats(docs).agg(F.sum("n_removed"), F.count("doc_id")).first()[:] == (300 * 1920, 300)
    assert sum(groups) == sum(rows) >= 30 and max(groups) == 1 and max(rows) <= 2
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before


@pytest.mark.parametrize("blocks", [[], [-1, -1, -1], [0], [-1, 0, 5, -1], [(1 << 40) + 3, -1, 7 << 32, (1 << 32) - 1], list(range(-1, 1000))])
def test_packed_blocks(blocks):
    blocks = np.array(blocks, np.int64)
    places, found = suffix_dedup._unpack_blocks(suffix_dedup._pack_blocks(blocks), len(blocks))
    assert places.tolist() == np.flatnonzero(blocks >= 0).tolist() and found.tolist() == blocks[blocks >= 0].tolist()


def test_a_search_takes_no_hundred_products():
    """Unit vectors, none of which a norm excludes: the best are exact, and found in less than a hundred times what all products take."""
    rng = np.random.default_rng(7)
    v = rng.standard_normal((16384, 64))
    v = np.floor(64 * v / np.sqrt((v**2).sum(1, keepdims=True))).astype(np.int64)
    rows = np.arange(len(v))
    shard, asked = topk.Vectors(rows, rows, v, np.zeros(0)), topk.Vectors(rows[::32], rows[::32], v[::32], np.zeros(0))
    index, took = topk.impact_index(v), []
    for _ in range(3):
        began = time.perf_counter()
        products = v.astype(np.float64) @ v[::32].T.astype(np.float64)
        took.append(time.perf_counter() - began)
    began = time.perf_counter()
    qs, vs, scores = topk.score_at_a_time(asked, shard, 20, index)
    assert time.perf_counter() - began < 100 * min(took)
    products[rows[::32], np.arange(len(asked.v))] = -np.inf
    for q in range(len(asked.v)):
        best = np.lexsort((rows, -products[:, q]))[:20]
        assert vs[qs == q].tolist() == best.tolist() and scores[qs == q].tolist() == products[best, q].tolist()


@pytest.mark.parametrize("factor", [1, 200, 3_000, 10**6])
def test_bounds_hold_whatever_the_size_of_numbers(factor):
    """Products beyond what single floats hold exactly; many ties; a score to reach that only ties reach."""
    rng = np.random.default_rng(9)
    v = rng.integers(-9, 10, (3000, 5)) * factor
    v[100:2000] = v[0]
    rows, exact = np.arange(len(v)), v.astype(object) @ v[::100].astype(object).T
    shard, asked = topk.Vectors(rows, rows[::-1], v, np.zeros(0)), topk.Vectors(rows[::100], rows[::-1][::100], v[::100], np.zeros(0))
    ids, sums = rows[::-1], exact.astype(np.float64)
    own = np.zeros(sums.shape, bool)
    own[rows[::100], np.arange(len(asked.v))] = True
    for least in (None, np.sort(np.where(own, -np.inf, sums), axis=0)[-7]):
        with_least = asked if least is None else topk.Vectors(asked.rows, asked.ids, asked.v, least)
        qs, vs, scores = topk.score_at_a_time(with_least, shard, 20)
        for q in range(len(asked.v)):
            best = [r for r in np.lexsort((ids, -sums[:, q])) if not own[r, q] and (least is None or sums[r, q] >= least[q])][:20]
            assert vs[qs == q].tolist() == best
            assert scores[qs == q].tolist() == exact[best, q].tolist()
