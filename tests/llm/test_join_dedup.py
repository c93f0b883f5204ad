import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from corpusloom.llm import components, jaccard_join, suffix_dedup
from corpusloom.llm.common import Workspace

from .odd import ROWS, no_docs, odd_docs, rows


def grams(text):
    words = regex.findall(r"[\p{L}\p{M}\p{N}]+", (text or "").lower()) or (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_join(docs, threshold=0.8):
    """Least id of the component and number of links, for each row."""
    sets, n = [grams(t) for _, t in docs], len(docs)
    parent, links = list(range(n)), [0] * n

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i in range(n):
        least[root(i)].append(docs[i][0])
    known = {r: min((x for x in ids if x is not None), default=None) for r, ids in least.items()}
    return sorted([(d, known[root(i)], links[i]) for i, (d, _) in enumerate(docs)], key=repr)


def near_copies(seed=1):
    rng, docs = random.Random(seed), []
    vocabulary = [f"Wort{i}" for i in range(500)]
    for base in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(3, 220))]
        for _ in range(rng.randint(1, 9)):
            changed = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(changed)))
        if base % 3 == 0:
            docs.append((len(docs), docs[-1][1]))
    return docs


def test_join_equals_brute_force(spark):
    docs = near_copies()
    got = jaccard_join.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    assert rows(got, "doc_id", "class_id", "n_links") == brute_join(docs)


def test_join_across_blocks(spark, monkeypatch):
    docs = near_copies(2)
    monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "GRAM_BLOCK", 1000)
    monkeypatch.setattr(components, "HOT", 1 / 20)
    monkeypatch.setattr(jaccard_join, "_PAIRS", 7)
    got = jaccard_join.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    assert rows(got, "doc_id", "class_id", "n_links") == brute_join(docs)


def test_join_of_odd_rows(spark):
    got = rows(jaccard_join.jaccard_join(odd_docs(spark)), "doc_id", "class_id", "n_links")
    want = brute_join([r[:2] for r in ROWS])
    assert got == [(d, d if n == 0 else c, n) for d, c, n in want]
    assert jaccard_join.jaccard_join(no_docs(spark)).count() == 0


def test_one_of_each_class_stays(spark):
    docs = near_copies(3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {c for _, c, _ in brute_join(docs)}
    assert {r.doc_id for r in jaccard_join.keep_one_each(df).collect()} == want
    kept = rows(jaccard_join.keep_one_each(odd_docs(spark)), "doc_id", "text")
    assert len(kept) == len(set(kept)) and {d for d, _ in kept} == {None, 1, 3, 4, 5, 6, 7, 8}


def test_pruning_keeps_what_can_reach_the_threshold():
    least = jaccard_join.least_matches()
    assert len(least) == jaccard_join.HASHES // jaccard_join.STEP and all(0 <= m <= 0.8 * 16 * (i + 1) for i, m in enumerate(least))
    assert least[-1] > 0.5 * jaccard_join.HASHES


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    parent = np.arange(2000)
    components.union(parent, np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    want = {i: r for i, r in enumerate(components.roots(parent).tolist()) if i != r}
    got = components.connected_components(Workspace(spark, "test-cc"), spark.createDataFrame(edges, "a long, b long"))
    assert dict((r.node, r.root) for r in got.collect()) == want


def brute_dedup(docs, length=200):
    texts = [(t or "").encode() for _, t in docs]
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for (doc_id, _), b in zip(docs, texts, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0]) == 1)
        out.append((doc_id, len(b), int(gone.sum()), len(edges), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def repeated_texts(seed=5):
    rng = random.Random(seed)
    letters = "abcdefghij éü"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [make(n) for n in (150, 190, 200, 230, 420)]
    docs = []
    for i in range(40):
        text = make(rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            text += rng.choice(passages) + make(rng.randint(0, 120))
        docs.append((i, text))
    docs += [(40, "x" * 199), (41, "y" * 200), (42, "z" * 201), (43, docs[3][1]), (44, "ab" * 400)]
    return docs


@pytest.mark.parametrize("block,bits", [(4 << 20, 64), (700, 64), (700, 0), (2500, 7), (4 << 20, 3)])
def test_dedup_equals_brute_force(spark, monkeypatch, block, bits):
    """With no bits all names are equal and only the bytes tell strings apart; with few, most names stand for several."""
    docs = repeated_texts()
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), bits)
    assert rows(got, *COLUMNS) == brute_dedup(docs)


def test_strings_that_differ_in_one_byte():
    rng = np.random.default_rng(0)
    mine = rng.integers(0, 4, 3000).astype(np.uint8)
    theirs = mine.copy()
    theirs[rng.integers(0, 3000, 3)] += 1
    for q in (np.arange(0, 2700), np.unique(rng.integers(0, 2700, 300)), np.array([5])):
        at = q.copy()
        want = [mine[a : a + 200].tobytes() != theirs[b : b + 200].tobytes() for a, b in zip(q, at, strict=True)]
        assert suffix_dedup._differ(mine, q, theirs, at).tolist() == want
        text, begin = suffix_dedup._extract(theirs, rng.permutation(q))
        assert len(text) <= len(theirs) and len(begin) == len(q)
    p = rng.permutation(np.unique(rng.integers(0, 2700, 200)))
    text, begin = suffix_dedup._extract(theirs, p)
    assert all(np.array_equal(text[b : b + 200], theirs[a : a + 200]) for a, b in zip(p, begin, strict=True))


def test_triples_of_names_stand_for_150_bytes():
    rng = random.Random(1)
    same = bytes(rng.randrange(256) for _ in range(150))
    texts = [bytes(rng.randrange(256) for _ in range(n)) + same + bytes(rng.randrange(256) for _ in range(90)) for n in (100, 137, 162)]
    block = suffix_dedup.Block(texts)
    positions, text = block.sample()
    own = suffix_dedup.Distinct(block.at(positions, suffix_dedup.PERIOD, 48), 8, 48)
    assert all((p - block.starts[t]) % 50 in suffix_dedup.COVER for p, t in zip(positions, text, strict=True))
    (batch,) = own.sent(3)
    answers = [x for part in batch.to_pylist() for x in suffix_dedup._merge(True, False)(pa.Table.from_pylist([part], batch.schema)).to_pylist()]
    names = own.ranks(answers)[own.place]
    alike = Counter(block.bytes[p : p + 50].tobytes() for p in positions)
    assert [bool(n) for n in names] == [alike[block.bytes[p : p + 50].tobytes()] > 1 for p in positions]
    ranked = dict(zip(own.names.tolist(), own.ranks(answers).tolist(), strict=True))
    order = [r for _, r in sorted(ranked.items()) if r]
    assert order == sorted(order) and len(set(order)) == len(order)


def test_dedup_of_odd_rows(spark):
    short = [(r[0], r[1] if r[1] is None else r[1][:3000], *r[2:]) for r in ROWS]
    cut = odd_docs(spark).withColumn("text", F.substring("text", 1, 3000))
    assert rows(suffix_dedup.remove_repeats(cut), *COLUMNS) == brute_dedup([r[:2] for r in short])
    assert suffix_dedup.remove_repeats(odd_docs(spark)).count() == len(ROWS)
    assert suffix_dedup.remove_repeats(no_docs(spark)).count() == 0
    broken = spark.sql("SELECT 1L AS doc_id, CAST(unhex(repeat('61FF', 150)) AS STRING) AS text UNION ALL SELECT 2, CAST(unhex(repeat('FE61FF', 50)) AS STRING)")
    assert rows(suffix_dedup.remove_repeats(broken), "doc_id", "n_bytes", "n_removed") == [(1, 300, 300), (2, 150, 0)]


def test_only_pairs_that_are_left_are_verified(spark, monkeypatch):
    seen = []
    docs = near_copies(3)
    table = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    rows_of = {r.node: r for r in jaccard_join.sketches(table, 5).collect()}
    batch = pa.Table.from_pylist([{"bucket": 1, "band": 0, "lo": 0, "hi": 0, "block": 0, "node": r.node, "sig": r.sig, "copies": 1, "shingles": next(jaccard_join.word_grams(pa.array([docs[r.doc_id][1]]))).tobytes()} for r in rows_of.values()])
    common = jaccard_join._common
    monkeypatch.setattr(jaccard_join, "_common", lambda sets, a, b: seen.extend(zip(a, b, strict=True)) or common(sets, a, b))
    left = [(a, b) for x, y in jaccard_join._survivors(batch, jaccard_join.least_matches()) for a, b in zip(x, y, strict=True)]
    (out,) = jaccard_join._verify(0.8, 1e-8)(iter(batch.to_batches()))
    assert len(seen) == len(left) > 0 and set(out["node"].to_pylist()) <= {batch["node"][int(i)].as_py() for pair in left for i in pair}


def test_products_count_what_single_comparisons_count():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint64)) for _ in range(12)]
    a, b = np.triu_indices(12, 1)
    want = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)]
    assert jaccard_join._common(sets, a, b).tolist() == want and jaccard_join._common(sets, a[:30], b[:30]).tolist() == want[:30]


def test_texts_that_are_not_utf8(spark):
    broken = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text UNION ALL SELECT 2, CAST(X'61FF62' AS STRING) UNION ALL SELECT 3, 'a b c'")
    assert rows(jaccard_join.jaccard_join(broken), "doc_id", "class_id", "n_links") == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]


def test_hubs_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT", 0.1)
    left = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), (None, 2), ("c", 3)], "k string, x int")
    right = spark.createDataFrame([("a", 50, "A"), ("b", 1, "B")], "k string, n long, y string")
    for how in ("inner", "left"):
        got = components.hub_join(left, right, "k", "n", 53, how)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, left.join(right.drop("n"), "k", how).collect()))
