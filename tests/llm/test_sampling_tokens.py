"""Importance resampling, fill-in-middle and token counts against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from corpusloom.llm import infilling, registry, resampling, token_count
from corpusloom.llm.packing import vocabulary_path

from .odd import LONG, MANY, ROWS, no_docs, odd_docs

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def plain_words(text):
    return WORD.findall((text or "").translate(FOLD))


def plain_features(text, longest=3):
    words = plain_words(text)
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, percent=5, least=20, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, plain_features(text)))
    for text in target:
        t.update(map(bucket, plain_features(text)))
    n, m = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in docs:
        features = plain_features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets)))) for b in map(bucket, features))
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(text)) >= least])
    fit = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, row in enumerate(fit[: percent * len(fit) // 100], 1):
        row[4] = k
    return sorted((tuple(r[:5]) for r in out), key=repr)


def got_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("window", [5, 64, 1 << 20])
def test_buckets_of_every_feature(window, monkeypatch):
    """Runs of suffixes and joined checksums give each n-gram its own CRC-32, across windows and block borders."""
    monkeypatch.setattr(resampling, "WINDOW", window)
    rng = random.Random(window)
    words = ["a", "Bc", "d9", "éà", "x" * 300, "Z", "日本語", "k" * 70_000]
    texts = [None, "", " . ", "one", "one two", *("".join(rng.choice(words[:-1]) + rng.choice([" ", ", ", "\n", "--", "_"]) for _ in range(rng.randint(1, 60))) for _ in range(40)), words[-1] + " " + words[-1]]
    raw = pa.array([(t or "").encode() for t in texts], pa.binary())
    for sliced, some in ((raw, texts), (raw.slice(3, 11), texts[3:14])):
        counts, found = resampling.feature_buckets(sliced, 3, 997)
        assert counts.tolist() == [len(plain_words(t)) for t in some]
        at = 0
        for text, count in zip(some, counts, strict=True):
            own = found[:, at : at + count]
            assert sorted(own[own >= 0].tolist()) == sorted(zlib.crc32(f.encode()) % 997 for f in plain_features(text))
            at += count


def test_joined_checksums():
    parts = [b"", b"a", b"hello", b"x" * 1000, bytes(range(256))]
    a, b = zip(*((p, q) for p in parts for q in parts), strict=True)
    joined = resampling.joined_crc(np.array([zlib.crc32(x) for x in a], np.uint32), np.array([zlib.crc32(x) for x in b], np.uint32), np.array([len(x) for x in b]))
    assert joined.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b, strict=True)]


def test_resampling_equals_plain(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    assert got_rows(registry.QUERIES["op11_importance_resampling"](spark, SF)) == plain_resample(docs, target)


def test_resampling_of_odd_rows(spark):
    target = spark.createDataFrame([("one two three w1 w2",), (None,), ("",)], "text string")
    plain = [(r[0], r[1]) for r in ROWS]
    found = resampling.resample(odd_docs(spark), target, percent=60, least_words=1).select("doc_id", "n_features", "weight", "score", "rank")
    assert got_rows(found) == plain_resample(plain, ["one two three w1 w2", None, ""], 60, 1)
    assert got_rows(resampling.resample(odd_docs(spark, False), target.limit(0), percent=100)) == plain_resample(plain, [], 100)
    assert resampling.resample(no_docs(spark), target).count() == 0


def test_ranks_of_many_equal_scores(spark):
    """One id and text for most rows: ranks are still 1, 2, 3, ... and the best come first."""
    docs = spark.range(4000).select(F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(7).alias("doc_id"), F.lit("w " * 20).alias("text"))
    rows = resampling.resample(docs, docs.limit(3), percent=50).where("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 2001))
    assert all((a["score"], -a["doc_id"]) >= (b["score"], -b["doc_id"]) for a, b in zip(rows, rows[1:], strict=False))


def plain_infill(doc_id, text, rate=50):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(tokens), "plain", None, None, text
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TRICKY = ["<", "<P", "S><M", "a <P> b", "< <S < M>", "\x00 a\x00b", "é́ 　x\x0b\x0c y", "\x1c\x85  z", "'; DROP TABLE docs; --", "end ", " \t", "x" * 200_000 + " y"]


@pytest.mark.parametrize("rate", [50, 100])
def test_infilling_equals_plain(spark, rate):
    docs = [(k, t) for k in range(40) for t in TRICKY]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    made = infilling.restore(infilling.fill_in_middle(df, rate=rate)).collect()
    assert len(made) == len(docs) and len({r.form for r in made}) == 3
    for r in made:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_infill(r.doc_id, r.text, rate) and r.restored == r.text


def test_infilling_of_odd_rows(spark):
    made = infilling.restore(infilling.fill_in_middle(odd_docs(spark).withColumn("n", F.lit("clash")).withColumn("place", F.lit(1))))
    assert made.columns[:4] == ["doc_id", "text", "lang", "source"] and "place" in made.columns and made.columns.count("n") == 1
    rows = made.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_infill(r.doc_id, r.text) and r.restored == (r.text or "")
    assert infilling.fill_in_middle(no_docs(spark)).count() == 0
    broken = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    assert infilling.fill_in_middle(broken, rate=0).first().output == "a�b"


def whole_counts(texts):
    return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model")).encode([t or "" for t in texts])]


PIECES = ["a", "  a", " ", "   ", "a  b", "x▁y", "▁", "▁▁ x", "1234 5", "a1b2", "\n\n a\n", "\r\n;\r", "\t\tx", "<s>x</s> <unk>", "<0x0A>", "\x00", "日本 語", "　x\xa0", "﻿x", "é", "🙂🙂 🙂", "a" * 5000, " " * 5000 + "x", "9" * 300, "don't, won't... (yes)", "x \n y"]


def test_pre_tokens_have_the_texts_pieces():
    for text, n in zip(PIECES, whole_counts(PIECES), strict=True):
        found = token_count.pre_tokens(text)
        assert "".join(found) == "▁" + text.replace(" ", "▁") and sum(token_count.piece_counts(found)) == n, text


def test_a_vocabulary_whose_pieces_span_pre_tokens_is_refused(monkeypatch):
    monkeypatch.setattr(token_count, "_models", {})
    monkeypatch.setattr(token_count, "PRE_TOKEN", re.compile("[^e]+|e"))
    with pytest.raises(ValueError, match="spans two pre-tokens"):
        token_count.model()


@pytest.mark.parametrize("block_bytes,buckets", [(1 << 23, 1024), (200, 3)])
def test_token_counts_equal_whole_texts(spark, block_bytes, buckets):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(PIECES)], "doc_id long, text string")).repartition(4)
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = dict(zip(texts, whole_counts(texts.values()), strict=True))
    got = token_count.token_counts(docs, block_bytes=block_bytes, buckets=buckets).collect()
    assert {r.doc_id: (r.n_tokens, r.n_bytes) for r in got} == {k: (n, len((texts[k] or "").encode())) for k, n in want.items()} and len(got) == len(texts)


def test_token_counts_of_odd_rows(spark):
    got = sorted(map(tuple, token_count.token_counts(odd_docs(spark)).collect()), key=repr)
    texts = [r[1] for r in ROWS]
    assert got == sorted(((r[0], len((r[1] or "").encode()), n) for r, n in zip(ROWS, whole_counts(texts), strict=True)), key=repr)
    assert token_count.token_counts(no_docs(spark)).count() == 0
    rows = registry.QUERIES["op13_token_counts"](spark, SF).collect()
    assert all(r.over_limit == (r.n_tokens > 4096) for r in rows) and len(LONG) and len(MANY)
