"""Self-join of documents on the Jaccard similarity of their word n-grams, with Bayesian pruning of candidates.

Texts are joined as classes of equal texts. Candidates share a band of their MinHash signature; their remaining MinHash
values are compared step by step, and a pair is dropped once the posterior probability that its similarity reaches
the threshold falls below a tolerance. Only the pairs that are left are verified, on the n-grams themselves: a document's
n-grams go to those pairs of blocks in which it has such a pair. Pairs exist only inside a task's arrays: rows
are made per document and pair of blocks, never per pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Workspace, read_table, readable
from corpusloom.llm.components import connected_components, hub_join, roots, union

NGRAM, THRESHOLD, TOLERANCE = 5, 0.8, 1e-8
#: MinHash values and values of a band. At similarity 0.8 a pair shares none of the 32 bands with probability 5e-8.
HASHES, BAND, STEP = 128, 4, 16
BANDS = HASHES // BAND
#: Documents of a block of a bucket, and n-grams that it holds on average, at most: long texts make smaller blocks.
BUCKET_BLOCK, GRAM_BLOCK = 2048, 4_000_000
_PAIRS = 400_000
_draw = np.random.default_rng(20_240_229)
_A = _draw.integers(0, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _draw.integers(0, 2**63, HASHES, np.uint64)
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_words(texts: pa.Array) -> pa.ListArray:
    """Words are runs of letters, marks and digits in lower case; a text without any is split at white space instead."""
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    plain = pc.utf8_trim_whitespace(pc.replace_substring_regex(lower, r"[^\pL\pM\pN]+", " "))
    kept = pc.if_else(pc.equal(plain, ""), pc.utf8_trim_whitespace(lower), plain)
    return pc.utf8_split_whitespace(kept)


def word_grams(texts: pa.Array, n: int = NGRAM) -> Iterator[np.ndarray]:
    """For each text the sorted set of its n-gram hashes; fewer words than n make one gram of them all, none make none."""
    split = split_words(texts)
    coded = split.flatten().dictionary_encode()
    words = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False) if len(coded) else np.zeros(0, np.uint64)
    h = words[coded.indices.to_numpy()] if len(coded) else words
    blank = np.array(coded.dictionary.to_pylist(), object) == "" if len(coded) else np.zeros(0, bool)
    empty = blank[coded.indices.to_numpy()] if len(coded) else blank
    rolled = h.copy()
    for k in range(1, n):
        rolled = rolled[:-1] * _M + h[k:] if len(rolled) > 1 else rolled[:0]
    rolled = _mix(rolled)
    ends = split.offsets.to_numpy() - split.offsets[0].as_py()
    for at, end in zip(ends[:-1], ends[1:], strict=True):
        if end - at >= n:
            yield np.unique(rolled[at : end - n + 1])
        elif end == at or empty[at]:
            yield np.zeros(0, np.uint64)
        else:
            short = np.full(1, end - at, np.uint64)
            for k in range(at, end):
                short = short * _M + h[k : k + 1]
            yield _mix(short)


def minhash(grams: np.ndarray) -> np.ndarray:
    """The low 16 bits of the least value of each hash function."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 2048):
        np.minimum(least, (grams[at : at + 2048, None] * _A + _B).min(0), out=least)
    return ((least >> np.uint64(16)) & np.uint64(0xFFFF)).astype("<u2")


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For n = STEP, 2 STEP, ...: the fewest matches of n that leave the threshold possible.

    With a uniform prior, the probability that the similarity reaches t given m matches of n is that of at most
    m successes in n + 1 draws of probability t.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, node, grams, sig``: ``node`` is the digest of the text, null for a null text."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                found = [(len(g), minhash(g).tobytes()) for g in word_grams(readable(batch.column(1)), n)]
                nodes = [hashlib.md5(t.as_py()).digest() if t.is_valid else None for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.binary())], names=["doc_id", "node", "grams", "sig"])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(sketch, "doc_id long, node binary, grams int, sig binary")


def _bands(nodes: DataFrame) -> DataFrame:
    """``bucket, band, node, grams, sig``: a row for each band of each signature."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(-1, BANDS)
                keys = _mix(keys * _M + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                places = pa.array(np.repeat(np.arange(len(keys)), BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(keys))), batch.column(0).take(places), batch.column(1).take(places)], names=["bucket", "band", "node", "grams"])

    return nodes.select("node", "grams", "sig").mapInArrow(cut, "bucket long, band int, node binary, grams int")


def _blocks(members: DataFrame) -> DataFrame:
    """Deals a bucket's rows into ``parts`` blocks and each block into its pairs with all blocks of the bucket: ``lo <= hi``."""
    dealt = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return _sorted(dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", "parts"))


def _sorted(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "block", "node")


def _groups(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups of (key, lo, hi), each of about ``rows`` rows or one group."""
    waiting: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        held += batch.num_rows
        if held < rows:
            continue
        table = pa.Table.from_batches(waiting)
        starts = _starts(table, key)
        if len(starts) > 1:
            yield table.slice(0, starts[-1])
        rest = table.slice(starts[-1])
        waiting, held = rest.to_batches(), rest.num_rows if len(starts) > 1 else 0
    if waiting:
        yield pa.Table.from_batches(waiting)


def _starts(table: pa.Table, key: str) -> np.ndarray:
    changed = np.zeros(table.num_rows, bool)
    changed[0] = True
    for name in (key, "lo", "hi"):
        column = table[name].to_numpy()
        changed[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(changed)


def _pairs(table: pa.Table, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of all pairs within groups, or between the two blocks of a group, in arrays of bounded length."""
    n = table.num_rows
    ends = np.r_[starts[1:], n]
    sizes = ends - starts
    block, lo, hi = (table[x].to_numpy() for x in ("block", "lo", "hi"))
    first, end = np.arange(1, n + 1), np.repeat(ends, sizes)
    across = lo != hi
    if across.any():
        upper = np.repeat(ends - np.add.reduceat((block == hi).astype(np.int64), starts), sizes)
        first = np.where(across, np.where(block == lo, upper, end), first)
    partners = np.concatenate([[0], np.cumsum(end - first)])
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(partners, partners[at] + _PAIRS, "right")) - 1)
        counts = end[at:to] - first[at:to]
        if counts.sum():
            a = np.repeat(np.arange(at, to), counts)
            yield a, np.repeat(first[at:to], counts) + np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = to


def _survivors(table: pa.Table, least: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of each bucket, compared step by step and pruned, at the first of the bands that they share."""
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), "<u2").reshape(-1, HASHES)
    keys, band = sig.view("<u8"), table["band"].to_numpy()
    own = keys[np.arange(len(keys)), band]
    for a, b in _pairs(table, _starts(table, "bucket")):
        same = (band[a] == band[b]) & (own[a] == own[b])  # buckets are hashes
        a, b = a[same], b[same]
        for earlier in range(int(band[a].max(initial=0))):
            new = (keys[a, earlier] != keys[b, earlier]) | (band[a] <= earlier)
            a, b = a[new], b[new]
        matches = np.zeros(len(a), np.int64)
        for k, fewest in enumerate(least):
            if not len(a):
                break
            matches += (sig[a, k * STEP : (k + 1) * STEP] == sig[b, k * STEP : (k + 1) * STEP]).sum(1)
            possible = matches >= fewest
            a, b, matches = a[possible], b[possible], matches[possible]
        if len(a):
            yield a, b


DEALT = "bucket long, band int, lo int, hi int, block int, node binary, sig binary"


def _prune(threshold: float, tolerance: float):
    """The rows of each pair of blocks that have a pair left there."""
    least = least_matches(threshold, tolerance)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "bucket", 20_000):
            needed = np.zeros(table.num_rows, bool)
            for a, b in _survivors(table, least):
                needed[a] = needed[b] = True
            yield from table.filter(pa.array(needed)).to_batches()

    return prune


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many n-grams the sets of each pair share: one by one where pairs are few, else by products of incidence matrices."""
    if len(a) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)])
    values, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, code, seen = np.unique(values, return_inverse=True, return_counts=True)
    column = np.cumsum(seen > 1) - 1
    shared = seen[code] > 1
    code, row = column[code[shared]], row[shared]
    order = np.argsort(code, kind="stable")
    code, row, common = code[order], row[order], np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        i, j = np.searchsorted(code, (low, low + 4096))
        x = np.zeros((len(sets), min(4096, int(code[-1]) + 1 - low)), np.float32)
        x[row[i:j], code[i:j] - low] = 1
        common += x @ x.T
    return common[a, b]


VERIFIED = "node binary, links long, root binary"


def _verify(threshold: float, tolerance: float):
    """Exact similarity of the pairs that are left in a pair of blocks; what links join comes out as stars, a row per document."""
    least = least_matches(threshold, tolerance)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "bucket", 1):
            found = list(_survivors(table, least))
            a, b = (np.concatenate([x[k] for x in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
            grams = [np.frombuffer(x.as_py(), "<u8") for x in table["shingles"].combine_chunks()]
            sizes, copies = np.array([len(g) for g in grams]), table["copies"].to_numpy()
            # what no chain of pairs connects is compared apart
            parent = np.arange(table.num_rows)
            union(parent, a, b)
            part = roots(parent)
            order = np.argsort(part[a], kind="stable")
            a, b, linked = a[order], b[order], np.zeros(len(a), bool)
            cuts = np.flatnonzero(np.diff(part[a])) + 1
            for at, end in zip(np.r_[0, cuts], np.r_[cuts, len(a)], strict=True):
                places, local = np.unique(np.r_[a[at:end], b[at:end]], return_inverse=True)
                common = _common([grams[i] for i in places], local[: end - at], local[end - at :]) if end > at else np.zeros(0)
                linked[at:end] = common >= threshold * (sizes[a[at:end]] + sizes[b[at:end]] - common) - 1e-9
            a, b, parent = a[linked], b[linked], np.arange(table.num_rows)
            union(parent, a, b)
            links = np.bincount(a, copies[b], table.num_rows) + np.bincount(b, copies[a], table.num_rows)
            kept = np.flatnonzero(links)
            nodes = table["node"].combine_chunks()
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(kept)), pa.array(links[kept].astype(np.int64)), nodes.take(pa.array(roots(parent)[kept]))], names=["node", "links", "root"])

    return verify


def jaccard_join(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """``doc_id, class_id, n_links, node, root`` for every row of ``docs``.

    ``n_links`` counts the other rows whose word n-grams have a Jaccard similarity of at least ``threshold``, equal
    texts included; ``class_id`` is the least ``doc_id`` of all rows that links connect with this one; ``node`` is the digest of
    the text and ``root`` the least digest of the class. Words are
    those of :func:`split_words`; a text of fewer words than ``n`` is one gram. A text that is
    null or without words has no gram, no link and its own ``doc_id`` as class. Repeated rows are copies of each
    other; an empty table gives no row; other columns are not read.

    A pair of similarity ``threshold`` is missed if it shares no band (at most 5e-8) or is pruned, which at each of the
    eight steps has a chance of at most ``tolerance`` / (1 - ``threshold``), 5e-8 (``tolerance`` is a posterior under a
    uniform prior); more similar pairs are missed less often. A pair that is found always has the exact similarity.
    """
    work = Workspace(docs.sparkSession, "jaccard")
    rows = work.table(sketches(docs, n), "sketches")
    known = rows.where("node is not null and grams > 0").groupBy("node")
    nodes = work.table(known.agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("grams").alias("grams"), F.first("sig").alias("sig")), "nodes")
    bands = _bands(nodes)
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(BUCKET_BLOCK), F.sum("grams") / F.lit(GRAM_BLOCK))).cast("int")
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), parts.alias("parts")).where("n > 1")
    shared = work.table(shared, "shared")
    members = hub_join(bands.drop("grams"), shared, "bucket", "n", nodes.count())
    candidates = _blocks(members.join(nodes.select("node", "sig"), "node"))
    left = work.table(candidates.select(*[c.split()[0] for c in DEALT.split(", ")]).mapInArrow(_prune(threshold, tolerance), DEALT), "left")
    wanted = left.select("node").distinct().join(nodes.select("node", "first_id", "copies"), "node")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                grams = pa.array([g.tobytes() for g in word_grams(readable(batch.column(2)), n)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), grams], names=["node", "copies", "shingles"])

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).withColumn("text_node", F.unhex(F.md5("text")))
    picked = wanted.join(texts, (F.col("node") == F.col("text_node")) & F.col("first_id").eqNullSafe(F.col("doc_id"))).dropDuplicates(["node"])
    shingled = work.table(picked.select("node", "copies", "text").mapInArrow(shingle, "node binary, copies long, shingles binary"), "shingled")
    verified = work.table(_sorted(left.join(shingled, "node")).mapInArrow(_verify(threshold, tolerance), VERIFIED), "verified")
    work.drop("shared", "left", "shingled")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    joined = connected_components(work, verified.select(F.col("node").alias("a"), F.col("root").alias("b")), "stars")
    whole = nodes.select("node", "first_id", "copies").join(links, "node", "left").join(joined, "node", "left")
    labelled = whole.select("node", "first_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    labelled = work.table(labelled, "labelled")
    classes = labelled.groupBy("root").agg(F.min("first_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    final = work.table(hub_join(labelled, classes, "root", "n", nodes.count()).select("node", "class_id", "n_links", "root", "copies"), "final")
    work.drop("nodes", "verified", "labelled")
    out = hub_join(rows.select("doc_id", "node"), final, "node", "copies", rows.count(), "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "node", "root")


def keep_one_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the row with the least ``doc_id`` (then digest) stays.

    Rows with equal ``doc_id`` and text are one document. Texts without words have no class and stay, as do null ones; all
    columns come back as they were, whatever their names; an empty table gives no row.
    """
    work = Workspace(docs.sparkSession, "keep")
    key = lambda node: F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.hex(node), F.lit("-")))
    rows = work.table(jaccard_join(docs), "classes")
    best = rows.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("best")).select("best.*")
    kept = best.union(rows.where("root is null").select("doc_id", "node")).select(key(F.col("node")).alias("_keep_key")).distinct()
    keyed = docs.withColumn("_keep_key", key(F.unhex(F.md5("text"))))
    return keyed.join(kept, "_keep_key", "left_semi").dropDuplicates(["_keep_key"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
