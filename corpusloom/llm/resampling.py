"""Importance resampling of documents towards a target's distribution of hashed word n-grams.

A block of texts becomes an array of word numbers. Its suffixes are sorted by their first words (a suffix array, as deep as
the longest feature), so that every repeated n-gram is a run of suffixes with a common prefix of n words. A run is hashed
once, its bucket is scattered to all its places, and what is counted or scored reads the buckets place by place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import Workspace, read_table

LONGEST, BUCKETS, SEED, PERCENT, LEAST_WORDS = 3, 10_000, 42, 5, 20
#: Bytes of texts that are cut into words together, and suffixes that are sorted together.
BLOCK_BYTES, WINDOW = 8 << 20, 1 << 20
_BYTES = np.arange(256)
#: Fixed by the contract: bytes of words, A to Z in lower case.
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
IN_WORD = (_BYTES >= 0x80) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((LOWER >= 0x61) & (LOWER <= 0x7A))
#: CRC-32 is linear: a byte's effect, by value.
_CRC = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, as bytes, one after another, and how many each text has."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = IN_WORD[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < ends[1:]]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    kept = np.cumsum(inside)  # bytes of words up to each place
    offsets = np.r_[kept[starts] - 1, kept[-1] if len(kept) else 0].astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(LOWER[raw[inside]])])
    return words, np.diff(np.searchsorted(starts, ends))


@lru_cache(maxsize=4096)
def _zeros(n: int) -> np.ndarray:
    """[byte of a CRC's four, its value]: what the CRC-32 register becomes by ``n`` zero bytes (linear, without its final inversion)."""
    if n == 0:
        return (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    if n == 1:
        c = _zeros(0)
        return _CRC[c & 255] ^ (c >> np.uint32(8))
    return _apply(_zeros(n - n // 2), _zeros(n // 2))


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> np.uint32(8)) & 255] ^ table[2][(crc >> np.uint32(16)) & 255] ^ table[3][crc >> np.uint32(24)]


def joined_crc(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings together, from the CRC-32 of each and the second one's length."""
    found, which = np.unique(length, return_inverse=True)
    tables = np.stack([_zeros(int(n)) for n in found]) if len(found) else np.zeros((0, 4, 256), np.uint32)
    return b ^ tables[which, 0, a & 255] ^ tables[which, 1, (a >> np.uint32(8)) & 255] ^ tables[which, 2, (a >> np.uint32(16)) & 255] ^ tables[which, 3, a >> np.uint32(24)]


def _suffix_array(key: np.ndarray, bits: int) -> np.ndarray:
    """The order of suffixes by their first words; ``key`` is [word, suffix]."""
    if bits * len(key) > 64:
        return np.lexsort(key[::-1])
    packed = np.zeros(key.shape[1], np.uint64)
    for row in key:
        packed = (packed << np.uint64(bits)) | row.astype(np.uint64)
    return np.argsort(packed, kind="stable")


def feature_buckets(texts: pa.Array, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and [n - 1, place of the first word] the bucket of each n-gram (-1 where a text ends before)."""
    words, counts = split_words(texts)
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.int64) + 1
    distinct = coded.dictionary.to_pylist()
    alone = np.array([0, *map(zlib.crc32, distinct)], np.uint32)
    behind = np.array([0, *(zlib.crc32(b" " + w) for w in distinct)], np.uint32)
    length = np.array([0, *(len(w) + 1 for w in distinct)], np.int64)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(ids))  # words from a place to its text's end
    ids = np.r_[ids, np.zeros(longest, np.int64)]
    out = np.full((longest, len(left)), -1, np.int32)
    for at in range(0, len(left), WINDOW):
        room = left[at : at + WINDOW]
        key = np.stack([np.where(room > k, ids[at + k : at + k + len(room)], 0) for k in range(longest)])
        order = _suffix_array(key, len(alone).bit_length())
        key = key[:, order]
        crc, run, parted = None, None, np.ones(len(order), bool)
        for n in range(1, longest + 1):
            # suffixes whose common prefix is shorter than n words begin another run
            parted[1:] = (key[n - 1, 1:] != key[n - 1, :-1]) | (parted[1:] if n > 1 else False)
            heads = np.flatnonzero(parted)
            word = key[n - 1, heads]
            crc = alone[word] if n == 1 else joined_crc(crc[run[heads]], behind[word], length[word])
            run = np.cumsum(parted) - 1
            out[n - 1, at + order] = np.where(key[n - 1] > 0, (crc % np.uint32(buckets)).astype(np.int32)[run], -1)
    return counts, out


def _slices(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    """Rows whose texts are of ``BLOCK_BYTES`` together, or one row."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK_BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, features``: how many features of all texts fall into each bucket that has any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in _slices(batches, 0):
            found = feature_buckets(batch.column(0), longest, buckets)[1]
            total += np.bincount(found[found >= 0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["bucket", "features"])

    counted = docs.select(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).mapInArrow(count, "bucket int, features long")
    return counted.groupBy("bucket").agg(F.sum("features").alias("features"))


def gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Per bucket 1000 times the logarithm of the target's smoothed share over the documents', rounded down.

    The counts come to the driver: ``buckets`` rows, whatever the tables hold.
    """
    s, t = (bucket_counts(x, longest, buckets).withColumnRenamed("features", k) for x, k in ((docs, "s"), (target, "t")))
    both = s.join(t, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")).toArrow()
    held = np.zeros((2, buckets))
    held[:, both["bucket"].to_numpy()] = both["s"].to_numpy(), both["t"].to_numpy()
    (own, aimed), (all_own, all_aimed) = held, held.sum(1)
    return np.floor(1000 * np.log(((aimed + 1) * (all_own + buckets)) / ((own + 1) * (all_aimed + buckets)))).astype(np.int64)


def importance(docs: DataFrame, weights: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row: the sum of its features' weights by bucket."""
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = np.r_[model.value, 0]  # the last for no feature
        for batch in _slices(batches, 1):
            counts, found = feature_buckets(batch.column(1), longest, len(worth) - 1)
            sums = np.concatenate([[0], np.cumsum(worth[found].sum(0))])
            ends = np.r_[0, np.cumsum(counts)]
            features = sum(np.maximum(counts - k, 0) for k in range(longest))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (counts, features, np.diff(sums[ends])))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("binary"), F.lit(b""))).mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def _noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise drawn from a digest of the id, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of ``docs``.

    Of the N rows with at least ``least_words`` words the floor(``percent`` N / 100) of the highest scores are drawn and
    ranked from 1, ties to the smaller id, then to fewer features, null ids last; the others' rank is null. A draw by
    weight and Gumbel noise equals one without replacement by the features' importance.

    A null text, and one without words, has no feature and weight 0; a null id is drawn for as an empty one; texts are
    read whole, whatever their length; repeated rows take part as rows of their own, with equal scores and
    neighbouring ranks; other columns are not read; an empty table gives no row, an empty target gains like any other.

    Ranks come from ranges of scores: each range is sorted in its own task, and its rows are numbered behind all
    earlier ranges' rows.
    """
    work = Workspace(docs.sparkSession, "resample")
    found = importance(docs, gains(docs, target, longest, buckets), longest)
    scored = work.table(found.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed)).withColumn("_row", F.monotonically_increasing_id()), "scored")
    enough = scored.where(F.col("n_words") >= least_words)
    drawn = enough.count() * percent // 100
    order = (F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("_row"))
    ranged = enough.repartitionByRange(*order).sortWithinPartitions(*order).select("_row", F.monotonically_increasing_id().alias("_at"))
    ranged = work.table(ranged.select("_row", F.shiftright("_at", 33).alias("_range"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_within")), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    # a row for each range, of which there are as many as shuffle partitions
    places = ranged.join(F.broadcast(before), "_range").select("_row", (F.col("_before") + F.col("_within") + 1).alias("rank")).where(F.col("rank") <= drawn)
    return scored.join(places, "_row", "left").drop("_row")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (read_table(spark, sf_dir, x) for x in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
