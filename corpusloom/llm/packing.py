"""Best-fit packing of tokenized documents into sequences of fixed capacity, with bounded space."""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Workspace, read_table, readable

CAPACITY, END_ID = 1024, 2
#: Open bins, and pieces that are placed together, the long ones first: fewer than bins, so that none closes for them.
OPEN_BINS, TOGETHER = 8192, 4096
#: Leftover bins of so many tasks meet in one task of the second round.
FAN_IN = 64
#: Fixed value: the pattern that splits text before the merges of the 50k byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = re.compile(r"<\|endoftext\|>")
#: White space runs of this length go through the JSON form: the rank form's splitter fails on about a million.
LONG_RUN = 100_000
_long_run = re.compile(r"(?<!\s)\s{%d}" % LONG_RUN)

_encoders: dict = {}


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """A public vocabulary file; the folder is a parameter (or ``CORPUSLOOM_TOKENIZERS``), files are never copied."""
    if folder or (folder := os.environ.get("CORPUSLOOM_TOKENIZERS")):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(folder: str | None = None):
    """``encode(text) -> uint32 ids``, once per worker.

    The merges run on the rank form of the vocabulary, which holds the same ids and is several times faster;
    texts that hold the special token's string go through the JSON form, which alone knows it, and so do those
    with a very long run of white space.
    """
    if folder not in _encoders:
        import tiktoken
        from tokenizers import Tokenizer

        with open(vocabulary_path("byte_bpe_50k.tiktoken", folder), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        fast = tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        whole = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json", folder))

        def encode(text: str) -> np.ndarray:
            if SPECIAL.search(text) or len(text) >= LONG_RUN and _long_run.search(text):
                return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
            return np.array(fast.encode_ordinary(text), np.uint32)

        _encoders[folder] = encode
    return _encoders[folder]


class BestFit:
    """Open bins by free space: bit f of ``free`` is set while some open bin has f places left.

    An item goes to the open bin with the least sufficient space; with ``limit`` bins open, the fullest one
    closes before another opens. Space is bounded by ``limit`` whatever the number of items.
    """

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.free, self.open, self.made = 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, space: int) -> int:
        found = self.bins[space].pop()
        if not self.bins[space]:
            self.free &= ~(1 << space)
        self.open -= 1
        return found

    def place(self, size: int) -> tuple[int, int]:
        """The bin's number and the offset in it."""
        fitting = self.free >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if size < self.capacity and self.open >= self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
            number, space = self.made, self.capacity
            self.made += 1
        if rest := space - size:
            self.bins[rest].append(number)
            self.free |= 1 << rest
            self.open += 1
        return number, self.capacity - space

    def left(self) -> list[int]:
        return [number for numbers in self.bins for number in numbers]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long"


def cut_and_place(docs: DataFrame, capacity: int, open_bins: int, folder: str | None) -> DataFrame:
    """First round: every task tokenizes, cuts and packs its own documents. ``left`` marks bins still open."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, base = encoder(folder), TaskContext.get().partitionId() << 36
        bins, waiting = BestFit(capacity, open_bins), []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

        def placed() -> pa.RecordBatch:
            waiting.sort(key=lambda x: -x[3])
            spots = [bins.place(x[3]) for x in waiting]
            rows = [(*x, base + number, offset) for x, (number, offset) in zip(waiting, spots, strict=True)]
            waiting.clear()
            return batch_of(rows)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), readable(batch.column(1)), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                end, piece = (len(ids) - 1) % capacity + 1, 0
                start = 0
                while start < len(ids):
                    waiting.append((doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start, end, piece = end, end + capacity, piece + 1
                if len(waiting) >= TOGETHER:
                    yield placed()
        yield placed()
        # A row without a document tells which bins are still open at the task's end.
        yield batch_of([(None, -1, 0, 0, 0, base + number, 0) for number in bins.left()])

    return docs.select("doc_id", "text").mapInArrow(pack, PIECES)


def pack_best_fit(docs: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, folder: str | None = None) -> DataFrame:
    """Packs every document, followed by the end id, into sequences of at most ``capacity`` ids.

    Documents above the capacity are cut into full pieces behind a first one that may be shorter. Bins that
    tasks leave open are packed once more as wholes, ``FAN_IN`` tasks to one. The pieces are staged, so a lost
    executor can't renumber a bin that others refer to. A null or empty text is the end id alone; repeated
    rows and ids, null included, are packed as rows of their own; an empty table gives no row; other columns
    are not read.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "pack")
    placed = work.table(cut_and_place(docs, capacity, open_bins, folder), "pieces")
    pieces, marks = placed.where("piece >= 0"), placed.where("piece < 0").select("bin")
    # used places of the open bins only
    used = pieces.join(marks, "bin", "left_semi").groupBy("bin").agg(F.sum("length").alias("used"))

    def pack_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, bins = (1 << 62) + (TaskContext.get().partitionId() << 36), BestFit(capacity, 1 << 20)
        for batch in batches:
            placed = [bins.place(n) for n in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([base + x[0] for x in placed], pa.int64()), pa.array([x[1] for x in placed], pa.int64())], names=["bin", "sequence_id", "base"])

    partition = F.shiftright("bin", 36)
    grouped = used.withColumn("part", F.floor(partition / FAN_IN)).repartition("part").sortWithinPartitions("part", F.desc("used"), "bin").select("bin", "used")
    moved = work.table(grouped.mapInArrow(pack_bins, "bin long, sequence_id long, base long"), "moved")
    joined = pieces.join(moved, "bin", "left")
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(read_table(spark, sf_dir, "documents"))
