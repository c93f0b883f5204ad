"""Token counts without token ids: pieces are counted once per distinct pre-token and summed by pre-token frequencies.

Texts are cut where no piece of the vocabulary can span: before a run of spaces, around digits and line breaks. What
lies between two cuts, a pre-token, is merged by itself, so a text has as many pieces as its pre-tokens have together.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Workspace, read_table, readable
from corpusloom.llm.packing import vocabulary_path

VOCABULARY, LIMIT = "piece_bpe_32k.model", 4096
#: The vocabulary's sign for a space, and the pre-tokens of a text in which it stands for every space.
MARK = "▁"
PRE_TOKEN = re.compile("▁*[^▁0-9\n]+|▁+|[0-9\n]")
#: Bytes of text whose distinct pre-tokens and frequencies are held together.
BLOCK_BYTES = 8 << 20
#: Buckets that pre-tokens are dealt to: a block sends a list for each.
BUCKETS = 1024

_models: dict = {}


def model(vocabulary: str = VOCABULARY, folder: str | None = None):
    """The vocabulary's processor, once per worker; an error if one of its pieces spans two pre-tokens."""
    if (vocabulary, folder) not in _models:
        import sentencepiece

        found = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(vocabulary, folder))
        for i in range(found.get_piece_size()):
            if not (found.is_control(i) or found.is_unknown(i) or found.is_byte(i)) and PRE_TOKEN.findall(found.id_to_piece(i)) != [found.id_to_piece(i)]:
                raise ValueError(f"{found.id_to_piece(i)!r} of {vocabulary} spans two pre-tokens")
        _models[vocabulary, folder] = found
    return _models[vocabulary, folder]


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text; the vocabulary puts a space before every text that isn't empty."""
    return PRE_TOKEN.findall(MARK + text.replace(" ", MARK)) if text else []


def piece_counts(found: list[str], vocabulary: str = VOCABULARY, folder: str | None = None) -> list[int]:
    """Pieces of each pre-token. The library puts a space before what it reads: one that begins with a space gives
    its own for it, another is read behind a line break, whose two pieces are taken off."""
    sent = [x[1:] if x.startswith(MARK) else "\n" + x for x in found]
    return [1 if x == MARK else len(ids) - 2 * (x[0] != MARK) for x, ids in zip(found, model(vocabulary, folder).encode(sent, num_threads=1), strict=True)]


def _packed(values: np.ndarray) -> bytes:
    """Unsigned numbers, compressed with their lowest bytes first of all: the others are zeros mostly."""
    return pa.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    flat = pa.decompress(raw, 4 * n, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def _bucket(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode()) % buckets


class Block:
    """Documents, their distinct pre-tokens, and for each document which of them it holds how often."""

    def __init__(self):
        self.ids, self.n_bytes, self.size = [], [], 0
        self.words: dict[str, int] = {}
        self.places: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, doc_id: int | None, text: str) -> None:
        found, size = Counter(pre_tokens(text)), len(text.encode())
        self.ids.append(doc_id)
        self.n_bytes.append(size)
        self.size += size + 64
        self.places.append(np.fromiter((self.words.setdefault(x, len(self.words)) for x in found), np.int64, len(found)))
        self.times.append(np.fromiter(found.values(), np.int64, len(found)))

    def row(self, number: int, buckets: int) -> pa.RecordBatch:
        """The block: its pre-tokens in the order of bucket and text, a line each (the line break is the empty one), and
        for each document the gaps between the places of those it holds, and how often it holds them."""
        order = sorted(self.words, key=lambda x: (_bucket(x, buckets), x))
        place = np.empty(len(order), np.int64)
        place[[self.words[x] for x in order]] = np.arange(len(order))
        lists = [{"bucket": b, "words": "\n".join("" if x == "\n" else x for x in group).encode()} for b, group in groupby(order, lambda x: _bucket(x, buckets))]
        kinds, gaps, times = np.array([len(x) for x in self.places]), [], []
        for old, n in zip(self.places, self.times, strict=True):
            new = place[old]
            sort = np.argsort(new)
            gaps.append(np.diff(new[sort], prepend=0))
            times.append(n[sort])
        flat = lambda x: _packed(np.concatenate(x))
        values = [number, self.ids, self.n_bytes, lists, _packed(kinds), flat(gaps), flat(times)]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, TYPES, strict=True)], names=list(NAMES))


NAMES = ("block", "ids", "n_bytes", "lists", "kinds", "gaps", "times")
TYPES = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())])), pa.binary(), pa.binary(), pa.binary())
BLOCK = "block long, ids array<long>, n_bytes array<long>, lists array<struct<bucket:int,words:binary>>, kinds binary, gaps binary, times binary"
COUNTS = "doc_id long, n_bytes long, n_tokens long"


def _blocks(docs: DataFrame, block_bytes: int, buckets: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, block = TaskContext.get().partitionId() << 32, Block()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                for doc_id, text in zip(batch.column(0).to_pylist(), readable(batch.column(1)), strict=True):
                    block.add(doc_id, text.as_py() or "")
                    if block.size >= block_bytes:
                        yield block.row(number, buckets)
                        number, block = number + 1, Block()
        if block.ids:
            yield block.row(number, buckets)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(cut, BLOCK)


def _counted(lists: DataFrame, vocabulary: str, folder: str | None) -> DataFrame:
    """``of, bucket, n, pieces``: the pieces of each list's ``n`` pre-tokens. All lists of a bucket meet in a task, where a
    pre-token is counted once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        last = None
        for batch in batches:
            out = []
            for bucket, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if bucket != last:
                    known, last = {}, bucket
                words = [x or "\n" for x in raw.decode().split("\n")]
                if fresh := [x for x in words if x not in known]:
                    known.update(zip(fresh, piece_counts(fresh, vocabulary, folder), strict=True))
                out.append((len(words), _packed(np.array([known[x] for x in words]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["of", "bucket", "n", "pieces"])

    return lists.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(count, "of long, bucket int, n int, pieces binary")


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, folder: str | None = None, block_bytes: int = BLOCK_BYTES, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row: as many tokens as the library's ids of the whole text, never made.

    A null or empty text has none; what isn't UTF-8 is read as U+FFFD; a text is never cut, however long; repeated rows
    and ids, null included, are counted as rows of their own; other columns are not read; an empty table gives no row.

    A block of documents sends each of its pre-tokens once, in a list for each bucket, and gets a list of counts back, so
    the most frequent pre-token moves as often as there are blocks, whatever the documents repeat. ``buckets`` may grow
    with the corpus: a bucket's distinct pre-tokens are held together.
    """
    work = Workspace(docs.sparkSession, "tokens")
    blocks = work.table(_blocks(docs, block_bytes, buckets), "blocks")
    counted = _counted(blocks.select("block", F.inline("lists")).select("block", "bucket", "words"), vocabulary, folder)

    def add(block: pa.Table, counted: pa.Table) -> pa.Table:
        out = []
        lists = sorted(zip(counted["bucket"].to_pylist(), counted["pieces"].to_pylist(), counted["n"].to_pylist(), strict=True))
        pieces = np.concatenate([np.zeros(0, np.int64), *(_unpacked(raw, n) for _, raw, n in lists)])
        for row in block.to_pylist():
            kinds = _unpacked(row["kinds"], len(row["ids"]))
            ends = np.r_[0, np.cumsum(kinds)]
            gaps, times = (_unpacked(row[x], int(ends[-1])) for x in ("gaps", "times"))
            # places are sums of gaps within a document
            sums = np.cumsum(gaps)
            places = sums - np.repeat(np.r_[0, sums][ends[:-1]], kinds)
            total = np.r_[0, np.cumsum(pieces[places] * times)]
            out.append(pa.table([pa.array(row["ids"], pa.int64()), pa.array(row["n_bytes"], pa.int64()), pa.array(np.diff(total[ends]), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64())] * 3, names=["doc_id", "n_bytes", "n_tokens"])

    return blocks.drop("lists").groupBy("block").cogroup(counted.groupBy("of")).applyInArrow(add, COUNTS)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
