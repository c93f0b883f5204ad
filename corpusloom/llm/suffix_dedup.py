"""Removal of byte strings that occur more than once, by a distributed difference-cover suffix sort.

A string of ``LENGTH`` bytes is repeated if and only if its suffix has a neighbour, in the sorted order of all suffixes, that
shares its first ``LENGTH`` bytes. So suffixes are sorted by as much of their beginning as that takes:

1. Suffixes at a difference cover of the positions are the sample: if two strings are equal, a suffix of the sample starts
   at the same place in both. Their first ``PERIOD`` bytes, a tuple, are sorted, and each tuple that isn't alone is
   named by its rank.
2. The names of a text at positions that are ``PERIOD`` apart form a string of their own. Its suffixes are sorted by
   triples of names: what isn't alone there shares ``3 * PERIOD`` bytes with another suffix of the sample.
3. The remaining suffixes, those that start at most a period before such a one, are merged into one order.
4. Neighbours of equal name are compared byte by byte. A suffix whose string isn't equal to its neighbour's, although
   its name is, is sorted once more together with all of that name, by its bytes themselves.

Tuples are ordered by 48-bit numbers made of their bytes, and remaining suffixes by 64-bit ones, instead of alphabetically: then
neighbours in the order are found by sending numbers and not strings. Different strings of one number only propose more in
1 to 3, and 4 tells them apart, so the result is exact whatever the numbers are.

Texts are staged as blocks of about ``BLOCK`` bytes. A block sends each of its numbers once to the task that owns its
part of their range, so a string that occurs everywhere costs a row per block; strings are compared between a
block and the one before it that has them too. An answer holds its neighbours' blocks as two packed lists, so what it
takes depends on the names in it and not on the number of pairs of blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Workspace, read_table, settings
from corpusloom.llm.components import hub_join

LENGTH = 200
#: Fixed value: a difference cover. Any two residues modulo 50 have a shift of at most 49 that brings both into it.
PERIOD, COVER = 50, (0, 1, 3, 8, 17, 28, 32, 38)
#: A sampled suffix and its triple of tuples lie within the string whatever the shift.
TRIPLE = 3 * PERIOD
#: Bytes of text in a block, positions numbered at once (their arrays fit a core's cache), bytes of text for each part of the numbers.
BLOCK, SLICE, PART_BYTES = 4 << 20, 1 << 16, 16 << 20
#: Positions that a part of the remaining suffixes' numbers is meant for: as many as a part has of the sample.
PART_NAMES = PART_BYTES * len(COVER) // PERIOD
#: While a result is made, a batch that goes to Python ends at a block's bytes, however many texts or blocks a task reads.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BLOCK)}
#: A row that holds a block, or lists of its positions, is a row group: it is written and read by itself, and splits end between blocks.
BY_ROW = {"compression": "zstd", "parquet.block.row.count.limit": "1"}
#: Bits of the numbers of tuples and triples, and of remaining suffixes.
SAMPLE_BITS, BITS = 48, 64

if len({(a - b) % PERIOD for a in COVER for b in COVER}) != PERIOD or TRIPLE + PERIOD - 1 > LENGTH:
    raise ValueError("not a difference cover")


def _fold(x: np.ndarray, second: int, third: int, odd: int) -> np.ndarray:
    """Numbers of longer prefixes from those at a position and at two further ones."""
    n, bits = len(x) - third, np.uint64(29)
    out = x[:n] * np.uint64(odd)
    out ^= out >> bits
    out += x[second : second + n]
    out *= np.uint64(odd ^ 0x5BD1E994)
    out ^= out >> bits
    out += x[third:]
    out *= np.uint64(odd)
    out ^= out >> bits
    return out


def _numbers(buffer: np.ndarray, upto: int) -> np.ndarray:
    """Numbers of all prefixes of ``upto`` bytes, by tripling."""
    top, seed = (1 << 64) - 1, 0x9E3779B97F4A7C15
    x = buffer.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed)
    x ^= x >> np.uint64(33)
    size, odd = 1, seed
    while 3 * size <= upto:
        x, size, odd = _fold(x, size, 2 * size, (odd * 5 + 2) & top | 1), 3 * size, (odd * 7 + 4) & top | 1
    if size < upto:  # the last triple overlaps
        x = _fold(x, min(size, upto - size), upto - size, odd)
    return x


def _least_bits(x: np.ndarray, bits: int) -> np.ndarray:
    return x >> np.uint64(64 - bits) if bits else np.zeros_like(x)


class Block:
    """The texts of a block one after the other, looked at in slices that overlap by a string's length."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)

    def at(self, positions: np.ndarray, length: int, bits: int) -> np.ndarray:
        """Numbers of the prefixes at these ascending positions."""
        out = np.zeros(len(positions), np.uint64)
        for low in range(0, len(self.bytes), SLICE):
            i, j = np.searchsorted(positions, (low, low + SLICE))
            if i < j:
                first = positions[i]
                out[i:j] = _numbers(self.bytes[first : positions[j - 1] + length], length)[positions[i:j] - first]
        return _least_bits(out, bits)

    def sample(self) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions, ascending: of texts that can hold a string those that have a tuple left; and each one's text."""
        out, texts = [], []
        for k in np.flatnonzero(self.sizes >= LENGTH):
            places = (np.arange(0, self.sizes[k], PERIOD)[:, None] + np.array(COVER)).ravel()
            places = places[places <= self.sizes[k] - PERIOD]
            out.append(places + self.starts[k])
            texts.append(np.full(len(places), k))
        empty = np.zeros(0, np.int64)
        return np.concatenate(out or [empty]), np.concatenate(texts or [empty])

    def triples(self, names: np.ndarray, left_out: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions whose three tuples all have names (0: none), outside texts left out, and the numbers of the triples."""
        positions, text = self.sample()
        n = max(0, len(positions) - 2 * len(COVER))
        second, third = slice(len(COVER), len(COVER) + n), slice(2 * len(COVER), 2 * len(COVER) + n)
        # the cover's residues come around again in each period of a text, so the next tuples stand this much further
        inside = (text[:n] == text[third]) & ~left_out[text[:n]] & (names[:n] > 0) & (names[second] > 0) & (names[third] > 0)
        kept = np.flatnonzero(inside)
        x = names[kept] * np.uint64(0x9E3779B97F4A7C15)
        for more in (names[kept + len(COVER)], names[kept + 2 * len(COVER)]):
            x ^= x >> np.uint64(29)
            x = (x + more) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        return positions[kept], _least_bits(x * np.uint64(0x94D049BB133111EB), bits)

    def remaining(self, repeated: np.ndarray) -> np.ndarray:
        """Positions that can start a repeated string: at most a period before a sampled suffix that isn't alone."""
        edge = np.zeros(len(self.bytes) + 1, np.int32)
        np.add.at(edge, np.maximum(repeated - PERIOD + 1, 0), 1)
        np.add.at(edge, repeated + 1, -1)
        near = np.cumsum(edge[:-1]) > 0
        for at, size in zip(self.starts[:-1], self.sizes, strict=True):
            near[max(at, at + size - LENGTH + 1) : at + size] = False
        return np.flatnonzero(near)


def _differ(mine: np.ndarray, q: np.ndarray, theirs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which strings of ``mine`` at ascending ``q`` differ from those of ``theirs`` at ``at``; bytes that strings share are read once."""
    if not len(q):
        return np.zeros(0, bool)
    step = np.diff(q)
    step = np.where((step <= LENGTH) & (np.diff(at) == step), step, LENGTH)
    begin, size = np.r_[0, np.cumsum(step)], np.r_[step, LENGTH]
    places = np.arange(begin[-1] + LENGTH)
    unlike = mine[np.repeat(q - begin, size) + places] != theirs[np.repeat(at - begin, size) + places]
    seen = np.r_[0, np.cumsum(unlike)]
    return seen[begin + LENGTH] > seen[begin]


def _extract(buffer: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the strings at these positions, shared ones once, and where each string starts in them."""
    order = np.argsort(positions, kind="stable")
    p = positions[order]
    step = np.minimum(np.diff(p), LENGTH)
    begin, size = np.r_[0, np.cumsum(step)].astype(np.int64), np.r_[step, LENGTH]
    at = np.empty(len(p), np.int64)
    at[order] = begin
    return buffer[np.repeat(p - begin, size) + np.arange(begin[-1] + LENGTH)], at


SENT = "part int, block long, names binary, many binary"
#: What a part tells a block, in one row: which of the names it sent are repeated; their ranks; which names it shares as
#: a neighbour with a block before and behind it, and which blocks these are.
ANSWER = "block long, part int, bits binary, ranks binary, before binary, behind binary"


def _encode(names: np.ndarray) -> bytes:
    """Sorted names as the bytes of their differences, equal bytes of all names together, so that they compress."""
    steps = np.diff(names)
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + names[:1].astype("<u8").tobytes() + planes.tobytes()


def _decode(blob: bytes) -> np.ndarray:
    if len(blob) < 9:
        return np.zeros(0, np.uint64)
    width = blob[0]
    n = 1 + (len(blob) - 9) // width
    steps = np.zeros((n - 1, 8), np.uint8)
    steps[:, :width] = np.frombuffer(blob, np.uint8, width * (n - 1), 9).reshape(width, n - 1).T
    return np.concatenate([np.frombuffer(blob, "<u8", 1, 1), steps.view("<u8").ravel()]).cumsum(dtype=np.uint64)


def _bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _pack_blocks(blocks: np.ndarray) -> bytes:
    """Numbers of blocks, -1 for none: a bit for each place, then those there are, in the least bytes that hold them."""
    there = blocks >= 0
    high, low = blocks[there] >> 32, blocks[there] & 0xFFFFFFFF
    shift = int(low.max(initial=0)).bit_length()
    short = (high << shift) | low
    width = (int(short.max(initial=0)).bit_length() + 7) // 8
    planes = short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([shift, width]) + np.packbits(there).tobytes() + planes.tobytes()


def _unpack_blocks(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ``n`` places those that have a block, and the blocks."""
    shift, width, begin = blob[0], blob[1], 2 + -(-n // 8)
    places = np.flatnonzero(_bits(blob[2:begin], n))
    short = np.zeros((len(places), 8), np.uint8)
    short[:, :width] = np.frombuffer(blob, np.uint8, -1, begin).reshape(width, len(places)).T if width else 0
    short = short.view("<i8").ravel()
    return places, (short >> shift << 32) | (short & ((1 << shift) - 1))


class Distinct:
    """A block's names: the distinct ones ascending, where each occurs first, and the place of each name among them."""

    def __init__(self, names: np.ndarray, parts: int, bits: int):
        order = np.argsort(names, kind="stable")
        ranked = names[order]
        new = np.ones(len(names), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        starts = np.flatnonzero(new)
        self.names, self.first, self.many = ranked[starts], order[starts], np.diff(np.r_[starts, len(names)]) > 1
        self.place = np.empty(len(names), np.int64)
        self.place[order] = np.cumsum(new) - 1
        bounds = np.array([(k << bits) // parts for k in range(1, parts)], np.uint64)
        #: Where each part of the range of names begins.
        self.cuts = np.r_[0, np.searchsorted(self.names, bounds), len(self.names)]

    def sent(self, block: int) -> Iterator[pa.RecordBatch]:
        rows = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)) if a < b]
        if rows:
            columns = ([k for k, _ in rows], [block] * len(rows), [_encode(self.names[x]) for _, x in rows], [np.packbits(self.many[x]).tobytes() for _, x in rows])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "block", "names", "many"])

    def repeated(self, answers: list[dict]) -> np.ndarray:
        out = np.zeros(len(self.names), bool)
        for x in answers:
            low, high = self.cuts[x["part"]], self.cuts[x["part"] + 1]
            out[low:high] = _bits(x["bits"], high - low)
        return out

    def ranks(self, answers: list[dict]) -> np.ndarray:
        """Of each distinct name its rank among the repeated ones of all blocks, from 1; 0 for those that are alone."""
        out = np.zeros(len(self.names), np.uint64)
        for x in answers:
            low, high = self.cuts[x["part"]], self.cuts[x["part"] + 1]
            # parts hold ascending ranges, so a part's number before the rank in it makes a rank in all
            out[low:high][_bits(x["bits"], high - low)] = (np.uint64(x["part"] << 32) | _decode(x["ranks"])) + np.uint64(1)
        return out

    def shared(self, answers: list[dict], side: str) -> dict[int, np.ndarray]:
        """For each block before or behind this one the places, ascending, of the names that both share as neighbours."""
        places, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x in sorted(answers, key=lambda x: x["part"]):
            low, high = self.cuts[x["part"]], self.cuts[x["part"] + 1]
            at, blocks = _unpack_blocks(x[side], high - low)
            places.append(low + at)
            others.append(blocks)
        places, others = np.concatenate(places), np.concatenate(others)
        order = np.argsort(others, kind="stable")
        places, others = places[order], others[order]
        cuts = np.flatnonzero(np.diff(others)) + 1
        return {int(others[a]): places[a:b] for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(others)], strict=True) if a < b}


def _merge(with_ranks: bool, with_neighbours: bool):
    """Sorts the names of a part, of all blocks, and looks at neighbours."""

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        blocks, part = table["block"].to_numpy(), table["part"][0].as_py()
        lists = [_decode(blob.as_py()) for blob in table["names"]]
        sizes = np.array([len(x) for x in lists])
        begins = np.r_[0, np.cumsum(sizes)]
        names = np.concatenate(lists)
        many = np.concatenate([_bits(m.as_py(), n) for m, n in zip(table["many"], sizes, strict=True)])
        order = np.argsort(names, kind="stable")  # of equal names, those of earlier blocks come first
        equal = names[order][1:] == names[order][:-1]
        repeated = many
        repeated[order[1:][equal]] = True
        repeated[order[:-1][equal]] = True
        ranks = np.zeros(len(names) if with_ranks else 0, np.uint64)
        if with_ranks:
            ranks[order] = np.cumsum(np.r_[True, ~equal][: len(names)]) - 1
        before, behind = (np.full(len(names) if with_neighbours else 0, -1) for _ in range(2))
        if with_neighbours:
            owner, one, two = np.repeat(blocks, sizes), order[:-1][equal], order[1:][equal]
            before[two], behind[one] = owner[one], owner[two]
        rows = []
        for k, (a, b) in enumerate(zip(begins[:-1], begins[1:], strict=True)):
            own = _encode(ranks[a:b][repeated[a:b]]) if with_ranks else b""
            near = [_pack_blocks(x[a:b]) if with_neighbours else b"" for x in (before, behind)]
            rows.append((blocks[k], part, np.packbits(repeated[a:b]).tobytes(), own, *near))
        return _table(rows, ANSWER)

    return merge


BLOCKS = "block long, doc_ids array<long>, texts array<binary>"


def text_blocks(docs: DataFrame) -> DataFrame:
    """Whole texts as bytes, gathered into rows of about ``BLOCK`` bytes; a longer text is a row of its own."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.binary()))], names=["block", "doc_ids", "texts"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_py() or b""
                if held + len(raw) > BLOCK and ids:
                    yield row()
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(doc_id)
                texts.append(raw)
                held += len(raw)
        if ids:
            yield row()

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(gather, BLOCKS)


def _copies(blocks: DataFrame, n_texts: int) -> DataFrame:
    """``block, copies``: the texts of a block that have equal ones elsewhere, as twice their place, plus 1 for the first of all."""
    texts = blocks.select("block", F.posexplode("texts").alias("place", "text")).select("block", "place", F.sha2("text", 256).alias("digest"))
    classes = texts.groupBy("digest").agg(F.min(F.struct("block", "place")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = hub_join(texts, classes, "digest", "n", n_texts)
    found = joined.withColumn("is_first", (F.col("first") == F.struct("block", "place")).cast("long"))
    return found.groupBy("block").agg(F.collect_list(F.col("place") * 2 + F.col("is_first")).alias("copies"))


MARKED = "block long, repeated binary, copies binary"
STRINGS = "block long, other long, at binary, text binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _rows(block: Block, doc_ids: list, starts: np.ndarray, copied: np.ndarray) -> list[tuple]:
    """The result's rows of a block, from where repeated strings start and which texts have copies."""
    edge = np.zeros(len(block.bytes) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + LENGTH, -1)
    gone = np.cumsum(edge[:-1]) > 0
    for k in copied:
        if block.sizes[k] >= LENGTH:
            gone[block.starts[k] : block.starts[k + 1]] = True
    out = []
    for doc_id, at, size in zip(doc_ids, block.starts[:-1], block.sizes, strict=True):
        mine = gone[at : at + size]
        spans = int(np.count_nonzero(mine[1:] & ~mine[:-1]) + (size > 0 and mine[0]))
        out.append((doc_id, int(size), int(mine.sum()), spans, hashlib.sha256(block.bytes[at : at + size][~mine].tobytes()).hexdigest()))
    return out


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    kinds |= {f"array<{k}>": pa.list_(t) for k, t in kinds.items()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def remove_repeats(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``, texts as their bytes (UTF-8 or not).

    A byte is removed if a string of ``LENGTH`` bytes that covers it starts anywhere else, in the same text or another;
    strings are judged on the input. Repeated rows are each other's copies and lose all bytes from ``LENGTH`` on; a
    null text is empty; texts below ``LENGTH`` bytes lose nothing; a null ``doc_id`` stays null; an empty table gives
    no row; other columns are not read. ``bits`` of the numbers that suffixes are sorted by: with
    fewer, more strings are compared in vain, and the result is the same.
    """
    with settings(docs.sparkSession, BATCHES):
        return _without_repeats(docs, bits)


def _without_repeats(docs: DataFrame, bits: int) -> DataFrame:
    work = Workspace(docs.sparkSession, "suffix")
    blocks = work.table(text_blocks(docs), "blocks", **BY_ROW)
    size = F.aggregate("texts", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t))
    total, n_texts = (x or 0 for x in blocks.agg(F.sum(size), F.sum(F.size("doc_ids"))).first())
    parts, sample_bits = max(8, -(-total // PART_BYTES)), min(bits, SAMPLE_BITS)

    def merged(sent: DataFrame, name: str, with_ranks: bool = False, with_neighbours: bool = False, **options: str) -> DataFrame:
        return work.table(sent.groupBy("part").applyInArrow(_merge(with_ranks, with_neighbours), ANSWER), name, **options)

    def met(answers: DataFrame, function, schema: str, left: DataFrame = blocks) -> DataFrame:
        """Each block with what it was told."""
        return left.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(function, schema)

    def tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch.column(1)[row].as_py())
                yield from Distinct(block.at(block.sample()[0], PERIOD, sample_bits), parts, sample_bits).sent(batch.column(0)[row].as_py())

    def triples(left: pa.Table, right: pa.Table) -> pa.Table:
        block, answers = Block(left["texts"][0].as_py()), right.to_pylist()
        own = Distinct(block.at(block.sample()[0], PERIOD, sample_bits), parts, sample_bits)
        names = own.ranks([x for x in answers if x["part"] is not None])[own.place]
        # of texts with copies one text of each class stands for all
        copies = np.array([x for row in answers if row["part"] is None for x in row["copies"]], np.int64)
        others = np.zeros(len(block.sizes), bool)
        others[copies[copies % 2 == 0] // 2] = True
        positions, numbers = block.triples(names, others, sample_bits)
        raw = (positions.astype("<i4").tobytes(), numbers.astype("<u8").tobytes(), (copies // 2).astype("<i8").tobytes())
        return _table([(left["block"][0].as_py(), *raw)], "block long, positions binary, numbers binary, copies binary")

    def names_of_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, names in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from Distinct(np.frombuffer(names.as_py(), "<u8"), parts, sample_bits).sent(number)

    def repeated(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Distinct(np.frombuffer(left["numbers"][0].as_py(), "<u8"), parts, sample_bits)
        kept = np.frombuffer(left["positions"][0].as_py(), "<i4")[own.repeated(right.to_pylist())[own.place]]
        near = int(np.minimum(np.diff(kept), PERIOD).sum()) + PERIOD * (len(kept) > 0)
        return _table([(left["block"][0].as_py(), kept.tobytes(), left["copies"][0].as_py(), near)], f"{MARKED}, near long")

    told = merged(blocks.select("block", "texts").mapInArrow(tuples, SENT), "tuples", with_ranks=True).withColumn("copies", F.lit(None).cast("array<long>"))
    known = told.unionByName(_copies(blocks, n_texts), allowMissingColumns=True)
    second = work.table(met(known, triples, "block long, positions binary, numbers binary, copies binary"), "second", **BY_ROW)
    answers = merged(second.select("block", "numbers").mapInArrow(names_of_triples, SENT), "triples")
    marked = work.table(met(answers, repeated, f"{MARKED}, near long", second), "marked", **BY_ROW)
    work.drop("tuples", "second", "triples")
    # their number depends on the texts, so these have parts of their own
    last_parts = max(8, -(-(marked.agg(F.sum("near")).first()[0] or 0) // PART_NAMES))
    marked = marked.drop("near")

    def suffixes(texts: pa.Table, mark: dict) -> tuple[Block, np.ndarray, Distinct]:
        block = Block(texts["texts"][0].as_py())
        positions = block.remaining(np.frombuffer(mark["repeated"], "<i4").astype(np.int64))
        return block, positions, Distinct(block.at(positions, LENGTH, bits), last_parts, bits)

    def remaining(left: pa.Table, right: pa.Table) -> pa.Table:
        batches = list(suffixes(left, right.to_pylist()[0])[2].sent(left["block"][0].as_py()))
        return pa.Table.from_batches(batches) if batches else _table([], SENT)

    answers = merged(met(marked, remaining, SENT), "merged", with_neighbours=True, compression="zstd")
    # every row that tells a block of its own names goes with it from here on
    for_block = answers.withColumn("repeated", F.lit(None).cast("binary")).withColumn("copies", F.lit(None).cast("binary")).unionByName(marked, allowMissingColumns=True)

    def split(right: pa.Table) -> tuple[dict, list[dict], list[dict]]:
        rows = right.to_pylist()
        mark = next(r for r in rows if r["repeated"] is not None)
        return mark, [r for r in rows if r["part"] is not None], [r for r in rows if r.get("text") is not None]

    def strings(left: pa.Table, right: pa.Table) -> pa.Table:
        """For each block behind this one that shares names with it as a neighbour, the strings of these names."""
        mark, told, _ = split(right)
        block, positions, own = suffixes(left, mark)
        rows = []
        for other, places in own.shared(told, "behind").items():
            text, at = _extract(block.bytes, positions[own.first[places]])
            rows.append((other, left["block"][0].as_py(), at.astype("<i4").tobytes(), text.tobytes()))
        return _table(rows, STRINGS)

    sent = work.table(met(for_block, strings, STRINGS), "strings", compression="zstd")
    compared = for_block.unionByName(sent, allowMissingColumns=True)

    def false_names(block: Block, positions: np.ndarray, own: Distinct, told: list[dict], received: list[dict]) -> np.ndarray:
        """Names under which strings stand that aren't equal: in this block, or here and in the block before."""
        out = [np.zeros(0, np.uint64)]
        first = positions[own.first[own.place]]
        again = np.flatnonzero(first != positions)
        out.append(own.names[own.place[again[_differ(block.bytes, positions[again], block.bytes, first[again])]]])
        mine = own.shared(told, "before")
        for row in received:
            places = mine[row["other"]]
            q, at = positions[own.first[places]], np.frombuffer(row["at"], "<i4").astype(np.int64)
            order = np.argsort(q, kind="stable")
            unlike = _differ(block.bytes, q[order], np.frombuffer(row["text"], np.uint8), at[order])
            out.append(own.names[places[order[unlike]]])
        return np.unique(np.concatenate(out))

    def judged(left: pa.Table, right: pa.Table) -> pa.Table:
        mark, told, received = split(right)
        block, positions, own = suffixes(left, mark)
        wrong = false_names(block, positions, own, told, received)
        starts = positions[own.repeated(told)[own.place]]
        rows = _rows(block, left["doc_ids"][0].as_py(), starts, np.frombuffer(mark["copies"], "<i8"))
        return _table([(*r, wrong.tobytes() if not k and len(wrong) else None) for k, r in enumerate(rows)], f"{RESULT}, wrong binary")

    result = work.table(met(compared, judged, f"{RESULT}, wrong binary"), "result")
    work.drop("strings")
    wrong = result.where("wrong is not null")
    if not wrong.isEmpty():
        result = work.table(_by_bytes(work, blocks, for_block, wrong, last_parts, bits, met, split, suffixes), "exact")
    work.drop("blocks", "marked", "merged")
    return result.drop("wrong")


def _by_bytes(work: Workspace, blocks: DataFrame, for_block: DataFrame, wrong: DataFrame, parts: int, bits: int, met, split, suffixes) -> DataFrame:
    """The result where some names stand for several strings: all strings of these names are grouped by their bytes."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                names = np.frombuffer(raw.as_py(), "<u8")
                own = Distinct(names, parts, bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(parts), np.diff(own.cuts)).astype(np.int32)), pa.array(own.names.view(np.int64))], names=["part", "name"])

    names = work.table(wrong.select("wrong").mapInArrow(numbered, "part int, name long").distinct(), "wrong")

    def asked(left: pa.Table, right: pa.Table) -> pa.Table:
        mark, _, _ = split(right)
        batches = list(suffixes(left, mark)[2].sent(left["block"][0].as_py()))
        return pa.Table.from_batches(batches) if batches else _table([], SENT)

    def known(left: pa.Table, right: pa.Table) -> pa.Table:
        """Which names of each block are among the wrong ones."""
        listed = np.sort(right["name"].to_numpy().view(np.uint64))
        rows = []
        for block, part, blob in zip(left["block"].to_pylist(), left["part"].to_pylist(), left["names"], strict=True):
            found = np.isin(_decode(blob.as_py()), listed)
            rows.append((block, part, np.packbits(found).tobytes()))
        return _table(rows, "block long, part int, bits binary")

    sent = met(for_block, asked, SENT)
    told = work.table(sent.groupBy("part").cogroup(names.groupBy("part")).applyInArrow(known, "block long, part int, bits binary"), "told").select("block", F.col("part").alias("at_part"), F.col("bits").alias("is_wrong"))
    with_wrong = for_block.unionByName(told, allowMissingColumns=True)

    def unsure(left: pa.Table, right: pa.Table):
        mark, told, _ = split(right)
        block, positions, own = suffixes(left, mark)
        rows = [{"part": r["at_part"], "bits": r["is_wrong"]} for r in right.to_pylist() if r["is_wrong"] is not None]
        return mark, told, block, positions, own, own.repeated(rows)[own.place]

    def spelled(left: pa.Table, right: pa.Table) -> pa.Table:
        _, _, block, positions, _, doubtful = unsure(left, right)
        number = left["block"][0].as_py()
        return _table([(number, int(p), block.bytes[p : p + LENGTH].tobytes()) for p in positions[doubtful]], "block long, position int, string binary")

    strings = work.table(met(with_wrong, spelled, "block long, position int, string binary"), "spelled")
    counts = work.table(strings.groupBy("string").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
    exact = hub_join(strings, counts, "string", "n", strings.count()).groupBy("block").agg(F.collect_list("position").alias("exact"))
    final = with_wrong.unionByName(exact, allowMissingColumns=True)

    def judged(left: pa.Table, right: pa.Table) -> pa.Table:
        mark, told, block, positions, own, doubtful = unsure(left, right)
        exact = [np.array(x, np.int64) for x in right["exact"].to_pylist() if x is not None]
        starts = np.concatenate([positions[own.repeated(told)[own.place] & ~doubtful], *exact])
        return _table(_rows(block, left["doc_ids"][0].as_py(), starts, np.frombuffer(mark["copies"], "<i8")), RESULT)

    return met(final, judged, RESULT)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))
