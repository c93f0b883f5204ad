"""Shingles and exact Jaccard joins: a prefix index proposes pairs of blocks, which are compared inside tasks.

Classes of equal token sequences are joined. Most have nothing alike: :func:`_kept` finds those that may have by a part of their
shingles, in four bytes each, and only they are cut into shingles that are staged and travel. Shingles are taken in the order of their frequency; classes that are similar
enough share one of their first few. Classes lie in blocks of those that resemble each other, and a class goes to each
pair of blocks in which it shares such a shingle with another: rows are made per class and pair of blocks, and
pairs of classes only inside a task's arrays, where filters by length and position come before the comparison. So a cluster
of n classes costs n times the number of its blocks, not n squared rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import tokens
from corpusloom.staging import Workspace, spread

SHINGLE, THRESHOLD = 5, 0.8
#: Classes of a block, at most, and shared shingles: long texts make smaller blocks.
BLOCK_CLASSES, BLOCK_SHINGLES = 2048, 2_000_000
#: Shingles of a bucket or of a part, those that a task deals out at once, and so few of one side that they sift the other's.
BUCKET_SHINGLES, DEALT_SHINGLES, FEW_SHINGLES = 4_000_000, 2_000_000, 250_000
#: Columns of a product, entries of it from which pairs aren't listed one by one, and pairs that are handled together.
_COLUMNS, _DENSE, _PAIRS = 2048, 0.25, 1 << 20
#: Tokens above which classes are sifted, the share of a class's shingles that is looked up besides its prefix, and lists' codes of a bucket.
SIFTED_TOKENS, EXTRA, BUCKET_CODES = 1_000_000, 0.2, 16_000_000


def shingles(sequence: Column, k: int = SHINGLE) -> Column:
    """The distinct hashes of all k consecutive tokens, sorted; fewer than k tokens are one shingle, none give none.

    Tokens are hashed once, and a window of k such hashes is hashed again.
    """

    def windows(hashes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(hashes) - k + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.xxhash64(*[F.try_element_at(hashes, i + j) for j in range(k)]))

    hashed = F.element_at(F.transform(F.array(F.transform(sequence, lambda w: F.xxhash64(w))), windows), 1)
    return F.when(F.size(sequence) > 0, F.array_sort(F.array_distinct(hashed))).otherwise(F.array().cast("array<bigint>"))


@dataclass(frozen=True)
class ShingleSets:
    """``rows``: ``key, cls, some, size``, whether it has shingles and how many tokens; ``texts``: ``key, text``.

    ``classes``: ``cls, n, shingles, cid``, one for all rows of equal token sequences; ``cid`` is a number that stands for ``cls`` where a
    class has many rows. They are made when they are asked for, from texts that are read again, as shingles are several times longer.
    """

    rows: DataFrame
    texts: DataFrame
    key: str

    @cached_property
    def classes(self) -> DataFrame:
        return self._cut(self.texts.select(_named("text"), "text").select("of.cls", "text").dropDuplicates(["cls"]))

    @cached_property
    def tokens(self) -> int:
        return self.rows.agg(F.sum("size")).first()[0] or 0

    def some(self, ids: DataFrame) -> DataFrame:
        """Of ``classes`` those of the given ``id``: the texts of their first rows are looked up."""
        work = Workspace(self.rows.sparkSession, "some")
        chosen = self.rows.select(self.key, "cls", _id().alias("id")).join(ids, "id", "left_semi").groupBy("cls").agg(F.min(self.key).alias(self.key))
        return self._cut(self.texts.join(work.table(chosen, "chosen"), self.key).select("cls", "text"))

    def _cut(self, texts: DataFrame) -> DataFrame:
        cut = texts.select("cls", shingles(tokens(F.col("text"))).alias("shingles"))
        made = cut.select("cls", F.size("shingles").cast("long").alias("n"), "shingles").withColumn("cid", F.monotonically_increasing_id())
        return Workspace(self.rows.sparkSession, "classes").table(made, "classes")


def _named(text: str) -> Column:
    of = lambda s: F.struct(F.sha2(F.array_join(s, "\x01"), 256).alias("cls"), (F.size(s) > 0).alias("some"), F.size(s).alias("size"))
    return F.element_at(F.transform(F.array(tokens(F.col(text))), of), 1).alias("of")


def _id() -> Column:
    """A number for a class, while it is only asked which classes go on."""
    return F.xxhash64("cls")


def shingle_sets(df: DataFrame, key: str, text: str = "text") -> ShingleSets:
    """The classes and shingles of each text: ``cls`` tells equal token sequences apart from others. A null text has none."""
    work = Workspace(df.sparkSession, "shingles")
    whole = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = spread(whole)
    texts = whole if dealt is whole else work.table(dealt, "texts")
    return ShingleSets(work.table(texts.select(key, _named("text")).select(key, "of.*"), "rows"), texts, key)


def _hashes(sets: ShingleSets, right: bool = False) -> DataFrame:
    """``id, right, hashes`` of the tokens of each row."""
    seq = tokens(F.col("text"))
    of = F.element_at(F.transform(F.array(seq), lambda s: F.struct(F.xxhash64(F.sha2(F.array_join(s, "\x01"), 256)).alias("id"), F.lit(right).alias("right"), F.transform(s, lambda w: F.xxhash64(w)).alias("hashes"))), 1)
    return sets.texts.select(of.alias("of")).select("of.*")


def _windows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the lists ``hashes``, and the distinct codes of their shingles, sorted by row and code; how many each row has."""
    sets = table["hashes"].combine_chunks()
    held, flat = np.diff(sets.offsets.to_numpy()), sets.flatten().to_numpy().view(np.uint64)
    row, at = np.repeat(np.arange(len(held)), held), np.arange(len(flat))
    end = np.repeat(np.cumsum(held), held)
    started = (at == end - held[row]) | (at + SHINGLE <= end)
    row, at, end = row[started], at[started], end[started]
    codes = np.zeros(len(at), np.uint64)
    for j in range(SHINGLE):
        codes ^= np.where(at + j < end, flat[np.minimum(at + j, len(flat) - 1)], np.uint64(0))
        codes *= np.uint64(0x9E3779B97F4A7C15)
        codes ^= codes >> np.uint64(31)
    order = np.lexsort((codes, row))
    row, codes = row[order], codes[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (codes[1:] != codes[:-1])][: len(row)]
    return row[new], codes[new], np.bincount(row[new], minlength=len(held))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of ``id, right, hashes`` in tables of some million tokens, a row for each class that has any."""
    kept, total = [], 0
    for batch in batches:
        some = batch.filter(pc.greater(pc.list_value_length(batch["hashes"]), 0))
        if some.num_rows:
            kept, total = [*kept, some], total + len(some["hashes"].flatten())
        if total >= DEALT_SHINGLES:
            yield _classes_of(kept)
            kept, total = [], 0
    if kept:
        yield _classes_of(kept)


def _classes_of(batches: list[pa.RecordBatch]) -> pa.Table:
    table = pa.Table.from_batches(batches)
    return table.take(np.sort(np.unique(table["id"].to_numpy(), return_index=True)[1]))


def _kept(left: ShingleSets, right: ShingleSets | None, threshold: float) -> DataFrame:
    """``id`` of the classes that may have a link, staged; of ``left`` alone if ``right`` has few tokens, else of both sides.

    A class of n shingles shares at least ceil(t n) of them with each that it is linked to. In the order of their codes, the first
    n - ceil(t n) + 1 + floor(e n) of a class, e being ``EXTRA``, hold at least floor(e n) and one of what two linked classes share,
    for both of them. So a class goes on if as many of its first codes are held by other classes (of two sides: by the other one).
    Codes travel in 32 bits and their bucket: two that fall together only let a class go on. Copies count as one class.
    """
    work = Workspace(left.rows.sparkSession, "kept")
    if right is not None and right.tokens <= FEW_SHINGLES:

        def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _gathered(batches):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_windows(table)[1]).view(np.int64))], names=["code"])

        few = np.sort(np.array([r.code for r in _hashes(right).mapInArrow(codes, "code bigint").distinct().collect()], np.int64).view(np.uint64))

        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _gathered(batches) if len(few) else ():
                row, found, n = _windows(table)
                hit = few[np.minimum(np.searchsorted(few, found), len(few) - 1)] == found
                kept = np.bincount(row[hit], minlength=len(n)) >= threshold * n - 1e-9
                yield pa.RecordBatch.from_arrays([pa.array(table["id"].to_numpy()[kept])], names=["id"])

        return work.table(_hashes(left).mapInArrow(held, "id bigint").distinct(), "ids")
    two, extra, total = right is not None, min(EXTRA, threshold), left.tokens + (right.tokens if right else 0)
    buckets = parts = max(int(total * min(1, 1 - threshold + extra) // BUCKET_CODES) + 1, min(32, int(total // 10_000) + 1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            row, codes, n = _windows(table)
            first = n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1 + np.floor(n * extra).astype(np.int64)
            head = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) < first[row]
            row, codes = row[head], codes[head]
            bucket = _bucket(codes, buckets)
            order = np.argsort(bucket, kind="stable")
            row, codes, bucket = row[order], codes[order], bucket[order]
            starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (row[1:] != row[:-1])])
            known = np.unique(bucket)
            ends = lambda sorted_: np.r_[np.searchsorted(sorted_, known), len(sorted_)]
            runs, owner = ends(bucket[starts]), row[starts]
            asked = np.maximum(np.floor(n * extra) - 1, 1).astype(np.int32)
            columns = [pa.array(known, pa.int32()), pa.array(np.full(len(known), table["right"][0].as_py())), _lists(runs, table["id"].to_numpy()[owner]), _lists(runs, asked[owner]), _lists(runs, np.diff(np.r_[starts, len(row)]).astype(np.int32)), _lists(ends(bucket), codes.astype(np.uint32).view(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "right", "ids", "asked", "held", "codes"])

    def count(table: pa.Table) -> pa.Table:
        flat = lambda name: table[name].combine_chunks().flatten().to_numpy()
        ids, asked = flat("ids"), flat("asked")
        side = np.repeat(table["right"].to_numpy(), pc.list_value_length(table["ids"]).to_numpy())
        codes = flat("codes")
        order = np.argsort(codes)
        codes, run = codes[order], np.repeat(np.arange(len(ids), dtype=np.int32), flat("held"))[order]
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        told = side if two else ids
        both = np.minimum.reduceat(told[run], starts) != np.maximum.reduceat(told[run], starts)
        hits = np.bincount(run[np.repeat(both, np.diff(np.r_[starts, len(codes)]))], minlength=len(ids))
        # copies of a class have the same hits
        names, first = np.unique(ids, return_index=True)
        first = first[hits[first] > 0]
        names, asked, hits = ids[first], asked[first], hits[first].astype(np.int32)
        part = _bucket(names, parts)
        order = np.argsort(part, kind="stable")
        known = np.unique(part)
        ends = np.r_[np.searchsorted(part[order], known), len(part)]
        columns = [pa.array(known, pa.int32()), *[_lists(ends, x[order]) for x in (names, asked, hits)]]
        return pa.table(columns, names=["part", "ids", "asked", "hits"])

    def chosen(table: pa.Table) -> pa.Table:
        ids, asked, hits = (table[name].combine_chunks().flatten().to_numpy() for name in ("ids", "asked", "hits"))
        names, first, of = np.unique(ids, return_index=True, return_inverse=True)
        return pa.table([pa.array(names[np.bincount(of, hits) >= asked[first]])], names=["id"])

    told = _hashes(left) if right is None else _hashes(left).union(_hashes(right, True))
    dealt = told.mapInArrow(deal, "bucket int, right boolean, ids array<bigint>, asked array<int>, held array<int>, codes array<int>")
    shared = dealt.groupBy("bucket").applyInArrow(count, "part int, ids array<bigint>, asked array<int>, hits array<int>")
    return work.table(shared.groupBy("part").applyInArrow(chosen, "id bigint"), "ids")


def _sifted(left: ShingleSets, right: ShingleSets | None, threshold: float) -> tuple[DataFrame, ...]:
    """The classes of each side, without those that :func:`_kept` tells to have no link if there are many tokens."""
    sides = (left,) if right is None else (left, right)
    if left.tokens <= SIFTED_TOKENS:
        return tuple(x.classes for x in sides)
    ids = _kept(left, right, threshold)
    return tuple(x.classes if x is right and x.tokens <= FEW_SHINGLES else x.some(ids) for x in sides)


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def _dealt(classes: DataFrame, buckets: int, right: bool) -> DataFrame:
    """``bucket, right, cids, ns, held, codes``: a list for each bucket of the shingles of many classes, with the number of each class."""

    def lists(table: pa.Table) -> pa.RecordBatch:
        sets = table["shingles"].combine_chunks()
        held, codes = np.diff(sets.offsets.to_numpy()), sets.flatten().to_numpy()
        row = np.repeat(np.arange(len(held)), held)
        bucket = _bucket(codes, buckets)
        order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
        codes, row, bucket = codes[order], row[order], bucket[order]
        starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (row[1:] != row[:-1])]) if len(row) else np.zeros(0, np.int64)
        known = np.unique(bucket)
        ends = lambda sorted_: np.r_[np.searchsorted(sorted_, known), len(sorted_)]
        runs, owner = ends(bucket[starts]), row[starts]
        columns = [pa.array(known, pa.int32()), pa.array(np.full(len(known), right)), _lists(runs, table["cid"].to_numpy()[owner]), _lists(runs, table["n"].to_numpy()[owner].astype(np.int32)), _lists(runs, np.diff(np.r_[starts, len(row)]).astype(np.int32)), _lists(ends(bucket), codes)]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "right", "cids", "ns", "held", "codes"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, total = [], 0
        for batch in batches:
            kept, total = [*kept, batch], total + pc.sum(batch["n"]).as_py() if batch.num_rows else total
            if total >= DEALT_SHINGLES:
                yield lists(pa.Table.from_batches(kept))
                kept, total = [], 0
        if total:
            yield lists(pa.Table.from_batches(kept))

    return classes.select("cid", "n", "shingles").mapInArrow(deal, "bucket int, right boolean, cids array<bigint>, ns array<int>, held array<int>, codes array<bigint>")


def _bucket(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of a multiplied hash, as many as there are buckets."""
    mixed = (codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return ((mixed * np.uint64(buckets)) >> np.uint64(24)).astype(np.int64)


def _nodes(left: DataFrame, right: DataFrame | None, threshold: float) -> DataFrame:
    """``right, cid, n, codes, prefix`` of the shared shingles: rarest first, and how many of them to look up.

    Two classes of the threshold have one of their first n - ceil(t n) + 1 shingles in common. Those that no other class (of
    two sides: none of the other side) holds come first of all and can't be shared, so they only take up places; classes that
    are left without any drop out. Shingles travel in lists: all of a bucket meet, which counts them, and those that are shared
    go on to their classes. A list takes little more than its shingles, where a row each takes five times as much.
    """
    own, sides = right is None, (left,) if right is None else (left, right)
    total = sum(x.agg(F.sum("n")).first()[0] or 0 for x in sides)
    buckets = parts = max(int(total // BUCKET_SHINGLES) + 1, min(32, int(total // 10_000) + 1))

    def count(table: pa.Table) -> pa.Table:
        flat = lambda name: table[name].combine_chunks().flatten().to_numpy()
        codes, held, side = flat("codes"), flat("held"), np.repeat(table["right"].to_numpy(), pc.list_value_length(table["cids"]).to_numpy())
        order = np.argsort(codes, kind="stable")
        codes, run = codes[order], np.repeat(np.arange(len(held)), held)[order]
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        times = np.diff(np.r_[starts, len(codes)])
        theirs = np.add.reduceat(side[run].astype(np.int64), starts)
        kept = np.repeat(times > 1 if own else (theirs > 0) & (theirs < times), times)
        codes, run, times = codes[kept], run[kept], np.repeat(times, times)[kept].astype(np.int32)
        cid, side = flat("cids")[run], side[run]
        part = 2 * _bucket(cid, parts) + side
        order = np.argsort(part, kind="stable")
        order = order[np.lexsort((run[order], part[order]))]
        known = np.unique(part)
        ends = np.r_[np.searchsorted(part[order], known), len(part)]
        columns = [pa.array(known, pa.int32()), *[_lists(ends, x[order]) for x in (cid, flat("ns")[run], times, codes)]]
        return pa.table(columns, names=["part", "cids", "ns", "times", "codes"])

    def ordered(table: pa.Table) -> pa.Table:
        cid, n, times, codes = (table[name].combine_chunks().flatten().to_numpy() for name in ("cids", "ns", "times", "codes"))
        order = np.lexsort((codes, times, cid))
        cid, n, codes = cid[order], n[order], codes[order]
        starts = np.flatnonzero(np.r_[True, cid[1:] != cid[:-1]])
        held = np.diff(np.r_[starts, len(cid)])
        prefix = held - np.ceil(n[starts] * threshold - 1e-9).astype(np.int64) + 1
        kept = prefix > 0
        columns = [pa.array(np.full(kept.sum(), table["part"][0].as_py() % 2 == 1)), pa.array(cid[starts][kept]), pa.array(n[starts][kept], pa.int64()), _lists(np.r_[0, np.cumsum(held[kept])], codes[np.repeat(kept, held)]), pa.array(prefix[kept], pa.int32())]
        return pa.table(columns, names=["right", "cid", "n", "codes", "prefix"])

    dealt = _dealt(left, buckets, False) if own else _dealt(left, buckets, False).union(_dealt(right, buckets, True))
    shared = dealt.groupBy("bucket").applyInArrow(count, "part int, cids array<bigint>, ns array<int>, times array<int>, codes array<bigint>")
    return shared.groupBy("part").applyInArrow(ordered, "right boolean, cid bigint, n bigint, codes array<bigint>, prefix int")


def _shared(flat: DataFrame, threshold: float) -> DataFrame:
    """``cid, n, codes, prefix`` as in :func:`_nodes`, of rows ``cid, n, shingle, count`` that are few."""
    ordered = flat.groupBy("cid", "n").agg(F.array_sort(F.collect_list(F.struct("count", "shingle"))).alias("o"))
    prefix = F.size("codes") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)) + 1
    return ordered.select("cid", "n", F.transform("o", lambda x: x["shingle"]).alias("codes")).withColumn("prefix", prefix.cast("int")).where("prefix > 0")


def _weight() -> Column:
    """What a class takes of a block."""
    return F.size("codes") / F.lit(BLOCK_SHINGLES) + F.lit(1 / BLOCK_CLASSES)


def _placed(work: Workspace, nodes: DataFrame, side: str) -> DataFrame:
    """``node, cid, grp, first, block``, staged: blocks of a group's nodes that have the same least prefix shingle, or nearly so."""
    local = F.array_min(F.transform(F.slice("codes", F.lit(1), F.col("prefix")), lambda s: F.xxhash64(s)))
    slim = nodes.select("cid", "grp", "first", local.alias("local"), _weight().alias("weight"))
    ranged = work.table(slim.repartitionByRange("grp", "local", "cid").withColumn("part", F.spark_partition_id()), f"ranged_{side}")
    running = F.sum("weight").over(Window.partitionBy("part").orderBy("grp", "local", "cid").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    block = F.col("part").cast("long") * F.lit(1 << 32) + F.floor(running).cast("long")
    return work.table(ranged.select("cid", "grp", "first", block.alias("block")), f"placed_{side}")


def _posts(placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """``grp, shingle, block, cid, n, rest`` for each prefix shingle; ``rest`` counts the class's shared shingles from it on."""
    heads = nodes.select("cid", "grp", "n", F.size("codes").alias("held"), F.slice("codes", F.lit(1), F.col("prefix")).alias("head"))
    looked_up = placed.select("cid", "grp", "block").join(heads, ["cid", "grp"])
    return looked_up.select("grp", "block", "cid", "n", "held", F.posexplode("head").alias("at", "shingle")).select("grp", "shingle", "block", "cid", "n", (F.col("held") - F.col("at")).alias("rest"))


def _meetings(posts: DataFrame, others: DataFrame, threshold: float, own: bool, right: bool = False) -> DataFrame:
    """``grp, lo, hi, cid, right``: the pairs of blocks in which a class shares a prefix shingle with one of the other side.

    Blocks are met only if their classes of that shingle reach the size and the number of common shingles that the threshold asks for.
    """
    heads = others.groupBy("grp", "shingle", F.col("block").alias("other")).agg(F.count(F.lit(1)).alias("held"), F.min("n").alias("_least"), F.max("n").alias("_most"), F.max("rest").alias("_rest"))
    t, n = F.lit(threshold), F.col("n")
    sized = (n * t <= F.col("_most") + 1e-9) & (F.col("_least") * t <= n + 1e-9)
    reached = F.least("rest", "_rest") >= F.lit(threshold / (1 + threshold)) * (n + F.greatest(F.col("_least").cast("double"), n * t)) - 1e-6
    met = posts.join(heads, ["grp", "shingle"]).where(sized & reached)
    if own:
        met = met.where("block <> other or held > 1")
        return met.select("grp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "cid", (F.col("block") > F.col("other")).alias("right")).distinct()
    lo, hi = ("other", "block") if right else ("block", "other")
    return met.select("grp", F.col(lo).alias("lo"), F.col(hi).alias("hi"), "cid", F.lit(right).alias("right")).distinct()


@dataclass
class _Side:
    """The classes of one block: their names, keys and sizes; ``codes`` of all of them, whose ``row`` and place ``at`` stand beside."""

    cid: np.ndarray
    first: pa.Array
    n: np.ndarray
    codes: np.ndarray
    row: np.ndarray
    at: np.ndarray
    held: np.ndarray
    prefix: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> _Side:
        codes = table["codes"].combine_chunks()
        held = np.diff(codes.offsets.to_numpy())
        row = np.repeat(np.arange(len(held)), held)
        at = np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held)
        return cls(table["cid"].to_numpy(), table["first"].combine_chunks(), table["n"].to_numpy(), codes.flatten().to_numpy(), row, at, held, table["prefix"].to_numpy())


def _candidates(a: _Side, b: _Side, own: bool, threshold: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs that share a prefix shingle and pass the filters; none if they are most of all pairs."""
    in_a, in_b = a.at < a.prefix[a.row], b.at < b.prefix[b.row]
    code_a, row_a, at_a = a.codes[in_a], a.row[in_a], a.at[in_a]
    code_b, row_b, at_b = b.codes[in_b], b.row[in_b], b.at[in_b]
    order = np.argsort(code_b, kind="stable")
    code_b, row_b, at_b = code_b[order], row_b[order], at_b[order]
    lo, hi = np.searchsorted(code_b, code_a, "left"), np.searchsorted(code_b, code_a, "right")
    counts = hi - lo
    if counts.sum() > max(_DENSE * len(a.n) * len(b.n), 4096):
        return None
    left = np.repeat(np.arange(len(counts)), counts)
    right = np.arange(len(left)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo, counts)
    i, j, at_i, at_j = row_a[left], row_b[right], at_a[left], at_b[right]
    kept = (i < j) if own else np.ones(len(i), bool)
    kept &= (a.n[i] >= threshold * b.n[j] - 1e-9) & (b.n[j] >= threshold * a.n[i] - 1e-9)
    i, j, at_i, at_j = i[kept], j[kept], at_i[kept], at_j[kept]
    # the first shingle that a pair shares bounds how many it shares at all
    order = np.lexsort((at_i, j, i))
    i, j, at_i, at_j = i[order], j[order], at_i[order], at_j[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    i, j, at_i, at_j = i[new], j[new], at_i[new], at_j[new]
    most = 1 + np.minimum(a.held[i] - at_i - 1, b.held[j] - at_j - 1)
    possible = most >= threshold / (1 + threshold) * (a.n[i] + b.n[j]) - 1e-6
    return i[possible], j[possible]


def _common(a: _Side, b: _Side, rows_a: np.ndarray, rows_b: np.ndarray) -> np.ndarray:
    """[row of a, row of b]: how many shingles they share, by products of incidence matrices."""
    place_a, place_b = np.full(len(a.n), -1), np.full(len(b.n), -1)
    place_a[rows_a], place_b[rows_b] = np.arange(len(rows_a)), np.arange(len(rows_b))
    in_a, in_b = place_a[a.row] >= 0, place_b[b.row] >= 0
    code_a, code_b = a.codes[in_a], b.codes[in_b]
    both = np.intersect1d(code_a, code_b)
    column_a, column_b = np.searchsorted(both, code_a), np.searchsorted(both, code_b)
    found_a = (column_a < len(both)) & (both[np.minimum(column_a, len(both) - 1)] == code_a) if len(both) else np.zeros(len(code_a), bool)
    found_b = (column_b < len(both)) & (both[np.minimum(column_b, len(both) - 1)] == code_b) if len(both) else np.zeros(len(code_b), bool)
    row_a, column_a = place_a[a.row[in_a]][found_a], column_a[found_a]
    row_b, column_b = place_b[b.row[in_b]][found_b], column_b[found_b]
    common = np.zeros((len(rows_a), len(rows_b)), np.float32)
    sort_a, sort_b = np.argsort(column_a, kind="stable"), np.argsort(column_b, kind="stable")
    row_a, column_a, row_b, column_b = row_a[sort_a], column_a[sort_a], row_b[sort_b], column_b[sort_b]
    for low in range(0, len(both), _COLUMNS):
        width = min(_COLUMNS, len(both) - low)
        x, y = np.zeros((len(rows_a), width), np.float32), np.zeros((len(rows_b), width), np.float32)
        for m, row, column in ((x, row_a, column_a), (y, row_b, column_b)):
            s, e = np.searchsorted(column, (low, low + width))
            m[row[s:e], column[s:e] - low] = 1
        common += x @ y.T
    return common


def _links(a: _Side, b: _Side, own: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of all pairs of the threshold and their similarity, in arrays of bounded length."""
    pairs = _candidates(a, b, own, threshold)
    if pairs is not None and len(pairs[0]) <= 4 * (len(a.n) + len(b.n)):
        i, j = pairs
        ends_a, ends_b = np.cumsum(a.held), np.cumsum(b.held)
        set_a, set_b = (lambda r: a.codes[ends_a[r] - a.held[r] : ends_a[r]]), (lambda r: b.codes[ends_b[r] - b.held[r] : ends_b[r]])
        common = np.array([len(np.intersect1d(set_a(x), set_b(y), assume_unique=True)) for x, y in zip(i, j, strict=True)], float)
        similarity = common / (a.n[i] + b.n[j] - common)
        kept = similarity >= threshold
        yield i[kept], j[kept], similarity[kept]
        return
    rows_a, rows_b = (np.arange(len(a.n)), np.arange(len(b.n))) if pairs is None else (np.unique(pairs[0]), np.unique(pairs[1]))
    step = max(1, _PAIRS // max(len(rows_b), 1))
    for at in range(0, len(rows_a), step):
        some = rows_a[at : at + step]
        common = _common(a, b, some, rows_b).astype(float)
        similarity = common / (a.n[some][:, None] + b.n[rows_b][None, :] - common)
        x, y = np.nonzero(similarity >= threshold)
        i, j, similarity = some[x], rows_b[y], similarity[x, y]
        kept = (i < j) if own else np.ones(len(i), bool)
        yield i[kept], j[kept], similarity[kept]


def _best(node: np.ndarray, order: tuple[np.ndarray, ...]) -> np.ndarray:
    """The places of the first entry of each node in the given order, the most important key first."""
    sort = np.lexsort((*order[::-1], node))
    new = np.ones(len(sort), bool)
    new[1:] = node[sort][1:] != node[sort][:-1]
    return sort[new]


def _compared(work: Workspace, left: DataFrame, right: DataFrame | None, threshold: float, want: str, kind: str) -> DataFrame:
    """Compares the nodes ``cid, n, codes, prefix, grp, first`` of two sides, or of one with itself, group by group.

    ``want`` is ``links`` (``a, b, similarity`` of all pairs), ``earlier`` (``cid, grp, first, similarity``: for each node its most
    similar one with a lesser ``first``, the least of equals) or ``least`` (for each node of the left the similar one of the
    right with the least ``first``); of the latter two a row for each pair of blocks in which there is one. ``kind`` is the
    type of ``first``.
    """
    own = right is None
    nodes = {"l": work.table(left, "nodes_l")} | ({} if own else {"r": work.table(right, "nodes_r")})
    carried = ("grp", "lo", "hi", "right", "cid", "n", "codes", "prefix", "first")
    if all((x.agg(F.sum(_weight())).first()[0] or 0) <= 1 for x in nodes.values()):
        # a block a side holds all there is
        alone = lambda k: nodes[k].withColumns({"lo": F.lit(0).cast("long"), "hi": F.lit(0 if own else 1).cast("long"), "right": F.lit(k == "r")}).select(*carried)
        shipped = alone("l") if own else alone("l").unionByName(alone("r"))
    else:
        placed = {k: _placed(work, x, k) for k, x in nodes.items()}
        posts = {k: work.table(_posts(placed[k], x), f"posts_{k}") for k, x in nodes.items()}
        carry = lambda met, k: met.join(nodes[k], ["cid", "grp"])
        if own:
            shipped = carry(_meetings(posts["l"], posts["l"], threshold, True), "l")
        else:
            shipped = carry(_meetings(posts["l"], posts["r"], threshold, False), "l").unionByName(carry(_meetings(posts["r"], posts["l"], threshold, False, True), "r"))
    group_type = dict(left.dtypes)["grp"]
    schema = "a bigint, b bigint, similarity double" if want == "links" else f"cid bigint, grp {group_type}, first {kind}, similarity double"

    def compare(table: pa.Table) -> pa.Table:
        within = own and table["lo"][0] == table["hi"][0]
        table = table.sort_by("cid")
        mask = table["right"].combine_chunks()
        a = _Side.of(table if within else table.filter(pc.invert(mask)))
        b = a if within else _Side.of(table.filter(mask))
        out: list[tuple] = []
        if want == "links":
            for i, j, s in _links(a, b, within, threshold):
                out.append((np.minimum(a.cid[i], b.cid[j]), np.maximum(a.cid[i], b.cid[j]), s) if own else (a.cid[i], b.cid[j], s))
            columns = [np.concatenate([x[k] for x in out]) if out else np.zeros(0) for k in range(3)]
            return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["a", "b", "similarity"])
        keys = (b.first if want == "least" else pa.concat_arrays([a.first, b.first])).dictionary_encode()
        sort = pc.array_sort_indices(keys.dictionary)
        rank = np.empty(len(sort), np.int64)
        rank[sort.to_numpy()] = np.arange(len(sort))
        ranks = rank[keys.indices.to_numpy()]
        of_a, of_b = ranks[: len(a.n)], ranks[len(ranks) - len(b.n) :]
        for i, j, s in _links(a, b, within, threshold):
            if want == "least":
                kept = _best(i, (of_b[j],))
                out.append((i[kept], of_b[j[kept]], s[kept]))
                continue
            # both ways: rows of b are numbered behind those of a
            node, other, both = np.r_[i, j + (0 if within else len(a.n))], np.r_[of_b[j], of_a[i]], np.r_[s, s]
            earlier = other < np.r_[of_a[i], of_b[j]]
            node, other, both = node[earlier], other[earlier], both[earlier]
            kept = _best(node, (-both, other))
            out.append((node[kept], other[kept], both[kept]))
        node, other, s = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(3))
        kept = _best(node, (other,) if want == "least" else (-s, other))
        name = a.cid if within or want == "least" else np.r_[a.cid, b.cid]
        firsts = keys.dictionary.take(sort).take(pa.array(other[kept], pa.int64()))
        group = pa.chunked_array([pa.array([table["grp"][0].as_py()] * len(kept), table.schema.field("grp").type)])
        return pa.table([pa.array(name[node[kept]], pa.int64()), group, firsts, pa.array(s[kept], pa.float64())], names=["cid", "grp", "first", "similarity"])

    return shipped.select(*carried).groupBy("grp", "lo", "hi").applyInArrow(compare, schema)


def _flat(classes: DataFrame) -> DataFrame:
    return classes.select("cid", "n", F.explode("shingles").alias("shingle"))


def _two_nodes(work: Workspace, left: DataFrame, right: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Nodes of the classes of two sides: of the shingles that both hold. A right of few shingles sifts the left's, which then need not travel."""
    if (right.agg(F.sum("n")).first()[0] or 0) > FEW_SHINGLES:
        both = work.table(_nodes(left, right, threshold), "both")
        return both.where("not right").drop("right"), both.where("right").drop("right")
    theirs = work.table(_flat(right), "theirs")
    ours = work.table(_flat(left).join(F.broadcast(theirs.select("shingle").distinct()), "shingle"), "ours")
    order = work.table(ours.groupBy("shingle").count().withColumnRenamed("count", "l").join(theirs.groupBy("shingle").count(), "shingle").select("shingle", (F.col("l") + F.col("count")).alias("count")), "order")
    return _shared(ours.join(order, "shingle"), threshold), _shared(theirs.join(order, "shingle"), threshold)


def class_links(left: ShingleSets, right: ShingleSets | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``a, b, similarity`` of all pairs of classes of at least ``threshold``; without ``right``, pairs of ``left`` with a < b.

    A class takes part once, however many rows it has. A class without shingles has no link. A row for each link is what is
    asked for here; :func:`earlier_classes` and :func:`least_classes` make one for each class.
    """
    work = Workspace(left.rows.sparkSession, "links")
    classes = _sifted(left, right, threshold)
    sides = _two_nodes(work, *classes, threshold) if right else (_nodes(*classes, None, threshold).drop("right"),)
    nodes = [x.withColumn("grp", F.lit(0)).withColumn("first", F.lit(0)) for x in sides]
    found = _compared(work, nodes[0], nodes[1] if right else None, threshold, "links", "int")
    name = lambda side, k: side.select(F.col("cid").alias(k), F.col("cls").alias(f"_{k}"))
    named = found.join(name(classes[0], "a"), "a").join(name(classes[-1], "b"), "b")
    ends = ("_a", "_b") if right else (F.least("_a", "_b"), F.greatest("_a", "_b"))
    return named.select(*ends, "similarity").toDF("a", "b", "similarity")


def earlier_classes(sets: ShingleSets, firsts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``cls, grp, first, similarity``: of each class of each group the most similar class with a lesser ``first``, the least of equals.

    ``firsts`` has ``cls, grp, first``; classes without an earlier one of the threshold have no row.
    """
    work = Workspace(sets.rows.sparkSession, "earlier")
    (classes,) = _sifted(sets, None, threshold)
    names = classes.select("cid", "cls")
    nodes = _nodes(classes, None, threshold).drop("right").join(firsts.join(names, "cls").select("cid", "grp", "first"), "cid")
    found = _compared(work, nodes, None, threshold, "earlier", dict(firsts.dtypes)["first"])
    best = F.min_by(F.struct("first", "similarity"), F.struct(-F.col("similarity"), F.col("first"))).alias("best")
    return found.groupBy("cid", "grp").agg(best).join(names, "cid").select("cls", "grp", "best.*")


def least_classes(left: ShingleSets, right: ShingleSets, firsts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``cls, first, similarity``: for each class of ``left`` the similar one of ``right`` with the least ``first``; ``firsts`` has ``cls, first``."""
    work = Workspace(left.rows.sparkSession, "least")
    classes = _sifted(left, right, threshold)
    (ours, theirs), kind = _two_nodes(work, *classes, threshold), dict(firsts.dtypes)["first"]
    ours = ours.withColumn("grp", F.lit(0)).withColumn("first", F.lit(None).cast(kind))
    numbered = firsts.join(classes[1].select("cid", "cls"), "cls").select("cid", "first")
    found = _compared(work, ours, theirs.withColumn("grp", F.lit(0)).join(numbered, "cid"), threshold, "least", kind)
    best = found.groupBy("cid").agg(F.min_by(F.struct("first", "similarity"), "first").alias("best"))
    return best.join(classes[0].select("cid", "cls"), "cid").select("cls", "best.*")
