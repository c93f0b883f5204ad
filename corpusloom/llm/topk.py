"""Exact top-k inner-product search over an impact-ordered index, score at a time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import Workspace, read_table

#: Vectors of an index shard, queries that travel together, shards that a task goes through one after the other.
SHARD, BLOCK, BUNDLE = 16384, 8192, 4
#: Queries and vectors whose accumulators are held at once (they fit a core's cache), members that are rescored at once.
HELD, TILE, RESCORED = 512, 1024, 4096
#: Impact levels, and the members a query may have left of a shard when it stops before the last level.
LEVELS, FEW = 24, 400
#: Vectors of a shard have norms within a factor of two to the power of one by this.
NORM_CLASSES = 8


def integer_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``row, vec_id, v``: floor(scale * x) of each component of each row; ``row`` numbers them.

    Vectors that are null or hold null or non-finite components are left out, as are rows without an id. Rows with
    the same id stay rows of their own.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    whole = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    sound = whole.where(F.forall("embedding", lambda x: F.coalesce(finite(x), F.lit(False))))
    ints = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return sound.select(F.monotonically_increasing_id().alias("row"), "vec_id", ints.alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column; shorter vectors are filled with 0."""
    lists = column.combine_chunks()
    ends = lists.offsets.to_numpy()
    sizes, flat = np.diff(ends), lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), max(1, sizes.max(initial=0))), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(rows)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


PACKED = "block long, rows binary, ids binary, least binary, v binary, dims long, width int"


def _pack(table: pa.Table) -> pa.Table:
    """The vectors of a shard or block as one row, in the least whole numbers that hold them."""
    v = _matrix(table["v"])
    width = next(w for w in (1, 2, 4, 8) if w == 8 or np.abs(v).max(initial=0) < 1 << (8 * w - 1))
    raw = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
    least = table["least"].to_numpy() if "least" in table.column_names else np.zeros(0)
    return pa.table(
        {
            "block": table["block"].slice(0, 1).cast(pa.int64()),
            "rows": raw(table["row"].to_numpy(), "<i8"),
            "ids": raw(table["vec_id"].to_numpy(), "<i8"),
            "least": raw(least, "<f8"),
            "v": raw(v, f"<i{width}"),
            "dims": pa.array([v.shape[1]], pa.int64()),
            "width": pa.array([width], pa.int32()),
        }
    )


@dataclass
class Vectors:
    rows: np.ndarray
    ids: np.ndarray
    v: np.ndarray
    least: np.ndarray


def _unpack(table: pa.Table) -> Vectors:
    read = lambda name, kind: np.frombuffer(table[name][0].as_py(), kind)
    v = read("v", f"<i{table['width'][0].as_py()}").astype(np.int64).reshape(-1, table["dims"][0].as_py())
    return Vectors(read("rows", "<i8"), read("ids", "<i8"), v, read("least", "<f8").copy())


@dataclass
class Segment:
    """Postings of one impact: the vectors whose component ``dim`` is quantised to ``impact``."""

    dim: int
    impact: float
    places: np.ndarray


def impact_index(v: np.ndarray, levels: int = LEVELS) -> tuple[list[list[Segment]], np.ndarray]:
    """Posting segments by descending level of their impact, and what each level leaves of the vectors' norms.

    A component stands in one segment, that of its dimension, sign and level, and counts there as the mean of the
    segment; zeros stand in none. ``rest[k]`` is the norm of what the levels up to ``k`` leave of each vector: whole
    components that are still to come, and what quantising took from those that came.
    """
    top = max(1, int(np.abs(v).max(initial=0)))
    place, dim = np.nonzero(v)
    value = v[place, dim].astype(np.float64)
    level = levels - 1 - np.minimum(levels - 1, (np.abs(value) * levels / (top + 1)).astype(int))
    key = 2 * (level * v.shape[1] + dim) + (value > 0)
    order = np.argsort(key.astype(np.int16) if 2 * levels * v.shape[1] < 1 << 15 else key, kind="stable")
    place, dim, value, level, key = (x[order] for x in (place, dim, value, level, key))
    starts = np.flatnonzero(np.r_[True, np.diff(key) != 0][: len(place)])
    sizes = np.diff(np.r_[starts, len(place)])
    means = np.add.reduceat(value, starts) / sizes if len(starts) else np.zeros(0)
    segments: list[list[Segment]] = [[] for _ in range(levels)]
    for at, size, mean in zip(starts, sizes, means, strict=True):
        segments[level[at]].append(Segment(int(dim[at]), float(mean), place[at : at + size]))
    impact = np.repeat(means, sizes)
    rest, left = np.zeros((levels, len(v))), (v.astype(np.float64) ** 2).sum(1)
    for k in range(levels):
        here = slice(*np.searchsorted(level, (k, k + 1)))
        left = left + np.bincount(place[here], weights=(value[here] - impact[here]) ** 2 - value[here] ** 2, minlength=len(v))
        rest[k] = np.sqrt(np.maximum(left, 0) * (1 + 1e-9) + 1e-6)
    return segments, rest


def _checked(rest: np.ndarray, largest: float) -> list[int]:
    """The levels after which bounds are looked at: when the largest rest is an eighth of the largest norm, whenever it has halved, and at the end."""
    most, out = rest.max(1, initial=0), []
    for k in range(len(most) - 1):
        if most[k] < (0.5 * most[out[-1]] if out else 0.125 * largest):
            out.append(k)
    return [*out, len(most) - 1]


def _norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v.astype(np.float64) ** 2).sum(1))


class Accumulators:
    """The postings of a shard up to a level, as the matrix by which all of them are added to the scores of many queries at once.

    Two more columns belong to the norm of the query and to the score it has to reach, so a product with a query's
    column says by how much its upper bound reaches that score. The norm's column allows for the rounding of ``real``.
    """

    def __init__(self, segments: list[list[Segment]], rest: np.ndarray, norms: np.ndarray, dims: int, real: type):
        self.segments, self.rest, self.norms, self.dims, self.real = segments, rest, norms, dims, real
        self.held: dict[int, np.ndarray] = {}

    def upto(self, level: int) -> np.ndarray:
        if level not in self.held:
            begin = max((k for k in self.held if k < level), default=-1)
            out = self.held[begin].copy() if begin >= 0 else np.zeros((len(self.norms), self.dims + 2), self.real)
            for postings in self.segments[begin + 1 : level + 1]:
                for s in postings:
                    out[s.places, s.dim] = s.impact
            rounding = (self.dims + 16) * np.finfo(self.real).eps
            out[:, -2] = self.rest[level] + rounding * (self.norms + 2 * self.rest[level] + 2 * self.norms.max(initial=0))
            out[:, -1] = 1
            self.held[level] = out
        return self.held[level]


def _rescored(q: np.ndarray, v: np.ndarray):
    """Exact products of rows of ``q`` and ``v`` by their places, in the fastest numbers that hold all partial sums."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    q, v = q.astype(kind), v.astype(kind)

    def scores(qs: np.ndarray, vs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(qs), np.int64)
        for i in range(0, len(qs), RESCORED):
            here = slice(i, i + RESCORED)
            out[here] = np.einsum("ij,ij->i", q[qs[here]], v[vs[here]])
        return out

    return scores


def score_at_a_time(queries: Vectors, shard: Vectors, k: int, index=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of a shard for each query: places of queries and of vectors, and exact scores.

    Segments are added to the accumulators by descending impact, those between two looks at the bounds as one product. What
    is not yet processed changes a score by at most the product of the query's norm and the norm of the rest of the vector.
    A query stops once few members are left whose upper bound reaches the k-th best score that it has: ``least``, from
    elsewhere, or the best so far of this shard; nothing else can be among its best. Otherwise it goes on to the last
    segment. Possible members are rescored with whole numbers.
    """
    width = max(queries.v.shape[1], shard.v.shape[1])
    q, v = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (queries.v, shard.v))
    segments, rest = index or impact_index(shard.v)
    n, norms, q_norms = len(v), _norms(v), _norms(q)
    largest = norms.max(initial=0)
    real = np.float32 if largest * q_norms.max(initial=0) < 1e30 else np.float64
    checks, sums, exact = _checked(rest, largest), Accumulators(segments, rest, norms, width, real), _rescored(q, v)
    most = max(FEW, 2 * k) / max(1, n)
    order = np.argsort(shard.rows)
    spot = np.minimum(np.searchsorted(shard.rows[order], queries.rows), n - 1)
    own = np.where(shard.rows[order][spot] == queries.rows, order[spot], -1)
    empty = np.zeros(0, np.int64)
    found = []
    for low in range(0, len(q), HELD):
        group = slice(low, min(low + HELD, len(q)))
        least = queries.least[group].copy() if len(queries.least) else np.full(len(q[group]), -np.inf)
        weights = np.empty((width + 2, len(least)), real)
        weights[:-2], weights[-2] = q[group].T, q_norms[group]
        ends, first = [n], min(n, TILE)
        if np.isinf(least).any():
            if first > k:
                sure = sums.upto(checks[0])[:first]
                lower = sure[:, :-2] @ weights[:-2] - sure[:, -2:-1] * weights[-2]
                mine = np.flatnonzero((own[group] >= 0) & (own[group] < first))
                lower[own[group][mine], mine] = -np.inf
                least = np.maximum(least, np.partition(lower, first - k, axis=0)[first - k])
            while ends[0] > TILE:  # what the first vectors score is known when the others are looked at
                ends.insert(0, -(-ends[0] // 2))
        qs, vs, scores = empty, empty, empty
        for begin, end in zip([0, *ends[:-1]], ends, strict=True):
            # whatever reaches less than nothing reaches this
            weights[-1] = -np.maximum(least, -2 * largest * q_norms[group] - 1)
            new_q, new_v = [qs], [vs]
            for at in range(begin, end, TILE):
                rows, live, columns = slice(at, min(at + TILE, end)), np.arange(len(least)), weights
                for level in checks:
                    hit = np.flatnonzero(sums.upto(level)[rows] @ columns >= 0)
                    member, asked = np.divmod(hit, len(live))
                    done = (np.bincount(asked, minlength=len(live)) <= most * (rows.stop - at)) | (level == checks[-1])
                    kept = done[asked]
                    new_q.append(live[asked[kept]])
                    new_v.append(member[kept] + at)
                    live = live[~done]
                    if not len(live):
                        break
                    columns = np.ascontiguousarray(weights[:, live])
            old, qs, vs = len(qs), np.concatenate(new_q), np.concatenate(new_v)
            scores = np.r_[scores, exact(qs[old:] + low, vs[old:])]
            good = (scores >= least[qs]) & (vs != own[group][qs])
            qs, vs, scores = qs[good], vs[good], scores[good]
            by_score = np.lexsort((-scores, qs))
            ranked = qs[by_score]
            last = by_score[np.arange(len(ranked)) - np.searchsorted(ranked, ranked, "left") == k - 1]
            least[qs[last]] = np.maximum(least[qs[last]], scores[last])
            good = scores >= least[qs]
            qs, vs, scores = qs[good], vs[good], scores[good]
        found.append((qs + low, vs, scores))
    qs, vs, scores = (np.concatenate([empty, *x]) for x in (zip(*found, strict=True) if found else [[]] * 3))
    order = np.lexsort((shard.ids[vs], -scores, qs))
    qs, vs, scores = qs[order], vs[order], scores[order]
    best = np.arange(len(qs)) - np.searchsorted(qs, qs, "left") < k
    return qs[best], vs[best], scores[best]


FOUND = "query long, query_id long, vec_id long, score long"


def exact_top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best inner products of every query with all other rows.

    Queries are the rows whose ``vec_id`` is divisible by ``every``; rows that share an id are queries, and candidates for
    each other, on their own. Shards hold vectors of like norm, the longest first. All queries meet the first shard;
    the k-th best score they have there holds in all others: a block of queries skips every shard whose norm
    can't reach it, and members below it are never rescored. Scores are exact while their partial sums stay below
    2^53. Ties go to the smaller ``vec_id``; vectors of different length are compared as if the shorter ended in
    zeros; an empty table gives no row; other columns are not read.
    """
    work = Workspace(vectors.sparkSession, "topk")
    squares = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    norm_class = F.floor(F.log2(F.greatest(squares, F.lit(0.5))) * F.lit(NORM_CLASSES / 2)).cast("int")
    ints = work.table(integer_vectors(vectors, scale).withColumn("norm", F.sqrt(squares)).withColumn("class", norm_class), "vectors")
    # a row per class of norms: their number is bounded by the range of the logarithm
    classes = ints.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("most")).orderBy(F.desc("class")).collect()
    first, parts, shards = {}, {}, 0
    for r in classes:
        first[r["class"]], parts[r["class"]] = shards, -(-r["n"] // SHARD)
        shards += parts[r["class"]]
    lookup = lambda known, c: F.element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.col(c))
    none = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    m = ints.where(F.col("vec_id") % every == 0).count() if shards else 0
    if not m:
        return none
    draw = F.xxhash64("vec_id", "row")
    sharded = ints.withColumn("block", lookup(first, "class") + F.pmod(draw, lookup(parts, "class").cast("long")))
    index = work.table(sharded.select("block", "row", "vec_id", "v").groupBy("block").applyInArrow(_pack, PACKED), "index")
    blocks = max(1, -(-m // BLOCK))
    queries = ints.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(draw, F.lit(blocks).cast("long")))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best of some shards for each query of a block; a shard is held against what those before it have."""
        empty = np.zeros(0, np.int64)
        found = (empty,) * 4
        if left.num_rows and right.num_rows:
            asked, (qs, ids, scores) = _unpack(right), (empty,) * 3
            for at in range(left.num_rows):
                shard = _unpack(left.slice(at, 1))
                q, v, score = score_at_a_time(asked, shard, k)
                qs, ids, scores = np.r_[qs, q], np.r_[ids, shard.ids[v]], np.r_[scores, score]
                order = np.lexsort((ids, -scores, qs))
                qs, ids, scores = qs[order], ids[order], scores[order]
                place = np.arange(len(qs)) - np.searchsorted(qs, qs, "left")
                last = place == k - 1
                asked.least[qs[last]] = np.maximum(asked.least[qs[last]], scores[last])
                qs, ids, scores = qs[place < k], ids[place < k], scores[place < k]
            found = asked.rows[qs], asked.ids[qs], ids, scores
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("query", "query_id", "vec_id", "score"), found, strict=True)})

    def met(shards: DataFrame, asked: DataFrame) -> DataFrame:
        """Blocks of queries with the shards named in their ``shards``, some of them at a time."""
        bundle = lambda s: F.floor(s / BUNDLE)
        wanted = asked.select(F.explode("shards").alias("shard"), F.col("block").alias("by"))
        sent = shards.withColumnRenamed("block", "shard").join(wanted, "shard").withColumn("bundle", bundle(F.col("shard"))).withColumnRenamed("by", "block")
        blocks = asked.withColumn("bundle", F.explode(F.array_distinct(F.transform("shards", bundle)))).drop("shards")
        return sent.groupBy("bundle", "block").cogroup(blocks.groupBy("bundle", "block")).applyInArrow(search, FOUND)

    def packed(asked: DataFrame, name: str) -> DataFrame:
        bounds = asked.groupBy("block").agg(F.max("norm").alias("norm"), F.min("least").alias("reach"))
        rows = asked.select("block", "row", "vec_id", "v", "least").groupBy("block").applyInArrow(_pack, PACKED)
        return work.table(rows.join(bounds, "block"), name)

    start = packed(queries.withColumn("least", F.lit(float("-inf"))), "queries")
    head = work.table(met(index.where("block = 0"), start.withColumn("shards", F.array(F.lit(0).cast("long"))).drop("norm", "reach")), "head")
    best = F.sort_array(F.collect_list("score"), asc=False)
    known = head.groupBy("query").agg(F.try_element_at(best, F.lit(k)).cast("double").alias("least"))
    again = queries.join(known, F.col("row") == F.col("query"), "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    found = head
    if shards > 1:
        spans = [(max(1, first[r["class"]]), first[r["class"]] + parts[r["class"]] - 1, r["most"]) for r in classes]
        known = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(top).alias("top")) for a, b, top in spans if a <= b])
        near: Column = F.filter(known, lambda s: F.col("norm") * s["top"] * (1 + 1e-9) >= F.col("reach"))
        named = packed(again, "again").withColumn("shards", F.flatten(F.transform(near, lambda s: F.sequence(s["a"], s["b"]))))
        found = head.unionByName(met(index.where("block > 0"), named.drop("norm", "reach")))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
