"""Chat formatting: a hidden Markov model over the lines of a transcript recovers who speaks.

States are roles, each with a first line and further lines of a turn. Viterbi decoding is a product of matrices
in the (max, +) algebra, so a long transcript is cut into chunks: each chunk is reduced to one small matrix, the
chunks of a transcript are resolved from these matrices, and each chunk is decoded on its own between the scores
it is entered with and the state it must end in. Results don't depend on where the cuts are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import Workspace, read_table

ROLES = ("system", "user", "assistant", "tool")
STATES = 2 * len(ROLES)  # state 2 r: first line of role r; 2 r + 1: a further line
START = STATES  # before the first line
#: Lines of a transcript in a chunk, chunks of a transcript that one task resolves at once, transcripts to learn from.
LINES, FAN = 256, 1024
#: The bounded sample that the model is fitted on: labelled transcripts, and turns of each from its start.
SAMPLE, TURNS = 500, 64
#: Parts of a transcript whose lines one window counts.
RANGE = 4096
MARKERS = (
    r"system|instructions?|sys",
    r"user|human|you|question|q|customer|prompt",
    r"assistant|ai|bot|answer|a|model|agent",
    r"tool|function|observation|output",
)
MARKER = re.compile(r"^\s*[\[<(*#_|]{0,4}\s*(?:" + "|".join(f"({m})" for m in MARKERS) + r")\s*[\])>*_|]{0,4}\s*(?::|(?<=[\]>|]))[*_]{0,2}\s*", re.I)
KINDS = (len(MARKERS) + 1, 5, 3)  # values of each feature: marker, words, end of the line


def line_features(line: str) -> tuple[int, int, int]:
    found = MARKER.match(line)
    body = line[found.end() :] if found else line
    words = len(body.split())
    end = body.rstrip()[-1:]
    return (found.lastindex if found else 0), (0 if not words else 1 if words < 4 else 2 if words < 12 else 3 if words < 40 else 4), (1 if end == "?" else 2 if end == ":" else 0)


def fit(transcripts: list[list[tuple[str, str]]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Log transitions [state or start, state] and log emissions per feature, counted with add-one smoothing.

    ``transcripts``: for each, its turns as role and raw text, in order.
    """
    moves = np.zeros((STATES + 1, STATES))
    seen = [np.ones((STATES, n)) for n in KINDS]
    for turns in transcripts:
        before = START
        for role, text in turns:
            for i, line in enumerate(text.split("\n")):
                state = 2 * ROLES.index(role) + (i > 0)
                moves[before, state] += 1
                for table, value in zip(seen, line_features(line), strict=True):
                    table[state, value] += 1
                before = state
    possible = np.zeros_like(moves)
    possible[:, ::2] = 1  # a turn can begin anywhere; it goes on only behind a line of its own
    for r in range(len(ROLES)):
        possible[2 * r : 2 * r + 2, 2 * r + 1] = 1
    moves = (moves + 0.1) * possible
    with np.errstate(divide="ignore"):
        return np.log(moves / moves.sum(1, keepdims=True)), [np.log(t / t.sum(1, keepdims=True)) for t in seen]


def emissions(lines: list[str], model) -> np.ndarray:
    """[line, state]"""
    values = np.array([line_features(x) for x in lines])
    return sum(table[:, values[:, k]].T for k, table in enumerate(model[1]))


def transfer(lines: list[str], model) -> np.ndarray:
    """[state before the chunk, state of its last line]: the best score of all paths in between."""
    best = None
    for e in emissions(lines, model):
        step = model[0] + e
        best = step if best is None else (best[:, :, None] + step[None, :STATES, :]).max(1)
    return best


def decode(lines: list[str], model, entered: np.ndarray, last: int) -> np.ndarray:
    """The best path through a chunk that ends in ``last``; ``entered`` scores the states before it."""
    scores, back = entered, []
    for e in emissions(lines, model):
        step = scores[:, None] + model[0][: len(scores)]
        back.append(step.argmax(0))
        scores = step.max(0) + e
    path = [last]
    for pointers in back[:0:-1]:
        path.append(int(pointers[path[-1]]))
    return np.array(path[::-1])


ENTRY = np.full(STATES + 1, -np.inf)
ENTRY[START] = 0.0


def _chain(matrices: list[np.ndarray], entered: np.ndarray, last: int) -> list[tuple[np.ndarray, int]]:
    """For each chunk of a run of chunks, the scores it is entered with and the state it ends in (``last`` -1: the best)."""
    scores = [entered]
    for m in matrices:
        scores.append((scores[-1][:, None] + m[: len(scores[-1])]).max(0))
    end = int(scores[-1].argmax()) if last < 0 else last
    ends = [end]
    for k in range(len(matrices) - 1, 0, -1):
        ends.append(int((scores[k] + matrices[k][:STATES, ends[-1]]).argmax()))
    return list(zip(scores[:-1], ends[::-1], strict=True))


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[list[dict]]:
    """Rows with equal keys together; rows come sorted."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for _, run in groupby(rows, lambda row: tuple(row[k] for k in keys)):
        yield list(run)


def _array(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<f8")


RESOLVED = "key string, chunk long, entered binary, last int"


def _resolve(work: Workspace, chunks: DataFrame, depth: int = 0) -> DataFrame:
    """``chunks`` (``key, chunk, matrix``) to ``RESOLVED``; runs longer than ``FAN`` are folded level by level."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, "key", "group"):
            given = run[0]["entered"]
            found = _chain(
                [_array(r["matrix"]).reshape(STATES + 1, STATES) for r in run],
                _array(given) if given is not None else ENTRY,
                run[0]["last"] if given is not None else -1,
            )
            yield pa.RecordBatch.from_pydict(
                {
                    "key": [r["key"] for r in run],
                    "chunk": [r["chunk"] for r in run],
                    "entered": [s.astype("<f8").tobytes() for s, _ in found],
                    "last": pa.array([e for _, e in found], pa.int32()),
                }
            )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, "key", "group"):
            best = None
            for r in run:
                m = _array(r["matrix"]).reshape(STATES + 1, STATES)
                best = m if best is None else (best[:, :, None] + m[None, :STATES, :]).max(1)
            yield pa.RecordBatch.from_pydict({"key": [run[0]["key"]], "chunk": pa.array([run[0]["group"]], pa.int64()), "matrix": [best.tobytes()]})

    grouped = chunks.withColumn("group", F.floor(F.col("chunk") / FAN))
    if chunks.agg(F.max("chunk")).first()[0] in (None, *range(FAN)):
        whole = grouped.withColumn("entered", F.lit(None).cast("binary")).withColumn("last", F.lit(-1))
    else:
        dealt = grouped.repartition("key", "group").sortWithinPartitions("key", "group", "chunk")
        upper = _resolve(work, work.table(dealt.mapInArrow(fold, "key string, chunk long, matrix binary"), f"folded{depth}"), depth + 1)
        whole = grouped.join(upper.withColumnRenamed("chunk", "group"), ["key", "group"])
    dealt = whole.select("key", "group", "chunk", "matrix", "entered", "last").repartition("key", "group").sortWithinPartitions("key", "group", "chunk")
    return dealt.mapInArrow(solve, RESOLVED)


def parse_transcripts(transcripts: DataFrame, model) -> DataFrame:
    """``conv_id, turn_no, role, n_lines, text, rendered``: the recovered turns of every transcript, from turn 0.

    ``transcripts`` has ``conv_id, part, text``: a transcript is the lines of its parts in order. A turn's text is
    its lines without the speaker marker. A null text is an empty line, a null ``part`` stands before all others,
    rows with a null ``conv_id`` make one transcript of their own, repeated rows repeat their lines; equal parts
    are ordered by text. An empty table gives no row; other columns are not read.
    """
    work = Workspace(transcripts.sparkSession, "chat")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, "key", "chunk"):
            lines = [line for r in run for line in r["lines"]]
            yield pa.RecordBatch.from_pydict(
                {
                    "key": [run[0]["key"]],
                    "conv_id": pa.array([run[0]["conv_id"]], pa.int64()),
                    "chunk": pa.array([run[0]["chunk"]], pa.int64()),
                    "lines": pa.array([lines], pa.list_(pa.string())),
                    "matrix": [transfer(lines, model).astype("<f8").tobytes()],
                }
            )

    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    keyed = transcripts.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"),
        F.col("conv_id").cast("long"),
        "part",
        F.coalesce(F.floor(F.col("part") / RANGE), F.lit(-(1 << 60))).alias("range"),
        lines.alias("lines"),
        F.size(lines).cast("long").alias("n"),
    )
    # a line's place in its transcript: lines are counted in ranges of parts, behind the ranges before
    sums = keyed.groupBy("key", "range").agg(F.sum("n").alias("range_lines"))
    earlier = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("key", "range", F.coalesce(F.sum("range_lines").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("key", "range").orderBy("part", "lines").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.withColumn("upto", F.sum("n").over(within)).join(offsets, ["key", "range"]).withColumn("at", F.col("before") + F.col("upto") - F.col("n"))
    cut = placed.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("at") / LINES), F.floor((F.col("at") + F.col("n") - 1) / LINES))))
    first, last = F.greatest("at", F.col("chunk") * LINES), F.least(F.col("at") + F.col("n"), (F.col("chunk") + 1) * LINES)
    own = F.slice("lines", (first - F.col("at") + 1).cast("int"), (last - first).cast("int"))
    dealt = cut.select("key", "conv_id", "chunk", "at", own.alias("lines")).repartition("key", "chunk").sortWithinPartitions("key", "chunk", "at")
    chunks = work.table(dealt.mapInArrow(reduce, "key string, conv_id long, chunk long, lines array<string>, matrix binary"), "chunks")
    resolved = _resolve(work, chunks.select("key", "chunk", "matrix"))

    def speak(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                path = decode(row["lines"], model, _array(row["entered"]), row["last"])
                starts = path % 2 == 0
                cuts = [0, *(i for i in np.flatnonzero(starts) if i), len(path)]
                for at, end in zip(cuts[:-1], cuts[1:], strict=True):
                    body = row["lines"][at:end]
                    if starts[at] and (found := MARKER.match(body[0])):
                        body = [body[0][found.end() :], *body[1:]]
                    out.append((row["key"], row["conv_id"], row["chunk"], int(starts[: at + 1].sum()), int(starts.sum()), ROLES[path[at] // 2], end - at, "\n".join(body)))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * len(kinds), kinds, strict=True)], names=["key", "conv_id", "chunk", "local", "starts", "role", "n_lines", "text"])

    fragments = work.table(chunks.drop("matrix").join(resolved, ["key", "chunk"]).mapInArrow(speak, "key string, conv_id long, chunk long, local long, starts long, role string, n_lines long, text string"), "fragments")
    before = F.sum("starts").over(Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = fragments.groupBy("key", "chunk").agg(F.max("starts").alias("starts")).select("key", "chunk", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = fragments.join(offsets, ["key", "chunk"]).withColumn("turn_no", F.col("before") + F.col("local") - 1)
    turns = numbered.groupBy("key", "turn_no").agg(
        F.first("conv_id").alias("conv_id"),
        F.first("role").alias("role"),
        F.sum("n_lines").alias("n_lines"),
        F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("pieces"),
    )
    text = F.array_join(F.transform("pieces", lambda x: x["text"]), "\n")
    return turns.select("conv_id", "turn_no", "role", "n_lines", text.alias("text"), F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), text, F.lit("\n<|end|>")).alias("rendered"))


#: Ways in which raw transcripts name a speaker; the last leaves the speaker to the model.
STYLES = {
    "system": ("System: ", "[system] ", "### Instructions: ", "System: ", "System: "),
    "user": ("User: ", "Human: ", "Q: ", "**You:** ", ""),
    "assistant": ("Assistant: ", "AI: ", "A: ", "**Assistant:** ", ""),
    "tool": ("Tool: ", "Output: ", "[tool] ", "Tool: ", "Tool: "),
}


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """``conv_id, part, text`` as a chat export would show it: each turn behind a marker in one of several styles."""
    style = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) + 1
    marker = F.lit("")
    for role, styles in STYLES.items():
        marker = F.when(F.col("role") == role, F.element_at(F.array(*map(F.lit, styles)), style.cast("int"))).otherwise(marker)
    return conversations.select("conv_id", F.col("turn").alias("part"), F.concat(marker, F.coalesce("text", F.lit(""))).alias("text"))


def labelled_sample(conversations: DataFrame, sample: int = SAMPLE, turns: int = TURNS) -> list[list[tuple[str, str]]]:
    """The first ``turns`` turns of at most ``sample`` transcripts, those first in the order of a hash, with their roles: to fit the model on."""
    chosen = conversations.where(F.col("role").isin(*ROLES)).select("conv_id").distinct().orderBy(F.xxhash64("conv_id"), "conv_id").limit(sample)
    known = conversations.where(F.col("role").isin(*ROLES) & (F.col("turn") < turns)).join(F.broadcast(chosen), "conv_id", "left_semi")
    raw = raw_transcripts(known).withColumnRenamed("conv_id", "c")
    rows = known.join(raw, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("part"))).select("conv_id", "turn", "role", raw["text"].alias("raw")).dropDuplicates(["conv_id", "turn"]).orderBy("conv_id", "turn").collect()
    return [[(r["role"], r["raw"]) for r in run] for _, run in groupby(rows, lambda r: r["conv_id"])]


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw transcripts of all conversations, parsed and rendered; roles are used for the fit's sample alone."""
    conversations = read_table(spark, sf_dir, "conversations")
    return parse_transcripts(raw_transcripts(conversations), fit(labelled_sample(conversations)))
