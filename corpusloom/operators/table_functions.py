"""Operators as table functions, for SQL: ``SELECT * FROM flatten_turns(TABLE(turns) PARTITION BY conv_id ORDER BY turn)``.

A table function sees the rows of a partition one after another and keeps only what the next row needs, so its memory doesn't
grow with the partition; but one task reads the whole partition. The DataFrame operators beside them cut hot groups
into ranges; these are for SQL users, whose groups one task can read.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


def _columns(table: AnalyzeArgument, *names: str) -> dict[str, T.DataType]:
    if not table.isTable:
        raise ValueError("the first argument is a table: TABLE(name)")
    kinds = {f.name: f.dataType for f in table.dataType.fields}
    if missing := [n for n in names if n not in kinds]:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    return kinds


class FlattenTurns:
    """``conv_id, turn, system, user, assistant``: a row for each assistant message with the last user message before it.

    Arguments: a table with ``conv_id, turn, role, text``, and optionally ``system`` and ``orphan``, the user message where there is
    none before. Partitions by conversation and orders by turn by itself. Null user messages don't count.
    """

    def __init__(self):
        self.user = None

    @staticmethod
    def analyze(table: AnalyzeArgument, system: AnalyzeArgument | None = None, orphan: AnalyzeArgument | None = None) -> AnalyzeResult:
        kinds = _columns(table, "conv_id", "turn", "role", "text")
        schema = T.StructType([T.StructField("conv_id", kinds["conv_id"]), T.StructField("turn", kinds["turn"])])
        for name in ("system", "user", "assistant"):
            schema = schema.add(name, T.StringType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("conv_id")], orderBy=[OrderingColumn("turn")])

    def eval(self, row, system: str = "You are a helpful assistant.", orphan: str = "Continue."):
        if row["role"] == "assistant":
            yield row["conv_id"], row["turn"], system, orphan if self.user is None else self.user, row["text"]
        elif row["role"] == "user" and row["text"] is not None:
            self.user = row["text"]


class PackRows:
    """``grp, key, pack, offset, tokens``: rows of a group laid end to end and cut into packs of ``length`` tokens.

    Arguments: a table with ``grp, key, size``, and ``length``. Rows are taken in the order of their key; a row is split where a pack
    ends, and the last pack may be shorter. Rows without tokens are in no pack.
    """

    def __init__(self):
        self.at = 0

    @staticmethod
    def analyze(table: AnalyzeArgument, length: AnalyzeArgument) -> AnalyzeResult:
        kinds = _columns(table, "grp", "key", "size")
        if length.value is None or length.value < 1:
            raise ValueError("length is a constant of at least 1")
        schema = T.StructType([T.StructField("grp", kinds["grp"]), T.StructField("key", kinds["key"])])
        for name in ("pack", "offset", "tokens"):
            schema = schema.add(name, T.LongType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("grp")], orderBy=[OrderingColumn("key")])

    def eval(self, row, length: int):
        left = int(row["size"] or 0)
        while left > 0:
            taken = min(left, length - self.at % length)
            yield row["grp"], row["key"], self.at // length, self.at % length, taken
            self.at += taken
            left -= taken


def register(spark: SparkSession) -> None:
    """Makes ``flatten_turns`` and ``pack_rows`` known to the session's SQL."""
    from pyspark.sql.functions import udtf

    for name, made in (("flatten_turns", FlattenTurns), ("pack_rows", PackRows)):
        spark.udtf.register(name, udtf(made))
