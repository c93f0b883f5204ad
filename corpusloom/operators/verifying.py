"""Verifiers and repairers that a user plugs in: batches of Arrow records in, verdicts or new texts out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.staging import Workspace


class Verifier(Protocol):
    """``schema`` names the columns that ``verify`` adds to a batch, in order; it gives a column for each, a value for each row."""

    schema: str

    def verify(self, batch: pa.RecordBatch) -> list[pa.Array]: ...


def verified(df: DataFrame, verifier: Verifier) -> DataFrame:
    """The rows of ``df`` with the verifier's columns; batches are verified in any order and again if an executor is lost."""
    added = [x.split()[0] for x in verifier.schema.split(", ")]
    own = df.drop(*added)
    names = [*own.columns, *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, *verifier.verify(batch)], names=names)

    return own.mapInArrow(run, ", ".join([*[f"`{c}` {t}" for c, t in own.dtypes], verifier.schema]))


def repaired(df: DataFrame, key: str, verify: Callable[[DataFrame], DataFrame], repair: Callable[[DataFrame], DataFrame], rounds: int) -> DataFrame:
    """The rows of ``df`` after at most ``rounds`` repairs, with ``passed, attempts``.

    ``verify`` adds ``passed`` to rows, ``repair`` gives rows of the same columns. Only rows that fail are repaired and
    verified again; each round is staged, so none of its calls is repeated for the next.
    """
    work = Workspace(df.sparkSession, "repair")
    latest = work.table(verify(df).withColumn("attempts", F.lit(0)), "round0")
    done = latest.where("passed")
    for turn in range(1, rounds + 1):
        failed = latest.where("not passed or passed is null")
        if failed.isEmpty():
            return done
        again = verify(repair(failed.select(*df.columns))).withColumn("attempts", F.lit(turn))
        latest = work.table(again, f"round{turn}")
        done = done.unionByName(latest.where("passed"))
    return done.unionByName(latest.where("not passed or passed is null"))
