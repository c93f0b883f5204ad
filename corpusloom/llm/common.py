"""Small helpers of the training-data operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusloom.staging import Workspace, scratch, settings, shared_dir

__all__ = ["Workspace", "read_table", "readable", "scratch", "settings", "shared_dir"]


def readable(raw: pa.Array) -> pa.Array:
    """Strings or bytes as text; what isn't UTF-8 is read as U+FFFD."""
    text = raw.cast(pa.binary()).cast(pa.string(), safe=False)
    try:
        text.validate(full=True)
        return text
    except pa.ArrowInvalid:
        return pa.array([x.as_py().decode("utf-8", "replace") if x.is_valid else None for x in raw.cast(pa.binary())], pa.string())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
