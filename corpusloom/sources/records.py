"""Scans of record files: strict, permissive and audited JSON lines, arrays, whole files, archives, Markdown, traces."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources.archives import zip_members
from corpusloom.sources.lines import PLACE, line_number, numbered, ranges, split_lines
from corpusloom.staging import Workspace


class ScanError(ValueError):
    """A scan that must not go on; the message begins with a code."""


def _is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(F.ltrim(value), F.lit("{")) & F.try_parse_json(value).isNotNull(), F.lit(False))


def _first_bad(lines: DataFrame) -> tuple[str, int] | None:
    """Path and line number of the first line that is no JSON object; one reading, a row for each byte range of a file."""
    bad = (F.trim("value") != "") & ~_is_object(F.col("value"))
    found = ranges(lines, bad=F.min(F.when(bad, F.col("at")))).where("bad is not null")
    first = found.agg(F.min(F.struct("path", line_number("bad").alias("line_no"))).alias("f")).first()["f"]
    return None if first is None else (first["path"], first["line_no"])


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Strict: the first bad line, by path and number, ends the scan with a code. Blank lines count, but aren't rows.

    Lines are checked once, before the first row is given, and parsed into ``schema`` when rows are read.
    """
    lines = split_lines(spark, path)
    if bad := _first_bad(lines):
        raise ScanError(f"JSONL_INVALID: {bad[0]}:{bad[1]}")
    return lines.where(F.trim("value") != "").select(F.from_json("value", schema).alias("record")).select("record.*")


def _parsed(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """All lines but blank ones, parsed once and staged: ``path, block, at, bad, record, raw`` (of bad ones); the byte ranges.

    Places hold for one reading of the files only, so lines that are to be numbered stay with theirs.
    """
    lines = split_lines(spark, path)
    bad = ~_is_object(F.col("value"))
    parsed = lines.select(*PLACE, (F.trim("value") == "").alias("blank"), bad.alias("bad"), F.when(~bad, F.from_json("value", schema)).alias("record"), F.when(bad, F.col("value")).alias("raw"))
    staged = Workspace(spark, "lines").table(parsed, "parsed")
    return staged.where("not blank").drop("blank"), ranges(staged)


def json_lines_permissive(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Bad lines stay as rows with ``malformed_line`` and ``raw``; only these are numbered."""
    rows, found = _parsed(spark, path, schema)
    good = rows.where("not bad").select("record.*", F.lit(None).cast("long").alias("malformed_line"), "raw")
    return good.union(numbered(rows.where("bad"), found).select("record.*", F.col("line_no").alias("malformed_line"), "raw"))


def json_lines_audit(spark: SparkSession, path: str) -> DataFrame:
    """``path, lines, malformed``: bad lines counted, none fatal."""
    held = split_lines(spark, path).where(F.trim("value") != "")
    return held.groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.count_if(~_is_object(F.col("value"))).alias("malformed"))


def json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Files that hold one array of records each; anything else is drift of the schema."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    odd = files.where(~F.startswith(F.trim("value"), F.lit("["))).agg(F.min("path")).first()[0]
    if odd is not None:
        raise ScanError(f"SCHEMA_DRIFT: {odd}")
    return spark.read.schema(schema).option("multiLine", True).json(path)


def text_files(spark: SparkSession, root: str, suffixes: Sequence[str], exclude: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """``path, content, sha256, bytes`` of the files below ``root`` with one of the suffixes, sorted; a missing root is fatal."""
    found = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | F.endswith("path", F.lit(s))
    for pattern in exclude:
        wanted = wanted & ~F.contains("path", F.lit(pattern))
    rows = found.where(wanted).select("path", "content", F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("bytes")).orderBy("path")
    return rows if most is None else rows.limit(most)


def zip_markdown(spark: SparkSession, path: str, preferred: Sequence[str] = ()) -> DataFrame:
    """``archive, member, content`` of the Markdown files in ZIP archives, preferred paths first; what isn't UTF-8 is read as U+FFFD."""
    members = zip_members(spark, path, "*.md").select("archive", "member", F.col("content").cast("string"))
    first = F.lit(1)
    for p in preferred:
        first = F.when(F.contains("member", F.lit(p)), 0).otherwise(first)
    return members.select("archive", "member", F.when(F.is_valid_utf8("content"), F.col("content")).otherwise(F.make_valid_utf8("content")).alias("content")).orderBy(first, "archive", "member")


TRAJECTORY = "id string, source string, messages array<struct<role:string,content:string>>, conversation struct<messages:array<struct<role:string,content:string>>>"


def trajectories(spark: SparkSession, path: str) -> DataFrame:
    """``id, source, messages``: wrapped conversations are unwrapped, missing ids are the file's stem and the line, from 0."""
    rows, found = _parsed(spark, path, TRAJECTORY)
    good = rows.where("not bad")
    named = good.where("record.id is not null").withColumn("line_no", F.lit(None).cast("long"))
    parsed = named.unionByName(numbered(good.where("record.id is null"), found))
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    identity = F.coalesce("record.id", F.concat(stem, F.lit("-"), (F.col("line_no") - 1).cast("string")))
    return parsed.select(identity.alias("id"), F.coalesce("record.source", stem).alias("source"), F.coalesce("record.conversation.messages", "record.messages").alias("messages"))


def markdown_index(spark: SparkSession, path: str) -> DataFrame:
    """``uuid, path``: the last path of each UUID in a file name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(path).select("path")
    uuid = F.regexp_extract("path", r"([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})", 1)
    return files.select(uuid.alias("uuid"), "path").where("uuid <> ''").groupBy("uuid").agg(F.max("path").alias("path"))


def trace_events(spark: SparkSession, path: str) -> DataFrame:
    """``name, n, total_us`` of a profiler's (gzipped) trace; exactly one file is expected."""
    files = spark.read.format("binaryFile").load(path).count()
    if files != 1:
        raise ScanError(f"TRACE_FILE_COUNT: {files}")
    trace = spark.read.schema("traceEvents array<struct<name:string,dur:double>>").option("multiLine", True).json(path)
    return trace.select(F.inline("traceEvents")).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("dur").alias("total_us"))


def write_conversations(turns: DataFrame, path: str, scrub=None) -> None:
    """One JSON line per conversation with its messages in order, scrubbed if asked; never over existing files."""
    rows = scrub(turns) if scrub else turns
    messages = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["text"].alias("content"), m["role"].alias("role")))
    rows.groupBy("conv_id").agg(messages.alias("messages")).select("conv_id", "messages").write.mode("errorifexists").json(path)


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def write_release(rows: DataFrame, path: str, artifacts: dict[str, Column], fingerprint: str, resume: bool = False) -> dict:
    """Writes ``path/artifact=name`` for each name, of the rows for which its condition holds, in one pass; gives the manifest.

    The manifest is written last and holds the fingerprint and the rows of each artifact. A folder with a finished release is
    refused, or with ``resume`` left as it is if its fingerprint is the same one; with ``resume`` an unfinished one is made anew.
    """
    spark = rows.sparkSession
    files, where = _files(spark, path)
    if files.exists(where) and files.listStatus(where):
        done = _files(spark, f"{path}/_manifest")[1]
        if not resume or not (files.exists(done) or files.exists(_files(spark, f"{path}/_begun")[1])):
            raise ScanError(f"OUTPUT_NOT_EMPTY: {path}")
        if files.exists(done):
            known = json.loads(spark.read.text(f"{path}/_manifest").first()[0])
            if known["fingerprint"] != fingerprint:
                raise ScanError("RESUME_FINGERPRINT_MISMATCH")
            return known
    spark.createDataFrame([(fingerprint,)], "value string").write.mode("overwrite").text(f"{path}/_begun")
    names = F.array_compact(F.array(*[F.when(held, F.lit(name)) for name, held in artifacts.items()]))
    rows.withColumn("artifact", F.explode(names)).write.mode("overwrite").partitionBy("artifact").parquet(f"{path}/rows")
    counts = {r["artifact"]: r["count"] for r in spark.read.parquet(f"{path}/rows").groupBy("artifact").count().collect()}
    manifest = {"fingerprint": fingerprint, "rows": {name: counts.get(name, 0) for name in artifacts}}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_manifest")
    files.delete(_files(spark, f"{path}/_begun")[1], True)
    return manifest
