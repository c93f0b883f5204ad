"""Queries over sources, sinks and streams: tables are written as files in the shared folder and read back by the library's scans."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.registry import query, table
from corpusloom.sources import artifacts, records
from corpusloom.sources.archives import filesystem
from corpusloom.staging import Workspace
from corpusloom.streaming import enrich

#: Rows in a file, by ranges of their ids, so that no file grows with the table: of lines, which many tasks read at once, of
#: whole texts and archives, and of an array, which is one value to whoever reads it.
LINE_ROWS, FILE_ROWS, ARRAY_ROWS = 20000, 1000, 100
#: Files in a stream's batch: each batch commits the state of all its partitions once.
STREAM_FILES = 500

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def _range(key: str, rows: int) -> Column:
    return F.floor(F.col(key) / rows).cast("long")


def _lines(rows: DataFrame, line: Column, by: list[str], order: list[str], path: str) -> str:
    """Writes a text file for each value of ``by``, its lines in order."""
    placed = rows.repartition(*by).sortWithinPartitions(*by, *order)
    placed.select(*by, line.alias("value")).write.partitionBy(*by).text(path)
    return path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long"))


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def strict_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "strict").path("lines")
    _documents(spark, sf_dir).write.json(path)
    return records.json_lines(spark, path, DOCUMENT)


#: Lines of documents whose length is divisible by five are cut short.
_CUT = "n_chars % 5 = 0"
_CUT_LINES = f"l AS (SELECT *, coalesce({_CUT}, false) AS cut, doc_id // 20000 AS file, row_number() OVER (PARTITION BY doc_id // 20000 ORDER BY doc_id) AS line_no FROM documents)"


def _cut_lines(spark: SparkSession, sf_dir: str, label: str) -> str:
    docs = _documents(spark, sf_dir).withColumn("file", _range("doc_id", LINE_ROWS))
    whole = F.to_json(F.struct("doc_id", "text", "lang", "source", "n_chars"))
    short = F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"), F.lit(', "text"'))
    return _lines(docs, F.when(F.expr(_CUT), short).otherwise(whole), ["file"], ["doc_id"], Workspace(spark, label).path("lines"))


@query(f"""
WITH {_CUT_LINES}
SELECT CASE WHEN NOT cut THEN doc_id END AS doc_id, CASE WHEN NOT cut THEN text END AS text, CASE WHEN NOT cut THEN n_chars END AS n_chars,
CASE WHEN cut THEN line_no END AS malformed_line, CASE WHEN cut THEN '{{"doc_id": ' || doc_id || ', "text"' END AS raw FROM l""")
def permissive_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.json_lines_permissive(spark, _cut_lines(spark, sf_dir, "permissive"), DOCUMENT)
    return rows.select("doc_id", "text", "n_chars", "malformed_line", "raw")


@query(f"WITH {_CUT_LINES} SELECT file, count(*) AS lines, count(*) FILTER (WHERE cut) AS malformed FROM l GROUP BY file")
def audited_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.json_lines_audit(spark, _cut_lines(spark, sf_dir, "audited"))
    return found.select(F.regexp_extract("path", r"file=(\d+)", 1).cast("long").alias("file"), "lines", "malformed")


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def json_array_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "arrays").path("files")
    docs = _documents(spark, sf_dir).withColumn("file", _range("doc_id", ARRAY_ROWS))
    arrays = docs.groupBy("file").agg(F.to_json(F.collect_list(F.struct("doc_id", "text", "lang", "source", "n_chars"))).alias("value"))
    arrays.write.partitionBy("file").text(path)
    return records.json_array(spark, path, DOCUMENT).select("doc_id", "text", "lang", "source", "n_chars")


@query("""
WITH f AS (SELECT coalesce(lang, 'none') AS lang, doc_id // 1000 AS file, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10) AS content FROM documents GROUP BY ALL)
SELECT lang, file, sha256(content) AS sha256, octet_length(encode(content)) AS n_bytes FROM f WHERE lang <> 'de'""")
def walked_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of texts below folders by language, one of which the walk leaves out."""
    docs = _documents(spark, sf_dir).withColumn("lang", F.coalesce("lang", F.lit("none"))).withColumn("file", _range("doc_id", FILE_ROWS))
    root = _lines(docs, F.coalesce("text", F.lit("")), ["lang", "file"], ["doc_id"], Workspace(spark, "walked").path("files"))
    found = records.text_files(spark, root, [".txt"], ["lang=de/"])
    named = lambda key: F.regexp_extract("path", f"{key}=([^/]+)/", 1)
    return found.select(named("lang").alias("lang"), named("file").cast("long").alias("file"), "sha256", F.col("bytes").cast("long").alias("n_bytes"))


def _zipped(rows: DataFrame, path: str) -> int:
    """Writes ``archive, member, content`` as a ZIP archive for each ``archive``; gives their number."""

    def write(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = filesystem(path)
        files.create_dir(base, recursive=True)
        from pyspark import TaskContext

        at = f"{base}/{key[0]}.zip"
        begun = f"{at}.{TaskContext.get().taskAttemptId()}"
        with files.open_output_stream(begun) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for frame in frames:
                for member, content in zip(frame["member"], frame["content"], strict=True):
                    z.writestr(member, content or "")
        files.move(begun, at)
        yield pd.DataFrame({"archive": [key[0]]})

    return rows.groupBy("archive").applyInPandas(write, "archive long").count()


@query("""
SELECT page_id // 1000 AS archive, CASE WHEN page_id % 2 = 0 THEN 'preferred/' ELSE 'pages/' END || page_id || '.md' AS member,
octet_length(encode(coalesce(html, ''))) AS n_bytes, sha256(coalesce(html, '')) AS sha256 FROM pages""")
def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as members of ZIP archives, beside members that aren't Markdown, read back by member."""
    path = Workspace(spark, "archives").path("zips")
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("content")).withColumn("archive", _range("page_id", FILE_ROWS))
    folder = F.when(F.col("page_id") % 2 == 0, F.lit("preferred/")).otherwise(F.lit("pages/"))
    members = pages.withColumn("suffix", F.explode(F.array(F.lit(".md"), F.lit(".txt"))))
    _zipped(members.select("archive", F.concat(folder, F.col("page_id").cast("string"), F.col("suffix")).alias("member"), "content"), path)
    found = records.zip_markdown(spark, path, ["preferred/"])
    return found.select(F.regexp_extract("archive", r"(\d+)\.zip$", 1).cast("long").alias("archive"), "member", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


@query("""
WITH c AS (SELECT conv_id, count(*) AS n, md5(string_agg(role || ':' || coalesce(text, ''), chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id),
l AS (SELECT *, conv_id // 20000 AS file, row_number() OVER (PARTITION BY conv_id // 20000 ORDER BY conv_id) - 1 AS place FROM c)
SELECT 'f' || file AS source, CASE WHEN n % 2 = 0 THEN conv_id ELSE place END AS number, n % 2 = 0 AS named, n AS n_messages, digest FROM l""")
def ingested_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of even length have an id of their own, the others are wrapped and get their line's."""
    turns = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL")
    messages = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    rows = turns.groupBy("conv_id").agg(messages.alias("messages")).withColumn("file", _range("conv_id", LINE_ROWS))
    own, source = F.size("messages") % 2 == 0, F.concat(F.lit("f"), F.col("file").cast("string")).alias("source")
    plain = F.to_json(F.struct(F.concat(F.lit("own-"), F.col("conv_id").cast("string")).alias("id"), source, "messages"))
    wrapped = F.to_json(F.struct(source, F.struct("messages").alias("conversation")))
    path = _lines(rows, F.when(own, plain).otherwise(wrapped), ["file"], ["conv_id"], Workspace(spark, "trajectories").path("lines"))
    spelled = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    number = F.regexp_extract("id", r"-(\d+)$", 1).cast("long").alias("number")
    return records.trajectories(spark, path).select("source", number, F.startswith("id", F.lit("own-")).alias("named"), F.size("messages").cast("long").alias("n_messages"), F.md5(spelled).alias("digest"))


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, role, replace(text, '@', ' at ') AS text FROM conversations")
def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "conversations").path("lines")
    records.write_conversations(table(spark, sf_dir, "conversations"), path, lambda turns: turns.withColumn("text", F.replace("text", F.lit("@"), F.lit(" at "))))
    found = records.json_lines(spark, path, "conv_id long, messages array<struct<role:string,content:string>>")
    return found.select("conv_id", F.posexplode("messages").alias("place", "m")).select("conv_id", F.col("place").cast("long").alias("place"), "m.role", F.col("m.content").alias("text"))


#: An artifact for all documents, one for those with a language and one for long ones.
_ARTIFACTS = {"all": "true", "known": "lang IS NOT NULL", "long": "n_chars > 2000"}
_CHOSEN = " UNION ALL ".join(f"SELECT '{name}' AS artifact, * FROM documents WHERE {held}" for name, held in _ARTIFACTS.items())


def _labelled(docs: DataFrame) -> DataFrame:
    return docs.withColumn("artifact", F.array_compact(F.array(*[F.when(F.expr(held), F.lit(name)) for name, held in _ARTIFACTS.items()])))


@query(f"SELECT artifact, doc_id, text, lang, source, n_chars FROM ({_CHOSEN})")
def written_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three artifacts in one pass, read back by the files that the manifest lists."""
    path = Workspace(spark, "artifacts").path("out")
    artifacts.write_artifacts(_labelled(_documents(spark, sf_dir)), path, "overwrite", compression="gzip")
    parts = [artifacts.read_artifact(spark, path, name, DOCUMENT).select(F.lit(name).alias("artifact"), "doc_id", "text", "lang", "source", "n_chars") for name in _ARTIFACTS]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"""
WITH n AS (SELECT artifact, count(*) AS n FROM ({_CHOSEN}) GROUP BY artifact)
SELECT CAST(version AS BIGINT) AS version, artifact, n AS n_rows FROM n, (VALUES (1), (2)) v(version)""")
def appended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps append to one log; its manifests are the rows."""
    path, docs = Workspace(spark, "log").path("out"), _labelled(_documents(spark, sf_dir))
    for step in ("first", "second"):
        artifacts.write_artifacts(docs, path, note=step, compression="gzip")
    log = spark.read.schema("version long, rows map<string,long>").json(f"{path}/{artifacts.LOG}")
    return log.select("version", F.explode("rows").alias("artifact", "n_rows"))


@query(f"SELECT artifact, count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM ({_CHOSEN}) GROUP BY artifact")
def released_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release made, and resumed by its fingerprint without being made again."""
    path, docs = Workspace(spark, "release").path("out"), _documents(spark, sf_dir)
    held = {name: F.expr(rule) for name, rule in _ARTIFACTS.items()}
    for resume in (False, True):
        records.write_release(docs, path, held, "documents", resume)
    return spark.read.parquet(f"{path}/rows").groupBy("artifact").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_chars").alias("n_chars"))


@query("SELECT doc_id, md5(lower(text)) AS digest, n_chars, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END AS size FROM documents")
def enriched_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive twice; each is enriched once, over two runs of the stream."""
    work = Workspace(spark, "enriched")
    docs = _documents(spark, sf_dir).select("doc_id", "text", "n_chars")
    digests = lambda rows: rows.select("doc_id", F.md5(F.lower("text")).alias("digest"), "n_chars")
    step = lambda rows: rows.withColumn("size", F.when(F.col("n_chars") > 2000, F.lit("long")).otherwise(F.lit("short")))
    for _ in range(2):
        docs.write.mode("append").parquet(work.path("in"))
        enrich.enrich(spark, work.path("in"), docs.schema, work.path("out"), work.path("checkpoint"), "doc_id", step, STREAM_FILES, digests).awaitTermination()
    return spark.read.parquet(work.path("out"))


@query("SELECT source, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY source")
def first_documents_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each source, as a registry keeps it that ignores later writers; and the source's documents."""
    work, docs = Workspace(spark, "registry"), _documents(spark, sf_dir).select("source", "doc_id")
    least = docs.groupBy("source").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    least.write.parquet(work.path("in"))
    for k in range(2):
        if k:
            docs.withColumn("n", F.lit(0).cast("long")).write.mode("append").parquet(work.path("in"))
        enrich.register_first(spark, work.path("in"), least.schema, work.path("out"), work.path("checkpoint"), "source", "doc_id", STREAM_FILES).awaitTermination()
    return spark.read.parquet(work.path("out"))


@query("SELECT time_bucket(INTERVAL 5 minutes, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL")
def events_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An addition: windows by event time."""
    events = table(spark, sf_dir, "events").withColumn("value", F.round(F.col("value") * 100).cast("long"))
    return enrich.event_windows(events).withColumnRenamed("total", "cents")
