"""A data source writer: several artifacts in one pass, visible only by a manifest that each commit adds to a log."""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from corpusloom.sources.archives import filesystem

LOG, DATA = "_log", "data"
#: gzip's fastest level: texts take an eighth more than at its slowest, in a sixth of the time.
LEVEL = 1


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: name, file, rows and bytes of each artifact's part."""

    parts: list[dict]


class Artifacts(DataSource):
    """``df.write.format("artifacts").mode("append").save(folder)``: rows by their column ``artifact`` (a name, or a list of names).

    A row goes into each artifact that it names, as a line of JSON with its other columns in the order of their names; nulls are
    kept. Tasks write files that nobody looks for. The commit adds one manifest to the log, by rename; only files that a
    manifest lists are part of an artifact, so a task that is killed, run twice or belongs to a failed job leaves nothing
    visible. ``append`` keeps earlier manifests, ``overwrite`` makes readers begin at the new one. Options: ``note`` is written into the manifest,
    ``compression`` is ``none`` or ``gzip`` (a file, which is a task's part of an artifact, is then read by one task).
    """

    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def writer(self, schema: T.StructType, overwrite: bool) -> ArtifactWriter:
        return ArtifactWriter(dict(self.options), schema, overwrite)


class ArtifactWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        if "artifact" not in schema.names:
            raise ValueError("rows need a column named artifact")
        self.path, self.note, self.overwrite = options["path"], options.get("note"), overwrite
        self.compression = options.get("compression", "none")
        if self.compression not in ("none", "gzip"):
            raise ValueError("compression is none or gzip")
        self.names = sorted(x for x in schema.names if x != "artifact")
        self.job = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, base = filesystem(self.path)
        open_files, counts, sizes, attempt = {}, {}, {}, uuid.uuid4().hex
        try:
            for batch in batches:
                labels = batch.column(batch.schema.get_field_index("artifact"))
                lines = [json.dumps(row, sort_keys=True, default=str, ensure_ascii=False) for row in batch.select(self.names).to_pylist()]
                several = pa.types.is_list(labels.type) or pa.types.is_large_list(labels.type)
                for line, held in zip(lines, labels.to_pylist(), strict=True):
                    for name in (held or []) if several else ([] if held is None else [held]):
                        if name not in open_files:
                            folder = f"{base}/{DATA}/{name}"
                            files.create_dir(folder, recursive=True)
                            at = f"{folder}/{self.job}-{attempt}.jsonl" + (".gz" if self.compression == "gzip" else "")
                            raw_file = files.open_output_stream(at, compression=None)
                            stream = gzip.GzipFile("", "wb", LEVEL, raw_file, 0) if self.compression == "gzip" else raw_file
                            open_files[name], counts[name], sizes[name] = (at, stream, raw_file), 0, 0
                        raw = line.encode() + b"\n"
                        open_files[name][1].write(raw)
                        counts[name] += 1
                        sizes[name] += len(raw)
        finally:
            for _, stream, raw_file in open_files.values():
                try:
                    stream.close()
                finally:
                    raw_file.close()
        return Written([{"artifact": n, "file": at[len(base) + 1 :], "rows": counts[n], "bytes": sizes[n]} for n, (at, *_) in sorted(open_files.items())])

    def commit(self, messages: list[Written | None]) -> None:
        """Adds the next manifest; a file of that number is there wholly or not at all."""
        files, base = filesystem(self.path)
        parts = sorted((p for m in messages if m is not None for p in m.parts), key=lambda p: (p["artifact"], p["file"]))
        rows: dict[str, int] = {}
        for p in parts:
            rows[p["artifact"]] = rows.get(p["artifact"], 0) + p["rows"]
        number = len(_log(self.path)) + 1
        manifest = {"version": number, "job": self.job, "note": self.note, "overwrite": self.overwrite, "rows": dict(sorted(rows.items())), "files": parts}
        files.create_dir(f"{base}/{LOG}", recursive=True)
        at, tmp = f"{base}/{LOG}/{number:012d}.json", f"{base}/{LOG}/.{self.job}.tmp"
        with files.open_output_stream(tmp) as f:
            f.write(json.dumps(manifest, sort_keys=True).encode())
        if files.get_file_info(at).is_file:
            files.delete_file(tmp)
            raise OSError(f"another job has committed {number}")
        files.move(tmp, at)

    def abort(self, messages: list[Written | None]) -> None:
        """Removes what ended tasks have written; what a killed one left is never read."""
        files, base = filesystem(self.path)
        for m in messages:
            for p in m.parts if m is not None else ():
                files.delete_file(f"{base}/{p['file']}")


def _log(path: str) -> list[dict]:
    from pyarrow import fs

    files, base = filesystem(path)
    found = files.get_file_info(fs.FileSelector(f"{base}/{LOG}", allow_not_found=True))
    names = sorted(x.path for x in found if x.is_file and x.base_name[:1].isdigit())
    out = []
    for name in names:
        with files.open_input_stream(name) as f:
            out.append(json.loads(f.read()))
    return out


def manifests(path: str) -> list[dict]:
    """The manifests that count, the oldest first: those from the last overwriting one on."""
    log = _log(path)
    last = max((k for k, m in enumerate(log) if m["overwrite"]), default=0)
    return log[last:]


def write_artifacts(rows: DataFrame, path: str, mode: str = "append", note: str | None = None, compression: str = "none") -> dict:
    """Writes ``rows`` by their column ``artifact`` in one pass; gives the manifest. Sizes in it are those of the lines, uncompressed."""
    rows.sparkSession.dataSource.register(Artifacts)
    options = {"path": path, "compression": compression} | ({"note": note} if note is not None else {})
    rows.write.format("artifacts").mode(mode).options(**options).save()
    return manifests(path)[-1]


def read_artifact(spark: SparkSession, path: str, artifact: str, schema: T.StructType | str) -> DataFrame:
    """The rows of one artifact, from the files that manifests list."""
    files = [f"{path}/{p['file']}" for m in manifests(path) for p in m["files"] if p["artifact"] == artifact]
    return spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)
