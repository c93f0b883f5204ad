"""Members of ZIP archives as rows: a data source that reads central directories first and then each member by itself."""

from __future__ import annotations

import fnmatch
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def filesystem(path: str):
    """A file system and the path in it; a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Members(InputPartition):
    """Neighbouring members of one archive, by their offsets."""

    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class ZipMembers(DataSource):
    """``spark.read.format("zip_members").load(path)``: ``archive, member, size, content`` of an archive or of all below a folder.

    Options: ``pattern`` (of member names, ``*`` by default), ``splitBytes`` (compressed bytes of the members that one task reads
    together, one member at least) and ``batchBytes`` (content in an Arrow batch). A task opens its archive, reads the
    directory at its end and then only its members, so an archive may be larger than any memory; a member may not.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, member string, size long, content binary"

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options)


class ZipReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.split, self.batch = int(options.get("splitBytes", 32 << 20)), int(options.get("batchBytes", 4 << 20))

    def _wanted(self, archive: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
        found = [x for x in archive.infolist() if not x.is_dir() and fnmatch.fnmatchcase(x.filename, self.pattern)]
        return sorted(found, key=lambda x: x.header_offset)

    def partitions(self) -> list[Members]:
        """Runs of members of about ``splitBytes``, from the directories alone."""
        from pyarrow import fs

        files, base = filesystem(self.path)
        info = files.get_file_info(base)
        found = [info] if info.is_file else files.get_file_info(fs.FileSelector(base, recursive=True))
        parts = []
        for path in sorted(x.path for x in found if x.is_file and (info.is_file or x.path.endswith(".zip"))):
            with files.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
                first, last, size = None, None, 0
                for entry in self._wanted(archive):
                    if first is not None and size + entry.compress_size > self.split:
                        parts.append(Members(path, first, last))
                        first, size = None, 0
                    first, last, size = entry.header_offset if first is None else first, entry.header_offset, size + entry.compress_size
                if first is not None:
                    parts.append(Members(path, first, last))
        return parts or [Members("", 0, -1)]

    def read(self, part: Members) -> Iterator[pa.RecordBatch]:
        if part.last < part.first:
            return
        files, _ = filesystem(self.path)
        rows, size = [], 0
        with files.open_input_file(part.path) as f, zipfile.ZipFile(f) as archive:
            for entry in self._wanted(archive):
                if part.first <= entry.header_offset <= part.last:
                    rows.append((part.path, entry.filename, entry.file_size, archive.read(entry)))
                    size += entry.file_size
                    if size >= self.batch:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["archive", "member", "size", "content"])


def zip_members(spark: SparkSession, path: str, pattern: str = "*", **options: int) -> DataFrame:
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").options(path=path, pattern=pattern, **{k: str(v) for k, v in options.items()}).load()
