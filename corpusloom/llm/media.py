"""Media columns: a Spark data source over archives of media members.

``write_archives`` stores payloads losslessly as 8-bit grey PNG images (64 samples a row) in ZIP archives of
bounded size, one writer task at a time. ``MediaArchiveSource`` plans byte ranges over a folder of such
archives, streams the members of a range as Arrow batches of bounded size, and retries each member on its own
at its offset.
"""

from __future__ import annotations

import hashlib
import re
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusloom.llm.common import Workspace, read_table

ROW = 64
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad_payload(raw: bytes) -> bytes:
    """Bytes 0 are appended up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % ROW if raw else ROW)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(raw: bytes, level: int = 1) -> bytes:
    """An 8-bit grey PNG of the padded payload; the unpadded length stands in a tEXt chunk."""
    samples = np.frombuffer(pad_payload(raw), np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(samples), ROW + 1), np.uint8)
    lines[:, 1:] = samples
    return b"".join(
        [
            PNG_SIGNATURE,
            _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(samples), 8, 0, 0, 0, 0)),
            _chunk(b"tEXt", b"Bytes\0%d" % len(raw)),
            _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)),
            _chunk(b"IEND", b""),
        ]
    )


def decode_png(media: bytes) -> tuple[bytes, int]:
    """Payload and unpadded length; every chunk's checksum is verified."""
    if media[:8] != PNG_SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, n_bytes, rows = 8, [], -1, -1
    while at < len(media):
        (size,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError(f"bad checksum in {kind!r}")
        if kind == b"IHDR":
            rows = struct.unpack_from(">II", body)[1]
        elif kind == b"tEXt" and body.startswith(b"Bytes\0"):
            n_bytes = int(body[6:])
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(rows, ROW + 1)
    return (_unfiltered(lines) if lines[:, 0].any() else lines[:, 1:]).tobytes(), n_bytes


def _unfiltered(lines: np.ndarray) -> np.ndarray:
    """The samples of rows that begin with their filter's number, as other writers of PNG store them."""
    out = np.zeros((len(lines) + 1, ROW + 1), np.uint8)  # a row and a column of zeros stand before the first ones
    for k, line in enumerate(lines, 1):
        kind, row, up = int(line[0]), line[1:], out[k - 1]
        if kind in (0, 2):
            out[k, 1:] = row + (up[1:] if kind else np.uint8(0))
        elif kind == 1:
            out[k, 1:] = np.cumsum(row, dtype=np.uint64).astype(np.uint8)
        elif kind in (3, 4):
            for x in range(1, ROW + 1):
                a, b, c = int(out[k, x - 1]), int(up[x]), int(up[x - 1])
                near = (a + b) // 2 if kind == 3 else min((a, b, c), key=lambda v: abs(a + b - c - v))
                out[k, x] = (int(row[x - 1]) + near) % 256
        else:
            raise ValueError(f"filter {kind} is unknown")
    return out[1:, 1:]


def describe(payload: bytes) -> str:
    """Statistics of the samples, as text: the same for equal payloads on any machine."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    mean = int(counts @ np.arange(256)) / len(samples)
    changes = int(np.count_nonzero(samples[1:] != samples[:-1]))
    return f"n={len(samples)};mean={mean:.4f};peak={int(counts.argmax())};levels={int((counts > 0).sum())};changes={changes}"


def _filesystem(path: str):
    """The file system of a path and the path in it; the names that Hadoop gives S3 are read as S3."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


def write_archives(docs: DataFrame, root: str, archive_bytes: int = 64 << 20) -> DataFrame:
    """One row per archive written under ``root``; ``docs`` has ``doc_id`` and ``text`` (null: empty).

    Archive names follow from the partition alone and appear by a rename, so a task that runs again replaces
    its own archives with the same ones.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        files, base = _filesystem(root)
        files.create_dir(base, recursive=True)
        done: list[tuple[str, int, int]] = []
        state: dict = {"zip": None}

        def close() -> None:
            if state["zip"] is not None:
                members = len(state["zip"].infolist())
                state["zip"].close()
                size = state["raw"].tell()
                state["raw"].close()
                final = f"{base}/part-{context.partitionId():07d}-{len(done):05d}.zip"
                try:
                    files.move(state["tmp"], final)
                except OSError:
                    files.delete_file(final)
                    files.move(state["tmp"], final)
                done.append((final.rpartition("/")[2], members, size))
                state["zip"] = None

        try:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if state["zip"] is None:
                        state["tmp"] = f"{base}/tmp-{context.taskAttemptId()}-{len(done)}"
                        state["raw"] = files.open_output_stream(state["tmp"])
                        state["zip"] = zipfile.ZipFile(state["raw"], "w", zipfile.ZIP_STORED)
                    media = encode_png(text.as_py() or b"")
                    name = zipfile.ZipInfo(f"{'null' if doc_id is None else doc_id}/{len(state['zip'].filelist)}.png")
                    state["zip"].writestr(name, media)
                    if state["zip"].fp.tell() >= archive_bytes:
                        close()
            close()
        except BaseException:
            if state["zip"] is not None:  # what a failed attempt began isn't left behind
                state["raw"].close()
                files.delete_file(state["tmp"])
            raise
        yield pa.RecordBatch.from_pydict(
            {
                "archive": pa.array([x[0] for x in done], pa.string()),
                "members": pa.array([x[1] for x in done], pa.int64()),
                "bytes": pa.array([x[2] for x in done], pa.int64()),
            }
        )

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(write, "archive string, members long, bytes long")


class _Window:
    """Bytes of an open file, read ahead: neighbouring members come with one request."""

    def __init__(self, f, ahead: int):
        self.f, self.ahead, self.start, self.held = f, ahead, 0, b""

    def get(self, start: int, size: int) -> bytes:
        if start < self.start or start + size > self.start + len(self.held):
            self.start, self.held = start, self.f.read_at(max(size, self.ahead), start)
        return self.held[start - self.start : start - self.start + size]


def _header_size(head: bytes) -> int:
    """How many bytes stand before a member's content."""
    if len(head) != 30 or head[:4] != b"PK\x03\x04":
        raise OSError("no member starts here")
    return 30 + sum(struct.unpack_from("<HH", head, 26))


def _content(raw: bytes, entry: zipfile.ZipInfo) -> bytes:
    """A member's bytes, checked."""
    media = zlib.decompress(raw, -15) if entry.compress_type == zipfile.ZIP_DEFLATED else raw
    if len(media) != entry.file_size or zlib.crc32(media) != entry.CRC:
        raise OSError("checksum or length differs")
    return media


class ArchiveRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class MediaArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(folder)``: a row for each member of each archive.

    Options: ``splitBytes`` (bytes of an archive that one task takes), ``batchBytes`` (media in an Arrow
    batch), ``attempts`` (reads of a member before it counts as failed), ``pauseSeconds`` (before the second of them, doubled
    each time), ``mode`` (``failfast`` raises then,
    ``permissive`` returns the member with null media and its error).
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, member string, offset long, media binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.split = int(options.get("splitBytes", 32 << 20))
        self.batch = int(options.get("batchBytes", 8 << 20))
        self.attempts = int(options.get("attempts", 3))
        self.pause = float(options.get("pauseSeconds", 0.5))
        self.permissive = options.get("mode", "failfast").lower() == "permissive"

    def partitions(self) -> list[ArchiveRange]:
        """Byte ranges: only names and sizes are listed here, each task reads its archive's directory itself."""
        from pyarrow import fs

        files, base = _filesystem(self.path)
        found = files.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        return [
            ArchiveRange(info.path, start, start + self.split)
            for info in sorted(found, key=lambda x: x.path)
            if info.is_file and info.path.endswith(".zip")
            for start in range(0, info.size, self.split)
        ]

    def _again(self, files, path: str, entry: zipfile.ZipInfo, error: str) -> tuple[bytes | None, str | None]:
        """Reads one member at its own offset, with a longer pause before each attempt."""
        for attempt in range(1, self.attempts):
            time.sleep(min(self.pause * 2 ** (attempt - 1), 60.0))
            try:
                with files.open_input_file(path) as f:
                    head = f.read_at(30, entry.header_offset)
                    size = _header_size(head)
                    return _content(f.read_at(entry.compress_size, entry.header_offset + size), entry), None
            except (OSError, zlib.error) as e:
                error = f"{path}@{entry.header_offset}: {e}"
        if not self.permissive:
            raise OSError(f"{error} ({self.attempts} attempts)")
        return None, error

    def read(self, part: ArchiveRange | None) -> Iterator[pa.RecordBatch]:
        """The archive is opened once, its directory read once, and the range's members are read as one stream."""
        if part is None:  # a folder without archives
            return
        files, _ = _filesystem(self.path)
        rows, size = [], 0
        with files.open_input_file(part.path) as f:
            entries = sorted((x for x in zipfile.ZipFile(f).infolist() if part.start <= x.header_offset < part.end), key=lambda x: x.header_offset)
            window = _Window(f, self.batch)
            for entry in entries:
                at = entry.header_offset
                try:
                    head = _header_size(window.get(at, 30))
                    media, error = _content(window.get(at + head, entry.compress_size), entry), None
                except (OSError, zlib.error) as e:
                    media, error = self._again(files, part.path, entry, f"{part.path}@{at}: {e}")
                rows.append((part.path, entry.filename, entry.header_offset, media, error))
                size += len(media or b"")
                if size >= self.batch:
                    yield _rows(rows)
                    rows, size = [], 0
        if rows:
            yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
    names = ("archive", "member", "offset", "media", "error")
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=list(names))


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(members: DataFrame) -> DataFrame:
    """Features of each stored member, from the bytes read back."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for member, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                media = media.as_py()
                payload, n_bytes = decode_png(media)
                key = member.partition("/")[0]
                out.append((None if key == "null" else int(key), n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), describe(payload)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in FEATURES.split(", ")])

    return members.select("member", "media").mapInArrow(features, FEATURES)


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores every text as a media member, reads the stored bytes back and describes them.

    One row for each row of ``docs``; a null text is the empty one (64 bytes 0), a null ``doc_id`` stays null,
    repeated rows give repeated rows, an empty table gives none; other columns are not read.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "media")
    work.table(write_archives(docs, work.path("archives")), "manifest")
    spark.dataSource.register(MediaArchiveSource)
    return media_features(spark.read.format("media_archive").option("path", work.path("archives")).load())


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(read_table(spark, sf_dir, "documents"))
