import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import media, packing
from corpusloom.llm.common import Workspace

from .odd import LONG, MANY, ROWS, no_docs, odd_docs


@pytest.mark.parametrize("raw", [b"", b"x", b"x" * 63, b"x" * 64, b"x" * 65, bytes(range(256)) * 9])
def test_png_round_trip(raw):
    payload, n = media.decode_png(media.encode_png(raw))
    assert n == len(raw) and payload[:n] == raw and not any(payload[n:]) and len(payload) % 64 == 0 and payload
    assert len(payload) - len(raw) < 64 or raw == b""


@pytest.mark.parametrize("kind", range(5))
def test_filtered_rows_are_read(kind):
    """Rows as other writers store them: each sample less what its neighbours say."""
    samples = np.random.default_rng(kind).integers(0, 256, (5, 64)).astype(int)
    lines = bytearray()
    for y in range(5):
        lines.append(kind)
        for x in range(64):
            a, b, c = (samples[y, x - 1] if x else 0), (samples[y - 1, x] if y else 0), (samples[y - 1, x - 1] if x and y else 0)
            paeth = min((a, b, c), key=lambda v: abs(a + b - c - v))
            lines.append((samples[y, x] - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
    raw = media.encode_png(samples.astype(np.uint8).tobytes())
    head, rest = raw.split(b"IDAT", 1)
    packed = zlib.compress(bytes(lines))
    png = head[:-4] + media._chunk(b"IDAT", packed) + media._chunk(b"IEND", b"")
    assert media.decode_png(png) == (samples.astype(np.uint8).tobytes(), 320)


def test_features_equal_plain_ones(spark):
    """Every column of the query against its definition, member by member."""
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    got = media.op1_media_columns(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        payload = texts[r.doc_id] + bytes(-len(texts[r.doc_id]) % 64 or 64 * (not texts[r.doc_id]))
        stored = media.encode_png(texts[r.doc_id])
        counts = [payload.count(bytes([v])) for v in range(256)]
        changes = sum(a != b for a, b in zip(payload[1:], payload[:-1], strict=True))
        feature = f"n={len(payload)};mean={sum(payload) / len(payload):.4f};peak={counts.index(max(counts))};levels={256 - counts.count(0)};changes={changes}"
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), feature)


def test_a_range_is_read_ahead_and_a_failed_read_repeated(spark, tmp_path, monkeypatch):
    work = Workspace(spark, "test-ahead")
    media.write_archives(odd_docs(spark).repartition(1), work.path("a")).collect()
    assert not [f for f in (tmp_path.parent).rglob("tmp-*") if "test-ahead" in str(f)]
    reader = media.ArchiveReader({"path": work.path("a"), "pauseSeconds": "0"})
    (part,) = reader.partitions()
    whole = [row for batch in reader.read(part) for row in batch.to_pylist()]
    assert len(whole) == len(ROWS) and all(r["error"] is None for r in whole)
    plain, failed = media._Window.get, []

    def flaky(self, start, size):
        if size != 30 and start % 3 == 0 and start not in failed:
            failed.append(start)
            raise OSError("connection lost")
        return plain(self, start, size)

    monkeypatch.setattr(media._Window, "get", flaky)
    assert [row for batch in reader.read(part) for row in batch.to_pylist()] == whole and failed


def test_media_of_odd_rows(spark):
    got = media.media_columns(odd_docs(spark)).collect()
    assert len(got) == len(ROWS)
    by_text = {}
    for doc_id, text, *_ in ROWS:
        raw = (text or "").encode()
        payload = media.pad_payload(raw)
        by_text[(doc_id, len(raw), hashlib.sha256(payload).hexdigest())] = zlib.crc32(payload[-64:])
    for r in got:
        assert by_text[(r.doc_id, r.n_bytes, r.payload_sha256)] == r.tail_crc32
        assert r.media_sha256 and r.media_bytes > 0 and r.feature
    assert len({r.media_sha256 for r in got if r.n_bytes == 0}) == 1
    assert media.media_columns(no_docs(spark)).count() == 0


def test_members_are_split_by_range_and_retried_alone(spark):
    work = Workspace(spark, "test-media")
    media.write_archives(odd_docs(spark).repartition(1), work.path("a"), archive_bytes=20_000).collect()
    folder = work.path("a").removeprefix("file://")
    spark.dataSource.register(media.MediaArchiveSource)
    read = lambda **o: spark.read.format("media_archive").options(path=work.path("a"), splitBytes=500, batchBytes=300, attempts=2, **o).load()
    assert read().count() == len(ROWS) and read().rdd.getNumPartitions() > 3
    members = {(r.archive, r.offset): r for r in read().collect()}
    (archive, offset), hit = max(members.items(), key=lambda x: len(x[1].media))
    with open(archive, "r+b") as f:
        f.seek(offset + 30 + len(hit.member) + 40)
        f.write(b"\xff\xfe")
    bad = [r for r in read(mode="permissive").collect() if r.error]
    assert len(bad) == 1 and bad[0].media is None and str(offset) in bad[0].error and folder in bad[0].archive
    with pytest.raises(Exception, match="attempts"):
        read().collect()


def test_ids_are_those_of_the_json_vocabulary(spark):
    whole, encode = Tokenizer.from_file(packing.vocabulary_path("byte_bpe_50k.json")), packing.encoder()
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text in [*texts, "", " ", "a<|endoftext|> b", "  tabs\t\n\n x", "it's 123,45 ñandú 漢字    x"]:
        assert encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("run", [" ", "\n", "a", "7", "-"])
def test_ids_of_very_long_runs(run):
    whole, encode = Tokenizer.from_file(packing.vocabulary_path("byte_bpe_50k.json")), packing.encoder()
    text = f"before {run * 1_200_000}x {run * 3} after"
    assert encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert bins.place(6) == (0, 0) and bins.place(7) == (1, 0)
    assert bins.place(3) == (1, 7)
    assert bins.place(5) == (2, 0) and bins.place(8) == (3, 0)  # bin 0 (4 free) closes before bin 2 (5 free)
    assert bins.place(4) == (2, 5)
    assert bins.place(10) == (4, 0) and bins.open == len(bins.left()) == 2


def check_packing(docs, got, capacity):
    encode = packing.encoder()
    want = defaultdict(int)
    for doc_id, text in docs:
        want[(doc_id, tuple(encode(text or "").tolist()) + (2,))] += 1
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    lengths = defaultdict(list)
    for (doc_id, ids), n in want.items():
        raw = np.array(ids, "<u4")
        for r in by_doc[doc_id]:
            part = raw[r.start : r.start + r.length]
            if r.start + r.length <= len(raw) and zlib.crc32(part.tobytes()) == r.ids_crc32:
                lengths[(doc_id, ids)].append(r.length)
        assert sum(lengths[(doc_id, ids)]) >= len(ids) * n
    assert sum(r.length for r in got) == sum(len(ids) * n for (_, ids), n in want.items())
    bins = defaultdict(list)
    for r in got:
        assert 1 <= r.length <= capacity and (r.piece == 0 or r.length == capacity)
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_odd_rows(spark):
    for capacity, open_bins in ((1024, 512), (16, 1)):
        got = packing.pack_best_fit(odd_docs(spark).repartition(3), capacity, open_bins).collect()
        check_packing([r[:2] for r in ROWS], got, capacity)
    assert packing.pack_best_fit(no_docs(spark)).count() == 0


def test_packing_is_tight(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(8, "doc_id")
    got = packing.pack_best_fit(docs).collect()
    n = check_packing([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], got, 1024)
    assert n <= 1.015 * -(-sum(r.length for r in got) // 1024) + 1
    assert len(LONG) and len(MANY)
