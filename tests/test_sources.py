import gzip
import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import paged, records
from corpusloom.streaming import enrich


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    assert sorted(r.x for r in records.json_lines(spark, str(tmp_path), "x int").collect()) == [1, 2]
    (tmp_path / "b.jsonl").write_text('{"x": 3}\n[1]\nbroken\n')
    with pytest.raises(records.ScanError, match=r"JSONL_INVALID: .*b\.jsonl:2"):
        records.json_lines(spark, str(tmp_path), "x int")
    kept = records.json_lines_permissive(spark, str(tmp_path), "x int").collect()
    assert len(kept) == 5 and sorted(r.malformed_line for r in kept if r.malformed_line) == [2, 3]
    assert {(r.path[-7:], r.lines, r.malformed) for r in records.json_lines_audit(spark, str(tmp_path)).collect()} == {("a.jsonl", 2, 0), ("b.jsonl", 3, 2)}


@pytest.fixture
def small_ranges(spark):
    """Files are cut into ranges of some hundred bytes."""
    conf = {"spark.sql.files.maxPartitionBytes": "100", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_one_file_is_read_in_ranges(spark, tmp_path, small_ranges):
    """Every line keeps the number that a single reader gives it, wherever the ranges' borders fall."""
    bad = {"a.jsonl": {17, 18, 203, 400}, "b.jsonl": {1, 399}, "c.jsonl": set()}
    for name, wrong in bad.items():
        lines = ["" if i % 50 == 9 else "[1]" if i in wrong else json.dumps({"x": i, "pad": "é" * (i % 37)}, ensure_ascii=False) for i in range(1, 401)]
        (tmp_path / name).write_bytes(("\r\n" if name == "b.jsonl" else "\n").join(lines).encode())
    assert lines_of(spark, tmp_path).rdd.getNumPartitions() > 100
    rows = records.json_lines_permissive(spark, str(tmp_path), "x int").collect()
    assert sorted(r.malformed_line for r in rows if r.raw) == sorted(x for xs in bad.values() for x in xs) and all(r.raw == "[1]" for r in rows if r.malformed_line)
    assert sorted(r.x for r in rows if r.x) == sorted(i for wrong in bad.values() for i in range(1, 401) if i % 50 != 9 and i not in wrong)
    with pytest.raises(records.ScanError, match=r"JSONL_INVALID: .*a\.jsonl:17$"):
        records.json_lines(spark, str(tmp_path), "x int")
    with pytest.raises(records.ScanError, match=r"JSONL_INVALID: .*b\.jsonl:1$"):
        records.json_lines(spark, str(tmp_path / "b.jsonl"), "x int")
    assert records.json_lines(spark, str(tmp_path / "c.jsonl"), "x int").agg(F.sum("x")).first()[0] == sum(i for i in range(1, 401) if i % 50 != 9)
    assert {(r.path[-7:], r.lines, r.malformed) for r in records.json_lines_audit(spark, str(tmp_path)).collect()} == {(n, 392, len(w)) for n, w in bad.items()}
    ids = sorted(r.id for r in records.trajectories(spark, str(tmp_path / "c.jsonl")).collect())
    assert ids == sorted(f"c-{i - 1}" for i in range(1, 401) if i % 50 != 9)


def lines_of(spark, path):
    return spark.read.text(str(path))


def test_arrays_files_and_archives(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    assert records.json_array(spark, str(tmp_path / "a.json"), "x int").count() == 2
    (tmp_path / "o.json").write_text('{"x": 1}')
    with pytest.raises(records.ScanError, match="SCHEMA_DRIFT"):
        records.json_array(spark, str(tmp_path / "o.json"), "x int")
    (tmp_path / "d").mkdir()
    for name in ("b.py", "a.py", "c.txt", "skip.py"):
        (tmp_path / "d" / name).write_text(name)
    assert [r.content for r in records.text_files(spark, str(tmp_path / "d"), [".py"], ["skip"]).collect()] == ["a.py", "b.py"]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x/late.md", "late")
        z.writestr("first/a.md", "early")
        z.writestr("n.txt", "no")
    assert [r.content for r in records.zip_markdown(spark, str(tmp_path / "z.zip"), ["first/"]).collect()] == ["early", "late"]
    with gzip.open(tmp_path / "t.json.gz", "wt") as f:
        json.dump({"traceEvents": [{"name": "a", "dur": 2.0}, {"name": "a", "dur": 3.0}]}, f)
    assert [tuple(r) for r in records.trace_events(spark, str(tmp_path / "t.json.gz")).collect()] == [("a", 2, 5.0)]


def test_trajectories_and_sink(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"conversation": {"messages": [{"role": "user", "content": "hi"}]}}\n{"id": "k", "messages": []}\n')
    assert sorted((r.id, r.source, len(r.messages)) for r in records.trajectories(spark, str(tmp_path)).collect()) == [("k", "s", 0), ("s-0", "s", 1)]
    turns = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a")], "conv_id int, turn int, role string, text string")
    records.write_conversations(turns, str(tmp_path / "out"))
    assert [m.content for m in spark.read.json(str(tmp_path / "out")).first().messages] == ["a", "b"]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        records.write_conversations(turns, str(tmp_path / "out"))


class Service(BaseHTTPRequestHandler):
    failures = 2

    def do_GET(self):
        if Service.failures:
            Service.failures -= 1
            self.send_error(503)
            return
        query = dict(p.split("=") for p in self.path.split("?")[1].split("&"))
        at, n = int(query["offset"]), int(query["length"])
        body = json.dumps({"total": 25, "rows": [{"i": i} for i in range(at, min(25, at + n))]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_paged_source(spark):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(paged.PagedSource)
    url = f"http://127.0.0.1:{server.server_port}/rows?offset={{offset}}&length={{length}}"
    df = spark.read.format("paged").option("url", url).option("length", 10).option("backoff", 0.01).load()
    assert sorted(r.row_idx for r in df.collect()) == list(range(25))
    server.shutdown()


def test_enrichment_resumes(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda: enrich.enrich(spark, source, "id long, v string", sink, str(tmp_path / "ck"), "id", lambda df: df.selectExpr("id", "upper(v) AS v")).awaitTermination()
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, v string").write.parquet(source)
    run()
    spark.createDataFrame([(2, "b"), (3, "c")], "id long, v string").write.mode("append").parquet(source)
    run()
    run()
    assert sorted(tuple(r) for r in spark.read.parquet(sink).collect()) == [(1, "A"), (2, "B"), (3, "C")]


def test_event_windows(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert enrich.event_windows(events).agg({"n": "sum"}).first()[0] == events.count()


def test_release_is_resumed_only_with_its_fingerprint(spark, tmp_path):
    rows, path = spark.range(10).withColumn("good", F.col("id") % 3 == 0), f"file://{tmp_path}/release"
    artifacts = {"inventory": F.lit(True), "decisions": F.lit(True), "candidates": F.col("good"), "none": F.lit(False)}
    made = records.write_release(rows, path, artifacts, "f1")
    assert made == {"fingerprint": "f1", "rows": {"inventory": 10, "decisions": 10, "candidates": 4, "none": 0}}
    assert {r.id for r in spark.read.parquet(f"{path}/rows").where("artifact = 'candidates'").collect()} == {0, 3, 6, 9}
    assert records.write_release(rows.limit(0), path, artifacts, "f1", resume=True) == made
    for fingerprint, resume in (("f1", False), ("f2", True), ("f2", False)):
        with pytest.raises(records.ScanError):
            records.write_release(rows, path, artifacts, fingerprint, resume)
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "file").write_text("x")
    with pytest.raises(records.ScanError):
        records.write_release(rows, f"file://{tmp_path}/other", artifacts, "f1", resume=True)
