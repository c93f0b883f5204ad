import zlib
from collections import Counter

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline

from corpusloom.llm import packing

from .odd import no_docs, odd_docs
from .test_join_dedup import brute_join
from .test_mixing_topk import brute_targets, size


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "personal_data", "mixing", "packing"]

    def step(name, df):
        stages[name](spark, df, "").write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    told = step("language", docs)
    assert told.columns == columns and told.count() == docs.where("text rlike '[a-zA-Z]'").count()
    alone = step("near_duplicates", told)
    want = {c for _, c, _ in brute_join([(r.doc_id, r.text) for r in told.collect()])}
    assert alone.columns == columns and sorted(r.doc_id for r in alone.collect()) == sorted(want)
    clean = step("personal_data", alone)
    before = {r.doc_id: r for r in alone.collect()}
    assert clean.count() == len(before)
    for r in clean.collect():
        assert r.n_chars == len(r.text) and (r.text == before[r.doc_id].text or "[" in r.text)
    mixed = step("mixing", clean)
    sizes, got = Counter(), Counter()
    for r in clean.collect():
        sizes[r.source] += size(r.text)
    for r in mixed.collect():
        got[r.source] += size(r.text)
    longest = max(size(r.text) for r in clean.collect())
    for s, target in brute_targets(sizes).items():
        assert abs(got[s] - target) <= longest
    assert mixed.columns == columns and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2
    packed = step("packing", mixed).collect()
    encode = packing.encoder()
    assert sum(r.length for r in packed) == sum(len(encode(r.text)) + 1 for r in mixed.collect())
    assert len({r.sequence_id for r in packed}) <= 1.02 * sum(r.length for r in packed) / 1024 + 8
    assert all(0 <= r.ids_crc32 <= 0xFFFFFFFF for r in packed) and zlib.crc32(b"") == 0


def test_run_and_odd_inputs(spark, tmp_path):
    for name, df in (("odd", odd_docs(spark)), ("none", no_docs(spark))):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert {r.doc_id for r in got} <= {None, 1, 3, 4, 5, 6, 7, 8} and bool(got) == (name == "odd")
