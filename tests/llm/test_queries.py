"""Queries with SQL against DuckDB, and what the others must return."""

import math

import duckdb
import pytest

from corpusloom.llm import registry

SF = "/root/testdata/sf0.01"
COLUMNS = {
    "op1_media_columns": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op2_ngram_jaccard_join": {"doc_id": "bigint", "class_id": "bigint", "n_links": "bigint"},
    "op3_html_main_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op4_chat_format": {"conv_id": "bigint", "turn_no": "bigint", "role": "string", "rendered": "string"},
    "op5_mix_sources": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op6_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op7_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8_exact_top_k": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op9_personal_data": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op10_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op11_importance_resampling": {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"},
    "op12_fill_in_middle": {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"},
    "op13_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
}


def normal(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return repr(round(x, 6)) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(tuple(map(normal, r)) for r in got.select(*columns).collect())
    assert rows == sorted(tuple(map(normal, (r[want.columns.index(c)] for c in columns))) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    kinds = dict(registry.QUERIES[name](spark, "/root/testdata/sf0.001").dtypes)
    assert COLUMNS[name].items() <= kinds.items()
