"""Fill-in-middle transformation, in SQL that DuckDB runs over each Arrow batch.

A text is cut into tokens of white space and what follows it, two cuts drawn from a digest of ``doc_id`` part it into
prefix, middle and suffix, and the parts are put together around sentinels so that the middle comes last.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import read_table, readable

SEED, RATE, SPM_RATE = 42, 50, 80
#: Fixed by the contract: sentinels before prefix, suffix and middle, and a token.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Bytes of text that one statement reads: its lists of tokens take several times that.
STATEMENT_BYTES = 4 << 20


def transform_sql(seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> str:
    """Reads ``docs (place, doc_id, text)``; gives ``place, n, form, prefix_chars, middle_chars, output``."""
    draw = lambda k: f"CAST('0x' || substr(digest, {8 * k + 1}, 8) AS UBIGINT)"
    return rf"""
WITH t AS (SELECT place, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS tokens, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM docs),
h AS (SELECT *, CAST(len(tokens) AS BIGINT) AS n, {draw(0)} % (len(tokens) + 1) AS a, {draw(1)} % (len(tokens) + 1) AS b,
  CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR {draw(2)} % 100 >= {rate} THEN 'plain' WHEN {draw(3)} % 100 < {spm_rate} THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT place, text, n, form, CASE WHEN form <> 'plain' THEN array_to_string(list_slice(tokens, 1, CAST(least(a, b) AS BIGINT)), '') END AS prefix,
  CASE WHEN form <> 'plain' THEN array_to_string(list_slice(tokens, CAST(least(a, b) AS BIGINT) + 1, CAST(greatest(a, b) AS BIGINT)), '') END AS middle,
  CASE WHEN form <> 'plain' THEN array_to_string(list_slice(tokens, CAST(greatest(a, b) AS BIGINT) + 1, n), '') END AS suffix FROM h)
SELECT place, n, form, CAST(length(prefix) AS BIGINT) AS prefix_chars, CAST(length(middle) AS BIGINT) AS middle_chars,
  CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output
FROM p"""


def restore_sql(docs: str = "docs") -> str:
    """Reads ``docs (place, form, output)``; gives ``place, restored``. No sentinel occurs in a text that is not plain."""
    second = f"CASE form WHEN 'psm' THEN instr(output, '{SUFFIX}') ELSE instr(output, '{PREFIX}') END"
    one, two = (f"substr(output, {len(PREFIX) + 1}, second - {len(PREFIX) + 1})", f"substr(output, second + {len(SUFFIX)}, third - second - {len(SUFFIX)})")
    last = f"substr(output, third + {len(MIDDLE)})"
    return f"""
SELECT place, CASE form WHEN 'plain' THEN output WHEN 'psm' THEN {one} || {last} || {two} ELSE {two} || {last} || {one} END AS restored
FROM (SELECT *, {second} AS second, instr(output, '{MIDDLE}') AS third FROM {docs})"""


def _through(df: DataFrame, sql: str, inputs: dict[str, str], added: T.StructType) -> DataFrame:
    """``df`` with the columns ``added`` that ``sql`` gives for each row, found again by its ``place`` in the batch.

    ``inputs`` are the columns that the statement reads, by the name it knows them by.
    """
    own = df.drop(*added.names)
    places = {name: own.columns.index(column) for name, column in inputs.items()}
    schema = T.StructType([*own.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1}) as session:
            for whole in batches:
                for batch in _slices(whole, max(places.values())):
                    read = {name: batch.column(at) for name, at in places.items()}
                    texts = {name: readable(x) if pa.types.is_string(x.type) or pa.types.is_binary(x.type) else x for name, x in read.items()}
                    session.register("docs", pa.table({"place": pa.array(range(batch.num_rows), pa.int64()), **texts}))
                    found = session.sql(f"SELECT * EXCLUDE (place) FROM ({sql}) ORDER BY place").to_arrow_table()
                    session.unregister("docs")
                    new = [found[f.name].combine_chunks().cast(kind) for f, kind in zip(added.fields, (_kind(f) for f in added.fields), strict=True)]
                    yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return own.mapInArrow(run, schema)


def _kind(field: T.StructField) -> pa.DataType:
    return pa.int64() if isinstance(field.dataType, T.LongType) else pa.string()


def _slices(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """Rows whose text, the column ``text_at``, is of ``STATEMENT_BYTES`` together, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(sizes.searchsorted((sizes[at - 1] if at else 0) + STATEMENT_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """Adds ``n, form, prefix_chars, middle_chars, output`` to every row of ``docs``.

    ``rate`` percent of the documents are rearranged, ``spm_rate`` percent of these with the suffix first. A null or
    empty text, and one that holds a sentinel, stays as it is (``plain``, the null as an empty text); a null ``doc_id`` is
    drawn for as an empty one; what isn't UTF-8 is read as U+FFFD; texts are read whole; a row's result depends on its
    ``doc_id`` and text alone, so repeated rows get equal ones; an empty table gives no row. Columns of these five
    names in ``docs`` are replaced, others are kept.
    """
    added = T.StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string")
    return _through(docs, transform_sql(seed, rate, spm_rate), {"doc_id": "doc_id", "text": "text"}, added)


def restore(transformed: DataFrame) -> DataFrame:
    """Adds ``restored``, the text that ``form`` and ``output`` were made of, to every row; it replaces a column of that name.

    A null output gives a null text; other columns are kept; an empty table gives no row.
    """
    return _through(transformed, restore_sql(), {"form": "form", "output": "output"}, T.StructType.fromDDL("restored string"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = restore(made.drop("text"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


#: The same over all of ``documents``.
SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS place, doc_id, text FROM documents),
made AS (SELECT * FROM docs JOIN ({transform_sql()}) USING (place)),
back AS ({restore_sql("made")})
SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM made JOIN back USING (place)"""
