"""From raw documents to packed training sequences: five stages, each staged as Parquet before the next begins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import Workspace, read_table, scratch
from corpusloom.llm.jaccard_join import keep_one_each
from corpusloom.llm.langid import keep_identified
from corpusloom.llm.mixing import training_order
from corpusloom.llm.packing import pack_best_fit
from corpusloom.llm.pii import without_personal_data


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.

    Null, empty and letterless texts go; repeated rows stay or go together; columns come back as they were, whatever
    their names; an empty table gives no row. A text of any length is read whole.
    """
    return keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the least ``doc_id``, then digest.

    Null texts and texts without words have no group and stay; rows of equal ``doc_id`` and text are one document;
    columns come back as they were, whatever their names; an empty table gives no row.
    """
    return keep_one_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind and ``n_chars`` counted anew.

    Null and empty texts stay as they are; repeated rows stay; other columns come back as they were, whatever their
    names; an empty table gives no row. A text of any length is read whole, in linear time.
    """
    return without_personal_data(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order.

    Null texts and texts without words are never taken; a null source is a source of its own, the last; repeated rows are
    documents of their own; columns come back as they were, whatever their names; an empty table gives no row.
    """
    return training_order(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences; the columns are those of the packing.

    A null or empty text is the end id alone; repeated rows are packed as rows of their own; other columns than
    ``doc_id`` and ``text`` are not read; an empty table gives no row.
    """
    return pack_best_fit(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_to_weights),
    ("packing", pack_sequences),
]

#: Language scores and pruned joins are beyond SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's own tables go once it is written, and its result once the next one is."""
    docs, work = read_table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        with scratch():
            docs = work.table(stage(spark, docs, sf_dir), name)
        if k:
            work.drop(STAGES[k - 1][0])
    return docs
