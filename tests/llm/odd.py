"""Rows that no operator may trip over: nulls, empty and very long texts, repeats, clashing columns."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LONG = "word" * 30_000
MANY = " ".join(f"w{i % 997}" for i in range(40_000))
ROWS = [
    (1, "one two three four five six seven eight nine ten", "en", "a"),
    (1, "one two three four five six seven eight nine ten", "en", "a"),
    (2, "one two three four five six seven eight nine ten", "de", None),
    (None, "a text without an id, long enough to be read", None, "b"),
    (3, None, "en", "a"),
    (4, "", None, "c"),
    (5, "  \n\t ", "en", "c"),
    (6, LONG, "en", "a"),
    (7, MANY, "de", "b"),
    (None, None, None, None),
    (8, "*** !!! 123", "en", None),
]
CLASHES = ("size", "key", "block", "rank", "node", "root", "part", "names", "count", "cls", "target", "start", "bin", "score", "draw", "language", "group")


def odd_docs(spark, clashes=True):
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in ROWS], SCHEMA)
    for c in CLASHES if clashes else ():
        df = df.withColumn(c, df["source"])
    return df


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=repr)
