"""Array operators over the embeddings table; results are summed up per vector and rounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import arrays as a
from corpusloom.operators import tiles
from corpusloom.plans.registry import query, table

_V = "v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x, list_reverse(list_transform(embedding, lambda e: CAST(e AS DOUBLE))) AS y FROM embeddings)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = a.doubles(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"), F.reverse(x).alias("y"))


def _summed(**arrays):
    """The weighted sum of each array: tells values and their places apart."""
    place = lambda arr: F.zip_with(arr, F.transform(F.sequence(F.lit(1), F.size(arr)), lambda i: i.cast("double")), lambda v, i: v * i)
    return [F.round(a.total(place(arr)), 6).alias(name) for name, arr in arrays.items()]


def _sql(**arrays: str) -> str:
    parts = ", ".join(f"round(list_sum(list_transform({arr}, lambda v, i: v * i)), 6) AS {name}" for name, arr in arrays.items())
    return f"WITH {_V} SELECT vec_id, {parts} FROM v"


def _zip(body: str) -> str:
    return f"list_transform(list_zip(x, y), lambda z: {body})"


_BINARY = {"add": "z[1] + z[2]", "subtract": "z[1] - z[2]", "multiply": "z[1] * z[2]", "maximum": "greatest(z[1], z[2])", "minimum": "least(z[1], z[2])", "safe_divide": "z[1] / (abs(z[2]) + 0.25)"}
_UNARY = {"relu": "greatest(e, 0.0)", "tanh": "tanh(e)", "sigmoid": "1.0 / (1.0 + exp(-e))", "square": "e * e", "absolute": "abs(e)", "exp": "exp(e)"}


@query(_sql(**{f"r_{k}": _zip(v) for k, v in _BINARY.items()}))
def binary_elementwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", *_summed(**{f"r_{k}": a.binary(k, F.col("x"), F.col("y")) for k in a.BINARY}))


@query(_sql(**{f"r_{k}": f"list_transform(x, lambda e: {v})" for k, v in _UNARY.items()}))
def unary_elementwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", *_summed(**{f"r_{k}": a.unary(k, F.col("x")) for k in a.UNARY}))


_GATES = {"silu": "z[1] / (1.0 + exp(-z[1]))", "gelu": "0.5 * z[1] * (1.0 + tanh(0.7978845608028654 * (z[1] + 0.044715 * z[1] * z[1] * z[1])))", "relu": "greatest(z[1], 0.0)", "tanh": "tanh(z[1])"}


@query(_sql(**{f"g_{k}": _zip(f"({v}) * z[2]") for k, v in _GATES.items()}))
def gated_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", *_summed(**{f"g_{k}": a.gate(k, F.col("x"), F.col("y")) for k in a.GATES}))


_MEAN = "list_avg(x)"


@query(_sql(
    rms="list_transform(x, lambda e: e / sqrt(list_avg(list_transform(x, lambda s: s * s)) + 1e-5))",
    layer=f"list_transform(x, lambda e: (e - {_MEAN}) / sqrt(list_avg(list_transform(x, lambda s: (s - {_MEAN}) * (s - {_MEAN}))) + 1e-5))",
    l2="list_transform(x, lambda e: e / sqrt(list_sum(list_transform(x, lambda s: s * s)) + 1e-5))",
))
def row_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return _vectors(spark, sf_dir).select("vec_id", *_summed(rms=a.rms_norm(x), layer=a.layer_norm(x), l2=a.l2_norm(x)))


@query(_sql(
    softmax="list_transform(x, lambda e: exp(e - list_max(x)) / list_sum(list_transform(x, lambda s: exp(s - list_max(x)))))",
    log_softmax="list_transform(x, lambda e: e - list_max(x) - ln(list_sum(list_transform(x, lambda s: exp(s - list_max(x))))))",
    softmin="list_transform(x, lambda e: exp(list_min(x) - e) / list_sum(list_transform(x, lambda s: exp(list_min(x) - s))))",
))
def softmaxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return _vectors(spark, sf_dir).select("vec_id", *_summed(softmax=a.softmax(x), log_softmax=a.log_softmax(x), softmin=a.softmin(x)))


@query(f"WITH {_V} SELECT vec_id, round(list_sum(x), 6) AS row_sum, list_max(x) AS row_max, round(list_avg(x), 6) AS row_mean, list_min(x) AS row_min, CAST(len(x) AS BIGINT) AS width FROM v")
def row_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, first = F.col("x"), F.lit(1)
    wide = lambda value: F.element_at(a.spread(x, value), first)
    return _vectors(spark, sf_dir).select("vec_id", F.round(wide(a.total(x)), 6).alias("row_sum"), wide(F.array_max(x)).alias("row_max"), F.round(wide(a.mean(x)), 6).alias("row_mean"), wide(F.array_min(x)).alias("row_min"), F.size(x).cast("long").alias("width"))


_LONG = f"{_V}, m AS (SELECT vec_id AS i, u.k - 1 AS k, x[u.k] AS value FROM v, unnest(range(1, 65)) u(k))"


@query(f"WITH {_LONG} SELECT k AS i, round(sum(value * i), 5) AS plain, round(sum(value * value * i), 5) AS square, round(sum(abs(value) * i), 5) AS absolute FROM m GROUP BY k")
def transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = a.entries(_vectors(spark, sf_dir), "vec_id", "x")
    total = lambda f: F.round(F.sum(f * F.col("k")), 5)
    v = F.col("value")
    return a.transpose(long).groupBy("i").agg(total(v).alias("plain"), total(v * v).alias("square"), total(F.abs(v)).alias("absolute"))


@query(f"""WITH {_LONG}, g AS (SELECT a.k AS i, b.k AS j, sum(a.value * b.value) AS value FROM m a JOIN m b ON a.i = b.i GROUP BY a.k, b.k), p AS (SELECT m.i, g.j, sum(m.value * g.value) AS value FROM m JOIN g ON m.k = g.i GROUP BY m.i, g.j)
SELECT i, CAST(j AS BIGINT) AS j, round(value, 4) + 0.0 AS value, round(greatest(value, 0.0), 4) AS relu, round(value * value, 4) AS square FROM p""")
def matrix_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as a matrix X, and X times (X' X): rectangular operands, the whole table on both sides."""
    long = a.entries(_vectors(spark, sf_dir), "vec_id", "x")
    product = tiles.matmul(long, tiles.matmul(a.transpose(long), long).select("i", F.col("j").alias("k"), "value"))
    return product.select("i", "j", (F.round("value", 4) + 0.0).alias("value"), F.round(F.greatest("value", F.lit(0.0)), 4).alias("relu"), F.round(F.col("value") * F.col("value"), 4).alias("square"))


@query(f"WITH {_V} SELECT vec_id, list_bool_and({_zip('abs(z[1] - z[2]) <= 0.5 + 0.5 * abs(z[2])')}) AS near, true AS same FROM v")
def tolerant_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", a.close(F.col("x"), F.col("y"), 0.5).alias("near"), a.close(F.col("x"), F.col("x")).alias("same"))


_DRAW = "(CAST('0x' || substr(md5('{0}:' || {1}vec_id), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))"


@query(f"""
SELECT vec_id, round(sqrt(-2 * ln(1 - {_DRAW.format(7, "'r:' || ")})) * cos(2 * pi() * {_DRAW.format(7, "'a:' || ")}), 6) AS normal, round(-1 + 3 * {_DRAW.format(8, "")}, 6) AS uniform,
  CAST(floor(5 + 10 * {_DRAW.format(9, "")}) AS BIGINT) AS whole, {_DRAW.format(10, "")} < 0.5 AS flag FROM embeddings""")
def generated_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    drawn = {"normal": a.seeded("normal", 7, "vec_id"), "uniform": a.seeded("uniform", 8, "vec_id", low=-1, high=2)}
    return rows.select("vec_id", *[F.round(v, 6).alias(k) for k, v in drawn.items()], a.seeded("integer", 9, "vec_id", low=5, high=15).alias("whole"), a.seeded("bool", 10, "vec_id").alias("flag"))
