"""Source-code functions over snippets built from the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import code
from corpusloom.plans.registry import query, table

_PARTS = (
    "import numpy as np\nfrom numpy import tanh as squash\n\nLIMIT = {n}\n\n",
    "def h0(x):\n    return np.tanh(x) + {n}\n\n",
    "def h1(x):\n    y = h0(x) * {n}\n    return y - {k}\n\n",
    "def h2(x):\n    for _ in range({k}):\n        if False:\n            return np.exp(x)\n    return squash(h1(x))\n\n",
)
_ENDS = (
    'def run(x):\n    """Doc {n}."""\n    if x < {n}:\n        return x\n    return {h}(x)\n',
    "def run(x):\n    while False:\n        return np.exp(x)\n    return np.arctanh({h}(x)) * {n}\n",
    "def run(x):\n    y = x + {n}\n    try:\n        return {h}(y) if y > {k} else y\n        return np.exp(y)\n    finally:\n        y = {k}\n",
)


def _snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows a document: its whole text, and a program whose constants, depth and branches follow from the document."""
    draw = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "doc_id", "text"), F.lit(n))
    depth = draw("depth", len(_PARTS) - 1).cast("int")
    body = F.concat(F.array_join(F.slice(F.array(*map(F.lit, _PARTS)), F.lit(1), depth + 2), ""), F.element_at(F.array(*map(F.lit, _ENDS)), (draw("end", len(_ENDS)) + 1).cast("int")))
    program = body
    for mark, value in (("{n}", draw("n", 1_000_003)), ("{k}", draw("k", 97) + 1), ("{h}", F.concat(F.lit("h"), depth.cast("string")))):
        program = F.replace(program, F.lit(mark), value.cast("string"))
    both = F.array(*(F.struct(F.lit(kind).alias("kind"), source.alias("source")) for kind, source in (("text", F.col("text")), ("program", program))))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.inline(both))


@query()
def normalized_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts and programs: what a parser refuses is normalized by its white space, so SQL has no plain form of it."""
    return _snippets(spark, sf_dir).select("doc_id", "kind", F.sha2(code.normalized_code("source"), 256).alias("normalized_sha256"))


@query()
def code_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _snippets(spark, sf_dir)
    return rows.select("doc_id", "kind", code.parses("source").alias("parses"), code.family_id(F.col("lang"), F.col("source"), ("the ", "und ")).alias("family_id"))


@query()
def code_inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _snippets(spark, sf_dir).withColumn("i", code.inspect_source(F.col("source"), "run", "tanh", "exp"))
    return rows.select("doc_id", "kind", "i.*", code.source_audit("source").alias("audit"))


@query()
def code_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three are null where a text isn't Python; the first and last also where nothing in a source can be changed."""
    rows = _snippets(spark, sf_dir).withColumn("m", code.mutation("source", "doc_id"))
    return rows.select("doc_id", "kind", "m.mutated", "m.spec", F.round("m.similarity", 6).alias("similarity"))


@query()
def static_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of one block each: a program with its arguments in order, in the wrong one, unfinished, or the turn's own text."""
    program = "import jax.experimental.pallas as pl\n\ndef run(x):\n    return pl.pallas_call(x, pl.BlockSpec({0}))"
    bodies = (program.format("(8, 8), lambda i: i"), program.format("lambda i: i, (8, 8)"), "def run(x):\n    ...", "def run(x):\n    return (x")
    body = F.element_at(F.array(*map(F.lit, bodies), F.col("text")), (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) + 1).cast("int"))
    replies = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("Plan\n```python\n"), body, F.lit("\n```")).alias("reply"))
    return code.static_contract(replies, "reply", "run", "BlockSpec", "pallas_call", "jnp.").select("conv_id", "turn", "stage", "passed", "feedback")


@query()
def required_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with a broken block before a sound one: the sound one is taken, of turns without it the broken one."""
    broken, sound = F.lit("```python\ndef run(x:\n    return x\n```\n"), F.lit("```py\ndef run(x):\n    return x\n```\n")
    reply = F.concat(broken, F.coalesce("text", F.lit("")), F.lit("\n"), F.when(F.col("turn") % 2 == 0, sound).otherwise(F.lit("```\nnone\n```")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", reply.alias("reply"))
    return code.required_block(rows, "reply", "run").select("conv_id", "turn", F.sha2("code", 256).alias("code_sha256"))
