"""Synthetic events and queries."""

from __future__ import annotations

import json
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The distribution of generated tables: types by Zipf's law, whole numbers evenly, others normally.
TYPES, ALPHA, START = 20, 1.2, 1_747_405_414


def zipf(n: int = TYPES, alpha: float = ALPHA) -> list[float]:
    weights = [1 / (i + 1) ** alpha for i in range(n)]
    return [w / sum(weights) for w in weights]


def events(spark: SparkSession, rows: int, seed: int = 11, shuffle: int = 0, types: int = TYPES, alpha: float = ALPHA) -> DataFrame:
    """seq, type, a1, a2, a3, a4 and time of `rows` events; the same rows for the same seed, on any cluster.

    shuffle: length of runs within which the order of arrival (seq) differs from that of time; 0 keeps it.
    """
    def uniform(name: str):
        return (F.pmod(F.xxhash64("id", F.lit(f"{seed}:{name}")), F.lit(1 << 40)) + 0.5) / float(1 << 40)

    def normal(name: str):
        return F.sqrt(-2 * F.log(uniform(name))) * F.cos(uniform(name + "'") * 6.283185307179586)

    so_far, total = F.lit(f"TYPE_{types - 1}"), 1.0
    for i in reversed(range(types - 1)):
        total -= zipf(types, alpha)[i + 1]
        so_far = F.when(uniform("type") < total, F.lit(f"TYPE_{i}")).otherwise(so_far)
    bounded = lambda name: F.round(F.least(F.greatest(normal(name) * 1000 + 5000, F.lit(0.0)), F.lit(10000.0)), 1)
    out = spark.range(rows).select("id", so_far.alias("type"), *((F.floor(uniform(a) * 1000) + 1).cast("int").alias(a) for a in ("a1", "a2")), *(bounded(a).alias(a) for a in ("a3", "a4")), (F.col("id") + START).alias("time"))
    if not shuffle:
        return out.withColumnRenamed("id", "seq")
    from pyspark.sql import Window

    run = F.floor(F.col("id") / shuffle)
    place = F.row_number().over(Window.partitionBy(run).orderBy(F.xxhash64("id", F.lit(seed)))) - 1
    return out.withColumn("seq", run * shuffle + place).drop("id")


SHAPES = (
    "SEQ({0} v0, {1} v1, {2} v2)",
    "SEQ({0} v0, {1} v1, {2} v2, {3} v3, {4} v4)",
    "SEQ({0} v0, AND({1} v1, {2} v2), {3} v3)",
    "AND(SEQ({0} v0, {1} v1), SEQ({2} v2, {3} v3))",
    "SEQ(AND({0} v0, {1} v1), AND({2} v2, {3} v3))",
)


def queries(n: int, seed: int = 1, strategy: str = "SKIP_TILL_ANY_MATCH", within: int = 1000, selectivity: float = 0.1, shapes: tuple[str, ...] = SHAPES, table: str = "synthetic") -> list[str]:
    """Random queries, shape after shape: a range of the given selectivity for every variable, and comparisons."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        shape = shapes[i % len(shapes)]
        count = shape.count("{")
        pattern = shape.format(*(f"TYPE_{t}" for t in rng.choices(range(TYPES), zipf(), k=count)))
        where = []
        for v in range(count):
            width = int(1000 * selectivity)
            low = rng.randint(1, 1000 - width + 1)
            where.append(f"{low} <= v{v}.{rng.choice(('a1', 'a2'))} <= {low + width - 1}")
        for v in range(1, count):
            if rng.random() < 0.5:
                a = rng.choice(("a1", "a2", "a3", "a4"))
                where.append(f"v{v}.{a} {rng.choice(('<=', '>='))} v{v - 1}.{a} * {rng.uniform(0.8, 1.2):.2f}")
        out.append(f"PATTERN {pattern} FROM {table} USING {strategy} WHERE {' AND '.join(where)} WITHIN {within} units RETURN COUNT(*)")
    return out


def by_length(n: int, length: int, **how) -> list[str]:
    """Random queries over sequences of one length."""
    return queries(n, shapes=("SEQ(" + ", ".join(f"{{{i}}} v{i}" for i in range(length)) + ")",), **how)


def save_queries(path: str, texts: list[str]) -> None:
    with open(path, "w") as f:
        json.dump(texts, f, indent=1)


def load_queries(path: str) -> list[str]:
    """A JSON array of query texts."""
    with open(path) as f:
        out = json.load(f)
    if not isinstance(out, list) or not all(isinstance(x, str) for x in out):
        raise ValueError("a query file is an array of texts")
    return out
