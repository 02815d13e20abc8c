"""Statistics of event tables: rates, synopses, samples and selectivities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import bucket
from ..plans.predicates import Range


def arrival_rates(events: DataFrame, by_second: bool = False) -> DataFrame:
    """_type, n and rate: events of the type over the time that the whole table spans."""
    per = events.groupBy("_type").agg(F.count("*").alias("n"), F.min("_ts").alias("lo"), F.max("_ts").alias("hi"))
    whole = per.agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
    span = (F.col("last") - F.col("first")) / (1_000_000 if by_second else 1)
    return per.crossJoin(F.broadcast(whole)).select("_type", "n", F.when(span > 0, F.col("n") / span).alias("rate"))


def synopsis(events: DataFrame, attrs: list[str], block: int) -> DataFrame:
    """Per block of sequence numbers and type: count, time range and range of each attribute."""
    sides = [f(F.col(a)).alias(f"{n}_{a}") for a in attrs for n, f in (("min", F.min), ("max", F.max))]
    return events.groupBy(bucket(F.col("_seq"), block).alias("block"), "_type").agg(F.count("*").alias("n"), F.min("_ts").alias("min_ts"), F.max("_ts").alias("max_ts"), *sides)


def overlapping(found: DataFrame, type: str, ranges: list[Range], lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Rows of a synopsis that may hold events of the type within the ranges and the time."""
    out = found.filter(F.col("_type") == type)
    for r in ranges:
        if r.low is not None:
            out = out.filter(F.col(f"max_{r.attr}") >= r.low)
        if r.high is not None:
            out = out.filter(F.col(f"min_{r.attr}") <= r.high)
    if lo is not None:
        out = out.filter(F.col("max_ts") >= lo)
    return out if hi is None else out.filter(F.col("min_ts") <= hi)


def sample(events: DataFrame, rows: int = 5_000, seed: int = 0) -> DataFrame:
    """A uniform sample of at most `rows` events, the same for the same seed: the least hashes of the sequence."""
    return events.orderBy(F.md5(F.concat_ws("|", F.col("_seq").cast("string"), F.lit(str(seed)))), "_seq").limit(rows)


def save_rates(rates: DataFrame, path: str) -> None:
    """Writes arrival rates (_type, n, rate) as one JSON object of types, a row a type being few."""
    found = rates.select(F.struct("_type", F.struct("n", "rate").alias("s")).alias("e"))
    found.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list("e")))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def load_rates(spark: SparkSession, path: str) -> DataFrame:
    """_type, n and rate, as `save_rates` wrote them."""
    found = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, struct<n: long, rate: double>>")))
    return found.select(F.col("key").alias("_type"), "value.n", "value.rate")


def selectivity(events: DataFrame, variables: dict[str, str], ranges: tuple[Range, ...]) -> DataFrame:
    """var and selectivity: the share of all events that have the variable's type and satisfy its ranges."""
    hits = []
    for var, type in variables.items():
        hit = F.col("_type") == type
        for r in ranges:
            if r.var == var:
                hit = hit & r.column(F.col(r.attr))
        hits.append(F.struct(F.lit(var).alias("var"), F.count(F.when(hit, 1)).alias("n")))
    return events.agg(F.count("*").alias("all"), F.array(*hits).alias("v")).select("all", F.explode("v").alias("v")).select("v.var", (F.col("v.n") / F.greatest("all", F.lit(1))).alias("selectivity"))
