"""Updates and deletes of events, as views over the rows that were written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Of rows with equal keys the one written last: a pre-aggregated maximum, so a key written often is no hot task."""
    rest = [c for c in df.columns if c not in key and c != seq]
    best = df.groupBy(*key).agg(F.max(F.struct(F.col(seq).alias("_s"), *rest)).alias("_x"))
    return best.select(*key, F.col("_x._s").alias(seq), *(F.col(f"_x.{c}") for c in rest)).select(*df.columns)


def without_deleted(df: DataFrame, key: list[str], seq: str, deleted: Column) -> DataFrame:
    """The latest versions, less those that mark a deletion."""
    return latest(df.withColumn("_deleted", F.coalesce(deleted, F.lit(False))), key, seq).filter(~F.col("_deleted")).drop("_deleted")
