"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, everywhere in this subpackage: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir. One of fewer splits than the cluster has cores, which is a small one, is dealt to all of them."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return found.repartition(cores) if found.rdd.getNumPartitions() < cores else found


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where that is unset and all runs on
    this machine, as in tests."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that all machines share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spindrift-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder, so that a lost executor costs no earlier stage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def in_few_tasks(df: DataFrame) -> DataFrame:
    """df, of far fewer rows than the input, computed in an eighth of the tasks that a shuffle has, or 4 a core if that is more.

    Each of its tasks writes a file of its own. Where the shared folder is a plain local path and Hadoop's native library is
    missing, each file and its checksum start a process (chmod) beside the executor's heap.
    """
    spark = df.sparkSession
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


#: Rows of texts that a Python worker gets at once; Spark's own 10,000 can be gigabytes where texts are long.
BATCH_ROWS = 2048


def small_batches(df: DataFrame) -> DataFrame:
    """df; its session hands rows to Python in batches of BATCH_ROWS at most from now on."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return df


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def give_back() -> None:
    """Gives to the system what this Python worker has freed; else its allocators keep the most that a batch ever took."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def giving_back(apply: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """apply, a function of batches, whose worker holds no freed memory after a batch or between tasks."""

    @functools.wraps(apply)
    def thrifty(batches):
        for out in apply(batches):
            yield out
            del out
            give_back()
        give_back()

    return thrifty


def clean_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def bucket(column: Column, n: int) -> Column:
    """crc32 of a value's text modulo n: the split of labelled rows into learnt and held-out ones."""
    return F.crc32(column.cast("string").cast("binary")) % n


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, bound: int) -> DataFrame:
    """At most `bound` rows (text, label 0 or 1) of the documents that may be learnt from.

    The rows are those with the smallest hashes of doc_id, so the choice does not depend on partitions. The chosen
    ids number `bound` at most, which is what makes broadcasting them safe. Rows without an id, a text or a label are
    left out, as are all but one row of each id.
    """
    small_batches(documents)
    rest = bucket(F.col("doc_id"), modulus)
    rule = rest != held_out
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & rule)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    return documents.select("doc_id", "text").filter(F.col("text").isNotNull() & rule).join(F.broadcast(chosen), "doc_id").select("text", "label")


def text_udf(schema: str, setup: Callable[[], Callable[[str], tuple]]):
    """A function of a text column that gives a struct of `schema`.

    setup is called once for each run of rows and returns the function of one text; null texts reach it as ''.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = setup()
        for batch in batches:
            yield pd.DataFrame([f(x or "") for x in batch], columns=names)

    return F.pandas_udf(giving_back(apply), schema)


#: Hash buckets in which `split_by_keys` notes keys; the rows that it broadcasts number so many at most.
KEY_BUCKETS = 1 << 21


def split_by_keys(df: DataFrame, column: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose column may be among the keys (one column), and those whose column surely is not.

    Only hash buckets of the keys are broadcast, KEY_BUCKETS numbers at most whatever the number of keys. With many
    keys more rows pass as possible ones; none is ever missed.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(KEY_BUCKETS))
    marked = checkpointed(in_few_tasks(keys.select(place(F.col(f"`{keys.columns[0]}`")).alias("__bucket")).distinct()))
    on = place(column) == F.col("__bucket")
    return df.join(F.broadcast(marked), on, "left_semi"), df.join(F.broadcast(marked), on, "left_anti")
