"""Event tables: a DataFrame with a type, a time and a sequence column, in one form for all operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.parser import UNITS, CreateTable

_KINDS = {"TYPE": T.StringType(), "INT": T.IntegerType(), "FLOAT": T.DoubleType(), "DOUBLE": T.DoubleType(), "CHAR": T.StringType(), "TIMESTAMP": T.LongType()}


@dataclass(frozen=True)
class EventTable:
    """Events in the total order (time, sequence); the sequence column is unique.

    Time columns of type timestamp count in microseconds; others are numbers in a unit of their own, in which named
    units mean milliseconds times their length.
    """

    df: DataFrame
    type_col: str
    ts_col: str
    seq_col: str
    scales: dict[str, int] = field(default_factory=dict)
    fixed_point: bool = False

    @property
    def timed(self) -> bool:
        return isinstance(self.df.schema[self.ts_col].dataType, T.TimestampType | T.TimestampNTZType | T.DateType)

    @property
    def numeric(self) -> list[str]:
        """Attributes that predicates may use."""
        return [f.name for f in self.df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != self.ts_col]

    def events(self, attrs: list[str] | None = None) -> DataFrame:
        """_type, _ts, _seq and the attributes, all numeric ones by default."""
        ts = F.unix_micros(F.col(self.ts_col).cast("timestamp")) if self.timed else F.col(self.ts_col).cast("long")
        return self.df.select(F.col(self.type_col).alias("_type"), ts.alias("_ts"), F.col(self.seq_col).cast("long").alias("_seq"), *(self.value(a).alias(a) for a in (self.numeric if attrs is None else attrs)))

    def value(self, attr: str):
        """An attribute as predicates see it: with fixed_point, cut to the scale that the table declares."""
        if attr not in self.numeric:
            raise ValueError(f"{attr} is no number of this table")
        if self.fixed_point and attr in self.scales:
            return (F.col(attr) * 10 ** self.scales[attr]).cast("long") / 10 ** self.scales[attr]
        return F.col(attr)

    def window(self, within: int, unit: str | None) -> int:
        """A window in the unit of _ts."""
        if unit is None:
            return within
        return within * UNITS[unit] if self.timed else within * UNITS[unit] // 1000


def struct_of(table: CreateTable) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in table.columns])


def column_of(table: CreateTable, kind: str) -> str:
    return next(name for name, k in table.columns if k == kind)


def with_sequence(df: DataFrame, order: list[str], seq: str = "seq") -> DataFrame:
    """df with a dense sequence by `order`: a range sort, then counts of the partitions before, not one task.

    The counts are one row a partition, which is what makes joining them back cheap.
    """
    placed = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    part, row = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    placed = placed.withColumns({"_part": part, "_row": row})
    from pyspark.sql import Window

    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(seq, F.col("_before") + F.col("_row")).drop("_at", "_part", "_row", "_before")


def read_csv(spark: SparkSession, path: str, table: CreateTable, header: bool = True, seq: str = "seq") -> DataFrame:
    """Events from CSV (also gzipped), columns in the order of the declaration; a field that cannot be read is null.

    The sequence is the place of a row: by file name, by offset of the split it was read in, and within that by Spark's
    ids, which follow a split's rows. It does not depend on how splits are dealt to tasks.
    """
    raw = spark.read.csv(path, header=header, schema=T.StructType([T.StructField(n, T.StringType()) for n, _ in table.columns]), enforceSchema=True)
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_offset"), F.monotonically_increasing_id().alias("_line")]
    typed = raw.select(*(F.trim(F.col(n)).try_cast(_KINDS[k]).alias(n) for n, k in table.columns), *place)
    return with_sequence(typed, ["_file", "_offset", "_line"], seq).drop("_file", "_offset", "_line")


def to_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as comma-separated text, the form that `read_csv` reads."""
    return df.select(F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("value"))


def write_events(table: EventTable, path: str, mode: str = "append", partitions: int | None = None, by_type: bool = False, index: tuple[str, ...] = ()) -> None:
    """Writes a table for pattern queries: sorted by type and time, or by type and the attributes of an index, so that
    row-group statistics skip what a query does not need, with delta encodings for time and sequence."""
    order = [table.type_col, *(index or (table.ts_col,))]
    df = table.df.repartitionByRange(partitions, *order) if partitions else table.df.repartitionByRange(*order)
    writer = df.sortWithinPartitions(*order, *((table.ts_col,) if index else ()), table.seq_col).write.mode(mode).option("parquet.writer.version", "v2").option("compression", "zstd")
    (writer.partitionBy(table.type_col) if by_type else writer).parquet(path)


def fetch(table: EventTable, seqs: DataFrame, seq: str = "seq") -> DataFrame:
    """The rows whose sequence numbers are in a column of `seqs`."""
    wanted = seqs.select(F.col(seq).alias("_wanted")).distinct()
    return table.df.join(wanted, F.col(table.seq_col) == F.col("_wanted"), "left_semi")
