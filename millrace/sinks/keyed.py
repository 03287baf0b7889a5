"""Tables stored by a hash of their key (K5, M1-M5): a merge reads and writes only the partitions that its batch touches.

Upserts replace the touched partitions by dynamic overwrite; insert-or-ignore appends the new rows and rewrites nothing.
The partition number is a function of the key alone, so every record of a key meets its stored row. A batch with keys all
over a large table touches nearly all partitions; for such batches, and for streams, there is `sinks.changes`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from millrace.operators import merging

PART = "_part"
PART_BYTES = 256 * 1024 * 1024  # of rows as text, that one partition is meant to hold
SALTS = 4  # tasks that write one partition


@dataclass(frozen=True)
class KeyedTable:
    """`keys` deal the rows out (the job key for links, so that a job's links lie together); `parts` stays as it was when
    the table was created: choose it so that one partition is a file of a few hundred MB."""

    path: str
    keys: tuple[str, ...]
    parts: int
    schema: StructType | None = None  # needed where the table may be empty

    @staticmethod
    def parts_for(rows: DataFrame, least: int = 8) -> int:
        """A number of partitions for rows of this size, which is measured."""
        size = rows.agg(F.sum(F.length(F.to_json(F.struct(*rows.columns))))).first()[0] or 0
        return max(least, -(-size // PART_BYTES))

    def part(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.parts)).cast("int")

    def create(self, rows: DataFrame) -> None:
        self._write(rows, "errorifexists")

    def _stored(self, spark: SparkSession) -> DataFrame:
        if self.schema is None:
            return spark.read.parquet(self.path)
        return spark.read.schema(StructType([*self.schema]).add(PART, IntegerType())).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._stored(spark).drop(PART)

    def touched(self, batch: DataFrame) -> DataFrame:
        """The stored rows of the partitions that keys of the batch fall into. At most `parts` numbers are collected."""
        numbers = [r[0] for r in batch.select(self.part().alias(PART)).distinct().collect()]
        return self._stored(batch.sparkSession).filter(F.col(PART).isin(numbers)).drop(PART)

    def upsert(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """`merge(stored, batch)` gives the new content of the touched partitions. The batch is read twice: hand in a
        written table where making it is costly. New files replace the old ones only after all tasks are done."""
        self._write(merge(self.touched(batch), batch), "overwrite")

    def insert(self, batch: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> None:
        """Insert-or-ignore: rows whose `keys` (the table's own unless given) are new are appended."""
        self._write(merging.new_rows(self.touched(batch), batch, keys or list(self.keys), order), "append")

    def _write(self, rows: DataFrame, mode: str) -> None:
        salt = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))
        dealt = rows.withColumn(PART, self.part()).repartition(PART, salt)
        dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path)
