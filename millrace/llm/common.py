"""Helpers shared by the corpus operators: staging, hashing, Arrow batches, connected components.

Convention of all operators here: only the named columns are read, so further columns of any name do no harm (two that
differ only by case are refused); NULL text is text without words; every row is judged on its own id and text, so repeated
rows and ties get equal results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.session import shared_dir

U64 = np.uint64
CLEANED_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = 1_000
CACHE_ENTRIES = 80_000  # of a worker's memo; what it gives up is computed again, so results stay the same


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Cut the lineage: written to the shared folder that all executors reach, and read back. What was shuffled for it is
    of no more use and goes at once; else it would lie on the executors' disks until the driver collects its garbage."""
    path, conf = shared_dir(df.sparkSession, purpose), df.sparkSession.conf
    before = conf.get(CLEANED_UP, "false")
    conf.set(CLEANED_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANED_UP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(fn: Callable) -> Callable:
    """A query or stage whose Arrow batches are small: the texts of a batch are in memory at once, on both sides."""

    @wraps(fn)
    def run(spark: SparkSession, *args, **options) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return fn(spark, *args, **options)

    return run


class Memo(dict):
    """A dict that computes what it lacks, with a bounded number of entries. When half of them are new, the others are
    given up, but for those that are asked for again."""

    def __init__(self, compute: Callable, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.compute, self.half, self.former = compute, entries // 2, {}

    def __missing__(self, key):
        if len(self) >= self.half:
            self.former = dict(self)
            self.clear()
        value = self.former.pop(key, None)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value


_KEPT: dict = {}  # of a worker process, from task to task


def kept(key: str, make: Callable):
    """What `make` gives, made once in a worker process and kept for the next tasks that name this key."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def given_up(key: str | None = None) -> None:
    """At the start of a task: all that is kept in its worker process goes, but for this key. Idle workers, several for
    each core, outlive a stage and would hold its memory while the next one works."""
    for other in _KEPT.keys() - {key}:
        del _KEPT[other]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit numbers."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def shingle_hashes(words: list[bytes], length: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; a shorter, non-empty text is one shingle as a whole."""
    if not words:
        return np.empty(0, U64)
    length = min(length, len(words))
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))
    n = len(words) - length + 1
    h = np.full(n, length, U64)
    for k in range(length):
        h = mix(h + each[k:k + n])
    return np.unique(h)


def sheltered(docs: DataFrame) -> tuple[DataFrame, Callable[[str], str], list[Column]]:
    """The table under column names that no inner name clashes with; where a column is now; and the columns under their old
    names. Columns that differ only by case are refused, since Spark can neither tell them apart nor store them."""
    inner = {name.lower(): f"c{k}" for k, name in enumerate(docs.columns)}
    if len(inner) < len(docs.columns):
        raise ValueError(f"columns that differ only by case: {docs.columns}")
    back = [F.col(c).alias(name) for c, name in zip(inner.values(), docs.columns)]
    return docs.toDF(*inner.values()), lambda name: inner[name.lower()], back


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def strings(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """A batch in small parts, which bounds what a task holds beside the batch."""
    return (batch.slice(low, rows) for low in range(0, batch.num_rows, rows))


def count_of(letters: bytes) -> Callable[[bytes], int]:
    """Counts the bytes of a text that are among the given ones."""
    others = bytes(sorted(set(range(256)) - set(letters)))
    return lambda text: len(text.translate(None, others))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType,
                key: str | None = None) -> DataFrame:
    """`fn` over the rows, a few hundred at a time. `key` is that of what it keeps in its worker, if it does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given_up(key)
        for batch in batches:
            yield from map(fn, slices(batch))

    return df.mapInArrow(run, schema)


def drawn(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """Labelled documents `(_id, label, text)`, from `docs(_id, text)` and `labels(_id, label)` with distinct ids: as many
    as `rows` on average, drawn by a hash of id and text, so an id that many rows share is drawn in part; of rows equal in
    both one. Their number is counted first, by id alone; no task sorts or holds all labels."""
    count = docs.select("_id").join(labels.select("_id"), "_id").count()
    draw = F.pmod(F.xxhash64(F.col("_id").cast("string"), "text", F.lit(5)), F.lit(1_000_003))
    some = docs.filter(draw < int(1_000_003 * rows / count)) if count > rows else docs  # before the texts are shuffled
    return some.join(labels, "_id").dropDuplicates(["_id", "text"])


def components(edges: DataFrame, purpose: str) -> DataFrame:
    """Connected components of undirected edges `(u, v)` as `(node, root)`, root being the smallest node.

    Alternating large-star and small-star steps: each is a grouped minimum and a join, so no task ever holds a
    component, and the number of steps grows with the logarithm of the longest path. Each step is a written table.
    """
    both = edges.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    current = staged(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), purpose)
    seen = None
    while True:
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        seen = mark
        sides = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sides.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = staged(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), purpose)


def finite_vectors(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """`(vec_id, label, vec)` of the rows that have a vector without NULL, NaN or infinite components."""
    known = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"),
                       F.col(vec_col).cast("array<double>").alias("vec")).filter(F.col("vec").isNotNull() & known)


def matrix(column: pa.Array, width: int, scale: float, limit: int) -> np.ndarray:
    """Vectors as rows of `floor(scale * x)`, held within `limit`; shorter ones are filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.clip(np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale), -limit, limit).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out
