"""Operator 11, vectors as short codes: each of a few consecutive parts becomes the number of its nearest codebook entry.

The nearest entry is found by slicing and intersecting: the entries are sorted by each coordinate, and every prefix of
that order carries a bit mask of its entries. A radius that surely reaches an entry selects a range per coordinate; the
range's mask is the difference of two prefix masks, and the masks of all coordinates, ANDed as 64-bit words, leave the
candidates, which are compared exactly. Codebooks are few numbers on the driver; the vectors stay in tasks, which add up
their own sums, merged by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import finite_vectors, matrix, slices, staged

LIMIT = 2 ** 27  # of a scaled component: sums of squared distances stay below 2 ** 63
SALTS = 16
ROWS = 250  # vectors that are compared at a time


class Book:
    """The entries of one part, with their order and prefix masks by each coordinate."""

    def __init__(self, entries: np.ndarray):
        n, width = entries.shape
        self.largest = int(np.abs(entries).max(initial=0))
        self.entries, self.order = entries, np.argsort(entries, axis=0, kind="stable")
        self.ordered = np.take_along_axis(entries, self.order, 0)
        bits = np.zeros((n, (n + 63) // 64), np.uint64)
        bits[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n, dtype=np.uint64) % np.uint64(64))
        self.prefix = np.zeros((width, n + 1, bits.shape[1]), np.uint64)
        for k in range(width):
            self.prefix[k, 1:] = np.bitwise_or.accumulate(bits[self.order[:, k]], axis=0)

    def reach(self, x: np.ndarray) -> np.ndarray:
        """A squared distance within which each vector has an entry: the best of its neighbours by single coordinates."""
        best = np.full(len(x), np.iinfo(np.int64).max)
        for k in range(x.shape[1]):
            near = self.order[np.minimum(np.searchsorted(self.ordered[:, k], x[:, k]), len(self.entries) - 1), k]
            best = np.minimum(best, ((x - self.entries[near]) ** 2).sum(1))
        return best

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries that are within the radius by every coordinate."""
        mask = np.full((len(x), self.prefix.shape[2]), ~np.uint64(0))
        for k in range(x.shape[1]):
            low = np.searchsorted(self.ordered[:, k], x[:, k] - radius, "left")
            high = np.searchsorted(self.ordered[:, k], x[:, k] + radius, "right")
            mask &= self.prefix[k, high] ^ self.prefix[k, low]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each vector, the lower number among equals, and the squared distance."""
        radius = np.ceil(np.sqrt(self.reach(x).astype(np.float64))).astype(np.int64) + 1
        mask = self.candidates(x, radius).astype("<u8")
        rows, entries = np.nonzero(np.unpackbits(mask.view(np.uint8), axis=1, bitorder="little"))
        starts = np.searchsorted(rows, np.arange(len(x)))
        # all candidates of a row follow each other; floating point is exact below 2 ** 53
        kind = np.float64 if 4 * x.shape[1] * max(int(np.abs(x).max(initial=0)), self.largest) ** 2 < 2 ** 53 else np.int64
        apart = np.repeat(x.astype(kind), np.diff(starts, append=len(rows)), axis=0)
        apart -= self.entries[entries]
        distances = np.einsum("ij,ij->i", apart, apart).astype(np.int64)
        best = np.minimum.reduceat(distances, starts)
        first = np.flatnonzero(distances == best[rows])
        _, at = np.unique(rows[first], return_index=True)
        return entries[first[at]], best


@dataclass
class Codebooks:
    """Entries by part (integers after scaling), equally many in each part, and how vectors are cut."""

    entries: list[np.ndarray]
    width: int
    scale: float

    def cut(self, column: pa.Array) -> list[np.ndarray]:
        return cut(column, len(self.entries), self.width, self.scale)

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for x in part.ravel().tolist()).encode()).hexdigest()


def cut(column: pa.Array, parts: int, width: int, scale: float) -> list[np.ndarray]:
    whole = matrix(column, parts * width, scale, LIMIT)
    return [np.ascontiguousarray(whole[:, k * width:(k + 1) * width]) for k in range(parts)]


def fit(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024, id_col: str = "vec_id",
        vec_col: str = "embedding", label_col: str = "label") -> Codebooks:
    """Codebooks that start as the vectors of the smallest ids (equal ids by their vectors, NULL ids last) and follow all
    rows for some rounds: each entry moves to the rounded-down mean of the parts nearest to it; unused ones stay.

    The driver holds codebooks and their sums, whose size the parameters fix. Tables with fewer rows than `entries` give
    fewer entries, tables without usable vectors none. Repeated rows count as often as they stand there.
    """
    few = finite_vectors(rows, id_col, vec_col, label_col)
    longest = few.agg(F.max(F.size("vec"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    seeds = few.select("vec_id", "vec").orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).collect()
    column = pa.array([r["vec"] for r in seeds], pa.list_(pa.float64()))
    books = Codebooks(cut(column, parts, width, scale), width, scale)
    for _ in range(rounds if seeds else 0):
        moved = [part.copy() for part in books.entries]
        for r in sums(few, books).collect():
            moved[r["part"]][r["entry"], r["at"]] = int(r["total"]) // r["n"]
        books = Codebooks(moved, width, scale)
    return books


def sums(few: DataFrame, books: Codebooks) -> DataFrame:
    """`(part, entry, at, n, total)`: number and component sums of the parts that are nearest to each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = [Book(part) for part in books.entries]
        count = [np.zeros(len(part), np.int64) for part in books.entries]
        total = [np.zeros_like(part) for part in books.entries]
        for batch in batches:
            for some in slices(batch, ROWS):
                for k, x in enumerate(books.cut(some["vec"])):
                    found, _ = index[k].nearest(x)
                    np.add.at(count[k], found, 1)
                    np.add.at(total[k], found, x)
        for k, n in enumerate(count):
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([k] * len(used), pa.int32()), "entry": pa.array(used, pa.int32()),
                "n": pa.array(n[used], pa.int64()), "total": pa.array(total[k][used].tolist(), pa.list_(pa.int64()))})

    made = few.select("vec").mapInArrow(run, "part int, entry int, n long, total array<long>")
    each = made.select("part", "entry", "n", F.posexplode("total").alias("at", "x"))
    return each.groupBy("part", "entry", "at").agg(
        F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("total")
    )


def encode(rows: DataFrame, books: Codebooks, id_col: str = "vec_id", vec_col: str = "embedding",
           label_col: str = "label") -> DataFrame:
    """`(vec_id, label, codes, error)` of each row that has a usable vector: one byte per part, and the sum of the parts'
    squared distances. Rows with a NULL vector or a NULL or non-finite component are left out; shorter vectors count as
    filled with zeros; components are held within 2 ** 27 after scaling; NULL ids and labels stay; repeated rows get equal
    codes; an empty table gives no rows."""
    if len(books.entries[0]) > 256:
        raise ValueError("codes of one byte name at most 256 entries")
    few = finite_vectors(rows, id_col, vec_col, label_col)
    kinds = {f.name: f.dataType.simpleString() for f in few.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = [Book(part) for part in books.entries]
        for batch in batches:
            for some in slices(batch, ROWS):
                found = [index[k].nearest(x) for k, x in enumerate(books.cut(some["vec"]))] if some.num_rows else []
                codes = np.stack([f[0] for f in found], 1).astype(np.uint8) if found else ()
                yield pa.RecordBatch.from_pydict({
                    "vec_id": some["vec_id"], "label": some["label"],
                    "codes": pa.array([c.tobytes() for c in codes], pa.binary()),
                    "error": pa.array(sum(f[1] for f in found) if found else [], pa.int64())})

    return few.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes binary, error long")


def decode(encoded: DataFrame, books: Codebooks) -> DataFrame:
    """`(vec_id, vec)`: the entries that the codes name, put together and divided by the scale; NULL codes give NULL."""
    kind = encoded.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = [None if c is None else (np.concatenate([part[i] for part, i in zip(books.entries, c)]) / books.scale).tolist()
                    for c in batch["codes"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"vec_id": batch["vec_id"], "vec": pa.array(vecs, pa.list_(pa.float64()))})

    return encoded.select("vec_id", "codes").mapInArrow(run, f"vec_id {kind}, vec array<double>")


def with_label_errors(encoded: DataFrame) -> DataFrame:
    """Adds label_error: the errors of all rows of the same label, NULL labels together. Errors are added up before the
    shuffle; the sums are dealt out under a few salts, so rows of a common label meet them in several tasks. A sum beyond
    a long is NULL."""
    rows = staged(encoded, "codes").withColumn("_salt", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(SALTS)).cast("int"))
    total = rows.groupBy("label").agg(F.try_sum("error").alias("label_error")).select(
        F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_of"))
    return rows.join(total, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_of"))).drop(
        "_salt", "_of", "_label")
