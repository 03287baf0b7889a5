"""Operator 13, hard negatives: per anchor and positive, the best rows of other labels inside a window of scores.

The index is a multiway hyperplane tree over split points: a row belongs to the nearest split point of each node on its
way down, and every node keeps, for each pair of split points, the range of distances from the one to all rows under the
other. A window of scores is an annulus of distances around the anchor; a sibling whose range the annulus cannot meet
falls away. The rows of the remaining leaves are compared exactly, in blocks.

The shape of the tree comes from a sample of bounded size, its ranges and leaves from all rows. The sample also gives each
search a lower bound to start with. Rows of a leaf are dealt to blocks, anchors to parts, both of bounded size; block and
part meet in one task, and only the few best rows of each anchor leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import finite_vectors, matrix, slices, staged

LIMIT = 2 ** 26  # of a scaled component: squared distances of up to 512 dimensions stay below 2 ** 63
SAMPLE = 4_096  # rows drawn for the tree's shape, on average
POINTS = 8  # split points of a node
LEAF_ROWS = 4_096  # a node that stands for fewer rows is a leaf
BLOCK_ROWS, PART_ANCHORS = 8_192, 1_024
SLICE = 128  # anchors compared with a block at a time
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: by floating point where every sum is below 2 ** 53, else by integers."""
    size = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if size < 2 ** 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * products(a, b)
    return np.sqrt(square.astype(np.float64))


def apart(x: np.ndarray, number: int) -> np.ndarray:
    """Split points: of a few spread rows, greedily the one that is farthest from those taken before."""
    pool = np.unique(x[np.linspace(0, len(x) - 1, min(len(x), 4 * number)).astype(int)], axis=0)
    between = distances(pool, pool)
    taken = [int(between.sum(1).argmax())]
    while len(taken) < min(number, len(pool)):
        taken.append(int(between[taken].min(0).argmax()))
    return pool[taken]


@dataclass
class Node:
    points: np.ndarray
    children: list[int]  # the number of a node, or -1 - the number of a leaf
    low: np.ndarray | None = None  # [i, j]: least distance from point i to the rows under point j
    high: np.ndarray | None = None
    norms: np.ndarray | None = None  # [0, j] and [1, j]: least and largest squared length of the rows under point j


class Tree:
    """Nodes in breadth-first order, so a row's way down is one walk through the list."""

    def __init__(self, sample: np.ndarray, rows: int):
        self.nodes: list[Node] = []
        self.leaves = 0
        waiting = [(sample, None, 0)]
        for x, parent, side in waiting:
            points = apart(x, POINTS) if len(x) > 2 * POINTS and len(x) * rows / len(sample) > LEAF_ROWS else x[:0]
            if len(points) < 2:
                number = -1 - self.leaves
                self.leaves += 1
            else:
                number = len(self.nodes)
                self.nodes.append(Node(points, [0] * len(points)))
                near = distances(x, points).argmin(1)
                waiting += [(x[near == j], number, j) for j in range(len(points))]
            if parent is not None:
                self.nodes[parent].children[side] = number

    def walk(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(node, rows, distances to its points, nearest point) for every node that rows pass."""
        at = np.zeros(len(x), np.int64) if self.nodes else np.full(len(x), -1)
        for number, node in enumerate(self.nodes):
            rows = np.flatnonzero(at == number)
            if len(rows):
                far = distances(x[rows], node.points)
                near = far.argmin(1)
                at[rows] = np.array(node.children)[near]
                yield number, rows, far, near
        self.found = -1 - at

    def leaf(self, x: np.ndarray) -> np.ndarray:
        for _ in self.walk(x):
            pass
        return self.found

    def set_ranges(self, found: list) -> None:
        for node in self.nodes:
            m = len(node.points)
            node.low, node.high = np.full((m, m), np.inf), np.full((m, m), -np.inf)
            node.norms = np.array([[np.inf] * m, [-np.inf] * m])
        for r in found:
            node = self.nodes[r["node"]]
            if r["i"] < 0:
                node.norms[:, r["j"]] = r["low"], r["high"]
            else:
                node.low[r["i"], r["j"]], node.high[r["i"], r["j"]] = r["low"], r["high"]

    def visits(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """[anchor, leaf]: whether the leaf may hold rows whose score is in one of the anchor's windows."""
        out = np.zeros((len(x), self.leaves), bool)
        norm = (x * x).sum(1).astype(np.float64)[:, None]
        score_low = np.where(low == LEAST, -np.inf, low.astype(np.float64))
        score_high = np.where(high == MOST, np.inf, high.astype(np.float64))
        usable = low <= high
        alive = [np.zeros(len(x), bool) for _ in self.nodes]
        if not self.nodes:
            out[:, 0] = usable.any(1)
            return out
        alive[0] = usable.any(1)
        for number, node in enumerate(self.nodes):
            far = distances(x, node.points)
            for j, child in enumerate(node.children):
                outer = norm + node.norms[1, j] - 2 * score_low
                inner = norm + node.norms[0, j] - 2 * score_high
                most, least = np.sqrt(np.maximum(outer, 0)), np.sqrt(np.maximum(inner, 0))
                slack = 1e-6 + 1e-9 * np.where(np.isfinite(most), most, 0)
                meets = usable & (outer >= -slack)
                for i in range(len(node.points)):
                    d = far[:, i:i + 1]
                    meets &= (np.maximum(d - most, least - d) <= node.high[i, j] + slack) & (d + most >= node.low[i, j] - slack)
                ok = alive[number] & meets.any(1)
                if child < 0:
                    out[:, -1 - child] |= ok
                else:
                    alive[child] |= ok
        return out


@dataclass
class Index:
    """The staged rows `(vec_id, label, vec, n, leaf)`, the tree with its ranges, the drawn rows, and how leaves are dealt."""

    rows: DataFrame
    tree: Tree
    sample: tuple[np.ndarray, np.ndarray, list]
    leaves: DataFrame  # (leaf, first, blocks, before, anchors)
    width: int


def build(rows: DataFrame, is_anchor: str, scale: float = 256, id_col: str = "vec_id", vec_col: str = "embedding",
          label_col: str = "label", sample_rows: int = SAMPLE) -> Index:
    """Index every row with an id, a label and a usable vector; `is_anchor` is a condition on `vec_id`.

    The tree's shape needs about `sample_rows` rows on the driver, drawn by a hash of id and vector. The driver also holds
    the tree's ranges and the number of rows of each leaf, whose size depends on the sample alone.
    """
    few = finite_vectors(rows, id_col, vec_col, label_col).filter("vec_id IS NOT NULL AND label IS NOT NULL").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "vec")
    count, longest = few.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    width = max(1, longest or 0)
    draw = F.pmod(F.xxhash64("vec_id", "vec", F.lit(13)), F.lit(1_000_003))
    drawn = few.filter(draw < int(1_000_003 * sample_rows / count)) if count > sample_rows else few
    drawn = {r["vec_id"]: r for r in sorted(drawn.collect(), key=lambda r: (r["vec_id"], r["label"], r["vec"]))}
    vecs = matrix(pa.array([r["vec"] for r in drawn.values()], pa.list_(pa.float64())), width, scale, LIMIT)
    tree = Tree(vecs, count)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                x = matrix(some["vec"], width, scale, LIMIT)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": some["vec_id"], "label": some["label"], "leaf": pa.array(tree.leaf(x), pa.int32()),
                    "vec": pa.array(x.tolist(), pa.list_(pa.int64()))})

    kind = "vec_id long, label string, leaf int, vec array<long>"
    routed = staged(few.mapInArrow(route, kind).withColumn("n", F.monotonically_increasing_id()), "leaves")
    tree.set_ranges(ranges(routed, tree, width).collect())
    sizes = routed.groupBy("leaf").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.expr(is_anchor), 1)).alias("anchors")).collect()
    dealt, first, before = [], 0, 0
    for r in sorted(sizes, key=lambda r: r["leaf"]):
        blocks = -(-r["rows"] // BLOCK_ROWS)
        dealt.append((r["leaf"], first, blocks, before, r["anchors"]))
        first, before = first + blocks, before + r["anchors"]
    leaves = rows.sparkSession.createDataFrame(dealt, "leaf int, first long, blocks long, before long, anchors long")
    return Index(routed, tree, (vecs, np.array(list(drawn), np.int64), [r["label"] for r in drawn.values()]), leaves, width)


def ranges(routed: DataFrame, tree: Tree, width: int) -> DataFrame:
    """`(node, i, j, low, high)`: distances from point i to all rows under point j, and with i = -1 their squared lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            for some in slices(batch):
                x = matrix(some["vec"], width, 1, LIMIT)
                for number, rows, far, near in tree.walk(x):
                    norm = (x[rows] * x[rows]).sum(1).astype(np.float64)
                    for j in np.unique(near):
                        under = np.column_stack([norm[near == j], far[near == j]])
                        low, high = found.get((number, j), (np.inf, -np.inf))
                        found[number, j] = np.minimum(low, under.min(0)), np.maximum(high, under.max(0))
        flat = [(n, i - 1, int(j), low[i], high[i]) for (n, j), (low, high) in found.items() for i in range(len(low))]
        names, kinds = ("node", "i", "j", "low", "high"), (pa.int32(),) * 3 + (pa.float64(),) * 2
        yield pa.RecordBatch.from_pydict({
            name: pa.array([r[k] for r in flat], kind) for k, (name, kind) in enumerate(zip(names, kinds))})

    made = routed.select("vec").mapInArrow(run, "node int, i int, j int, low double, high double")
    return made.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def vectors(batch: pa.RecordBatch | pa.Table, width: int) -> np.ndarray:
    column = batch["vec"]
    return matrix(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, width, 1, LIMIT)


def search(index: Index, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """The best `k` rows of each anchor and window: `(n, slot, vec_id, score)`, best first by `place`, from 1.

    `anchors`: `(n, vec_id, label, vec, leaf, low, high)` with the windows as two arrays of scores. `same` asks for rows of
    the anchor's own label, else for those of other labels. Rows of the anchor's own id are no answers; of rows equal in id
    and score one counts.
    """
    tree, width, (vecs, ids, labels) = index.tree, index.width, index.sample
    labels = np.array(labels, object)

    def matches(own: np.ndarray, other: np.ndarray, own_id: np.ndarray, other_id: np.ndarray) -> np.ndarray:
        return ((own[:, None] == other[None, :]) == same) & (own_id[:, None] != other_id[None, :])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, SLICE):
                if not some.num_rows:
                    continue
                x = vectors(some, width)
                low, high = (np.array(some[c].to_pylist(), np.int64).reshape(len(x), -1) for c in ("low", "high"))
                scores = products(x, vecs)
                ok = matches(np.array(some["label"].to_pylist(), object), labels, some["vec_id"].to_numpy(), ids)
                for slot in range(low.shape[1]):
                    inside = ok & (scores >= low[:, slot:slot + 1]) & (scores <= high[:, slot:slot + 1])
                    best = np.partition(np.where(inside, scores, LEAST), -k, axis=1)[:, -k] if len(vecs) >= k else LEAST
                    low[:, slot] = np.maximum(low[:, slot], best)
                leaves = tree.visits(x, low, high)
                yield pa.RecordBatch.from_pydict({
                    **{c: some[c] for c in ("n", "vec_id", "label", "vec", "part")},
                    "low": pa.array(low.tolist(), pa.list_(pa.int64())), "high": some["high"],
                    "leaf": pa.array([np.flatnonzero(row).tolist() for row in leaves], pa.list_(pa.int32()))})

    dealt = F.col("before") + F.pmod(F.xxhash64("n"), F.greatest("anchors", F.lit(1)))
    leaves = F.broadcast(index.leaves)  # as many rows as the tree has leaves
    parts = anchors.join(leaves, "leaf").withColumn("part", F.floor(dealt / PART_ANCHORS)).select(
        "n", "vec_id", "label", "vec", "part", "low", "high")
    kind = "n long, vec_id long, label string, vec array<long>, part long, low array<long>, high array<long>"
    visits = staged(parts.mapInArrow(visit, f"{kind}, leaf array<int>"), "visits")
    blocks = visits.withColumn("leaf", F.explode("leaf")).join(leaves, "leaf").withColumn(
        "block", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1))).select(
        "block", "part", "n", "vec_id", "label", "vec", "low", "high")
    tiles = blocks.select("block", F.col("part").alias("for_part")).distinct()
    rows = index.rows.join(leaves, "leaf").withColumn(
        "block", F.col("first") + F.pmod(F.xxhash64("n"), F.col("blocks"))).select("block", "vec_id", "label", "vec")
    asked = rows.join(tiles, "block").withColumnRenamed("block", "in_block")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best rows of one block for the anchors of one part."""
        left = left.sort_by([("vec_id", "ascending"), ("label", "ascending")])
        x, id_of = vectors(left, width), left["vec_id"].to_numpy()
        label_of = np.array(left["label"].to_pylist(), object)
        repeated = len(np.unique(id_of)) < len(id_of)
        out: list[np.ndarray] = []
        for start in range(0, right.num_rows, SLICE):
            some = right.slice(start, SLICE)
            low, high = (np.array(some[c].to_pylist(), np.int64).reshape(some.num_rows, -1) for c in ("low", "high"))
            key, at = some["n"].to_numpy(), np.arange(some.num_rows)
            scores = products(vectors(some, width), x)
            ok = matches(np.array(some["label"].to_pylist(), object), label_of, some["vec_id"].to_numpy(), id_of)
            for slot in range(low.shape[1]):
                left_over = np.where(ok & (scores >= low[:, slot:slot + 1]) & (scores <= high[:, slot:slot + 1]), scores, LEAST)
                for _ in range(min(k, len(x))):
                    best = left_over.argmax(1)  # the first of equal scores has the smallest id
                    score = left_over[at, best]
                    found = score > LEAST
                    if not found.any():
                        break
                    out.append(np.stack([key, np.full(len(at), slot), id_of[best], score], 1)[found])
                    if repeated:
                        left_over[(id_of[None, :] == id_of[best][:, None]) & (left_over == score[:, None])] = LEAST
                    else:
                        left_over[at, best] = LEAST
        found = np.concatenate(out) if out else np.empty((0, 4), np.int64)
        return pa.table({c: pa.array(found[:, j], pa.int64()) for j, c in enumerate(("n", "slot", "vec_id", "score"))})

    met = asked.groupBy("in_block", "for_part").cogroup(blocks.groupBy("block", "part")).applyInArrow(
        compare, "n long, slot long, vec_id long, score long")
    best = Window.partitionBy("n", "slot").orderBy(F.desc("score"), "vec_id")
    return met.distinct().withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)


def mine(rows: DataFrame, is_anchor: str = "vec_id % 50 = 0", positives: int = 5, negatives: int = 3,
         least: int = 50, most: int = 95, scale: float = 256, id_col: str = "vec_id", vec_col: str = "embedding",
         label_col: str = "label", sample_rows: int = SAMPLE) -> DataFrame:
    """`(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`: for each anchor its best rows of the
    same label, and for each of these the best rows of other labels that score between `least` and `most` per cent of it.

    Scores are inner products of `floor(scale * x)`; equal scores go by the smaller id. Rows with a NULL id, label, vector
    or component or a non-finite component take no part. Shorter vectors count as filled with zeros; components are held
    within 2 ** 26 after scaling. Repeated rows count once, also as anchors. Every row is indexed and the search is exact.
    """
    index = build(rows, is_anchor, scale, id_col, vec_col, label_col, sample_rows)
    each = index.rows.filter(is_anchor)
    each = staged(each.groupBy("vec_id", "label", "vec").agg(F.min("n").alias("n"), F.min("leaf").alias("leaf")), "anchors")
    free = each.withColumn("low", F.array(F.lit(LEAST))).withColumn("high", F.array(F.lit(MOST)))
    near = staged(search(index, free, True, positives).select(
        "n", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
        (F.col("place") - 1).cast("long").alias("slot")), "positives")
    whole = F.expr("positive_score div 100")
    rest = F.col("positive_score") - whole * 100
    window = near.groupBy("n").agg(F.array_sort(F.collect_list(F.struct(  # at most `positives` of an anchor
        "slot", (whole * least + F.ceil(rest * least / 100)).alias("low"),
        (whole * most + F.floor(rest * most / 100)).alias("high")))).alias("w"))
    # windows that no row can be in stay as they are; missing ones are filled up so that all anchors have equally many
    filled = lambda side, value: F.transform(
        F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.try_element_at(F.col("w"), i)[side], F.lit(value)))
    asked = each.join(window, "n").withColumn("low", filled("low", MOST)).withColumn("high", filled("high", LEAST)).drop("w")
    hard = search(index, asked, False, negatives).select(
        "n", "slot", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        F.col("score").alias("negative_score"))
    return hard.join(near, ["n", "slot"]).join(each.select("n", F.col("vec_id").alias("anchor_id")), "n").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
