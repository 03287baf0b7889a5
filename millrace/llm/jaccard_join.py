"""Operator 3, n-gram Jaccard join by PartEnum signatures.

Sets are dealt into size bands. In a band, linked sets differ in at most `k` elements; the feature domain is cut by hash
into blocks, each block into `parts`, and a signature is the content of all but `spare` parts of a block. By the
pigeonhole principle linked sets share a block that differs in at most `spare` elements, and so a signature of it. Every
pair that shares a signature is then verified exactly, in bounded blocks of members.

Subsets that are empty or hold only frequent n-grams (a licence line, a passage in many texts) would bring together all
texts that share no more than these. They are needed only if a set has too few others for the pigeonhole: with more
blocks than differences can spoil, a telling subset is always among those that agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, groupby
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import (U64, Memo, components, given_up, map_batches, mix, sheltered, shingle_hashes, slices,
                                 staged, utf8)

BLOCK = 512  # members of a bucket that one comparison block takes at most
SPARE_BLOCKS = 0.2  # blocks beyond those the pigeonhole needs, so that untelling ones need no signature
FREQUENT = 500_000  # n-grams at most that count as frequent; which ones they are changes the cost, never the result
FREQUENT_SAMPLE, FREQUENT_TIMES = 16, 3  # seen so many times in one of so many documents
PART = mix(np.arange(64, dtype=U64)) | U64(1)  # odd factors that tell the parts of a block apart
HEAPS, SHINGLES_A_HEAP = 64, 1_000_000  # a heap of signatures grows with those of its share of the n-grams, not with the table
PACKED = 500_000  # signatures that a task holds before it hands them on
BROADCAST_IDS = 2_000_000  # ids that are broadcast at most; beyond, the same join is shuffled


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return text.lower().split() if text else []


class Bands:
    """Size bands for 'num / den or more': a band spans `steps` factors of den / num."""

    def __init__(self, num: int, den: int, steps: int = 2):
        self.num, self.den, self.steps, self.bounds = num, den, steps, [(1, 1)]

    def of(self, size: int) -> list[tuple[int, int]]:
        """(band, most differing elements) for each band whose signatures a set of this size gives: its own, and the
        next one if that holds sets it may be linked with."""
        while self.bounds[-1][0] <= size:
            low = self.bounds[-1][1] + 1
            self.bounds.append((low, max(low, low * self.den**self.steps // self.num**self.steps)))
        own = next(i for i in range(len(self.bounds)) if self.bounds[i][1] >= size)
        found = [own]
        if own + 1 < len(self.bounds) and size * self.den >= self.num * self.bounds[own + 1][0]:
            found.append(own + 1)
        return [(i, 2 * self.bounds[i][1] * (self.den - self.num) // (self.den + self.num)) for i in found]


def signatures(features: np.ndarray, bands: Bands, parts: int, spare: int, frequent: np.ndarray) -> np.ndarray:
    """The set's signatures. Where the bound is 0 only equal sets are linked, and they need none."""
    made = []
    telling = np.ones(len(features))
    if len(frequent):
        place = np.minimum(np.searchsorted(frequent, features), len(frequent) - 1)
        telling -= frequent[place] == features
    value, spot = mix(features), features >> U64(17)
    subsets = np.array(list(combinations(range(parts), parts - spare)))
    number = np.arange(len(subsets), dtype=U64) * U64(0xD6E8FEB86659FD93)
    for band, k in bands.of(len(features)):
        if not k:
            continue
        need = k // (spare + 1) + 1
        blocks = need + ceil(SPARE_BLOCKS * need)
        at = (spot % U64(blocks * parts)).astype(np.int64)
        content = np.zeros(blocks * parts, U64)
        np.add.at(content, at, value)
        content = content.reshape(blocks, parts) * PART[:parts]
        filled = np.bincount(at, telling, blocks * parts).reshape(blocks, parts) > 0
        everything = (filled.sum(1) > spare).sum() < need  # too few telling blocks: all subsets are needed
        place = (np.arange(blocks, dtype=U64) + U64(band << 32)) * U64(0x9E3779B97F4A7C15)
        found = mix(content[:, subsets].sum(2) + place[:, None] + number)
        made.append(found.ravel() if everything else found[filled[:, subsets].any(2)])
    return np.concatenate(made) if made else np.empty(0, U64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    values = np.concatenate(rows) if rows else np.empty(0, U64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _profile(few: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, mark of the text, n_shingles, digest of the set, key: eight bytes of it)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_hashes(words_of(t), shingle) for t in utf8(batch["text"])]
        digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        return pa.RecordBatch.from_pydict({
            "doc_id": batch["doc_id"], "mark": batch["mark"], "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
            "digest": pa.array(digests, pa.binary()), "key": pa.array(map(_key, digests), pa.int64())})

    return map_batches(few.withColumn("mark", _mark("text")), run,
                       f"{_id(few)}, mark long, n_shingles long, digest binary, key long")


def _mark(text_col: str) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(F.col(text_col).cast("string"))


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _frequent(few: DataFrame, shingle: int) -> np.ndarray:
    """Hashes of frequent n-grams, as seen in a sample of the documents by a hash of their ids."""
    some = few.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(FREQUENT_SAMPLE)) == 0)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"grams": _lists(
            [shingle_hashes(words_of(t), shingle) for t in utf8(batch["text"])])})

    counted = map_batches(some, run, "grams array<long>").select(F.explode("grams").alias("g")).groupBy("g").count()
    top = counted.filter(F.col("count") >= FREQUENT_TIMES).orderBy(F.desc("count"), "g").limit(FREQUENT)
    return np.sort(np.array([r["g"] for r in top.select("g").collect()], np.int64).view(U64))


def _signed_sets(few: DataFrame, shingle: int, num: int, den: int, parts: int, spare: int,
                 frequent: np.ndarray, heaps: int) -> DataFrame:
    """(heap, keys, sigs): sets and their signatures, dealt into heaps by signature and packed, as 16 bytes each. Of a set
    there is one copy in each task as far as it remembers."""
    bands = Bands(num, den)
    seen = Memo(lambda digest: [])

    def signed(text: bytes | None) -> tuple[int, np.ndarray] | None:
        features = shingle_hashes(words_of(text), shingle)
        digest = xxhash.xxh3_128_digest(features.tobytes())
        if not len(features) or seen[digest]:
            return None
        seen[digest].append(True)
        return _key(digest), signatures(features, bands, parts, spare, frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given_up()
        held, size = [], 0
        for text in (text for batch in batches for part in slices(batch) for text in utf8(part["text"])):
            one = signed(text)
            if one is not None and len(one[1]):
                held.append(one)
                size += len(one[1])
            if size >= PACKED:
                yield _packed(held, heaps)
                held, size = [], 0
        if size:
            yield _packed(held, heaps)

    return few.select("text").mapInArrow(run, "heap int, keys binary, sigs binary")


def _packed(signed: list[tuple[int, np.ndarray]], heaps: int) -> pa.RecordBatch:
    keys, sigs = zip(*signed, strict=True)
    key, sig = np.repeat(np.array(keys, np.int64), [len(s) for s in sigs]), np.concatenate(sigs)
    heap = (sig % U64(heaps)).astype(np.int32)
    order = np.argsort(heap, kind="stable")
    first = np.concatenate([[0], np.flatnonzero(np.diff(heap[order])) + 1])
    offsets = pa.py_buffer((np.append(first, len(heap)) * 8).astype(np.int32))

    def bytes_of(values: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(values[order])])

    return pa.RecordBatch.from_arrays([pa.array(heap[order][first]), bytes_of(key), bytes_of(sig)], ["heap", "keys", "sigs"])


def _repeated(key: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by signature, what has a signature that comes more than once."""
    order = np.argsort(sig, kind="stable")
    key, sig = key[order], sig[order]
    again, some = sig[1:] == sig[:-1], np.zeros(len(sig), bool)
    some[1:] |= again
    some[:-1] |= again
    return key[some], sig[some]


def _met(packed: DataFrame) -> DataFrame:
    """(sig, key), each once, of the signatures that two sets or more have. A heap is in memory at once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given_up()
        stream = (row for batch in batches for row in zip(*(batch[n].to_pylist() for n in ("heap", "keys", "sigs")),
                                                          strict=True))
        for _, rows in groupby(stream, lambda r: r[0]):
            _, keys, sigs = zip(*rows, strict=True)
            key, sig = _repeated(np.frombuffer(b"".join(keys), np.int64), np.frombuffer(b"".join(sigs), np.int64))
            order = np.lexsort((key, sig))
            key, sig = key[order], sig[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])
            key, sig = _repeated(key[fresh], sig[fresh])
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(key)], ["sig", "key"])

    return packed.repartition("heap").sortWithinPartitions("heap").mapInArrow(run, "sig long, key long")


def _sets(few: DataFrame, shingle: int) -> DataFrame:
    """(key, features) of documents."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_hashes(words_of(t), shingle) for t in utf8(batch["text"])]
        return pa.RecordBatch.from_pydict({
            "key": pa.array([_key(xxhash.xxh3_128_digest(s.tobytes())) for s in sets], pa.int64()),
            "features": _lists(sets)})

    return map_batches(few.select("text"), run, "key long, features array<long>")


def _id(df: DataFrame) -> str:
    return "doc_id " + df.schema["doc_id"].dataType.simpleString()


def _common(rows: list[np.ndarray]) -> np.ndarray:
    """Pairwise intersection sizes of sorted distinct arrays, as a matrix product over the shared elements."""
    n = len(rows)
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    values, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    everywhere = int((times == n).sum())
    use = (times > 1) & (times < n)
    column = np.cumsum(use) - 1
    total = np.full((n, n), everywhere, np.int64)
    inside = use[at]
    owner, at = owner[inside], column[at[inside]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for low in range(0, int(use.sum()), 4_096):  # bounds the dense piece at members x 4,096
        a, b = np.searchsorted(at, (low, low + 4_096))
        dense = np.zeros((n, 4_096), np.float32)
        dense[owner[a:b], at[a:b] - low] = 1
        total += (dense @ dense.T).astype(np.int64)
    return total


def _verify(num: int, den: int):
    """Sorted rows (bucket, i, j, key, chunk, features, buckets) to links found in each comparison block: a spanning
    forest of them `(u, v)`, and the number of links of each member `(u, NULL, n)`. A pair that meets in several buckets
    is counted in the smallest."""

    def block(bucket: int, i: int, j: int, rows: list[tuple]) -> Iterator[tuple]:
        keys, chunk, sets, buckets = zip(*(r[3:] for r in rows), strict=True)
        n = len(rows)
        size = np.array([len(s) for s in sets])
        shared = _common(sets)
        linked = shared * (num + den) >= num * (size[:, None] + size[None, :])
        if i != j:
            side = np.array(chunk) == i
            linked &= side[:, None] != side[None, :]
        np.fill_diagonal(linked, False)
        if not linked.any():
            return
        earlier = [b[b < bucket] for b in buckets]
        counted = linked & (_common(earlier) == 0) if any(map(len, earlier)) else linked
        for a in np.flatnonzero(counted.any(1)):
            yield keys[a], None, int(counted[a].sum())
        todo = set(range(n))
        while todo:  # breadth first: each member is reached once
            front = [todo.pop()]
            while front:
                a = front.pop()
                for b in np.flatnonzero(linked[a]):
                    if b in todo:
                        todo.discard(b)
                        front.append(b)
                        yield keys[a], keys[b], 0

    def arrays(column: pa.Array) -> list[np.ndarray]:
        ends, values = column.offsets.to_numpy(), column.values.to_numpy()
        return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        names = ("bucket", "i", "j", "key", "chunk")
        return zip(*(batch[n].to_pylist() for n in names), arrays(batch["features"]), arrays(batch["buckets"]), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given_up()
        stream = (row for batch in batches for row in rows(batch))
        for key, members in groupby(stream, lambda r: r[:3]):
            found = list(block(*key, list(members)))
            if found:
                u, v, links = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()),
                                                  pa.array(links, pa.int64())], ["u", "v", "n"])

    return run


def join(docs: DataFrame, shingle: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text",
         parts: int = 1, spare: int = 0) -> DataFrame:
    """Self-join of documents whose sets of word n-grams have a Jaccard similarity of num / den or more.

    One row per row: doc_id (long), n_shingles, n_links (linked sets other than its own; copies of a set are one),
    component_id (smallest doc_id reachable over links and equal sets). Sets are told apart by what they hold, so rows
    of one id with different texts are judged each for itself. A text without words has an empty set, no links, and is
    its own component. Rows with a NULL id are kept, with a NULL component and no links. Exact copies collapse before
    any pairing; an empty table gives no rows.
    """
    return _grouped(docs, shingle, num, den, id_col, text_col, parts, spare).select(
        "doc_id", "n_shingles", "component_id", "n_links")


def _grouped(docs: DataFrame, shingle: int, num: int, den: int, id_col: str, text_col: str, parts: int,
             spare: int) -> DataFrame:
    """What `join` gives, with `mark` of the text and `group`, a number of the component (NULL without words or id)."""
    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = staged(_profile(few, shingle), "jaccard-profiles")
    heads = base.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy("digest", "key").agg(
        F.min("doc_id").alias("head"))
    named = few.filter("doc_id IS NOT NULL")
    heaps = HEAPS + (base.agg(F.sum("n_shingles")).first()[0] or 0) // SHINGLES_A_HEAP
    packed = _signed_sets(named, shingle, num, den, parts, spare, _frequent(named, shingle), heaps)
    met = staged(_met(packed), "jaccard-met")
    member = staged(_buckets(met), "jaccard-members")
    ids = heads.join(member.select("key").distinct(), "key").select(F.col("head").alias("doc_id")).distinct()
    ids = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    sets = _sets(named.join(ids, "doc_id", "left_semi"), shingle)
    own = member.groupBy("key").agg(F.collect_list("bucket").alias("buckets"),
                                    F.collect_list(F.struct("bucket", "chunks")).alias("places"))
    pieces = sets.join(own, "key").dropDuplicates(["key"]).select(
        "key", "features", "buckets", F.explode("places").alias("b")).select(
        "key", "features", "buckets", F.col("b.bucket").alias("bucket"), F.col("b.chunks").alias("chunks"),
        F.pmod(F.xxhash64("key", F.lit(7)), F.col("b.chunks")).cast("int").alias("chunk"))
    pieces = pieces.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).select(
        "bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "key", "chunk",
        "features", "buckets")
    dealt = pieces.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    links = staged(dealt.mapInArrow(_verify(num, den), "u long, v long, n long"), "jaccard-links")
    roots = components(links.filter("v IS NOT NULL").select("u", "v"), "jaccard-components")
    counts = links.filter("v IS NULL").groupBy(F.col("u").alias("key")).agg(F.sum("n").alias("n_links"))
    rooted = heads.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "group", F.coalesce("root", "key"))
    least = rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("head").alias("least"))
    classes = rooted.join(least, "root", "left").join(counts, "key", "left").select(
        "digest", "group", F.coalesce("least", "head").alias("root"), "n_links")
    named = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return base.select("doc_id", "mark", "n_shingles", "digest").join(classes, "digest", "left").select(
        "doc_id", "mark", "n_shingles", F.when(named, F.col("group")).alias("group"),
        F.when(named, F.col("root")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(named, F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"))


def _buckets(met: DataFrame) -> DataFrame:
    """(bucket, key, chunks): what is to be compared, from (sig, key). Signatures with the same members are one bucket.
    Then, twice, each bucket joins the largest one that its first member is in: every pair stays together, and a set is
    sent to a few buckets rather than to one for each of its signatures."""
    sized = met.groupBy("sig").agg(
        F.count(F.lit(1)).alias("size"), F.min("key").alias("low"), F.max("key").alias("high"),
        F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("mark")).filter("size > 1")
    kept = sized.groupBy("size", "low", "high", "mark").agg(F.min("sig").alias("sig")).select("sig")
    member = staged(met.join(kept, "sig"), "jaccard-buckets")
    for _ in range(2):
        sized = member.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.min("key").alias("key"))
        largest = member.join(sized.select("sig", "size"), "sig").groupBy("key").agg(
            F.max(F.struct("size", "sig"))["sig"].alias("into"))
        into = sized.join(largest, "key").select("sig", "into")
        member = staged(member.join(into, "sig").select(F.col("into").alias("sig"), "key").distinct(), "jaccard-buckets")
    sized = member.groupBy("sig").count().filter("count > 1")
    return member.join(sized, "sig").select(
        F.col("sig").alias("bucket"), "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("chunks"))


def keep_one(docs: DataFrame, shingle: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id",
             text_col: str = "text", parts: int = 1, spare: int = 0) -> DataFrame:
    """The document of smallest id of each group, all columns as they are; of rows equal in id and text one. Rows of one
    id with different texts stay, each as the first of its own group. Documents without an id stay."""
    docs, place, back = sheltered(docs)
    id_col, text_col = place(id_col), place(text_col)
    groups = _grouped(docs, shingle, num, den, id_col, text_col, parts, spare).filter("doc_id IS NOT NULL")
    first = groups.filter("group IS NOT NULL").groupBy("group").agg(F.min(F.struct("doc_id", "mark")).alias("f"))
    stay = first.select("f.*").unionByName(groups.filter("group IS NULL").select("doc_id", "mark")).distinct().select(
        F.col("doc_id").alias("_stays"), F.col("mark").alias("_mark"))
    named = docs.filter(F.col(id_col).isNotNull()).withColumn("_of", _mark(text_col))
    kept = named.join(stay, (F.col(id_col) == F.col("_stays")) & (F.col("_of") == F.col("_mark")), "left_semi")
    return kept.dropDuplicates([id_col, "_of"]).drop("_of").unionByName(docs.filter(F.col(id_col).isNull())).select(*back)
