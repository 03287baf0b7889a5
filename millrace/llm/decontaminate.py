"""Operator 6, benchmark decontamination as a prefix-filtered containment join.

Benchmark items are cut into windows of WINDOW words. The words of a window are ordered by rarity in the corpus; as the
whole window must be contained, its rarest word alone is the necessary prefix. Document positions of that word are the
candidates; the positional bound places the window around it, the length bound keeps it inside the text, and an exact
comparison of the words decides.

Windows of bounded size in all go to the tasks, which look them up in every text: no text is shuffled. Beyond that bound
the same steps are Spark joins: places of prefix words with the windows, and the pieces of text so found with the windows
again. Either way the plan has a fixed number of steps, however many items there are.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from itertools import pairwise

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import sheltered, slices, staged, utf8

WINDOW = 13
BLOCK_BYTES = 16 * 1024 * 1024  # of windows and item ids, measured, up to which they go to the tasks
RARITY_WORDS = 500_000  # words that a task counts before it gives them out
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # after lower-casing; fixed by the contract's word pattern


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


def _windows(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Distinct (window, item_id), windows as words joined by a space."""
    few = items.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item_id"),
                                                           F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"].to_pylist(), utf8(batch["text"]), strict=True):
                words = words_of(text)
                rows += [(b" ".join(words[k:k + WINDOW]), item)
                         for k in range(max(1, len(words) - WINDOW + 1)) if words]
            yield pa.RecordBatch.from_pydict({"window": pa.array([r[0] for r in rows], pa.binary()).cast(pa.string()),
                                              "item_id": pa.array([r[1] for r in rows], pa.string())})

    return few.mapInArrow(run, "window string, item_id string").distinct()


def _rarity(docs: DataFrame, text_col: str, vocabulary: frozenset) -> dict[bytes, int]:
    """In how many documents each word of the block stands, over all documents; summed in tasks first."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        found: Counter = Counter()
        for batch in batches:
            for text in utf8(batch["text"]):
                found.update(shared.value.intersection(words_of(text)))
        yield pa.RecordBatch.from_pydict({"word": pa.array(found.keys(), pa.binary()),
                                          "n": pa.array(found.values(), pa.int64())})

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word binary, n long")
    return {bytes(r[0]): r[1] for r in rows.groupBy("word").agg(F.sum("n")).collect()}


def _index(rows: list, rarity: dict[bytes, int]) -> dict:
    """Rarest word of each window (the leftmost of equally rare ones) to [(offset, words, item ids)]."""
    owners = defaultdict(set)
    for r in rows:
        owners[r["window"]].add(r["item_id"])
    index = defaultdict(list)
    for window, items in owners.items():
        words = window.encode().split(b" ")
        offset = min(range(len(words)), key=lambda k: (rarity.get(words[k], 0), k))
        index[words[offset]].append((offset, words, sorted(items)))
    return dict(index)


def _match(words: list[bytes], index: dict) -> tuple[list[tuple[int, int]], set[str]]:
    spans, items = [], set()
    if index.keys().isdisjoint(words):
        return spans, items
    for at, word in enumerate(words):
        for offset, window, owners in index.get(word, ()):
            start = at - offset
            if start >= 0 and start + len(window) <= len(words) and words[start:start + len(window)] == window:
                spans.append((start, start + len(window)))
                items.update(owners)
    return spans, items


def _covered(spans: list[tuple[int, int]]) -> int:
    total, reach = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def contaminated(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


FOUND = "_n_words long, _spans array<int>, _items array<string>"


def scan(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns, with `_n_words`, `_spans` (flat word offsets of found windows) and `_items` (ids, sorted);
    columns of the table that are called so make way.

    A row stays a row, whatever its id. NULL texts have no words; items with a NULL id or without words have no windows.
    """
    inner, place, back = sheltered(docs)
    windows = _windows(items, item_col, item_text_col)
    size = windows.agg(F.sum(F.octet_length("window") + F.octet_length("item_id") + 100)).first()[0] or 0
    look = _scan_in_tasks if size <= block_bytes else _scan_by_join
    own = [c for c, name in zip(back, docs.columns) if name.lower() not in ("_n_words", "_spans", "_items")]
    return look(inner, windows, place(text_col)).select(*own, "_n_words", "_spans", "_items")


def _with_found(batch: pa.RecordBatch, names: list[str], rows: list[tuple[int, list[int], list[str]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*(batch[n] for n in names), pa.array([r[0] for r in rows], pa.int64()),
         pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.list_(pa.string()))],
        [*names, "_n_words", "_spans", "_items"])


def _schema(docs: DataFrame) -> str:
    return ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema), FOUND])


def _scan_in_tasks(docs: DataFrame, windows: DataFrame, text_col: str) -> DataFrame:
    rows, names = windows.collect(), docs.columns
    vocabulary = frozenset(w for r in rows for w in r["window"].encode().split(b" "))
    index = docs.sparkSession.sparkContext.broadcast(_index(rows, _rarity(docs, text_col, vocabulary)))

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            found = []
            for text in utf8(batch[text_col]):
                words = words_of(text)
                spans, items = _match(words, index.value)
                found.append((len(words), [x for s in spans for x in s], sorted(items)))
            yield _with_found(batch, names, found)

    return docs.mapInArrow(run, _schema(docs))


def _word_hash(word: bytes) -> int:
    """What Spark's xxhash64 gives for the word."""
    return (xxhash.xxh64_intdigest(word, 42) + 2**63) % 2**64 - 2**63


def _scan_by_join(docs: DataFrame, windows: DataFrame, text_col: str) -> DataFrame:
    """Rows get a number in a written copy, since ids may repeat. What is gathered per row is bounded by its own text (places
    of windows) and by its result (items)."""
    names = docs.columns
    rows = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "decontaminate-rows")
    windows = staged(windows, "decontaminate-windows")
    texts = rows.select("_row", F.col(text_col).cast("string").alias("text"))

    def rarity(batches):
        found: Counter = Counter()
        for batch in batches:
            for text in utf8(batch["text"]):
                found.update(map(_word_hash, set(words_of(text))))
            if len(found) > RARITY_WORDS:  # the shuffle adds up what a task gives out in parts
                yield _counts(found)
                found = Counter()
        yield _counts(found)

    counts = texts.select("text").mapInArrow(rarity, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    word = windows.select("window").distinct().select("window", F.posexplode(F.split("window", " ")).alias("offset", "word"))
    rated = word.select("window", "offset", F.xxhash64("word").alias("h")).join(counts, "h", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "h")).alias("p")
    prefixes = rated.groupBy("window").agg(rarest, F.count(F.lit(1)).cast("int").alias("size")).filter("p.n > 0").select(
        "p.h", "p.offset", "size").distinct()

    def places(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            words = [words_of(t) for t in utf8(batch["text"])]
            yield pa.RecordBatch.from_pydict({
                "_row": batch["_row"], "n_words": pa.array(map(len, words), pa.int32()),
                "h": pa.array([[_word_hash(w) for w in own] for own in words], pa.list_(pa.int64()))})

    at = texts.mapInArrow(places, "_row long, n_words int, h array<long>").select("_row", "n_words", F.posexplode("h").alias("at", "h"))
    start = F.col("at") - F.col("offset")
    asked = at.join(prefixes, "h").select("_row", "n_words", start.alias("start"), "size").filter(
        "start >= 0 AND start + size <= n_words")
    pieces = texts.join(asked.groupBy("_row").agg(F.collect_set(F.struct("start", "size")).alias("asked")), "_row")

    def cut(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            out = []
            for row, text, spans in zip(batch["_row"].to_pylist(), utf8(batch["text"]), batch["asked"].to_pylist(), strict=True):
                words = words_of(text)
                out += [(row, s["start"], s["size"], b" ".join(words[s["start"]:s["start"] + s["size"]])) for s in spans]
            yield pa.RecordBatch.from_pydict({
                "_row": pa.array([r[0] for r in out], pa.int64()), "start": pa.array([r[1] for r in out], pa.int32()),
                "size": pa.array([r[2] for r in out], pa.int32()), "window": pa.array([r[3] for r in out], pa.binary()).cast(pa.string())})

    cuts = pieces.mapInArrow(cut, "_row long, start int, size int, window string")
    found = staged(cuts.join(windows, "window").select("_row", "start", "size", "item_id"), "decontaminate-found")
    of_row = found.groupBy("_row").agg(
        F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end"))).alias("spans"),
        F.array_sort(F.collect_set("item_id")).alias("items"))

    def finish(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            out = []
            for text, spans, items in zip(utf8(batch[text_col]), batch["spans"].to_pylist(), batch["items"].to_pylist(), strict=True):
                ordered = sorted((s["start"], s["end"]) for s in spans or ())
                out.append((len(words_of(text)), [x for s in ordered for x in s], items or []))
            yield _with_found(batch, names, out)

    return rows.join(of_row, "_row", "left").drop("_row").mapInArrow(finish, _schema(docs))


def _counts(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"h": pa.array(found.keys(), pa.int64()), "n": pa.array(found.values(), pa.int64())})


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_words (merged offsets)."""
    few = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = scan(few, items, **options).drop("text")
    kind = few.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sizes = batch["_n_words"].to_pylist()
            hits = [_covered([(a, b) for a, b in list(pairwise(s))[::2]]) for s in batch["_spans"].to_pylist()]
            items = batch["_items"].to_pylist()
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "n_words": batch["_n_words"], "n_hit": pa.array(hits, pa.int64()),
                "n_items": pa.array(map(len, items), pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()),
                "contaminated": pa.array(map(contaminated, sizes, hits), pa.bool_())})

    return found.mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, "
                                 "contaminated boolean")


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, all columns as they are; NULL and empty texts stay."""
    docs, place, back = sheltered(docs)
    found = scan(docs, items, place(text_col), **options)

    def run(batches):
        for batch in batches:
            hits = [_covered([(a, b) for a, b in list(pairwise(s))[::2]]) for s in batch["_spans"].to_pylist()]
            bad = map(contaminated, batch["_n_words"].to_pylist(), hits)
            yield batch.filter(pa.array([not b for b in bad], pa.bool_()))

    return found.mapInArrow(run, found.schema).select(*back)
