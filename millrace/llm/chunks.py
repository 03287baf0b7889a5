"""Operator 5, substring dedup by content-defined chunking.

A gear rolling hash over the last two words (16 bytes at most) rates word ends; the lowest of each WINDOW consecutive
ones is a boundary, wherever the text stands. From each boundary a variable chunk runs to the first boundary at least
MIN_WORDS on, so an insertion shifts nothing beyond itself. Chunks are deduplicated by digest over the corpus; runs of
repeated chunks are repeated passages.

Every passage of SURE_WORDS words that stands in two places has a run of PASSAGE_WORDS or more, whatever surrounds it.
Number its word ends from 0: those from 1 on are rated by the passage alone. Let the first WINDOW of them have their
lowest at f, the last WINDOW at l. Windows that reach out of the passage pick nothing inside it but before f or after l,
so from f to l the boundaries are the same in both places, WINDOW apart at most. f <= WINDOW and l >= SURE_WORDS - WINDOW.
The chunks that start and end there touch each other, begin at f and end less than WINDOW before l, as the boundary
after the last start is at most WINDOW on and has no chunk: SURE_WORDS - 3 * WINDOW + 1 words at least.
"""

from __future__ import annotations

import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import given_up, mix, sheltered, slices, utf8

MIN_WORDS = 8
WINDOW = 7  # word ends, of which the lowest is a boundary: boundaries are so many words apart at most, 4 on average
PASSAGE_WORDS = 24  # a run of repeated chunks of fewer words is left alone
SURE_WORDS = PASSAGE_WORDS + 3 * WINDOW - 1  # every repeated passage of so many words holds such a run: 44
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def boundaries(words: list[bytes]) -> np.ndarray:
    """Numbers of the words at which a chunk may begin: after the word end of the lowest gear hash (the last of equal
    ones) in a window."""
    n = len(words)
    if n < WINDOW:
        return np.empty(0, np.int64)
    data = b" ".join(words)
    h = np.zeros(len(data) + 1, np.uint16)
    h[1:] = GEAR[np.frombuffer(data, np.uint8)]
    for reach in (1, 2, 4, 8):  # h[i] sums the gears of the 2 * reach bytes before i, each shifted by its age
        h[reach:] = h[reach:] + (h[:-reach] << np.uint16(reach))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    own = np.diff(ends, n=1, prepend=-1) - 1
    own[1:] += own[:-1] + 1  # bytes of the last two words
    before = np.where(own < 16, h[ends - own] << np.minimum(own, 15).astype(np.uint16), 0)  # gears of what precedes them
    rated = ((h[ends] - before) & 0xFFFF).astype(np.int64) << 32 | np.arange(n)[::-1]
    lowest = rated[:n - WINDOW + 1]
    for k in range(1, WINDOW):
        lowest = np.minimum(lowest, rated[k:n - WINDOW + 1 + k])
    cuts = n - (lowest & 0xFFFFFFFF)
    return cuts[np.diff(cuts, prepend=-1) > 0]


def chunks(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(first word, word after the last, digest) of each chunk; each starts and ends at a boundary."""
    cuts = boundaries(words)
    after = np.searchsorted(cuts, cuts + MIN_WORDS)
    after = after[after < len(cuts)]
    digest = xxhash.xxh3_64_intdigest
    return [(a, b, digest(b" ".join(words[a:b])) - 2**63)
            for a, b in zip(cuts[:len(after)].tolist(), cuts[after].tolist(), strict=True)]


def repeated_spans(found: list[tuple[int, int, int]], elsewhere: set[int], least: int) -> list[tuple[int, int]]:
    """Word spans covered by chunks that are kept elsewhere or stood earlier in this text, joined where they touch."""
    spans: list[list[int]] = []
    seen: dict[int, int] = {}
    for first, last, digest in found:
        again = seen.get(digest)
        if digest in elsewhere or (again is not None and again <= first):
            if spans and first <= spans[-1][1]:
                spans[-1][1] = last
            else:
                spans.append([first, last])
        seen.setdefault(digest, last)
    return [(a, b) for a, b in spans if b - a >= least]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = PASSAGE_WORDS) -> DataFrame:
    """The documents, all columns, with passages that an earlier document (smaller id) or an earlier place holds cut out
    of the text column, and `_spans`: array of (start, end) character offsets cut, `_n_words`: words before; columns of
    the table that are called so make way.

    A NULL id neither keeps nor loses a passage to others. Rows of one id and text count as one. NULL and empty texts
    stay as they are. An empty table gives no rows.
    """
    keep = docs.columns
    docs, place, back = sheltered(docs)
    id_col, text_col = place(id_col), place(text_col)
    few = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = few.schema["_id"].dataType.simpleString()

    def digests(batches):
        given_up()
        for batch in batches:
            for part in slices(batch):
                rows = [sorted({d for _, _, d in chunks(t.split())}) if t else [] for t in utf8(part["_text"])]
                yield pa.RecordBatch.from_pydict({"_id": part["_id"], "_d": pa.array(rows, pa.list_(pa.int64()))})

    held = few.filter("_id IS NOT NULL").mapInArrow(digests, f"_id {kind}, _d array<long>").select(
        "_id", F.explode("_d").alias("_d"))
    keepers = held.groupBy("_d").agg(F.min("_id").alias("_keeper"), F.max("_id").alias("_last")).filter(
        "_keeper <> _last").select("_d", "_keeper")
    lost = held.join(keepers, "_d").filter("_id <> _keeper").groupBy("_id").agg(F.collect_set("_d").alias("_lost"))
    taken = docs.join(lost.withColumnRenamed("_id", "_of"), F.col(id_col) == F.col("_of"), "left").drop("_of")
    names = docs.columns

    def cut(batches):
        given_up()
        for batch in (part for whole in batches for part in slices(whole)):
            texts, spans, sizes = [], [], []
            for text, known in zip(utf8(batch[text_col]), batch["_lost"], strict=True):
                places = [m.span() for m in WORD.finditer(text)] if text else []
                words = [text[a:b] for a, b in places]
                elsewhere = set(known.values.to_numpy(zero_copy_only=False).tolist()) if known.is_valid else set()
                cuts = [(places[a][0], places[b - 1][1]) for a, b in repeated_spans(chunks(words), elsewhere, least)]
                edges = [0, *(x for c in cuts for x in c), len(text or b"")]
                texts.append(text if not cuts else b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                chars = [len(text[a:b].decode()) for a, b in pairwise(edges[:-1])] if cuts else []
                at = np.cumsum(chars).tolist()
                spans.append([{"start": a, "end": b} for a, b in zip(at[::2], at[1::2])])
                sizes.append(len(words))
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if n == text_col else batch[n] for n in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(spans, pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))),
                 pa.array(sizes, pa.int64())], [*names, "_spans", "_n_words"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    found = taken.mapInArrow(cut, f"{schema}, _spans array<struct<start:bigint,end:bigint>>, _n_words bigint")
    own = [c for c, name in zip(back, keep) if name.lower() not in ("_spans", "_n_words")]
    return found.select(*own, "_spans", "_n_words")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their repeated passages, all columns; one that has no word left is dropped, texts that had none
    to begin with stay. A column `n_chars` follows the text."""
    inner, place, back = sheltered(docs)
    text, left = place(text_col), dedup(inner, place(id_col), place(text_col))
    changed = F.size("_spans") > 0
    gone = changed & (F.trim(F.translate(text, "\t\n\x0b\f\r", "     ")) == "")
    left = left.filter(~F.coalesce(gone, F.lit(False)))
    if "n_chars" in docs.columns:
        size = place("n_chars")
        left = left.withColumn(size, F.when(changed, F.length(text)).otherwise(F.col(size)).cast(docs.schema["n_chars"].dataType))
    return left.select(*back)
