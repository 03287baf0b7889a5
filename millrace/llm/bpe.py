"""Operator 10, BPE encoding and decoding with a given tokenizer file.

A piece is a doubly linked list of symbols; a priority queue holds the ranks of possible merges, lowest rank first and
leftmost among equals. Entries that an earlier merge made stale are skipped when they come up. Decoding puts together
the vocabulary strings of the ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Memo, kept, map_batches, strings

MEMO_ENTRIES = 500_000  # words, and pieces of words, that a worker remembers
SPACE = regex.compile("[\t-\r \x85\xa0  -     　]+")
SEPARATORS = regex.compile("[\x1c-\x1f]")  # white space to str.split, but not to Unicode


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


def read_tokenizer(path: str) -> dict:
    """What this operator needs of a tokenizer file, checked to be of the kind it implements: NFC, white space runs to a
    space, lower case; pieces by a pattern, as bytes; BPE with word ends and without a decoder."""
    with open(path, "rb") as file:
        content = file.read()
    data = json.loads(content)
    model, parts = data["model"], data["pre_tokenizer"]["pretokenizers"]
    steps = [s["type"] for s in data["normalizer"]["normalizers"]]
    split = parts[0]
    if (steps != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or data["decoder"] is not None
            or [p["type"] for p in parts] != ["Split", "ByteLevel"] or model["unk_token"] is not None
            or split["behavior"] != "Removed" or not split["invert"] or parts[1]["add_prefix_space"]):
        raise ValueError("not a tokenizer file of the kind implemented here")
    return {"vocab": model["vocab"], "merges": [tuple(m) for m in model["merges"]],
            "pattern": split["pattern"]["Regex"], "end": model["end_of_word_suffix"] or "",
            "added": {t["content"]: t["id"] for t in data["added_tokens"]}, "digest": hashlib.sha256(content).hexdigest()}


def merger(vocab: dict[str, int], merges: list[tuple[str, str]]):
    """Symbols of one piece to the ids after all merges. A merge goes by its rank: `ranks` leads from two neighbours, as one
    number, to it, `pairs` and `made` lead back. An entry of the queue is one number too, the rank before the place."""
    ranks = {vocab[a] << 32 | vocab[b]: rank for rank, (a, b) in enumerate(merges)}
    pairs = [vocab[a] << 32 | vocab[b] for a, b in merges]
    made = [vocab[a + b] for a, b in merges]
    find, pop, push = ranks.get, heapq.heappop, heapq.heappush

    def merge(ids: list[int]) -> list[int]:
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [rank << 32 | k for k, (a, b) in enumerate(zip(ids, ids[1:])) if (rank := find(a << 32 | b)) is not None]
        heapq.heapify(queue)
        while queue:
            entry = pop(queue)
            rank, k = entry >> 32, entry & 0xFFFFFFFF
            right = after[k]
            if right == n or ids[k] << 32 | ids[right] != pairs[rank]:  # an earlier merge took one of the two
                continue
            new = ids[k] = made[rank]
            ids[right] = -1
            following = after[k] = after[right]
            if following < n:
                before[following] = k
                if (rank := find(new << 32 | ids[following])) is not None:
                    push(queue, rank << 32 | k)
            left = before[k]
            if left >= 0 and (rank := find(ids[left] << 32 | new)) is not None:
                push(queue, rank << 32 | left)
        return [i for i in ids if i >= 0]

    return merge


def encoder(tokenizer: dict):
    """Text to (number of ids, ids as decimal text, decoded text). Of a word or piece only its ids are remembered, as one
    string: the decoded text follows from them."""
    vocab, end, added = tokenizer["vocab"], tokenizer["end"], tokenizer["added"]
    merge = merger(vocab, tokenizer["merges"])
    inner, last = ([vocab.get(letter + mark, -1) for _, letter in sorted(byte_letters().items())] for mark in ("", end))
    names = {str(i): s for s, i in [*vocab.items(), *added.items()]}
    pieces = regex.compile(tokenizer["pattern"])
    special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def of_piece(piece: str) -> str:
        letters = piece.encode("utf-8", "replace")
        return " ".join(map(str, merge([i for i in [*[inner[b] for b in letters[:-1]], last[letters[-1]]] if i >= 0])))

    def of_word(word: str) -> str:
        parts = pieces.findall(word)
        if len(parts) == 1:
            return by_piece[word if parts[0] == word else parts[0]]  # the same strings in both memos
        return " ".join([x for p in parts if (x := by_piece[p])])

    by_piece, by_word = Memo(of_piece, MEMO_ENTRIES), Memo(of_word, MEMO_ENTRIES)

    def words(text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower-cased letter by letter
        text = text.lower()
        parts = SPACE.split(text) if SEPARATORS.search(text) else text.split()
        return [found for w in parts if (found := by_word[w])]

    def encode(text: str) -> tuple[int, str, str]:
        if special is None or not special.search(text):
            found = words(text)
        else:
            found = [x for part in special.split(text) if part
                     for x in ([str(added[part])] if part in added else words(part))]
        ids = " ".join(found)
        each = ids.split()
        return len(each), ids, " ".join([names[i] for i in each])

    return encode


def encode_documents(docs: DataFrame, tokenizer: dict, id_col: str = "doc_id", text_col: str = "text",
                     full: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and with `full` the ids and the decoded text.

    NULL texts count as empty; texts of any length are encoded whole. Added tokens standing in a text are taken as such.
    """
    few = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = few.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = kept(tokenizer["digest"], lambda: encoder(tokenizer))
        found = [encode(t) for t in strings(batch["text"])]
        columns = {
            "doc_id": batch["doc_id"], "n_tokens": pa.array([f[0] for f in found], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(f[1].encode()).hexdigest() for f in found], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(f[2].encode()).hexdigest() for f in found], pa.string())}
        if full:
            columns["ids"] = pa.array([list(map(int, f[1].split())) for f in found], pa.list_(pa.int32()))
            columns["decoded"] = pa.array([f[2] for f in found], pa.string())
        return pa.RecordBatch.from_pydict(columns)

    return map_batches(few, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
                                 + ", ids array<int>, decoded string" * full, tokenizer["digest"])


def decode_documents(encoded: DataFrame, tokenizer: dict, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) of an ids column: the vocabulary strings, joined by a space as this kind of file says. NULL ids
    give an empty text; numbers outside the vocabulary are left out."""
    names = {i: s for s, i in tokenizer["vocab"].items()} | {i: s for s, i in tokenizer["added"].items()}
    few = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [" ".join(names[i] for i in ids or () if i in names) for ids in batch["ids"].to_pylist()]
        return pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "decoded": pa.array(texts, pa.string())})

    return map_batches(few, run, f"doc_id {few.schema['doc_id'].dataType.simpleString()}, decoded string")
