"""Operator 9, quality rules with line sequence labelling.

A linear-chain conditional random field over the lines of a text marks each as content or boilerplate: features of the
line and transitions between neighbours, decoded by Viterbi. The share of words in content lines decides retention,
after base rules on length and repetition.
"""

from __future__ import annotations

from collections import Counter
from math import exp, log

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import count_of, drawn, map_batches, utf8

TRAIN_ROWS = 3_000  # labelled documents that the field is fitted on: all up to this number, else so many on average
CONTENT_SHARE = 0.5
CAPITALS = bytes(range(65, 91))
symbols, capitals = count_of(b"#*$%&|<>"), count_of(CAPITALS)
letter_count = count_of(CAPITALS + CAPITALS.lower() + b"\xc3")  # the byte that Latin letters with accents begin with
CONTINUATION = bytes(range(128, 192))
N_FEATURES = 15
RUNS = (1, 1, 1, 1, 2, 2, 4, 8)  # lines of one class in a row, in sequences joined for training


def base_rules(text: bytes | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or b""
    words = text.split()
    n = len(words)
    chars = len(b"".join(words).translate(None, CONTINUATION))
    lines = [line for line in text.split(b"\n") if line.strip()]
    triples = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(triples)) < len(triples):
        times = Counter(triples)
        covered = bytearray(n)
        for k, t in enumerate(triples):
            if times[t] > 1:
                covered[k:k + 3] = b"\1\1\1"
        repeated = sum(covered)
    return (n, chars, symbols(text), len(lines) - len(set(lines)), repeated,
            n < 50 or 100 * repeated > 50 * n)


def line_features(line: bytes, words: list[bytes], seen: bool) -> tuple[int, ...]:
    """Numbers of the features that hold for a line; 0 always does."""
    n = len(words)
    letters = letter_count(line)
    tests = (
        True, n <= 2, 3 <= n <= 8, n > 20, line.rstrip()[-1:] in b".?!:", b"|" in words,
        symbols(line) > 0.05 * len(line), capitals(line) > 0.4 * max(1, letters), b"!!" in line,
        seen, sum(map(bytes.__eq__, words, words[1:])) > 0.15 * n, n >= 8 and len(set(words)) < 0.5 * n,
        letters < 0.5 * len(line), n >= 8 and sum(len(w) <= 3 and w.isalpha() for w in words) > 0.15 * n,
        n >= 8 and sum(w[:1].isupper() for w in words) > 0.5 * n,
    )
    return tuple(k for k, t in enumerate(tests) if t)


def lines_of(text: bytes | None) -> list[tuple[tuple[int, ...], int]]:
    """(features, words) of each line that has a word."""
    found, seen = [], set()
    for line in (text or b"").split(b"\n"):
        if words := line.split():
            found.append((line_features(line, words, line in seen), len(words)))
            seen.add(line)
    return found


def viterbi(emission: list[float], move: tuple[float, float, float, float]) -> list[int]:
    """Best labels (0 content, 1 boilerplate). emission: score of label 1 over 0; move: transitions 00, 01, 10, 11. Equal
    scores go to content."""
    best0 = best1 = 0.0
    back = []
    for k, e in enumerate(emission):
        if k:
            from0, from1 = best0 + move[0] < best1 + move[2], best0 + move[1] < best1 + move[3]
            best0, best1 = (best1 + move[2] if from0 else best0 + move[0]), (best1 + move[3] if from1 else best0 + move[1])
            back.append((from0, from1))
        best1 += e
    label = int(best1 > best0)
    labels = [label]
    for pair in reversed(back):
        label = int(pair[label])
        labels.append(label)
    return labels[::-1] if emission else []


def _add(a: float, b: float) -> float:
    return max(a, b) + log(1 + exp(-abs(a - b)))


def mixed(rows: list[tuple[int, list[list[int]]]]) -> list[tuple[list[int], list[list[int]]]]:
    """Sequences whose label changes: the lines of each document of the one class, in runs, between runs of lines of a
    document of the other. Run lengths follow a hash of the place, so they are the same in every session."""
    sides = [[lines for label, lines in rows if label == side] for side in (0, 1)]
    out = []
    for k in range(max(map(len, sides)) if all(sides) else 0):
        left = [list(side[k % len(side)]) for side in sides]
        labels, lines = [], []
        turn = xxhash.xxh3_64_intdigest(b"%d" % k) % 2
        while left[0] or left[1]:
            length = RUNS[xxhash.xxh3_64_intdigest(b"%d %d" % (k, len(lines))) % len(RUNS)]
            run, left[turn] = left[turn][:length], left[turn][length:]
            labels += [turn] * len(run)
            lines += run
            turn = 1 - turn
        out.append((labels, lines))
    return out


def train(rows: list[tuple[list[int], list[list[int]]]], rounds: int = 3, rate: float = 0.2) -> dict:
    """Stochastic gradient ascent of the conditional likelihood. rows: (label of each line, features of each line)."""
    w, t = [0.0] * N_FEATURES, [0.0] * 4
    for turn in range(rounds):
        speed = rate / (1 + turn)
        for labels, lines in rows:
            n = len(lines)
            e = [sum(w[k] for k in f) for f in lines]
            ahead = [(0.0, e[0])]
            for k in range(1, n):
                a, b = ahead[-1]
                ahead.append((_add(a + t[0], b + t[2]), e[k] + _add(a + t[1], b + t[3])))
            whole = _add(*ahead[-1])
            a = b = 0.0
            scale = speed / n
            for k in range(n - 1, -1, -1):
                miss = labels[k] - exp(ahead[k][1] + b - whole)
                for f in lines[k]:
                    w[f] += scale * miss
                if k:
                    p, q = ahead[k - 1]
                    t0, t1, t2, t3 = t
                    seen = 2 * labels[k - 1] + labels[k]
                    for i, x in enumerate((p + t0 + a, p + t1 + e[k] + b, q + t2 + a, q + t3 + e[k] + b)):
                        t[i] += scale * ((i == seen) - exp(x - whole))
                    a, b = _add(t0 + a, t1 + e[k] + b), _add(t2 + a, t3 + e[k] + b)
    return {"weights": w, "moves": tuple(t)}


def fit(docs: DataFrame, labels: DataFrame, quality_col: str = "quality", id_col: str = "doc_id",
        text_col: str = "text", train_rows: int = TRAIN_ROWS) -> dict:
    """Distant supervision: lines of documents labelled 1 count as content, of those labelled 0 as boilerplate. The field
    is trained on the documents and on sequences joined from lines of both classes, which teach it how labels change.
    About `train_rows` labelled documents (all, if there are no more) are drawn, by a hash of id and text; of rows equal
    in both, one. Without any, every line is content."""
    graded = labels.filter(F.col(id_col).isNotNull() & F.col(quality_col).isNotNull()).groupBy(
        F.col(id_col).alias("_id")).agg(F.max(F.col(quality_col).cast("int")).alias("_good"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    known = drawn(texts, graded, train_rows)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[f for f, _ in lines_of(t)] for t in utf8(batch["text"])]
        return pa.RecordBatch.from_pydict({"_id": batch["_id"], "good": batch["_good"],
                                           "lines": pa.array(found, pa.list_(pa.list_(pa.int32())))})

    kind = known.schema["_id"].dataType.simpleString()
    rows = map_batches(known, run, f"_id {kind}, good int, lines array<array<int>>").filter("size(lines) > 0").collect()
    ordered = sorted(rows, key=lambda r: (xxhash.xxh3_64_intdigest(str(r["_id"])), r["_id"], r["lines"]))
    whole = [(1 - r["good"], r["lines"]) for r in ordered]
    joined = mixed(whole)
    return train([row for k in range(max(len(whole), len(joined))) for row in (
        *([([label] * len(lines), lines) for label, lines in whole[k:k + 1]]), *joined[k:k + 1])])


def judge(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text",
          least: float = CONTENT_SHARE) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    content_share (of the words), n_content_lines. NULL and empty texts have zeros and fail."""
    weights, moves = model["weights"], model["moves"]
    few = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = few.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, share, content = [], [], []
        for text in utf8(batch["text"]):
            base.append(base_rules(text))
            lines = lines_of(text)
            labels = viterbi([sum(weights[k] for k in f) for f, _ in lines], moves)
            total = sum(n for _, n in lines)
            share.append(sum(n for (_, n), y in zip(lines, labels, strict=True) if not y) / total if total else 0.0)
            content.append(labels.count(0))
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        return pa.RecordBatch.from_pydict({
            "doc_id": batch["doc_id"], **{c: pa.array([b[k] for b in base], pa.int64()) for k, c in enumerate(names)},
            "base_failed": pa.array([b[5] for b in base], pa.bool_()),
            "kept": pa.array([not b[5] and s >= least for b, s in zip(base, share, strict=True)], pa.bool_()),
            "content_share": pa.array([round(s, 6) for s in share], pa.float64()),
            "n_content_lines": pa.array(content, pa.int64())})

    return map_batches(few, run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                 "n_repeat_words long, base_failed boolean, kept boolean, content_share double, "
                                 "n_content_lines long")
