"""Operator 1, quality classifier: a weak-label model and a hashed linear scorer.

Overlapping heuristic labellers vote good, bad or nothing on each text. Expectation-maximisation over the counts of all
vote patterns of the whole corpus (at most 3 to the number of labellers) estimates the accuracy of each labeller and the
posterior of each pattern. The posteriors are the labels of a linear scorer over hashed word shapes, which judges.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Memo, count_of, map_batches, sheltered, utf8

TRAIN_ROWS = 4_000  # expected rows of the training sample in each class; only the scorer is fitted on a sample
BUCKETS = 4_096
BETTER = 8.0
GOOD, BAD, NONE = "g", "b", "-"
CAPITALS = bytes(range(65, 91))
marks, capitals = count_of(b"#*$%&|<>"), count_of(CAPITALS)
letter_count = count_of(CAPITALS + CAPITALS.lower() + b"\xc3")  # the byte that Latin letters with accents begin with
SHAPE = bytes.maketrans(
    bytes(range(256)),
    bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else b for b in range(256)),
)
RUN = re.compile(rb"(.)\1+")
LABELLERS = ["symbols", "capitals", "stutter", "lines", "columns", "shouting", "endings", "short words", "variety"]


def _vote(value: float, good: float, bad: float) -> str:
    """Good up to `good`, bad from `bad` on, no vote between."""
    return GOOD if value <= good else BAD if value >= bad else NONE


def votes(text: bytes) -> str:
    """One character for each of LABELLERS; texts of fewer than five words get no vote."""
    words = text.split()
    n = len(words)
    if n < 5:
        return NONE * len(LABELLERS)
    letters = letter_count(text)
    lines = [line for line in text.split(b"\n") if line.strip()]
    long = n >= 20
    return "".join((
        _vote(marks(text) / len(text), 0.01, 0.06),
        _vote(capitals(text) / letters, 0.12, 0.4) if letters >= 20 else NONE,
        _vote(sum(map(bytes.__eq__, words, words[1:])) / n, 0.04, 0.15),
        _vote(1 - len(set(lines)) / len(lines), 0.1, 0.4) if len(lines) >= 4 else NONE,
        _vote(words.count(b"|") / n, 0.01, 0.15),
        _vote(text.count(b"!!") / n, 0.01, 0.15),
        _vote(1 - sum(line.rstrip()[-1:] in b".?!:" for line in lines) / len(lines), 0.3, 0.9),
        _vote(0.3 - sum(len(w) <= 4 and w.isalpha() for w in words) / n, 0.1, 0.27) if long else NONE,
        _vote(1 - len(set(words)) / min(n, 400), 0.55, 0.8) if long else NONE,
    ))


def fit_labellers(counts: dict[str, int], rounds: int = 60) -> dict[str, float]:
    """EM over vote patterns; the posterior of *good* for each pattern.

    Labellers are taken to be better than chance: each vote is at least BETTER times as frequent in its own class. This
    keeps the classes from turning into two kinds of bad text, as each labeller knows one kind only.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}
    weight = np.array([counts[p] for p in patterns], float)
    seen = np.array([[[c == k for k in (GOOD, BAD, NONE)] for c in p] for p in patterns], float)
    good = 1 / (1 + np.exp(3.0 * seen[:, :, 1].sum(1) - 3.5))
    for _ in range(rounds):
        prior = (weight @ good + 1) / (weight.sum() + 2)
        rates = []
        for share in (good, 1 - good):
            hits = np.einsum("p,plk->lk", weight * share, seen) + 0.5
            rates.append(hits / hits.sum(1, keepdims=True))
        own, other = rates
        other[:, 1] = np.maximum(other[:, 1], own[:, 1] * BETTER)
        other[:, 0] = np.minimum(other[:, 0], own[:, 0])
        rates = np.log(own), np.log(other)
        # silence says nothing about the class: only the votes that were given count
        gap = (seen[:, :, :2] * (rates[0] - rates[1])[:, :2]).sum((1, 2)) + np.log(prior / (1 - prior))
        good = 1 / (1 + np.exp(-np.clip(gap, -30, 30)))
    return dict(zip(patterns, good.tolist(), strict=True))


def _shape(word: bytes) -> bytes:
    return RUN.sub(rb"\1\1", word.translate(SHAPE))


def featurizer():
    """Text to hashed features: word shapes, pairs of shapes, and repetition, as log counts of unit length."""
    shapes = Memo(_shape)
    bucket = Memo(lambda key: xxhash.xxh3_64_intdigest(key) % BUCKETS)

    def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        row = [shapes[w] for w in words]
        found = Counter(row)
        found.update(a + b" " + b for a, b in zip(row, row[1:]))
        found[b"same"] = sum(map(bytes.__eq__, words, words[1:])) * 4
        found[b"few"] = max(0, min(len(words), 400) // 2 - len(set(words))) * 4
        lines = [line for line in text.split(b"\n") if line.strip()]
        found[b"line"] = (len(lines) - len(set(lines))) * 4
        total = max(1, len(words))
        at = np.fromiter(map(bucket.__getitem__, found), np.int32, len(found))
        value = np.log1p(np.fromiter(found.values(), float, len(found)) * (50 / total))
        return at, value / (np.sqrt(value @ value) or 1.0)

    return features


def fit_scorer(rows: list[tuple], rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weighted logistic regression on soft labels `(label, weight, buckets, values)`, by gradient steps."""
    weights, bias = np.zeros(BUCKETS), 0.0
    if not rows:
        return weights, bias
    label, share = (np.array([r[i] for r in rows], float) for i in (0, 1))
    share /= share.sum()
    owner = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    at = np.concatenate([np.asarray(r[2], np.int64) for r in rows])
    value = np.concatenate([np.asarray(r[3], float) for r in rows])
    prior = np.clip(share @ label, 1e-4, 1 - 1e-4)
    bias = float(np.log(prior / (1 - prior)))
    slope, slope_bias = np.full(BUCKETS, 1e-6), 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(owner, value * weights[at], len(rows)) + bias)))
        miss = share * (p - label)
        step = np.bincount(at, value * miss[owner], BUCKETS) + 1e-7 * weights
        slope += step * step
        slope_bias += miss.sum() ** 2
        weights -= 0.5 * step / np.sqrt(slope)
        bias -= 0.1 * miss.sum() / np.sqrt(slope_bias)
    return weights, bias


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> dict:
    """The model of a corpus: posteriors by vote pattern (all rows) and the scorer's weights (a sample by a hash of id
    and text, one row of those equal in both)."""
    name, words = F.col(id_col).cast("string"), F.col(text_col).cast("string")
    few = docs.select(F.xxhash64(name.isNull(), name, words).alias("pair"), words.alias("text")).withColumn(
        "draw", F.pmod("pair", F.lit(1_000_003)))

    def patterns(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Counter(votes(t) for t in utf8(batch["text"]) if t and t.strip())
        return pa.RecordBatch.from_pydict({"pattern": pa.array(found.keys(), pa.string()),
                                           "n": pa.array(found.values(), pa.int64())})

    counted = map_batches(few.select("text"), patterns, "pattern string, n long").groupBy("pattern").agg(F.sum("n"))
    counts = {r[0]: r[1] for r in counted.collect()}
    posterior = fit_labellers(counts)
    size = [sum(n for p, n in counts.items() if (posterior[p] < 0.5) == bad) for bad in (False, True)]
    rate = [min(1.0, train_rows / n) if n else 1.0 for n in size]
    make = featurizer()

    def sample(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for pair, draw, text in zip(batch["pair"].to_pylist(), batch["draw"].to_pylist(), utf8(batch["text"]), strict=True):
            if not text or not text.strip() or draw >= 1_000_003 * max(rate):
                continue
            good = posterior[votes(text)]
            if draw < 1_000_003 * (own := rate[good < 0.5]):
                at, value = make(text)
                at, place = np.unique(at, return_inverse=True)  # at most BUCKETS, however long the text
                rows.append((good, 1 / own, at, np.bincount(place, value), pair))
        return pa.RecordBatch.from_pydict({
            "label": pa.array([r[0] for r in rows], pa.float64()), "weight": pa.array([r[1] for r in rows], pa.float64()),
            "at": pa.array([r[2] for r in rows], pa.list_(pa.int32())),
            "value": pa.array([r[3].astype(np.float32) for r in rows], pa.list_(pa.float32())),
            "pair": pa.array([r[4] for r in rows], pa.int64())})

    drawn = map_batches(few, sample, "label double, weight double, at array<int>, value array<float>, pair long"
                        ).dropDuplicates(["pair"]).drop("pair")
    rows = sorted((tuple(r) for r in drawn.collect()), key=lambda r: (r[0], r[1], r[2]))
    weights, bias = fit_scorer(rows)
    return {"posterior": posterior, "weights": weights, "bias": bias}


def judge(model: dict):
    """Text to (weak posterior, score). Texts without a word get 0 and 0."""
    make, weights, bias, posterior = featurizer(), model["weights"], model["bias"], model["posterior"]

    def score(text: bytes | None) -> tuple[float, float]:
        if not text or not text.strip():
            return 0.0, 0.0
        at, value = make(text)
        return posterior.get(votes(text), 0.5), float(1 / (1 + np.exp(-np.clip(weights[at] @ value + bias, -30, 30))))

    return score


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: dict | None = None) -> DataFrame:
    """One row per document: id, p_weak (posterior of the labellers), score (linear scorer), kept (score >= 0.5).

    Empty and NULL texts get score 0 and are not kept; a NULL id is carried along. An empty table gives no rows.
    """
    score = judge(model or fit(docs, id_col, text_col))
    few = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [score(t) for t in utf8(batch["text"])]
        return pa.RecordBatch.from_pydict({
            "doc_id": batch["doc_id"], "p_weak": pa.array([round(a, 6) for a, _ in found], pa.float64()),
            "score": pa.array([round(b, 6) for _, b in found], pa.float64()),
            "kept": pa.array([b >= 0.5 for _, b in found], pa.bool_())})

    kind = few.schema["doc_id"].dataType.simpleString()
    return map_batches(few, run, f"doc_id {kind}, p_weak double, score double, kept boolean")


def keep_good(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents that the classifier keeps, all columns as they are. NULL and empty texts and texts without a word score
    0 and go."""
    docs, place, back = sheltered(docs)
    text_col, id_col = place(text_col), place(id_col)
    score = judge(fit(docs, id_col, text_col))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([score(t)[1] >= 0.5 for t in utf8(batch[text_col])], pa.bool_()))

    return map_batches(docs, run, docs.schema).select(*back)
