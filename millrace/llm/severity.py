"""Operator 8, toxicity as severity: cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(threshold_k - w.x) with one weight vector shared by all thresholds, which are kept in order by
adding positive steps. The features are the words and word beginnings that set graded documents apart.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Memo, drawn, map_batches, staged, utf8

TRAIN_ROWS = 20_000  # labelled documents that the model is fitted on: all up to this number, else so many on average
FEATURES = 2_000  # words and word beginnings that are kept
LEAST_DOCUMENTS, LEAST_ODDS = 3, 2.0  # above grade 0, and the log odds that a feature needs
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
STEMS = (4, 5, 6, 7, 8)


def _keys(word: bytes) -> tuple[bytes, ...]:
    text = word.decode("utf-8", "ignore")
    return (word, *((text[:n] + "*").encode() for n in STEMS if len(text) > n))


def tokens(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.decode("utf-8", "replace").lower().encode()) if text else []


def vectors(names: list[bytes]):
    """Text to (feature numbers, values): log counts of the chosen features, and the number of words."""
    number = {name: k for k, name in enumerate(names)}
    known = Memo(lambda w: tuple(number[k] for k in _keys(w) if k in number))

    def make(text: bytes | None) -> tuple[list[int], list[float], int]:
        words = tokens(text)
        found: Counter = Counter()
        for word, times in Counter(words).items():
            for k in known[word]:
                found[k] += times
        return list(found), np.log1p(list(found.values())).tolist(), len(words)

    return make


def choose(rows: list[tuple[bytes, int, int]], n: list[int], limit: int) -> list[bytes]:
    """Features by their smoothed log odds of standing in a graded document; `rows`: (name, documents of grade 0,
    documents above), `n`: all documents of either kind."""
    scored = []
    for name, low, high in rows:
        odds = np.log((high + 0.3) / (n[1] + 0.6)) - np.log((low + 0.3) / (n[0] + 0.6))
        if high >= LEAST_DOCUMENTS and odds > LEAST_ODDS:
            scored.append((high * odds, bytes(name)))
    return [name for _, name in sorted(scored, reverse=True)[:limit]]


def fit_ordinal(rows: list[tuple[list[int], list[float], int]], size: int, grades: int, rounds: int = 400,
                ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and `grades - 1` ordered thresholds by full gradients with adaptive steps. rows: (at, values, grade)."""
    grade = np.array([r[2] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    at = np.array([k for r in rows for k in r[0]], np.int64)
    value = np.array([v for r in rows for v in r[1]], float)
    share = np.array([(grade <= k).mean() if len(rows) else 0.5 for k in range(grades - 1)]).clip(1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(first), 0.1))
    w, theta = np.zeros(size), np.concatenate((first[:1], gaps))
    speed = np.full(size + len(theta), 1e-8)
    for _ in range(rounds if len(rows) else 0):
        limits = np.cumsum(np.concatenate((theta[:1], np.exp(theta[1:]))))
        eta = np.bincount(owner, value * w[at], len(rows))
        ends = 1 / (1 + np.exp(-np.clip(limits[None, :] - eta[:, None], -30, 30)))
        full = np.hstack((np.zeros((len(rows), 1)), ends, np.ones((len(rows), 1))))
        slope = full * (1 - full)
        r = np.arange(len(rows))
        chance = np.maximum(full[r, grade + 1] - full[r, grade], 1e-9)
        d_eta = (slope[r, grade + 1] - slope[r, grade]) / chance / len(rows)
        d_limit = np.array([(np.where(grade == k, -slope[:, k + 1], 0) + np.where(grade == k + 1, slope[:, k + 1], 0))
                            @ (1 / chance) / len(rows) for k in range(grades - 1)])
        tail = np.cumsum(d_limit[::-1])[::-1]
        step = np.concatenate((np.bincount(at, value * d_eta[owner], size) + ridge * w,
                               tail[:1], tail[1:] * np.exp(theta[1:])))
        speed += step * step
        move = 0.3 * step / np.sqrt(speed)
        w -= move[:size]
        theta -= move[size:]
    return w, np.cumsum(np.concatenate((theta[:1], np.exp(theta[1:]))))


def fit(docs: DataFrame, labels: DataFrame, grade_col: str = "grade", id_col: str = "doc_id", text_col: str = "text",
        train_rows: int = TRAIN_ROWS, features: int = FEATURES, grades: int | None = None) -> dict:
    """Fit on about `train_rows` labelled documents (all, if there are no more), drawn by a hash of id and text. A grade is an
    integer from 0 on; of rows equal in id and text one counts.

    With grades 0 and 1 only, and `grades` of 3 or more, documents above 0 are spread over the upper grades by the share
    of telling words in them (equal parts of the training rows). Labels with NULLs are left out; of several labels of
    one document the highest counts.
    """
    graded = labels.filter(F.col(id_col).isNotNull() & F.col(grade_col).isNotNull()).groupBy(
        F.col(id_col).alias("_id")).agg(F.max(F.col(grade_col).cast("int")).alias("_grade"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    known = staged(drawn(texts, graded, train_rows).select("_grade", "text"), "severity-sample")  # read twice

    def count(batches):
        found: dict[int, Counter] = {}
        for batch in batches:
            for grade, text in zip(batch["_grade"].to_pylist(), utf8(batch["text"]), strict=True):
                own = found.setdefault(min(grade, 1), Counter())
                own.update({k for w in set(tokens(text)) for k in _keys(w)})
        for grade, own in found.items():
            yield pa.RecordBatch.from_pydict({"high": pa.array([grade] * len(own), pa.int32()),
                                              "name": pa.array(own.keys(), pa.binary()),
                                              "n": pa.array(own.values(), pa.int64())})

    sums = known.mapInArrow(count, "high int, name binary, n long").groupBy("name").agg(
        F.sum(F.when(F.col("high") == 0, F.col("n")).otherwise(0)).alias("low"),
        F.sum(F.when(F.col("high") > 0, F.col("n")).otherwise(0)).alias("top"))
    size = [known.filter("_grade = 0").count(), known.filter("_grade > 0").count()]
    odds = F.ln((F.col("top") + 0.3) / (size[1] + 0.6)) - F.ln((F.col("low") + 0.3) / (size[0] + 0.6))
    told = sums.filter((F.col("top") >= LEAST_DOCUMENTS) & (odds > LEAST_ODDS - 1e-6)).collect()  # of the drawn texts
    names = choose([(bytes(r[0]), r[1], r[2]) for r in told], size, features)
    make = vectors(names)

    def vector(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [make(t) for t in utf8(batch["text"])]
        return pa.RecordBatch.from_pydict({
            "grade": batch["_grade"], "at": pa.array([r[0] for r in rows], pa.list_(pa.int32())),
            "value": pa.array([r[1] for r in rows], pa.list_(pa.float64())),
            "n": pa.array([r[2] for r in rows], pa.int64())})

    rows = [(r[0], list(r[1]), list(r[2]), r[3])
            for r in map_batches(known, vector, "grade int, at array<int>, value array<double>, n long").collect()]
    rows.sort()
    top = max((r[0] for r in rows), default=1)
    if grades and grades > 2 and top == 1 and any(r[0] for r in rows):
        dense = sorted(sum(r[2]) / max(1, r[3]) for r in rows if r[0])
        steps = [dense[len(dense) * k // (grades - 1)] for k in range(1, grades - 1)]
        rows = [(g and 1 + sum(sum(v) / max(1, n) >= s for s in steps), a, v, n) for g, a, v, n in rows]
        top = grades - 1
    weights, limits = fit_ordinal([(a, v, g) for g, a, v, _ in rows], len(names), top + 1)
    return {"names": names, "weights": weights, "limits": limits}


def grade(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, severity (expected grade), grade (most likely), toxic (grade 0 is less likely than the
    others together), eta (linear score). NULL and empty texts have eta 0: what the thresholds alone say."""
    names, weights, limits = model["names"], model["weights"], model["limits"]
    make = vectors(names)
    few = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = few.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        eta = np.array([weights[a] @ np.asarray(v) if a else 0.0 for a, v, _ in map(make, utf8(batch["text"]))])
        above = 1 - 1 / (1 + np.exp(-np.clip(limits[None, :] - eta[:, None], -30, 30)))
        full = np.hstack((np.ones((len(eta), 1)), above, np.zeros((len(eta), 1))))
        return pa.RecordBatch.from_pydict({
            "doc_id": batch["doc_id"], "severity": pa.array(above.sum(1).round(6)),
            "grade": pa.array((full[:, :-1] - full[:, 1:]).argmax(1), pa.int32()),
            "toxic": pa.array(above[:, 0] >= 0.5), "eta": pa.array(eta.round(6))})

    return map_batches(few, run, f"doc_id {kind}, severity double, grade int, toxic boolean, eta double")
