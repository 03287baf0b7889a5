"""Operator 4, language identification by mixture inference.

Hashed letter n-gram counts per language are summed over all training texts. For a document, expectation-maximisation
estimates the proportions of languages that explain its n-grams; languages join its set one by one, as long as the
likelihood gains more than the penalty of one further proportion. The largest proportion names the document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_batches, strings

BUCKETS = 16_384
SMOOTHING = 0.5
UNKNOWN = "und"


def ngrams(text: str) -> np.ndarray:
    """Bucket numbers of the text's letter 1-, 2- and 3-grams, words padded by one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    if not len(points):
        return np.empty(0, np.int64)
    low, back = np.unique(points, return_inverse=True) if len(points) > 2_000 else (points, None)
    letter = np.fromiter((chr(p).isalpha() for p in low.tolist()), bool, len(low))
    letter = letter if back is None else letter[back]
    c = np.concatenate(([32], np.where(letter, points, 32), [32])).astype(np.uint64)
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
    if len(c) < 3:
        return np.empty(0, np.int64)
    one = c[1:-1] * np.uint64(0x9E3779B97F4A7C15)
    two = (c[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[1:] * np.uint64(0x165667B19E3779F9))
    three = two[:-1] * np.uint64(0x9FB21C651E98DF25) + c[2:] * np.uint64(0xD6E8FEB86659FD93)
    h = np.concatenate((one[c[1:-1] != 32], two + np.uint64(1), three + np.uint64(2)))
    h ^= h >> np.uint64(31)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(50)).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    """Fixed split: crc32 of the id as text has remainder 2 by 4. A NULL id is neither held out nor trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages and the log of their n-gram rates, from all rows given. The counts are summed by language and bucket
    before they reach the driver: their number depends on the languages, not on the rows."""
    few = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if len(grams := ngrams(text)):
                    total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    total[lang] += np.bincount(grams, minlength=BUCKETS)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at)), "bucket": pa.array(at, pa.int32()),
                                              "n": pa.array(counts[at], pa.int64())})

    rows = few.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = rows.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("found")).orderBy("lang").collect()
    langs = [r["lang"] for r in table]
    counts = np.full((len(langs), BUCKETS), SMOOTHING)
    for k, r in enumerate(table):
        counts[k, [x["bucket"] for x in r["found"]]] += [x["n"] for x in r["found"]]
    return langs, np.log(counts / counts.sum(1, keepdims=True)) if langs else counts


def _mixture(rates: np.ndarray, weight: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, float]:
    """EM for the proportions of the rows of `rates`; the proportions and the log likelihood."""
    share = np.full(len(rates), 1 / len(rates))
    for _ in range(rounds if len(rates) > 1 else 0):
        part = share[:, None] * rates
        share = (part / part.sum(0)) @ weight / weight.sum()
    return share, float(np.log(share @ rates) @ weight)


def infer(grams: np.ndarray, log_rates: np.ndarray, penalty: float = 3.0) -> dict[int, float]:
    """Language numbers and proportions of one text. Each further language must gain `penalty` times half the log of the
    number of n-grams, over the correlation of overlapping n-grams (three for each letter)."""
    at, weight = np.unique(grams, return_counts=True)
    rates = np.exp(log_rates[:, at])
    weight = weight / 3.0
    single = np.log(rates) @ weight
    chosen = [int(np.argmax(single))]
    share, value = _mixture(rates[chosen], weight)
    while len(chosen) < len(rates):
        slope = (rates / (share @ rates[chosen])) @ weight
        slope[chosen] = -np.inf
        extra = int(np.argmax(slope))
        if slope[extra] <= weight.sum():  # the likelihood falls with any share of it
            break
        more, better = _mixture(rates[[*chosen, extra]], weight)
        if better - value <= penalty * 0.5 * np.log(weight.sum() + 1):
            break
        chosen, share, value = [*chosen, extra], more, better
    return dict(zip(chosen, share.tolist(), strict=True))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score (its proportion), languages (map of all found proportions).

    A text that is NULL or has no letter, or a model without languages, gives `und`, score 0 and an empty map. Of equal
    proportions the language found first wins; of equal likelihoods, the first by name.
    """
    langs, log_rates = model[0], model[1].astype(np.float32)
    few = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                      F.col(text_col).cast("string").alias("text"))
    kind = few.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for text in strings(batch["text"]):
            grams = ngrams(text)
            found.append(infer(grams, log_rates) if len(grams) and langs else {})
        best = [max(f, key=f.get) if f else None for f in found]
        return pa.RecordBatch.from_pydict({
            "doc_id": batch["doc_id"], "held_out": batch["held_out"],
            "lang_pred": pa.array([UNKNOWN if b is None else langs[b] for b in best], pa.string()),
            "score": pa.array([0.0 if b is None else round(min(1.0, f[b]), 6) for b, f in zip(best, found, strict=True)],
                              pa.float64()),
            "languages": pa.array([[(langs[k], round(v, 6)) for k, v in f.items()] for f in found],
                                  pa.map_(pa.string(), pa.float64()))})

    return map_batches(few, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, "
                                 "languages map<string,double>")
