"""Operator 2, token counts: Viterbi that only counts.

An Aho-Corasick automaton enumerates the vocabulary pieces inside a text; dynamic programming over end positions carries
the best score and its number of pieces, never the pieces. Ties go as in unigram tokenizers: starts are tried from left
to right and only a strictly better score replaces, so of equal scores the longest last piece stays.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Memo, map_batches, strings

SPACE = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value of unigram tokenizers: an unknown character scores so much below the worst piece


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces and scores of a model file with byte fallback. Read once, where the job is defined."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    if not any(model.is_byte(i) for i in ids):
        raise ValueError("a vocabulary with byte pieces is needed: unknown characters count as bytes")
    return [(model.id_to_piece(i), model.get_score(i)) for i in ids
            if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]


def counter(pieces: list[tuple[str, float]]):
    """Text to (pieces, score). Spaces become the mark, one more leads; unknown characters count as their bytes.

    The text is cut where no piece can reach across: before a mark, if pieces have marks at their start only, and around
    line ends, if no piece has them. The best path of the whole is then the sum over the parts, which are memoised.
    """
    automaton = ahocorasick.Automaton()
    for piece, score in pieces:
        automaton.add_word(piece, (len(piece), score))
    automaton.make_automaton()
    unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
    inner = any(SPACE in p.lstrip(SPACE) for p, _ in pieces)
    lines = any("\n" in p for p, _ in pieces)
    parts = re.compile("(?s:.+)" if inner or lines else f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")

    def best(part: str) -> tuple[int, float]:
        size = len(part)
        total, count = [0.0] * (size + 1), [0] * (size + 1)
        reached = [False] * (size + 1)
        reached[0] = True
        matches = automaton.iter(part)
        upcoming = next(matches, None)
        for end in range(1, size + 1):
            score, number, found, single = 0.0, 0, False, False
            while upcoming is not None and upcoming[0] == end - 1:  # longest first
                length, own = upcoming[1]
                single |= length == 1
                if reached[end - length] and (not found or total[end - length] + own > score):
                    score, number, found = total[end - length] + own, count[end - length] + 1, True
                upcoming = next(matches, None)
            if not single and (not found or total[end - 1] + unknown > score):
                score, number = total[end - 1] + unknown, count[end - 1] + len(part[end - 1].encode("utf-8", "replace"))
            total[end], count[end], reached[end] = score, number, True
        return count[size], total[size]

    memo = Memo(best)

    def whole(text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        pieces_, score = 0, 0.0
        for part in parts.findall(SPACE + text.replace(" ", SPACE)):
            n, s = memo[part]
            pieces_ += n
            score += s
        return pieces_, score

    return whole


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document: id, n_chars (code points), n_tokens, score of the best path.

    NULL and empty texts have no tokens and score 0; whole texts of any length are counted.
    """
    few = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = few.schema["doc_id"].dataType.simpleString()
    made: list = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:  # once per task: an automaton cannot be shipped
            made.append(counter(pieces))
        texts = strings(batch["text"])
        found = [made[0](t) for t in texts]
        return pa.RecordBatch.from_pydict({
            "doc_id": batch["doc_id"], "n_chars": pa.array(map(len, texts), pa.int64()),
            "n_tokens": pa.array([n for n, _ in found], pa.int64()), "score": pa.array([s for _, s in found], pa.float64())})

    return map_batches(few, run, f"doc_id {kind}, n_chars long, n_tokens long, score double")
