"""One lookahead pattern for many fixed terms.

`(?=(...))` consumes no text, so terms that start at different places are all found, also where they overlap.
Where several terms match at one place the longest is captured; the shorter ones there are prefixes of it, so
which of them match is known beforehand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(text: str) -> str:
    return "".join(ch if ch.isalnum() or ch in " _" else "\\" + ch for ch in text)


def prefix_pattern(terms: list[str], end: Callable[[str], str] = lambda term: "", done: int = 0) -> str:
    """A pattern for terms that share their first `done` characters; longer terms are tried first. `end` gives
    what has to hold after a term."""
    by_char: dict[str, list[str]] = {}
    finished: str | None = None
    for term in terms:
        if len(term) == done:
            finished = end(term)
        else:
            by_char.setdefault(term[done], []).append(term)
    options = []
    for group in by_char.values():
        shared = done + 1
        while all(len(t) > shared and t[shared] == group[0][shared] for t in group):
            shared += 1
        options.append(quoted(group[0][done:shared]) + prefix_pattern(group, end, shared))
    if finished is not None:
        options.append(finished)
    return options[0] if len(options) == 1 else "(?:" + "|".join(options) + ")"


def first_of(terms: list[str]) -> str:
    """A cheap test that goes before terms: whether one of their first characters comes next."""
    return "(?=[" + "".join(map(quoted, sorted({term[0] for term in terms}))) + "])" if terms else ""


def word_start(terms: list[str]) -> str:
    """The word boundary before terms. Where all begin with a plain word character, none that comes before is a cheaper
    test that goes first, as there is no boundary between two of them."""
    plain = terms and all(term[0].isascii() and (term[0].isalnum() or term[0] == "_") for term in terms)
    return r"(?<![a-z0-9_])\b" if plain else r"\b"


def captured(text: Column, start: str, terms: list[str], end: Callable[[str], str] = lambda term: "") -> Column:
    """The longest term at every place of `text` where one matches."""
    return F.regexp_extract_all(
        text, F.lit(f"(?U){first_of(terms)}{start}(?=({prefix_pattern(sorted(terms), end)}))"), F.lit(1))


def sql_string(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
