"""Text helpers as column expressions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.patterns import prefix_pattern

_SEPARATOR = "\u0001"
# Elements whose content is not page text, in the order comment, element with content, any other tag.
_HIDDEN = "script|style|template|rt|rp"
_TAG = r"[/!?a-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
# All that Unicode counts as white space, which is what `(?U)\s` matches.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Tried before the full table, as nearly all references are one of these.
_COMMON = {"nbsp": "\u00a0", "quot": '"', "gt": ">", "lt": "<", "amp": "&"}


# References to these numbers mean the characters of Windows-1252.
_WINDOWS = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
# Names that stand without a semicolon too; the pattern finds the longest one at the start.
_CLOSED_NAME = "^[A-Za-z][A-Za-z0-9]{1,31};"
_OPEN_NAME = "^" + prefix_pattern(sorted(name for name in html5 if not name.endswith(";")))


def _map(entries: dict) -> Column:
    """A constant map; its characters travel as hexadecimal UTF-8, so that none needs escaping."""
    pairs = (f"{k!r}, decode(X'{v.encode().hex()}', 'UTF-8')" for k, v in entries.items())
    return F.expr(f"map({', '.join(pairs)})")


def _named(name: Column) -> Column:
    """The characters of a name. Maps are searched from the front, so the table is split by the first letters."""
    by_head: dict[str, dict[str, str]] = {}
    for key, value in html5.items():
        by_head.setdefault(key[:2], {})[key] = value
    constant = F.from_json(F.lit(json.dumps(by_head)), "map<string,map<string,string>>")
    return F.try_element_at(F.try_element_at(constant, F.substring(name, 1, 2)), name)


def _numbered(code: Column) -> Column:
    """The character of a number as browsers read it: Windows-1252 for 128 to 159, the replacement character for 0,
    surrogates and what lies beyond the code space."""
    odd = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    return F.when(odd, F.lit("\ufffd")).otherwise(F.coalesce(
        F.try_element_at(_map(_WINDOWS), code.cast("int")), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))


def unescape(text: Column) -> Column:
    """Decode character references: all names of the HTML standard, and the older ones without a semicolon too. Text
    without `&` is passed through."""
    def numeric(piece: Column) -> Column:
        whole = F.regexp_extract(piece, "^#(?:[0-9]{1,15}|[xX][0-9a-fA-F]{1,12});?", 0)
        digits = F.rtrim(F.substr(whole, F.lit(2)), F.lit(";"))
        code = F.when(digits.rlike("^[xX]"), F.conv(F.substr(digits, F.lit(2)), 16, 10)).otherwise(digits).try_cast("bigint")
        return F.concat(_numbered(code), F.substr(piece, F.length(whole) + 1))

    def by_name(piece: Column, pattern: str) -> Column:
        name = F.nullif(F.regexp_extract(piece, pattern, 0), F.lit(""))
        return F.concat(_named(name), F.substr(piece, F.length(name) + 1))

    def decode(piece: Column) -> Column:
        decoded = F.when(piece.startswith("#"), numeric(piece)).otherwise(
            F.coalesce(by_name(piece, _CLOSED_NAME), by_name(piece, _OPEN_NAME)))
        for name, common in _COMMON.items():
            decoded = F.when(
                piece.startswith(name + ";"), F.concat(F.lit(common), F.substr(piece, F.lit(len(name) + 2)))
            ).otherwise(decoded)
        return F.coalesce(decoded, F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&")
    tail = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), decode)
    return F.when(~text.contains("&"), text).otherwise(F.concat(F.element_at(pieces, 1), F.array_join(tail, "")))


def clean_html(html: Column, drop_script_style: bool = True) -> Column:
    """F8: the text pieces between tags, trimmed, joined by one space; NULL gives ''.

    Comments, declarations and (unless told otherwise) script, style, template and ruby-annotation content
    are not text.
    """
    markup = r"(?is)<(?:!--.*?-->|"
    if drop_script_style:
        markup += rf"({_HIDDEN})\b[^>]*>.*?</\1\s*>|"
    marked = F.regexp_replace(html, markup + _TAG + ")", _SEPARATOR)
    pieces = F.transform(F.split(marked, _SEPARATOR), lambda piece: F.trim(unescape(piece), F.lit(WHITE_SPACE)))
    return F.coalesce(F.array_join(F.filter(pieces, lambda piece: piece != ""), " "), F.lit(""))


def truncate(text: Column, max_chars: int = 300) -> Column:
    """cut, go back to the last space, add an ellipsis; NULL gives ''."""
    cut = F.regexp_replace(F.substring(text, 1, max_chars), r" [^ ]*\z", "")
    return F.coalesce(F.when(F.length(text) <= max_chars, text).otherwise(F.concat(cut, F.lit("…"))), F.lit(""))


def normalise_whitespace(text: Column) -> Column:
    """F10."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def time_ago(posted_at: Column, as_of: Column) -> Column:
    """age against an explicit moment."""
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(posted_at.cast("timestamp"))
    hours = F.floor(micros / 3_600_000_000)
    days = F.floor(hours / 24)
    return (
        F.when(hours.isNull(), "")
        .when(hours < 1, "just now")
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .when(days < 7, F.concat(days.cast("string"), F.lit("d ago")))
        .otherwise(F.concat(F.floor(days / 7).cast("string"), F.lit("w ago")))
    )


def pair_label(a: Column, b: Column) -> Column:
    """F15."""
    return F.concat_ws(" + ", a, b)


def initial(name: Column) -> Column:
    """F18."""
    return F.upper(F.substring(name, 1, 1))


def last_updated_label(moment: Column) -> Column:
    """F19."""
    return F.date_format(moment, "MMM dd, yyyy hh:mm a")


def week_label(day: Column) -> Column:
    """Monday/Sunday of the week of `day`."""
    monday = F.date_trunc("week", day).cast("date")
    return F.concat(monday.cast("string"), F.lit("/"), F.date_add(monday, 6).cast("string"))
