"""Operator 12, chat formatting: conversations rebuilt from their event logs, then rendered with a loss mask.

A log holds events `(conv_id, seq, message, kind, role, text)`. In the order of `seq`:
  message     writes message number `message` anew, with role and text
  delta       adds text to the message (a streamed answer)
  edit        puts the text in place of the message's
  regenerate  empties the message and takes back all later ones; what follows is the new attempt
Built-in expressions only. The fold has two levels: first each run of `block` sequence numbers by itself, then the few
results of the runs. The log of one very long conversation is thus dealt to many tasks; only its final text, which is one
row of the result, meets in one.

Events without seq or message number, or of another kind, are not applied. Redelivered events (equal in all columns) count
once; other events of equal seq are applied in the order of the list above, then by role and text. NULL text is empty, a
NULL role too; a NULL conv_id is a conversation of its own. An empty log gives no conversations. Other columns of the log
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ["message", "delta", "edit", "regenerate"]
BLOCK = 4_096
PIECE = 512
HEAD, FOOT = "<turn ", "\n</turn>\n"
ANSWERS = "assistant"


def escape(text: Column) -> Column:
    """Text without `<` and `>`, so no mark can stand in it. A backslash is always followed by one of three letters."""
    for char, code in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for char, code in ((">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def _joined(parts: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(parts), lambda x: x["text"]), "")


def fold(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """`(conv_id, message, role, text)`: the messages that stand at the end of the log."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    events = log.select(
        "conv_id", F.col("seq").cast("long").alias("seq"), F.col("message").cast("long").alias("message"),
        rank.alias("rank"), F.col("role"),
        F.when(F.col("kind") == "regenerate", "").otherwise(F.coalesce("text", F.lit(""))).alias("text"),
    ).filter("seq IS NOT NULL AND message IS NOT NULL AND rank > 0")
    events = events.withColumn("block", F.floor(F.col("seq") / F.lit(block)))
    order = ["seq", "rank", "role", "text"]
    newest = [F.desc(c) for c in order]
    later = Window.partitionBy("conv_id", "block").orderBy(*newest, F.desc("message"))
    own = Window.partitionBy("conv_id", "block", "message").orderBy(*newest)
    above = (Window.unboundedPreceding, -1)
    reset, cut = F.col("rank") != 2, F.when(F.col("rank") == 4, F.col("message"))
    seen = events.select(
        "*", reset.alias("reset"), cut.alias("cut"),
        F.min(cut).over(later.rowsBetween(*above)).alias("low"),
        F.coalesce(F.max(reset).over(own.rowsBetween(*above)), F.lit(False)).alias("void"),
        F.coalesce(F.struct(*order) == F.lag(F.struct(*order)).over(own), F.lit(False)).alias("again"),
    )
    runs = _standing(seen).filter(~F.col("again")).groupBy("conv_id", "block", "message").agg(
        F.max_by("role", F.when(F.col("role").isNotNull(), F.struct(*order))).alias("role"),
        _joined(F.collect_list(F.when(~F.col("void"), F.struct(*order)))).alias("text"),
        F.max("reset").alias("reset"), F.min("cut").alias("cut"),
    ).withColumn("back", -F.col("block"))
    later = Window.partitionBy("conv_id").orderBy("back").rangeBetween(*above)
    own = Window.partitionBy("conv_id", "message").orderBy("back").rowsBetween(*above)
    seen = runs.select("*", F.min("cut").over(later).alias("low"),
                       F.coalesce(F.max("reset").over(own), F.lit(False)).alias("void"))
    return _standing(seen).groupBy("conv_id", "message").agg(
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("block"))).alias("role"),
        _joined(F.collect_list(F.when(~F.col("void"), F.struct("block", "text")))).alias("text"),
    )


def _standing(seen: DataFrame) -> DataFrame:
    """What no later regeneration of an earlier message takes back."""
    return seen.filter("low IS NULL OR message <= low")


def render(messages: DataFrame) -> DataFrame:
    """`(conv_id, formatted, segments)`: the text of a conversation, and the same text in pieces with the loss mask:
    `loss` holds for what an assistant said, without the marks around it."""

    def of(turn: Column) -> Column:
        role, text = escape(F.coalesce(turn["role"], F.lit(""))), escape(turn["text"])
        mark = F.lit(False).alias("loss")
        return F.array(
            F.struct(F.concat(F.lit(HEAD), role, F.lit(">\n")).alias("text"), mark),
            F.struct(text.alias("text"), F.coalesce(turn["role"] == ANSWERS, F.lit(False)).alias("loss")),
            F.struct(F.lit(FOOT).alias("text"), mark))

    turns = F.array_sort(F.collect_list(F.struct("message", "role", "text")))
    cut = messages.groupBy("conv_id").agg(turns.alias("turns")).select(
        "conv_id", F.flatten(F.transform("turns", of)).alias("segments"))
    return cut.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def format_log(log: DataFrame, block: int = BLOCK) -> DataFrame:
    return render(fold(log, block))


def read_turns(formatted: Column) -> Column:
    """The `(role, text)` of each turn, read from a formatted conversation."""
    turns = F.split(formatted, FOOT)  # the marks hold `<`, so none stands in a text; the last piece is empty
    pattern = rf"(?s)\A{HEAD}([^>]*)>\n(.*)\z"
    return F.transform(
        F.slice(turns, F.lit(1), F.size(turns) - 1),
        lambda t: F.struct(unescape(F.regexp_extract(t, pattern, 1)).alias("role"),
                           unescape(F.regexp_extract(t, pattern, 2)).alias("text")))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, as it was said."""
    said = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(said, lambda s: unescape(s["text"])), "")


def log_of(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """The log that leads to the given turns `(conv_id, turn, role, text)`, one message per row in the order of turn (NULL
    first), role and text: an assistant's answer is streamed in pieces after a first attempt, its beginning, that was
    regenerated; other messages are first sent with the first half of their first piece, then edited."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    text = F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", F.row_number().over(order).cast("long").alias("message"), "role", text.alias("text"))
    begin = F.left(F.col("text"), F.lit(piece // 2))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))
    streamed = F.concat(
        F.array(event("message", F.lit("")), event("delta", begin), event("regenerate", F.lit(""))),
        F.transform(pieces, lambda p: event("delta", p)))
    edited = F.array(event("message", begin), event("edit", F.col("text")))
    events = F.when(F.col("role") == ANSWERS, streamed).otherwise(edited)
    each = rows.select("conv_id", "message", "role", F.posexplode(events).alias("at", "event"))
    return each.select(
        "conv_id", (F.col("message") * F.lit(1 << 32) + F.col("at")).alias("seq"), "message", "event.kind",
        F.when(F.col("event.kind") == "message", F.col("role")).alias("role"), "event.text")
