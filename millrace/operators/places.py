"""Place aliases as a table of any size (F3): a substring join in place of one expression for all aliases.

An alias stands inside a text wherever one of its k-grams stands with the rest around it. Each alias is anchored at its
rarest k-gram among the given texts, so common letter groups bring few rows together; grams that anchor no alias are
dropped before anything is shuffled. What a gram brings along is the piece of text that an alias around it could cover.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import words
from millrace.session import explode_once, is_small

GRAM = 3
CHUNK = 512  # letters of a text that are looked at together, beside the overlap that an alias may need


def _grams(rows: DataFrame, keep: list[str], text: str, sizes: list[int]) -> DataFrame:
    """A row for every place of the text and every size: `gram`, and `at` from 1. A lookahead walks through the text once."""
    found = [F.transform(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)),
                         lambda gram, at: F.struct(gram.alias("gram"), (at + 1).alias("at"))) for n in sizes]
    every = F.concat(*found) if found else F.array().cast("array<struct<gram:string,at:int>>")
    return explode_once(rows, keep, every, "g").select(*keep, "g.gram", "g.at")


def ranked_aliases(location_aliases: DataFrame) -> DataFrame:
    """`(alias, canonical, rank)` from `(alias, canonical, ord)`: lower-cased, each of the first place that names it; places
    are ranked by their first `ord`. Rows without alias, place or ord are left out."""
    known = location_aliases.filter("alias <> '' AND canonical IS NOT NULL AND ord IS NOT NULL")
    ranks = known.groupBy("canonical").agg(F.min("ord").alias("rank"))
    named = known.select(F.lower("alias").alias("alias"), "canonical").join(ranks, "canonical")
    best = F.min(F.struct("rank", "canonical")).alias("b")
    return named.groupBy("alias").agg(best).select("alias", "b.canonical", "b.rank")


def places_by_join(df: DataFrame, id_cols: list[str], text_col: str, location_aliases: DataFrame) -> DataFrame:
    """`(id_cols, place)`: for each text the first place in table order with an alias inside, if any. `id_cols` identify a
    row. Equal texts are looked up once, so a text that a third of all rows have costs as much as any other.
    A text that speaks of a place abroad has none."""
    aliases = ranked_aliases(location_aliases)
    longest = aliases.agg(F.max(F.length("alias"))).first()[0] or 0
    low = df.select(*id_cols, F.lower(text_col).alias("_text"))
    texts = low.filter(~F.col("_text").rlike(words.bounded(words.FOREIGN_WORDS))).select("_text").distinct()
    starts = F.sequence(F.lit(1), F.length("_text") + 1, F.lit(CHUNK))  # positions in a long text are costly to find
    chunks = F.transform(starts, lambda at: F.substring(F.col("_text"), at, F.lit(CHUNK + longest - 1)))
    parts = explode_once(texts, ["_text"], chunks, "_part").select(F.md5("_text").alias("_id"), "_part")
    # Of an alias only the grams of its own size count: GRAM letters, or all of a shorter one.
    own = F.least(F.length("alias"), F.lit(GRAM))
    sizes = sorted(r[0] for r in aliases.select(own).distinct().collect())
    offered = _grams(aliases.withColumn("_size", own), ["alias", "canonical", "rank", "_size"], "alias", sizes).filter(
        F.length("gram") == F.col("_size"))
    used = offered.select("gram").distinct()
    if is_small(used):
        used = F.broadcast(used)
    counts = _grams(parts, ["_id"], "_part", sizes).join(used, "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min(F.struct("n", "gram", "at")).alias("a")  # an alias with a gram that no text has is in none
    anchored = offered.join(counts, "gram", "left").groupBy("alias", "canonical", "rank").agg(
        rarest, F.count("n").alias("met"), F.count(F.lit(1)).alias("grams")).filter("met = grams").select(
        "alias", "canonical", "rank", "a.gram", F.col("a.at").alias("offset"))
    anchors = anchored.select("gram").distinct()
    if is_small(anchors):
        anchored, anchors = F.broadcast(anchored), F.broadcast(anchors)
    met = _grams(parts, ["_id", "_part"], "_part", sizes).join(anchors, "gram", "left_semi")
    # the piece of text around a gram, from where an alias around it may begin
    begin = F.greatest(F.col("at") - longest + 1, F.lit(1))
    pieces = met.select("_id", "gram", (F.col("at") - begin).alias("_before"),
                        F.substring(F.col("_part"), begin, F.lit(2 * longest)).alias("_piece"))
    start = F.col("_before") - F.col("offset") + 2
    found = pieces.join(anchored, "gram").filter(
        (start >= 1) & (F.substring(F.col("_piece"), start, F.length("alias")) == F.col("alias")))
    best = found.groupBy("_id").agg(F.min(F.struct("rank", "canonical")).alias("b"))
    return low.withColumn("_id", F.md5("_text")).join(best, "_id").select(*id_cols, F.col("b.canonical").alias("place"))
