"""Co-listen similarity: pairs of items that the same users turn to, by cosine (§2.13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import is_small, shared_dir

SALTS = 8


def weights(events: DataFrame, item: str, user: str) -> DataFrame:
    """`(item, user, w)`: how often a user turned to an item. Events without item or user are left out."""
    return events.groupBy(F.col(item).alias("item"), F.col(user).alias("user")).agg(
        F.count(F.lit(1)).cast("double").alias("w")).filter("item IS NOT NULL AND user IS NOT NULL")


def prefixes(rows: DataFrame) -> DataFrame:
    """Adds `rest`, the squared length of what an item's vector has from users as common as this one on, users in the order
    from rare to common, and `norm`, the squared length of the whole. Squares are summed up by item and commonness first:
    the running sums go over these few rows, and an item that a third of all users turn to stays in many tasks."""
    common = rows.groupBy("user").agg(F.count(F.lit(1)).alias("items"))
    ordered = rows.join(common, "user")
    steps = ordered.groupBy("item", "items").agg(F.sum(F.col("w") * F.col("w")).alias("squares"))
    rest = Window.partitionBy("item").orderBy("items").rowsBetween(0, Window.unboundedFollowing)
    sums = steps.withColumns({
        "rest": F.sum("squares").over(rest), "norm": F.sum("squares").over(Window.partitionBy("item"))})
    return ordered.join(sums.drop("squares"), ["item", "items"])


def similar_items(events: DataFrame, item: str, user: str, threshold: float) -> DataFrame:
    """`(item_a, item_b, users, similarity)` with item_a < item_b: every pair whose cosine is at least `threshold`, exactly.

    Two such items share a user in the first part of both vectors, up to where the rest is shorter than `threshold` of the
    whole: if the first user they share came later, the rest would bound their cosine below it. Only these users bring
    pairs together; as rare users come first, the ones who turn to nearly everything bring none. A user's remaining rows
    are dealt out by salt, one copy of the left side against parts of the right. The candidates' cosine is then summed up
    from the whole vectors. The weights are written once to the shared folder, since all steps need them; so are the
    candidates, which alone are broadcast, if measured to be few. Vectors never are: their files are far smaller than their
    rows, so a join that goes by the size of the files would take millions of rows for a small table.
    """
    spark = events.sparkSession
    path, met = shared_dir(spark, "weights"), shared_dir(spark, "pairs")
    prefixes(weights(events, item, user)).write.parquet(path)
    rows = spark.read.parquet(path)
    first = rows.filter(F.col("rest") >= threshold * threshold * F.col("norm") * (1 - 1e-9)).select("item", "user", "norm")
    salt = F.pmod(F.xxhash64("item"), F.lit(SALTS)).cast("int")
    left = first.select(F.col("item").alias("item_a"), "user", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    right = first.select(F.col("item").alias("item_b"), "user", salt.alias("salt"))
    left.hint("merge").join(right, ["user", "salt"]).filter("item_a < item_b").select("item_a", "item_b").distinct(
        ).write.parquet(met)
    pairs = spark.read.parquet(met)
    pairs = F.broadcast(pairs) if is_small(pairs) else pairs.hint("merge")
    whole = rows.select("item", "user", "w", "norm")
    one = pairs.join(whole.select(F.col("item").alias("item_a"), "user", F.col("w").alias("w_a"), F.col("norm").alias("norm_a")), "item_a")
    # hashed after the shuffle: a row per item and user, so the parts are even, and the longer side is not sorted
    both = one.join(whole.select(F.col("item").alias("item_b"), "user", F.col("w").alias("w_b"),
                                 F.col("norm").alias("norm_b")).hint("shuffle_hash"), ["item_b", "user"])
    found = both.groupBy("item_a", "item_b").agg(
        F.count(F.lit(1)).alias("users"),
        (F.sum(F.col("w_a") * F.col("w_b")) / F.sqrt(F.first("norm_a") * F.first("norm_b"))).alias("similarity"))
    return found.filter(F.col("similarity") >= threshold)
