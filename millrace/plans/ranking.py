"""Offline metrics of ranked lists at k: precision, recall, average precision, discounted gain (§2.13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_ranked(scores: DataFrame, k: int, user: str, item: str, score: str) -> DataFrame:
    """`(user, item, rank)`: the best `k` items of each user, equal scores by the smaller item. Rows are cut to `k` per user
    before the shuffle."""
    best = Window.partitionBy("user").orderBy(F.desc("score"), "item")
    rows = scores.select(F.col(user).alias("user"), F.col(item).alias("item"), F.col(score).alias("score"))
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("user", "item", "rank")


def per_user(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """`(user, relevant, hits, precision, recall, average_precision, ndcg)` for every user who has relevant items.

    `ranked` has (user, item, rank from 1), each item once per user; `relevant` has (user, item, gain), gain above 0. A user
    without a ranked list scores 0. Precision divides by k also where the list is shorter; average precision by the
    smaller of k and the number of relevant items; the ideal order ranks by gain, so ties among gains do not matter.
    """
    listed = ranked.filter(F.col("rank") <= k)
    wanted = relevant.filter("user IS NOT NULL AND item IS NOT NULL AND gain > 0").groupBy("user", "item").agg(F.max("gain").alias("gain"))
    joined = wanted.join(listed, ["user", "item"], "left")
    by_rank = Window.partitionBy("user").orderBy(F.col("rank").asc_nulls_last(), "item")
    by_gain = Window.partitionBy("user").orderBy(F.desc("gain"), "item")
    placed = joined.withColumns({"hits_so_far": F.count("rank").over(by_rank), "ideal": F.row_number().over(by_gain)})

    def discounted(place: Column) -> Column:
        return F.sum(F.when(place <= k, F.col("gain") / F.log2(place + 1)))

    sums = placed.groupBy("user").agg(
        F.count(F.lit(1)).alias("relevant"), F.count("rank").alias("hits"),
        F.coalesce(F.sum(F.when(F.col("rank").isNotNull(), F.col("hits_so_far") / F.col("rank"))), F.lit(0.0)).alias("precisions"),
        F.coalesce(discounted(F.col("rank")), F.lit(0.0)).alias("dcg"), discounted(F.col("ideal")).alias("best"))
    return sums.select(
        "user", "relevant", "hits", (F.col("hits") / k).alias("precision"), (F.col("hits") / F.col("relevant")).alias("recall"),
        (F.col("precisions") / F.least("relevant", F.lit(k))).alias("average_precision"), (F.col("dcg") / F.col("best")).alias("ndcg"))


def metrics(ranked: DataFrame, relevant: DataFrame, ks: list[int]) -> DataFrame:
    """`(k, users, precision, recall, map, ndcg)`, means over the users who have relevant items. A pass for each k."""
    rows = [
        per_user(ranked, relevant, k).agg(
            F.count(F.lit(1)).alias("users"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
            F.avg("average_precision").alias("map"), F.avg("ndcg").alias("ndcg"),
        ).select(F.lit(k).alias("k"), "*") for k in ks
    ]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out
