"""Concentration and the long tail: running sums over all rows in order, without a task that sees them all (§2.13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import shared_dir


def running_totals(rows: DataFrame, value: str, tie: str) -> DataFrame:
    """Adds `rank`, from 1, and `running`, the sum of all values up to and with this one, in the order of value and `tie`.

    Rows are dealt out by ranges of the order and written once; each range adds up its own rows, and the totals of the
    ranges before it, one row per range, are joined on. Rows of equal value and tie lie together in one range.
    """
    spark = rows.sparkSession
    path = shared_dir(spark, "ranges")
    order = [F.col(value).asc(), F.col(tie).asc()]
    rows.filter(F.col(value).isNotNull()).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    totals = dealt.groupBy("_range").agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = totals.select(
        "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"))
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumns({"running": F.sum(value).over(own), "rank": F.row_number().over(own)})
    joined = placed.join(F.broadcast(offsets), "_range")  # as many rows as ranges
    return joined.withColumns({"running": F.col("running") + F.col("_sum_before"), "rank": (F.col("rank") + F.col("_rows_before")).cast("long")}
                              ).drop("_range", "_sum_before", "_rows_before")


def lorenz(rows: DataFrame, value: str, tie: str, points: int = 20) -> DataFrame:
    """`(point, rows, total, share, gini)`: for each of `points` equal steps of the ranking, from the smallest value up, how
    many rows it takes in and which share of the sum they hold; and the Gini coefficient of all values. Values below 0
    make no share and are left out; a sum of 0 has neither share nor coefficient."""
    path = shared_dir(rows.sparkSession, "running")
    running_totals(rows.filter(F.col(value) >= 0), value, tie).write.parquet(path)
    ranked = rows.sparkSession.read.parquet(path)
    whole = ranked.agg(
        F.count(F.lit(1)).alias("n"), F.max("running").alias("all"),
        F.sum(F.col("rank").cast("double") * F.col(value)).alias("weighted"))
    steps = whole.select("*", F.explode(F.sequence(F.lit(1), F.lit(points))).alias("point")).filter("n > 0").withColumn(
        "rank", F.ceil(F.col("point") * F.col("n") / points).cast("long"))
    gini = F.try_divide(2 * F.col("weighted"), F.col("n") * F.col("all")) - (F.col("n") + 1) / F.col("n")
    found = F.broadcast(steps).join(ranked.select("rank", "running"), "rank")  # `points` rows
    return found.select("point", F.col("rank").alias("rows"), F.col("running").alias("total"),
                        F.try_divide("running", "all").alias("share"), gini.alias("gini"))


def shares_of_top(rows: DataFrame, value: str, tie: str, parts: list[float]) -> DataFrame:
    """`(part, rows, share)`: the share of the sum that the largest `part` of the rows holds, at least one row."""
    path = shared_dir(rows.sparkSession, "running")
    running_totals(rows.filter(F.col(value) >= 0), value, tie).write.parquet(path)
    ranked = rows.sparkSession.read.parquet(path)
    whole = ranked.agg(F.count(F.lit(1)).alias("n"), F.max("running").alias("all")).filter("n > 0")
    asked = whole.select("*", F.explode(F.array(*map(F.lit, parts))).alias("part")).withColumn(
        "rows", F.greatest(F.lit(1), F.floor(F.col("part") * F.col("n"))).cast("long"))
    below = ranked.select(F.col("rank").alias("_rank"), "running")
    return asked.join(below, F.col("n") - F.col("rows") == F.col("_rank"), "left").select(
        "part", "rows", F.try_divide(F.col("all") - F.coalesce("running", F.lit(0)), "all").alias("share"))
