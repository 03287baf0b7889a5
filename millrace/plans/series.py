"""Daily series: counts on a filled calendar, growth week over week, smoothed velocity, spikes (§2.13).

The calendar has every day from the first to the last of the table, for every series; days without events count 0. All
frames are ranges of days, so they mean the same on gaps. Events are counted before anything else, so a series that is a
third of all events is one row per day like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, series: Column, ts: str = "ts") -> DataFrame:
    """`(series, day, n)` on the filled calendar. Events without series or time are left out."""
    counts = events.select(series.alias("series"), F.to_date(ts).alias("day")).filter(
        "series IS NOT NULL AND day IS NOT NULL").groupBy("series", "day").agg(F.count(F.lit(1)).alias("n"))
    first, last = counts.agg(F.min("day"), F.max("day")).first()
    calendar = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    every = counts.select("series").distinct().select("series", F.explode(calendar).alias("day"))
    return every.join(counts, ["series", "day"], "left").select("series", "day", F.coalesce("n", F.lit(0)).alias("n"))


def _days(back: int, until: int) -> WindowSpec:
    """From `back` days before to `until` days before."""
    return Window.partitionBy("series").orderBy(F.unix_date("day")).rangeBetween(-back, -until)


def _covered(back: int) -> Column:
    """Whether the calendar goes back that far."""
    return F.min("day").over(Window.partitionBy("series")) <= F.date_sub("day", back)


def growth(daily: DataFrame, days: int = 7) -> DataFrame:
    """Adds `week`, the last `days` days, `week_before`, as many before them (NULL where the calendar does not reach back),
    and `growth`, NULL also where there was nothing before."""
    before = F.when(_covered(2 * days - 1), F.sum("n").over(_days(2 * days - 1, days)))
    spans = daily.withColumns({
        "week": F.when(_covered(days - 1), F.sum("n").over(_days(days - 1, 0))), "week_before": before})
    return spans.withColumn("growth", F.try_divide(F.col("week") - F.col("week_before"), F.col("week_before")))


def velocity(daily: DataFrame, recent: int = 7, base: int = 21) -> DataFrame:
    """Adds `recent_rate` and `base_rate`, the daily rates of the last `recent` days and of the `base` days before them,
    both smoothed, and `velocity`, the first over the second.

    Smoothing: the rates of all series are taken as drawn from a gamma distribution, whose shape and weight follow from mean
    and variance of all daily counts; a rate from few days or few events is drawn towards that mean. Where counts vary no
    more than chance would have it, all rates equal the mean. Days that the calendar does not cover do not count.
    """
    mean, var = daily.agg(F.avg("n"), F.var_pop("n")).first()
    mean, var = float(mean or 0), float(var or 0)

    def rate(back: int, until: int) -> Column:
        frame = _days(back, until)
        total, seen = F.coalesce(F.sum("n").over(frame), F.lit(0)), F.count("n").over(frame)
        if var <= mean or not mean:
            return F.lit(mean)
        weight = mean / (var - mean)
        return (F.lit(mean * weight) + total) / (F.lit(weight) + seen)

    rates = daily.withColumns({"recent_rate": rate(recent - 1, 0), "base_rate": rate(recent + base - 1, recent)})
    return rates.withColumn("velocity", F.try_divide("recent_rate", "base_rate"))


def _median(ordered: Column) -> Column:
    n = F.size(ordered)
    middle = lambda k: F.get(ordered, F.floor(k / 2).cast("int"))
    return F.when(n > 0, (middle(n - 1) + middle(n)) / 2)


def spikes(daily: DataFrame, days: int = 14, limit: float = 3.5) -> DataFrame:
    """Adds `median` and `mad` of the `days` days before (exact, from the at most `days` values of the frame), `score`, the
    distance from the median in robust standard deviations, and `spike`: +1 or -1 where the score passes `limit`.

    Where more than half of the days were equal, the deviation is 0; a day that differs then scores by one event instead.
    Days with fewer than `days` days before them have no median.
    """
    values = F.array_sort(F.collect_list("n").over(_days(days, 1)))
    seen = daily.withColumn("values", F.when(_covered(days), values)).withColumn("median", _median(F.col("values")))
    away = F.array_sort(F.transform("values", lambda x: F.abs(x - F.col("median"))))
    scored = seen.withColumn("mad", _median(away)).withColumn(
        "score", (F.col("n") - F.col("median")) / F.greatest(F.col("mad") * 1.4826, F.when(F.col("mad") == 0, 1.0).otherwise(0.0)))
    return scored.withColumn("spike", F.when(F.col("score") >= limit, 1).when(F.col("score") <= -limit, -1).otherwise(0)).drop("values")
