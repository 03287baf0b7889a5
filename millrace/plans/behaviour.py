"""What users do over time: funnels of ordered steps, and retention by cohort (§2.13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = 63  # periods in one bitmap number


def funnel_starts(
    events: DataFrame, steps: list[str], span: str, user: str = "user_id", ts: str = "ts", kind: str = "event_type",
    tie: str = "event_id",
) -> DataFrame:
    """`(user, start, steps_done)`: for each span of time in which a user enters the funnel, the number of steps that were
    done in order, each by a later event than the one before, all within `span` of the first.

    A fold over the sorted events, written as one running maximum per step: what a step keeps is the latest first event of
    a chain that got there, which is the best one for everything that follows. A chain that starts in one span ends in the
    next at the latest, so events go to the group of their own span and of the one before: no task sorts all events of a
    busy user. Events without user, time or kind are left out; events of equal time follow each other by `tie`.
    """
    length = F.expr(f"unix_micros(timestamp'1970-01-01 00:00:00 UTC' + interval {span})")
    used = events.filter(F.col(kind).isin(steps)).select(
        F.col(user).alias("user"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(kind).alias("kind"),
        F.col(tie).alias("tie"),
    ).filter("user IS NOT NULL AND at IS NOT NULL").withColumn("length", length)
    own = F.floor(F.col("at") / F.col("length"))
    dealt = used.withColumn("own", own).withColumn("start", F.explode(F.array(own, own - 1)))
    # a group without a first step cannot hold a chain, but that is known only in its task
    order = Window.partitionBy("user", "start").orderBy("at", "tie", "kind")
    reached = dealt.withColumn("reached_1", F.when(
        (F.col("kind") == steps[0]) & (F.col("own") == F.col("start")), F.col("at")))
    for k, step in enumerate(steps[1:], 2):
        best = F.max(f"reached_{k - 1}").over(order.rowsBetween(Window.unboundedPreceding, -1))
        reached = reached.withColumn(f"reached_{k}", best).withColumn(f"reached_{k}", F.when(
            (F.col("kind") == step) & (F.col("at") - F.col(f"reached_{k}") <= F.col("length")), F.col(f"reached_{k}")))
    done = F.lit(0)
    for k in range(1, len(steps) + 1):
        done = F.when(F.col(f"reached_{k}").isNotNull(), k).otherwise(done)
    return reached.groupBy("user", "start").agg(F.max(done).alias("steps_done")).filter("steps_done > 0")


def funnel(events: DataFrame, steps: list[str], span: str, **columns: str) -> DataFrame:
    """`(step, event_type, users, rate_of_previous, rate_of_first)`: users whose best chain reached each step."""
    best = funnel_starts(events, steps, span, **columns).groupBy("user").agg(F.max("steps_done").alias("done"))
    counts = best.agg(*[F.count(F.when(F.col("done") >= k, 1)).alias(f"n{k}") for k in range(1, len(steps) + 1)])
    rows = [
        F.struct(F.lit(k).alias("step"), F.lit(step).alias("event_type"), F.col(f"n{k}").alias("users"),
                 F.try_divide(f"n{k}", f"n{max(k - 1, 1)}").alias("rate_of_previous"),
                 F.try_divide(f"n{k}", F.col("n1")).alias("rate_of_first"))
        for k, step in enumerate(steps, 1)
    ]
    return counts.select(F.inline(F.array(*rows)))


def activity(events: DataFrame, first_day: str, days: int, periods: int, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """`(user, first, words)`: one bitmap per user, bit `p` set where the user was active in period `p` of `days` days from
    `first_day` on. Bits are gathered by `bit_or`, which combines before the shuffle. Events outside the `periods` are not
    looked at."""
    period = F.floor(F.datediff(F.to_date(ts), F.lit(first_day).cast("date")) / days).cast("int")
    seen = events.select(F.col(user).alias("user"), period.alias("p")).filter(
        F.col("user").isNotNull() & F.col("p").between(0, periods - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p") % WORD)
    words = [
        F.coalesce(F.bit_or(F.when(F.floor(F.col("p") / WORD) == w, bit)), F.lit(0).cast("long")).alias(f"w{w}")
        for w in range(-(-periods // WORD))
    ]
    return seen.groupBy("user").agg(F.min("p").alias("first"), *words).select(
        "user", "first", F.array(*[F.col(f"w{w}") for w in range(len(words))]).alias("words"))


def is_active(words: Column, period: Column) -> Column:
    word = F.get(words, F.floor(period / WORD).cast("int"))
    return F.call_function("shiftright", word, (period % WORD).cast("int")).bitwiseAND(1) == 1


def retention(events: DataFrame, first_day: str, days: int, periods: int, **columns: str) -> DataFrame:
    """`(cohort, period, users, active, rate)`: of the users whose first period is `cohort` (its first day), how many were
    active `period` periods later; periods without activity are listed with 0. One shuffle of one row per user and task."""
    users = activity(events, first_day, days, periods, **columns)
    ahead = F.sequence(F.lit(0), F.lit(periods - 1) - F.col("first"))
    marked = users.select("first", F.explode(F.transform(ahead, lambda k: F.struct(
        k.alias("period"), is_active(F.col("words"), F.col("first") + k).alias("active")))).alias("x"))
    counts = marked.groupBy("first", "x.period").agg(
        F.count(F.lit(1)).alias("users"), F.count(F.when(F.col("x.active"), 1)).alias("active"))
    cohort = F.date_add(F.lit(first_day).cast("date"), F.col("first") * days)
    return counts.select(cohort.alias("cohort"), "period", "users", "active",
                         (F.col("active") / F.col("users")).alias("rate"))
