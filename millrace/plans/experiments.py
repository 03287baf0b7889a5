"""Experiment readout: mergeable moments, CUPED, Welch's t-test and a Poisson bootstrap (§2.13)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: coefficients of Stirling's series -----------------------------------------------------
STIRLING = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188]
POISSON_LIMIT = 12  # a weight of 12 or more has a chance below 1e-9


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5 of the parts: the same everywhere, without state."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(2 ** 32)


def assigned(users: DataFrame, variants: list[str], salt: str, user: str = "user_id") -> DataFrame:
    """Adds `variant` by a hash of the user."""
    number = F.floor(uniform(F.lit(salt), F.col(user)) * len(variants)).cast("int")
    return users.withColumn("variant", F.get(F.array(*map(F.lit, variants)), number))


def moments(units: DataFrame, outcome: str = "y", covariate: str = "x") -> DataFrame:
    """One row per variant: n, means, variances and the covariance, in one pass that combines before the shuffle. Units
    without outcome or covariate are left out."""
    return units.filter(F.col(outcome).isNotNull() & F.col(covariate).isNotNull()).groupBy("variant").agg(
        F.count(F.lit(1)).alias("n"), F.avg(outcome).alias("mean_y"), F.avg(covariate).alias("mean_x"),
        F.var_samp(outcome).alias("var_y"), F.var_samp(covariate).alias("var_x"),
        F.covar_samp(outcome, covariate).alias("cov"))


def readout(units: DataFrame, control: str, outcome: str = "y", covariate: str = "x") -> DataFrame:
    """`(variant, method, n, mean, lift, t, df, p)`: each variant against `control`, by plain means and by CUPED.

    CUPED takes `theta * (x - mean of x)` off each outcome, theta being the regression of y on x within the variants, their
    moments put together. Both means and variances follow from the moments, so the units are read once.
    """
    every = Window.partitionBy(F.lit(0))  # of one row per variant
    weight = F.col("n") - 1
    rows = moments(units, outcome, covariate).withColumns({
        "theta": F.try_divide(F.sum(weight * F.col("cov")).over(every), F.sum(weight * F.col("var_x")).over(every)),
        "all_x": F.try_divide(F.sum(F.col("n") * F.col("mean_x")).over(every), F.sum("n").over(every))})
    theta = F.coalesce("theta", F.lit(0.0))
    each = rows.select("variant", "n", F.inline(F.array(
        F.struct(F.lit("plain").alias("method"), F.col("mean_y").alias("mean"), F.col("var_y").alias("var")),
        F.struct(F.lit("cuped").alias("method"),
                 (F.col("mean_y") - theta * (F.col("mean_x") - F.col("all_x"))).alias("mean"),
                 (F.col("var_y") + theta * theta * F.col("var_x") - 2 * theta * F.col("cov")).alias("var")))))
    base = each.filter(F.col("variant") == control).select(
        "method", F.col("n").alias("n0"), F.col("mean").alias("mean0"), F.col("var").alias("var0"))
    pairs = each.filter(F.col("variant") != control).join(F.broadcast(base), "method")  # a row per method
    one, two = F.col("var") / F.col("n"), F.col("var0") / F.col("n0")
    df = F.try_divide((one + two) ** 2, one ** 2 / (F.col("n") - 1) + two ** 2 / (F.col("n0") - 1))
    tested = pairs.withColumns({
        "lift": F.try_divide(F.col("mean") - F.col("mean0"), "mean0"), "df": df,
        "t": F.try_divide(F.col("mean") - F.col("mean0"), F.sqrt(one + two))})
    return tested.select("variant", "method", "n", "mean", "lift", "t", "df", t_two_sided(F.col("t"), F.col("df")).alias("p"))


def log_gamma(x: Column) -> Column:
    """For x > 0: Stirling's series eight steps further up."""
    y = x + 8
    series = sum((F.lit(c) / F.pow(y, 2 * k + 1) for k, c in enumerate(STIRLING)), F.lit(0.0))
    back = sum((F.ln(x + k) for k in range(8)), F.lit(0.0))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - back


def _beta_fraction(a: Column, b: Column, x: Column, steps: int) -> Column:
    """The continued fraction of the incomplete beta function, from its tail upwards."""

    def level(rest: Column, k: Column) -> Column:
        """Two coefficients, of numbers 2k and 2k + 1."""
        even = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        odd = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        return 1 + even / (1 + odd / rest)

    tail = F.aggregate(F.reverse(F.sequence(F.lit(1), F.lit(steps))), F.lit(1.0), level)
    return 1 / (1 - (a + b) * x / (a + 1) / tail)


def incomplete_beta(a: Column, b: Column, x: Column, steps: int = 2_000) -> Column:
    """The regularised incomplete beta function as a native expression; the smaller side is expanded."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    low = front * _beta_fraction(a, b, x, steps) / a
    high = 1 - front * _beta_fraction(b, a, 1 - x, steps) / b
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), low).otherwise(high)


def t_two_sided(t: Column, df: Column) -> Column:
    """The chance that Student's t with `df` degrees of freedom is as far from 0 as `t`."""
    return incomplete_beta(df / 2, F.lit(0.5), df / (df + t * t))


def poisson_weight(u: Column) -> Column:
    """A Poisson(1) number from a uniform one."""
    below, weight = 0.0, F.lit(0)
    for k in range(POISSON_LIMIT):
        below += math.exp(-1) / math.factorial(k)
        weight = weight + F.when(u >= below, 1).otherwise(0)
    return weight


def bootstrap(units: DataFrame, control: str, replicates: int = 200, confidence: float = 0.95, salt: str = "bootstrap",
              user: str = "user_id", outcome: str = "y") -> DataFrame:
    """`(variant, difference, low, high)`: the difference of means to `control` with its bootstrap interval.

    Every unit has a Poisson(1) weight in every replicate, drawn from a hash of unit and replicate, so replicates need no
    state, no second pass and no resampling, and a lost task draws the same again. A unit's replicates are summed up before
    the shuffle: `replicates` rows per variant and task are all that moves.
    """
    known = units.filter(F.col(outcome).isNotNull()).select(F.col(user).alias("user"), "variant", F.col(outcome).alias("y"))
    drawn = known.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates)))).withColumn(
        "w", F.when(F.col("r") == 0, 1).otherwise(poisson_weight(uniform(F.lit(salt), F.col("user"), F.col("r")))))  # 0: as they are
    means = drawn.groupBy("variant", "r").agg(F.try_divide(F.sum(F.col("w") * F.col("y")), F.sum("w")).alias("mean"))
    base = means.filter(F.col("variant") == control).select("r", F.col("mean").alias("mean0"))
    found = means.filter(F.col("variant") != control).join(base, "r").withColumn("difference", F.col("mean") - F.col("mean0"))
    side = (1 - confidence) / 2
    return found.groupBy("variant").agg(
        F.max(F.when(F.col("r") == 0, F.col("difference"))).alias("difference"),
        F.expr(f"percentile(difference, array({side}, {1 - side})) FILTER (WHERE r > 0)").alias("ends"),
    ).select("variant", "difference", F.get("ends", F.lit(0)).alias("low"), F.get("ends", F.lit(1)).alias("high"))
