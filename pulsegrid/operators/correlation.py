"""Lagged pairs, correlation with intervals, and false-discovery control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.functions.significance import correlation_p
from pulsegrid.operators.rollup import r

#: Pairs below which no correlation is told, the rate of false discoveries,
#: the variance inflation of ranks, the normal quantile of a 95 % interval, and how near a
#: coefficient may come to one in it.
LEAST_PAIRS, FDR, SPEARMAN_INFLATION, Z95, NEAR_ONE = 8, 0.10, 1.06, 1.96, 0.999999


def lagged_pairs(x: DataFrame, y: DataFrame, lag: int, wear: DataFrame | None = None, least_wear: float = 12) -> DataFrame:
    """x of ``lag`` days before with y of a day; days with too few known wear hours drop out."""
    a = x.select(F.date_add("date", lag).alias("date"), F.col("date").alias("x_date"), F.col("value").alias("x"))
    pairs = y.select("date", F.col("value").alias("y")).join(a, "date")
    if wear is not None:
        hours = wear.select(F.col("local_date").alias("day"), "hours")
        for name, key in (("hx", "x_date"), ("hy", "date")):
            pairs = pairs.join(hours.select(F.col("day").alias(key), F.col("hours").alias(name)), key, "left")
        pairs = pairs.where((F.coalesce("hx", F.lit(24)) >= least_wear) & (F.coalesce("hy", F.lit(24)) >= least_wear)).drop("hx", "hy")
    return pairs.select("date", "x_date", "x", "y")


def average_rank(column: str, keys: list[str]) -> Column:
    """Rank in which equal values share the mean of their places."""
    order = Window.partitionBy(*keys).orderBy(column)
    ties = Window.partitionBy(*keys, column)
    return F.rank().over(order) + (F.count("*").over(ties) - 1) / 2


def _interval(rho: Column, n: Column, inflation: float) -> tuple[Column, Column]:
    z, se = F.atanh(F.greatest(F.lit(-NEAR_ONE), F.least(F.lit(NEAR_ONE), rho))), F.sqrt(F.lit(inflation) / (n - 3))
    return F.tanh(z - Z95 * se), F.tanh(z + Z95 * se)


def correlations(pairs: DataFrame, keys: list[str], ranked: bool = False) -> DataFrame:
    """``status``, pairs, coefficient, 95 % interval and two-sided ``p`` by key.

    Too few pairs and constant series keep their row: their status says why the rest is
    null."""
    ends = [F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")]
    if ranked:
        pairs = pairs.withColumns({"x": average_rank("x", keys), "y": average_rank("y", keys)})
    out = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("rho"), *ends)
    few, flat = F.col("n") < LEAST_PAIRS, (F.col("x0") == F.col("x1")) | (F.col("y0") == F.col("y1"))
    out = out.withColumn("status", F.when(few, "insufficient_data").when(flat, "undefined_constant_series").otherwise("ok"))
    rho = F.when(F.col("status") == "ok", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("rho"))))
    out = out.withColumn("rho", rho)
    low, high = _interval(F.col("rho"), F.col("n"), SPEARMAN_INFLATION if ranked else 1.0)
    p = F.when(F.col("rho").isNotNull(), correlation_p(F.col("rho"), F.col("n")))
    return out.select(*keys, "status", "n", r("rho", 5).alias("rho"), r(low, 4).alias("low"), r(high, 4).alias("high"), r(p, 4).alias("p"))


def judged(tests: DataFrame, q: float = FDR) -> DataFrame:
    """Tests with ``q_value`` and ``passed_fdr``, corrected together over those that have a
    p; the others keep their rows, without a q."""
    table = q_values(tests.where(F.col("p").isNotNull())).select("p", F.col("q").alias("q_all")).distinct()
    return tests.join(table, "p", "left").select(*tests.columns, F.round("q_all", 4).alias("q_value"), F.coalesce(F.col("q_all") <= q, F.lit(False)).alias("passed_fdr"))


def scan(series: DataFrame, target: str, lags: list[int]) -> DataFrame:
    """Rank correlations of every other metric with a target, at several lags, with the
    false discoveries of all of them held down together."""
    grid = F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag")
    x = series.where(F.col("metric") != target).select("metric", "date", "value", grid).select("metric", "lag", F.date_add("date", F.col("lag")).alias("date"), F.col("value").alias("x"))
    y = series.where(F.col("metric") == target).select("date", F.col("value").alias("y"))
    return judged(correlations(x.join(y, "date"), ["metric", "lag"], ranked=True).where("status = 'ok'"))


def tested(hypotheses: DataFrame, series: DataFrame, q: float = FDR) -> DataFrame:
    """Only the pairs that were named beforehand: ``name``, ``mx``, ``my``, ``lag``, with
    status, pairs, rank correlation, p, q and the least correlation that the best of the
    tests could have shown.  A pair that can't be tested keeps its row and its reason, and
    doesn't count among the tests."""
    from pulsegrid.functions.significance import least_rho

    series = series.select("metric", "date", "value")
    y = hypotheses.join(series.select(F.col("metric").alias("my"), F.col("date").alias("on"), F.col("value").alias("y")), "my")
    pairs = y.withColumn("date", F.expr("date_sub(on, lag)")).join(series.select(F.col("metric").alias("mx"), "date", F.col("value").alias("x")), ["mx", "date"])
    found = correlations(pairs.select("name", "x", "y"), ["name"], ranked=True)
    every = hypotheses.join(found, "name", "left").withColumns({"status": F.coalesce("status", F.lit("insufficient_data")), "n": F.coalesce("n", F.lit(0).cast("long"))})
    tests = every.agg(F.count("p").alias("tests"))
    held = judged(every, q).crossJoin(F.broadcast(tests))  # one row
    return held.withColumn("least_rho", F.round(least_rho(F.col("n"), F.col("tests"), q), 4)).select(*every.columns, "q_value", "passed_fdr", "least_rho")


def q_values(tests: DataFrame, p: str = "p", digits: int = 4) -> DataFrame:
    """Benjamini-Hochberg q of all tests together, over p rounded to ``digits``."""
    rounded = tests.withColumn("p", F.round(p, digits))
    m = rounded.agg(F.count("p").alias("m"))
    # a p-value holds its largest rank; the smallest bound at or above it counts
    counts = rounded.groupBy("p").agg(F.count("*").alias("c"))
    upto = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    above = Window.orderBy("p").rowsBetween(0, Window.unboundedFollowing)
    steps = counts.withColumn("rank", F.sum("c").over(upto)).crossJoin(m)  # one row
    q = F.min(F.col("p") * F.col("m") / F.col("rank")).over(above)
    table = steps.select("p", F.round(F.least(q, F.lit(1.0)), 6).alias("q"))
    return rounded.join(table, "p", "left").withColumn("significant", F.col("q") <= FDR)
