"""Summaries, coverage, wear, load, readiness, movers and long-term change of daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.operators.rollup import r

STALE, SPARSE, WEAR_HOURS = 14, 0.7, 12


def d(text: str) -> Column:
    return F.lit(text).cast("date")


def summary(series: DataFrame) -> DataFrame:
    """n, mean, median, extremes with their first dates, sample deviation (null for one day)."""
    first = lambda sign: F.max_by(F.struct("value", "date"), F.struct(sign * F.col("value"), -F.datediff("date", d("1970-01-01"))))
    out = series.groupBy("metric").agg(F.count("value").alias("n"), r(F.avg("value")).alias("mean"), r(F.percentile("value", 0.5)).alias("median"), first(-1).alias("lo"), first(1).alias("hi"), r(F.stddev_samp("value")).alias("sd"))
    return out.select("metric", "n", "mean", "median", F.col("lo.value").alias("min"), F.col("lo.date").alias("min_date"), F.col("hi.value").alias("max"), F.col("hi.date").alias("max_date"), "sd")


def recent_vs_baseline(series: DataFrame, most: int = 7) -> DataFrame:
    """Mean of the last rn rows against that of the rest; rn is a third of the rows, 1 to ``most``."""
    every = Window.partitionBy("metric")
    held = series.withColumn("n", F.count("*").over(every)).withColumn("k", F.row_number().over(every.orderBy(F.col("date").desc())))
    rn = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.col("n") / 3)))
    out = held.withColumn("rn", rn).groupBy("metric").agg(F.first("n").alias("n"), F.first("rn").alias("rn"), r(F.avg(F.when(F.col("k") <= F.col("rn"), F.col("value")))).alias("recent"), r(F.avg(F.when(F.col("k") > F.col("rn"), F.col("value")))).alias("rest"), r(F.avg("value")).alias("every"))
    base = F.coalesce("rest", "every")
    return out.select("metric", "n", "rn", "recent", base.alias("baseline"), F.when(base != 0, F.round((F.col("recent") - base) * 100 / base, 2)).alias("change_pct"))


def slope(series: DataFrame) -> DataFrame:
    """Least-squares change a week; null under three points."""
    day = F.datediff("date", d("2000-01-01")).cast("double")
    return series.groupBy("metric").agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, r(F.regr_slope("value", day) * 7, 5)).alias("slope_per_week"))


def period_compare(series: DataFrame, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Means of two date ranges and the change from the first to the second."""
    mean = lambda x: F.avg(F.when(F.col("date").between(d(x[0]), d(x[1])), F.col("value")))
    size = lambda x: F.sum(F.col("date").between(d(x[0]), d(x[1])).cast("long"))
    out = series.groupBy("metric").agg(size(a).alias("n_a"), size(b).alias("n_b"), r(mean(a), 4).alias("mean_a"), r(mean(b), 4).alias("mean_b"))
    return out.withColumn("diff", r(F.col("mean_b") - F.col("mean_a"), 4)).withColumn("change_pct", F.when(F.col("mean_a") != 0, F.round((F.col("mean_b") - F.col("mean_a")) * 100 / F.col("mean_a"), 2)))


def noise_floor(series: DataFrame, as_of: str, days: int = 365, least: int = 20) -> DataFrame:
    """Deviation of differences of consecutive days over the root of 2, and the lag-1
    autocorrelation of rows, both to two decimals; null under ``least`` pairs."""
    held = series.where(F.col("date").between(F.date_sub(d(as_of), days - 1), d(as_of)))
    order = Window.partitionBy("metric").orderBy("date")
    steps = held.withColumn("before", F.lag("value").over(order)).withColumn("gap", F.datediff("date", F.lag("date").over(order)))
    diff = F.when(F.col("gap") == 1, F.col("value") - F.col("before"))
    out = steps.groupBy("metric").agg(F.count(diff).alias("n_pairs"), F.stddev_samp(diff).alias("sd"), F.corr("value", "before").alias("rho"))
    good = F.col("n_pairs") >= least
    return out.select("metric", "n_pairs", F.when(good, F.round(F.col("sd") / F.sqrt(F.lit(2.0)), 2)).alias("floor"), F.when(good, F.round("rho", 2)).alias("rho"))


def smallest_change(floor: DataFrame, n: int) -> DataFrame:
    """95 % detectable change of a mean of n days, widened by autocorrelation."""
    wide = F.when(F.col("rho") > 0, (1 + F.col("rho")) / (1 - F.least("rho", F.lit(0.99)))).otherwise(1.0)
    return floor.withColumn("mdc95", F.round(F.lit(1.96) * F.sqrt(F.lit(2.0)) * F.col("floor") / F.sqrt(F.lit(float(n))) * F.sqrt(wide), 2))


def coverage(series: DataFrame, as_of: str) -> DataFrame:
    """first, last, n, density of the last 14 days, typical gap and state of each metric."""
    seen = series.where(F.col("date") <= d(as_of))
    order = Window.partitionBy("metric").orderBy("date")
    recent = F.date_sub(d(as_of), 59)
    held = seen.withColumn("gap", F.when(F.lag("date").over(order) >= recent, F.datediff("date", F.lag("date").over(order))))
    density = F.sum((F.col("date") > F.date_sub(d(as_of), STALE)).cast("int")) / STALE
    out = held.groupBy("metric").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n"), r(density, 4).alias("density"), F.percentile("gap", 0.5).alias("typical_gap"))
    gap = F.datediff(d(as_of), F.col("last_date"))
    state = F.when(gap > STALE, "stale").when(F.col("density") < SPARSE, "sparse").otherwise("active")
    return out.withColumn("status", state).withColumn("behind", F.coalesce((gap > 0) & (gap > F.col("typical_gap")), F.lit(False)))


def wear_hours(records: DataFrame) -> DataFrame:
    """Hours of the day with a sample from something that is worn."""
    return records.where(F.col("source") == "watch").groupBy("local_date").agg(F.countDistinct(F.floor(F.pmod("start_s", F.lit(86400)) / 3600)).alias("hours"))


def worn_days(series: DataFrame, wear: DataFrame, least: float = WEAR_HOURS, density: float = 0.25) -> DataFrame:
    """Days with enough wear hours; where those are unknown, days with a quarter of the
    samples of the 90th percentile day (the lower one, not interpolated)."""
    order = Window.partitionBy("metric").orderBy("count", "date")
    ranked = series.withColumn("k", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("metric")))
    reference = ranked.where(F.col("k") == F.floor(0.9 * (F.col("n") - 1)) + 1).select("metric", F.col("count").alias("reference"))
    joined = series.join(reference, "metric").join(wear.withColumnRenamed("local_date", "date"), "date", "left")
    return joined.withColumn("worn", F.when(F.col("hours").isNotNull(), F.col("hours") >= least).otherwise(F.col("count") >= density * F.col("reference")))


def load_ratio(days: DataFrame, as_of: str, window: int = 28, least: int = 21, least_acute: int = 5, share: float = 0.75) -> DataFrame:
    """Acute 7-day against chronic 28-day load of worn days; why not, where it is withheld."""
    held = days.where(F.col("date").between(F.date_sub(d(as_of), window - 1), d(as_of)))
    acute = F.col("date") > F.date_sub(d(as_of), 7)
    out = held.groupBy("metric").agg(
        F.count("*").alias("rows"),
        F.sum(F.col("worn").cast("long")).alias("worn"),
        F.sum((F.col("worn") & acute).cast("long")).alias("worn_acute"),
        r(F.avg(F.when(F.col("worn") & acute, F.col("value"))) * 7, 4).alias("acute"),
        r(F.avg(F.when(F.col("worn"), F.col("value"))) * 7, 4).alias("chronic"),
    )
    refusal = F.when(F.col("rows") < least, "insufficient_history").when(F.col("worn") < F.ceil(share * F.col("rows")), "insufficient_wear").when(F.col("worn_acute") < least_acute, "insufficient_recent_wear")
    ratio = F.when(refusal.isNull() & (F.col("chronic") > 0), F.round(F.col("acute") / F.col("chronic"), 3))
    band = F.when(ratio < 0.8, "low").when(ratio <= 1.3, "steady").when(ratio <= 1.5, "raised").when(ratio.isNotNull(), "high")
    return out.select("metric", "rows", "worn", "worn_acute", refusal.alias("refusal"), "acute", "chronic", ratio.alias("ratio"), band.alias("band"))


def movers(series: DataFrame, as_of: str, least: int = 21, top: int = 8, least_pct: float = 15, least_effect: float = 1.5) -> DataFrame:
    """Metrics whose recent mean left their baseline, by effect in population deviations."""
    held = series.where(F.col("date").between(F.date_sub(d(as_of), 27), d(as_of)))
    every = Window.partitionBy("metric")
    held = held.withColumn("n", F.count("*").over(every)).where(F.col("n") >= least).withColumn("k", F.row_number().over(every.orderBy(F.col("date").desc())))
    rn = F.greatest(F.lit(1), F.least(F.lit(7), F.floor(F.col("n") / 3)))
    rest = F.when(F.col("k") > rn, F.col("value"))
    out = held.groupBy("metric").agg(F.avg(F.when(F.col("k") <= rn, F.col("value"))).alias("recent"), F.avg(rest).alias("base"), F.stddev_pop(rest).alias("sd"))
    pct, effect = (F.col("recent") - F.col("base")) * 100 / F.abs("base"), (F.col("recent") - F.col("base")) / F.col("sd")
    out = out.where((F.abs("base") >= 1e-6) & (F.col("sd") > 0)).withColumns({"pct": pct, "effect": effect}).where((F.abs("pct") >= least_pct) & (F.abs("pct") <= 10000) & (F.abs("effect") >= least_effect))
    cap = lambda c, m: F.greatest(F.lit(-m), F.least(F.lit(m), F.col(c)))
    return out.orderBy(F.abs("effect").desc(), F.abs("pct").desc(), "metric").limit(top).select("metric", r("recent", 4).alias("recent"), r("base", 4).alias("baseline"), F.round(cap("pct", 500.0), 2).alias("pct"), F.round(cap("effect", 99.0), 3).alias("effect"))


def long_term(series: DataFrame, as_of: str) -> DataFrame:
    """Mean of 30 days now and 3, 6 and 12 months of 30 days ago."""
    end = d(as_of)
    mean = lambda back: r(F.avg(F.when(F.col("date").between(F.date_sub(end, back + 29), F.date_sub(end, back)), F.col("value"))), 4)
    return series.groupBy("metric").agg(mean(0).alias("now"), mean(90).alias("ago_3m"), mean(180).alias("ago_6m"), mean(365).alias("ago_12m")).withColumn("yoy_pct", F.when(F.col("ago_12m") != 0, F.round((F.col("now") - F.col("ago_12m")) * 100 / F.col("ago_12m"), 2)))


def all_time_highs(series: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Metrics whose highest value so far (its first day) lies in the last days."""
    top = F.max_by(F.struct("date", "value"), F.struct("value", -F.datediff("date", d("1970-01-01"))))
    return series.where(F.col("date") <= d(as_of)).groupBy("metric").agg(top.alias("t")).select("metric", "t.*").where(F.col("date") > F.date_sub(d(as_of), days))


def readiness(series: DataFrame, as_of: str, gain: float = 1.25, least: int = 14) -> DataFrame:
    """Score of each metric: 50 plus ``gain`` points a percent above its baseline.

    Current is the mean of the last three calendar days that end at the latest value,
    the baseline the median of up to 28 rows before them."""
    held = series.where(F.col("date") <= d(as_of)).withColumn("latest", F.max("date").over(Window.partitionBy("metric")))
    now = F.col("date") > F.date_sub("latest", 3)
    order = Window.partitionBy("metric", "now").orderBy(F.col("date").desc())
    held = held.withColumn("now", now).withColumn("k", F.row_number().over(order))
    base = F.when(~F.col("now") & (F.col("k") <= 28), F.col("value"))
    out = held.groupBy("metric").agg(F.first("latest").alias("latest"), F.avg(F.when(F.col("now"), F.col("value"))).alias("current"), F.percentile(base, 0.5).alias("baseline"), F.count(base).alias("n_base"))
    raw = 50 + gain * (F.col("current") - F.col("baseline")) * 100 / F.col("baseline")
    score = F.when((F.col("n_base") >= least) & (F.col("baseline") > 0), F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 3))
    return out.select("metric", "latest", r("current", 4).alias("current"), r("baseline", 4).alias("baseline"), "n_base", score.alias("score"), (F.datediff(d(as_of), F.col("latest")) > 1).alias("stale"))
