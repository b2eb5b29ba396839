"""Regularity and timing of nights, and time-window statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pulsegrid.operators.rollup import r


def regularity_pairs(nights: DataFrame) -> DataFrame:
    """Share of the minutes of two nights in a row that are alike.

    ``nights``: date, bed_min and wake_min, minutes after noon.  Of 1440 minutes those
    differ that only one of both nights sleeps through."""
    before = nights.select(F.date_add("date", 1).alias("date"), F.col("bed_min").alias("b0"), F.col("wake_min").alias("w0"))
    both = nights.join(before, "date")
    shared = F.greatest(F.lit(0), F.least("wake_min", "w0") - F.greatest("bed_min", "b0"))
    differ = (F.col("wake_min") - F.col("bed_min")) + (F.col("w0") - F.col("b0")) - 2 * shared
    return both.select("date", r(1 - differ / 1440).alias("same_share"))


def rolling_sd(series: DataFrame, days: int = 28, least: int = 21) -> DataFrame:
    """Sample deviation of the values of the last ``days`` calendar days, with enough of them."""
    frame = Window.partitionBy("metric").orderBy(F.datediff("date", F.lit("1970-01-01").cast("date"))).rangeBetween(-(days - 1), 0)
    out = series.withColumn("n", F.count("value").over(frame)).withColumn("sd", F.stddev_samp("value").over(frame))
    return out.select("metric", "date", "n", F.when(F.col("n") >= least, r("sd", 4)).alias("sd"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bias, spread and largest difference of two measures of one thing, by date."""
    both = a.select("date", F.col("value").alias("a")).join(b.select("date", F.col("value").alias("b")), "date").withColumn("diff", F.col("a") - F.col("b"))
    return both.agg(F.count("*").alias("n"), r(F.avg("diff"), 4).alias("bias"), r(F.stddev_samp("diff"), 4).alias("sd"), r(F.max(F.abs("diff")), 4).alias("max_abs"))


def compliance(bedtimes: DataFrame, anchor: float) -> DataFrame:
    """Nights by how many minutes after the anchor they begin: up to 15, up to 45, later."""
    late = F.col("bed_min") - anchor
    band = F.when(late <= 15, "on_time").when(late <= 45, "near").otherwise("late")
    every = bedtimes.agg(F.count("*").alias("total"))
    return bedtimes.groupBy(band.alias("band")).agg(F.count("*").alias("n")).crossJoin(every).select("band", "n", r(F.col("n") / F.col("total"), 4).alias("share"))
