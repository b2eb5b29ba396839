"""Long histories: eras, reference ranges, sustained periods, trajectories, instruments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.operators.rollup import r

ERA_GAP, WINDOW_DAYS, MIN_DAYS, MIN_FRACTION, SHARE, DENSITY = 14, 30, 21, 0.7, 0.8, 0.7


def day_number(column: str = "date") -> Column:
    return F.datediff(F.col(column), F.lit("1970-01-01").cast("date"))


def eras(series: DataFrame, gap: int = ERA_GAP) -> DataFrame:
    """Series with an era number: a new one after more than ``gap`` days without a value."""
    order = Window.partitionBy("metric").orderBy("date")
    new = F.coalesce((F.datediff("date", F.lag("date").over(order)) > gap).cast("int"), F.lit(1))
    return series.withColumn("__new", new).withColumn("era", F.sum("__new").over(order)).drop("__new")


def era_summary(with_era: DataFrame) -> DataFrame:
    span = F.datediff(F.max("date"), F.min("date")) + 1
    return with_era.groupBy("metric", "era").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n"), span.alias("span_days"), r(F.count("*") / span).alias("density"))


def reference_ranges(with_era: DataFrame) -> DataFrame:
    p = lambda q: r(F.percentile("value", q))
    return with_era.groupBy("metric", "era").agg(F.count("*").alias("n"), p(0.5).alias("median"), p(0.05).alias("p5"), p(0.95).alias("p95"))


def rolling(with_era: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """Median and count of the values of the last ``days`` calendar days of the era."""
    frame = Window.partitionBy("metric", "era").orderBy("day").rangeBetween(-(days - 1), 0)
    first = F.min("day").over(Window.partitionBy("metric", "era"))
    out = with_era.withColumn("day", day_number())
    return out.withColumn("median", r(F.percentile("value", 0.5).over(frame), 4)).withColumn("points", F.count("value").over(frame)).withColumn("full", F.col("day") - first + 1 >= days)


def enough(days: int = WINDOW_DAYS, least: int = MIN_DAYS, fraction: float = MIN_FRACTION) -> Column:
    return F.col("full") & (F.col("points") >= least) & (F.col("points") >= fraction * days)


def best_sustained(with_era: DataFrame, highest: bool = True, days: int = WINDOW_DAYS) -> DataFrame:
    """Best rolling median of each era, the earliest of equals."""
    sign = F.lit(1 if highest else -1)
    best = F.max_by(F.struct("date", "median", "points"), F.struct(sign * F.col("median"), -F.col("day")))
    return rolling(with_era, days).where(enough(days)).groupBy("metric", "era").agg(best.alias("b")).select("metric", "era", "b.*")


def sustained_periods(with_era: DataFrame, threshold: float, days: int = WINDOW_DAYS, share: float = SHARE) -> DataFrame:
    """Merged windows in which enough of the points reach the threshold."""
    frame = Window.partitionBy("metric", "era").orderBy("day").rangeBetween(-(days - 1), 0)
    met = F.sum((F.col("value") >= threshold).cast("int")).over(frame)
    good = rolling(with_era, days).withColumn("met", met).where(enough(days) & (F.col("met") >= share * F.col("points")))
    order = Window.partitionBy("metric", "era").orderBy("day")
    new = F.coalesce((F.col("day") - F.lag("day").over(order) > days).cast("int"), F.lit(1))
    held = good.withColumn("new", new).withColumn("period", F.sum("new").over(order))
    return held.groupBy("metric", "era", "period").agg(F.date_sub(F.min("date"), days - 1).alias("start"), F.max("date").alias("stop"), F.count("*").alias("n_windows"))


def trajectory(with_era: DataFrame, unit: str = "quarter", density: float = DENSITY) -> DataFrame:
    """Means by calendar period and era, withheld where too few of the days are there."""
    period = F.trunc("date", unit).cast("date")
    days = F.datediff(F.add_months("period", 3 if unit == "quarter" else 1), F.col("period"))
    out = with_era.groupBy("metric", "era", period.alias("period")).agg(F.count("*").alias("n"), r(F.avg("value"), 4).alias("mean"))
    return out.withColumn("density", r(F.col("n") / days)).withColumn("mean", F.when(F.col("density") >= density, F.col("mean")))


def source_months(records: DataFrame) -> DataFrame:
    return records.groupBy("metric", F.trunc("local_date", "month").cast("date").alias("month"), "source").agg(F.count("*").alias("n"))


def dominant(months: DataFrame, least: int = 5) -> DataFrame:
    """Source with most samples in each month with enough of them; ties by name."""
    top = F.min_by(F.struct("source", "n"), F.struct(-F.col("n"), F.col("source")))
    return months.groupBy("metric", "month").agg(F.sum("n").alias("total"), top.alias("t")).where(F.col("total") >= least).select("metric", "month", "t.source", "t.n", "total")


def boundaries(top: DataFrame) -> DataFrame:
    """Months in which another source takes over for this and the next month."""
    order = Window.partitionBy("metric").orderBy("month")
    lasting = F.col("source") == F.lead("source").over(order)
    held = top.withColumn("lasting", F.coalesce(lasting, F.lit(False)) | (F.row_number().over(order) == 1))
    kept = held.where("lasting").withColumn("before", F.lag("source").over(order))
    return kept.where("before is not null and before <> source").select("metric", F.col("month").alias("boundary"), "before", "source")
