"""Daily roll-up, overlays, catalogue and weekly reduction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DIGITS = 6


def r(column: Column | str, digits: int = DIGITS) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def daily_rollup(records: DataFrame) -> DataFrame:
    """count, sum, avg, min, max and last per (metric, local_date).

    ``last`` is the value of the row that is greatest by (start, end, id); count takes
    rows without a value too.  One shuffle, with partial aggregation."""
    return records.groupBy("metric", "local_date").agg(
        F.count("*").alias("count"),
        r(F.sum("value")).alias("sum"),
        r(F.avg("value")).alias("avg"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.max_by("value", F.struct("start_s", "end_s", "id")).alias("last"),
    )


def last_sample(records: DataFrame) -> DataFrame:
    """The latest sample of each metric and day."""
    best = F.max_by(F.struct("id", "value", "start_s", "source"), F.struct("start_s", "end_s", "id"))
    return records.groupBy("metric", "local_date").agg(best.alias("b")).select("metric", "local_date", "b.*")


def catalog(records: DataFrame) -> DataFrame:
    return records.groupBy("metric").agg(F.min("local_date").alias("first_date"), F.max("local_date").alias("last_date"), F.count("*").alias("n"), F.countDistinct("local_date").alias("n_days"), F.countDistinct("source").alias("n_sources"))


def week_of(day: Column | str) -> Column:
    """Monday of the week."""
    return F.trunc(day, "week").cast("date")


def weekly(series: DataFrame, how: Column) -> DataFrame:
    """Weeks of a daily series, reduced as ``how`` says: sum, last or mean.

    A week is clipped to the series' first and last date; it is partial when fewer
    than 7 days remain."""
    bounds = series.groupBy("metric").agg(F.min("date").alias("from_date"), F.max("date").alias("to_date"))
    weeks = series.groupBy("metric", week_of("date").alias("week")).agg(
        r(F.avg("value")).alias("mean"), F.count("value").alias("n_days"), r(F.sum("value")).alias("total"), F.max_by("value", "date").alias("latest")
    )
    start = F.greatest("week", "from_date")
    stop = F.least(F.date_add("week", 6), F.col("to_date"))
    return weeks.join(bounds, "metric").select(
        "metric",
        "week",
        start.alias("period_start"),
        stop.alias("period_end"),
        "n_days",
        "mean",
        F.when(how == "sum", F.col("total")).when(how == "last", F.col("latest")).otherwise(F.col("mean")).alias("value"),
        (F.datediff(stop, start) < 6).alias("partial"),
    )


def overlay_totals(daily: DataFrame, totals: DataFrame) -> DataFrame:
    """Consolidated totals replace ``sum`` and never ``count``; days without samples
    come in with count 0.  ``totals``: metric, date, total."""
    joined = daily.withColumn("has", F.lit(True)).join(totals, ["metric", "date"], "full_outer")
    return joined.select(
        "metric",
        "date",
        F.coalesce("count", F.lit(0)).alias("count"),
        F.coalesce("total", "sum").alias("sum"),
        "avg",
        "min",
        "max",
        "last",
        F.when(F.col("total").isNotNull(), "consolidated").otherwise("samples").alias("source_kind"),
    )


def overlay_fill(daily: DataFrame, stats: DataFrame) -> DataFrame:
    """Statistics fill only days whose count is 0 or that have no row.  ``stats``: metric, date, stat."""
    joined = daily.join(stats, ["metric", "date"], "full_outer")
    fills = F.coalesce(F.col("count"), F.lit(0)) == 0
    return joined.select("metric", "date", F.coalesce("count", F.lit(0)).alias("count"), F.when(fills, F.coalesce("stat", "avg")).otherwise(F.col("avg")).alias("avg"), (fills & F.col("stat").isNotNull()).alias("filled"))


def differences(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Days on which two roll-ups disagree, null-safely."""
    a = stored.select("metric", "date", F.col("count").alias("stored_count"), F.col("sum").alias("stored_sum"), F.lit(1).alias("s"))
    b = rebuilt.select("metric", "date", F.col("count").alias("rebuilt_count"), F.col("sum").alias("rebuilt_sum"), F.lit(1).alias("b"))
    both = a.join(b, ["metric", "date"], "full_outer")
    kind = F.when(F.col("s").isNull(), "missing").when(F.col("b").isNull(), "extra").when(~F.col("stored_count").eqNullSafe(F.col("rebuilt_count")), "count").when(~F.col("stored_sum").eqNullSafe(F.col("rebuilt_sum")), "sum")
    return both.withColumn("kind", kind).where("kind is not null").select("metric", "date", "kind", "stored_count", "rebuilt_count", "stored_sum", "rebuilt_sum")


def revision_report(writes: DataFrame) -> DataFrame:
    """How much a day's total moved, by days between its first and a later write.

    ``writes``: metric, date, written_on, total.  Deltas are between successive writes."""
    order = Window.partitionBy("metric", "date").orderBy("written_on")
    steps = writes.withColumn("before", F.lag("total").over(order)).where("before is not null")
    lag = F.datediff("written_on", "date")
    delta = F.abs(F.col("total") - F.col("before"))
    return steps.groupBy("metric", lag.alias("lag_days")).agg(F.count("*").alias("n"), r(F.max(delta)).alias("max_abs"), r(F.percentile(delta, 0.5)).alias("median_abs"))


def gap_filled(periods: DataFrame, start: str, stop: str, step: str) -> DataFrame:
    """Every period between two dates; those without a row keep nulls.

    ``periods``: period and value columns."""
    spark = periods.sparkSession
    grid = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(stop).cast("date"), F.expr(f"interval {step}"))).alias("period"))
    return grid.join(periods, "period", "left")
