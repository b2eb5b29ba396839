"""Running form from buckets, carried and zero-filled days, plans and checks of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.functions.stats import close
from pulsegrid.operators.rollup import r, week_of


def halves(buckets: DataFrame, flag: str) -> DataFrame:
    """Mean pace of the first and second half of each day's flagged buckets (the first
    half is the smaller one of an odd number)."""
    day = Window.partitionBy("local_date")
    held = buckets.where(flag).withColumn("k", F.row_number().over(day.orderBy("bkt"))).withColumn("n", F.count("*").over(day))
    first = F.col("k") <= F.floor(F.col("n") / 2)
    out = held.groupBy("local_date").agg(F.count("*").alias("n"), r(F.avg(F.when(first, F.col("pace"))), 4).alias("first_half"), r(F.avg(F.when(~first, F.col("pace"))), 4).alias("second_half"))
    return out.withColumn("change_pct", F.when(F.col("first_half") != 0, F.round((F.col("second_half") - F.col("first_half")) * 100 / F.col("first_half"), 2)))


#: Fixed value: comparable sessions below which there is no reference.
LEAST_SESSIONS = 5


def reference(changes: DataFrame, keys: list[str], excluded: Column | None = None) -> DataFrame:
    """The usual range of ``change_pct`` by key: median, tenth and ninetieth percentile, and
    the smallest change that stands out, two standard errors of the mean.

    Nulls don't count.  ``excluded`` marks rows that are to be held against a range which
    they didn't help to make.  A key with fewer than LEAST_SESSIONS keeps its row and says so."""
    held = F.col("change_pct").isNotNull() if excluded is None else F.col("change_pct").isNotNull() & ~excluded
    value = F.when(held, F.col("change_pct"))
    out = changes.groupBy(*keys).agg(F.count(value).alias("n_sessions"), F.percentile(value, [0.1, 0.5, 0.9]).alias("p"), F.stddev_samp(value).alias("sd"))
    enough = F.col("n_sessions") >= LEAST_SESSIONS
    tell = lambda c: F.when(enough, r(c, 4))
    return out.select(
        *keys, F.when(enough, "ok").otherwise("insufficient_sessions").alias("status"), "n_sessions", tell(F.get("p", 1)).alias("median"), tell(F.get("p", 0)).alias("p10"), tell(F.get("p", 2)).alias("p90"), tell(2 * F.col("sd") / F.sqrt(F.greatest(F.lit(1), F.col("n_sessions")))).alias("least_change")
    )


def bouts(buckets: DataFrame, flag: str) -> DataFrame:
    """Rising edges and buckets of a flag by day, in the order of the buckets at hand."""
    order = Window.partitionBy("local_date").orderBy("bkt")
    edge = F.col(flag) & ~F.coalesce(F.lag(flag).over(order), F.lit(False))
    return buckets.withColumn("edge", edge).groupBy("local_date").agg(F.sum(F.col("edge").cast("long")).alias("n_bouts"), F.sum(F.col(flag).cast("long")).alias("n_buckets"))


def banded_weekly(buckets: DataFrame, low: float, high: float, least: int = 10) -> DataFrame:
    """Weekly mean pace and distance of buckets in a pace band, where there are enough."""
    held = buckets.where(F.col("pace").between(low, high))
    return held.groupBy(week_of("local_date").alias("week")).agg(F.count("*").alias("n"), r(F.avg("pace"), 4).alias("pace"), r(F.avg("mi"), 6).alias("mi")).where(F.col("n") >= least)


def zero_filled(days: DataFrame, wear: DataFrame, least: float = 12) -> DataFrame:
    """Days with a value, and zeros for worn days without one."""
    worn = wear.where(F.col("hours") >= least).select(F.col("local_date").alias("date"))
    return days.join(worn, "date", "full_outer").select("date", F.coalesce("value", F.lit(0.0)).alias("value"))


def carried(days: DataFrame, horizon: int) -> DataFrame:
    """Every day from a metric's first to ``horizon`` days after its last, each with the
    latest value so far."""
    spans = days.groupBy("metric").agg(F.min("date").alias("a"), F.date_add(F.max("date"), horizon).alias("b"))
    grid = spans.select("metric", F.explode(F.sequence("a", "b")).alias("date"))
    order = Window.partitionBy("metric").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(days, ["metric", "date"], "left").withColumn("value", F.last("value", ignorenulls=True).over(order)).select("metric", "date", "value")


def projected(log: DataFrame) -> DataFrame:
    """Rules of each scope that came after its last withdrawal.  ``log``: scope, seq, kind, rule."""
    last = log.where("kind = 'withdraw'").groupBy("scope").agg(F.max("seq").alias("cut"))
    return log.where("kind = 'rule'").join(last, "scope", "left").where("cut is null or seq > cut").select("scope", "seq", "rule")


def checked(claims: DataFrame, actual: DataFrame, keys: list[str], rel: float = 0.005, floor: float = 0.05) -> DataFrame:
    """Claims against recomputed values: verified, wrong or without a basis."""
    joined = claims.join(actual, keys, "left")
    verdict = F.when(F.col("actual").isNull(), "no_basis").when(close(F.col("claimed"), F.col("actual"), rel, floor), "verified").otherwise("wrong")
    return joined.withColumn("verdict", verdict)


def downsampled(rows: DataFrame, seconds: int = 20) -> DataFrame:
    """Sums by (metric, day, source, bucket), with the first and last time of each."""
    return rows.groupBy("metric", "local_date", "source", F.floor(F.col("start_s") / seconds).alias("bkt")).agg(r(F.sum("value")).alias("value"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("n"))


def nearest_rank(rows: DataFrame, keys: list[str], q: float, value: Column) -> DataFrame:
    """Nearest-rank percentile: the value whose place is ceil(q * n)."""
    order = Window.partitionBy(*keys).orderBy(value)
    ranked = rows.withColumn("__k", F.row_number().over(order)).withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    return ranked.where(F.col("__k") == F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("__n")))).select(*keys, value.alias("p"))
