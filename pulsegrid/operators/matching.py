"""Sessions: gap sessions, overlap matching, containment and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pulsegrid.operators.rollup import r

GAP_SECONDS = 90 * 60
COVERED = 0.9


def gap_sessions(intervals: DataFrame, keys: list[str], gap: int = GAP_SECONDS) -> DataFrame:
    """Intervals with the number of their session: a new one starts when the start lies
    more than ``gap`` seconds behind the latest end so far."""
    order = Window.partitionBy(*keys).orderBy("start_s", "end_s", "id")
    latest = F.max("end_s").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start_s") - latest > gap).cast("int"), F.lit(1))
    return intervals.withColumn("new", new).withColumn("session", F.sum("new").over(order)).drop("new")


def session_spans(sessioned: DataFrame, keys: list[str]) -> DataFrame:
    spans = sessioned.groupBy(*keys, "session").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("n"), r(F.sum("value")).alias("total"))
    return spans.withColumn("span_min", r((F.col("end_s") - F.col("start_s")) / 60, 4)).withColumn("too_long", F.col("end_s") - F.col("start_s") > 86400)


def reattributed(sessioned: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals re-dated to the day on which their session ends."""
    ends = sessioned.groupBy(*keys, "session").agg(F.max("end_s").alias("session_end"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("session_end") / 86400).cast("int"))
    return sessioned.join(ends, [*keys, "session"]).withColumn("session_date", day)


def _overlaps(items: DataFrame, parents: DataFrame) -> DataFrame:
    hour = lambda: F.explode(F.sequence(F.floor(F.col("start_s") / 3600), F.floor((F.col("end_s") - 1) / 3600)))
    a = items.where("end_s > start_s").select(F.col("id").alias("item_id"), F.col("source").alias("item_source"), F.col("start_s").alias("a0"), F.col("end_s").alias("a1"), hour().alias("hour"))
    b = parents.where("end_s > start_s").select(F.col("id").alias("parent_id"), F.col("source").alias("parent_source"), F.col("start_s").alias("b0"), F.col("end_s").alias("b1"), hour().alias("hour"))
    return a.join(b, "hour").where("a0 < b1 and b0 < a1").drop("hour").distinct().withColumn("overlap", F.least("a1", "b1") - F.greatest("a0", "b0"))


def best_overlap(items: DataFrame, parents: DataFrame, covered: float = COVERED) -> DataFrame:
    """Parent of each item: both at least ``covered`` by their overlap; the largest
    overlap wins, then the same source, then the lowest id."""
    fit = _overlaps(items, parents).where((F.col("overlap") >= covered * (F.col("a1") - F.col("a0"))) & (F.col("overlap") >= covered * (F.col("b1") - F.col("b0"))))
    best = F.max_by(F.struct("parent_id", "overlap"), F.struct("overlap", (F.col("item_source") == F.col("parent_source")).alias("same"), (-F.col("parent_id")).alias("first")))
    return fit.groupBy("item_id").agg(best.alias("b")).select("item_id", "b.*")


def hourly_containers(sessions: DataFrame) -> DataFrame:
    """Outermost session that strictly contains each session of the same kind and source;
    candidates are met by the hour in which the inner session starts."""
    spans = sessions.select(F.col("id").alias("container_id"), "kind", "source", F.col("start_s").alias("b0"), F.col("end_s").alias("b1"), F.explode(F.sequence(F.floor(F.col("start_s") / 3600), F.floor(F.col("end_s") / 3600))).alias("hour"))
    inside = sessions.withColumn("hour", F.floor(F.col("start_s") / 3600)).join(spans, ["kind", "source", "hour"]).where("id <> container_id and b0 <= start_s and b1 >= end_s and (b0 < start_s or b1 > end_s)")
    best = F.min_by("container_id", F.struct("b0", (-F.col("b1")).alias("e"), "container_id"))
    return inside.groupBy("id").agg(best.alias("container_id"))


def session_statistics(samples: DataFrame, sessions: DataFrame, least: int = 1, share: float = 0.0) -> DataFrame:
    """Mean and maximum of the samples that start in each session, where there are
    enough of them over enough of its length."""
    from pulsegrid.operators.arbitration import in_sessions

    inside = in_sessions(samples, sessions)
    held = inside.groupBy("session_id", "s0", "s1").agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean"), F.max("value").alias("max"), (F.max("start_s") - F.min("start_s")).alias("spread"))
    return held.where((F.col("n") >= least) & (F.col("spread") >= share * (F.col("s1") - F.col("s0")))).select("session_id", "n", "mean", "max")


def not_nested(sessions: DataFrame) -> DataFrame:
    """Sessions of a day that do not lie inside one that started before."""
    order = Window.partitionBy("local_date").orderBy("start_s", F.col("end_s").desc(), "id").rowsBetween(Window.unboundedPreceding, -1)
    return sessions.withColumn("reach", F.max("end_s").over(order)).where("reach is null or end_s > reach").drop("reach")
