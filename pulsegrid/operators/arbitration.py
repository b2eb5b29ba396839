"""Which of several sources counts when they measured the same thing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DAY, HOUR = 86400, 3600


def day_losers(records: DataFrame, cutoff: str) -> DataFrame:
    """Phone samples of days, from the cutoff on, on which a watch wrote too."""
    watch = records.where((F.col("source") == "watch") & (F.col("local_date") >= F.lit(cutoff).cast("date"))).select("metric", "local_date").distinct()
    return records.where(F.col("source") == "phone").join(watch, ["metric", "local_date"], "left_semi")


def in_sessions(records: DataFrame, sessions: DataFrame) -> DataFrame:
    """Samples with each session that their start lies in.

    Sessions are laid over the hours they touch, so the range condition is met by
    equality on the hour first."""
    hours = F.explode(F.sequence(F.floor(F.col("start_s") / 3600), F.floor((F.col("end_s") - 1) / 3600)))
    spans = sessions.where("end_s > start_s").select(F.col("id").alias("session_id"), F.col("start_s").alias("s0"), F.col("end_s").alias("s1"), hours.alias("hour"))
    return records.withColumn("hour", F.floor(F.col("start_s") / 3600)).join(spans, "hour").where("start_s >= s0 and start_s < s1").drop("hour")


def session_losers(records: DataFrame, sessions: DataFrame) -> DataFrame:
    """Phone samples in a session with watch or mirror samples, and watch samples in one
    with mirror samples.

    A session that holds a sample and a rival of its metric also holds the nearest rival
    before or after the sample.  So the work grows with samples and sessions, not with their
    pairs: of the sessions that began by a sample's time the one that ends last has to reach
    the next rival, or of those that end after it the one that began first the last rival."""
    hour = F.floor(F.col("start_s") / HOUR).alias("hour")
    samples = records.where("metric is not null and start_s is not null and source in ('phone', 'watch', 'mirror')").select("id", "metric", "source", F.col("start_s").alias("t"), hour)
    ways = {"any": F.col("source") != "phone", "mirror": F.col("source") == "mirror"}
    # what other hours hold of a metric, in a row an hour
    hourly = samples.groupBy("metric", "hour").agg(*[f(F.when(on, F.col("t"))).alias(f"{end}_{name}") for name, on in ways.items() for f, end in ((F.max, "last"), (F.min, "first"))])
    earlier = Window.partitionBy("metric").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("metric").orderBy(F.col("hour").desc()).rowsBetween(Window.unboundedPreceding, -1)
    beyond = hourly.select("metric", "hour", *[c for name in ways for c in (F.max(f"last_{name}").over(earlier).alias(f"before_{name}"), F.min(f"first_{name}").over(later).alias(f"after_{name}"))])
    # a session opens and closes in every hour that it touches
    touched = F.explode(F.sequence(F.floor(F.col("start_s") / HOUR), F.floor((F.col("end_s") - 1) / HOUR))).alias("hour")
    laid = sessions.where("end_s > start_s").select("start_s", "end_s", touched)
    opening = laid.select("hour", F.greatest("start_s", F.col("hour") * HOUR).alias("t"), F.lit(-1).alias("turn"), F.col("end_s").alias("until"))
    closing = laid.select("hour", F.least("end_s", (F.col("hour") + 1) * HOUR).alias("t"), F.lit(1).alias("turn"), F.col("start_s").alias("since"))
    points = samples.withColumn("turn", F.lit(0))
    for more in (opening, closing, beyond):
        points = points.unionByName(more, allowMissingColumns=True)
    up, down = Window.partitionBy("hour").orderBy("t", "turn"), Window.partitionBy("hour").orderBy(F.col("t").desc(), "turn")
    reach = points.withColumns({"reach": F.max("until").over(up.rowsBetween(Window.unboundedPreceding, 0)), "start": F.min("since").over(down.rowsBetween(Window.unboundedPreceding, 0))})
    same = Window.partitionBy("metric", "hour")

    def met(name: str, on: Column) -> Column:
        at = F.when(on, F.col("t"))
        before = F.greatest(F.max(at).over(same.orderBy("t")), F.max(f"before_{name}").over(same))
        after = F.least(F.min(at).over(same.orderBy(F.col("t").desc())), F.min(f"after_{name}").over(same))
        return F.coalesce(F.col("start") <= before, F.lit(False)) | F.coalesce(F.col("reach") > after, F.lit(False))

    judged = reach.where("metric is not null").withColumns({name: met(name, on) for name, on in ways.items()})
    return judged.where("(source = 'phone' and any) or (source = 'watch' and mirror)").select("id").distinct()


def mirror_losers(records: DataFrame, cutoff: str) -> DataFrame:
    """On days with mirrored and other samples the mirrored ones lose from the cutoff
    on, the others before it."""
    mirrored = F.col("source") == "mirror"
    both = records.groupBy("metric", "local_date").agg(F.max(mirrored).alias("m"), F.max(~mirrored).alias("o")).where("m and o").select("metric", "local_date")
    late = F.col("local_date") >= F.lit(cutoff).cast("date")
    return records.where(mirrored == late).join(both, ["metric", "local_date"], "left_semi")


def ceiling_losers(records: DataFrame, ceiling: float) -> DataFrame:
    """Samples above the ceiling on days that also have samples at or under it."""
    plausible = records.where(F.col("value") <= ceiling).select("metric", "local_date").distinct()
    return records.where(F.col("value") > ceiling).join(plausible, ["metric", "local_date"], "left_semi")


def survivors(records: DataFrame, *losers: DataFrame) -> DataFrame:
    """Records without those in any of the losing sets."""
    lost = losers[0].select("id")
    for more in losers[1:]:
        lost = lost.unionByName(more.select("id"))
    return records.join(lost.distinct(), "id", "left_anti")
