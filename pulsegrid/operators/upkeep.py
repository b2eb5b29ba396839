"""Keeping stored tables right over time: watermarks, marks, tombstones, enrichment and
stale derivations, and what is read from them by month or by session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.operators.arbitration import in_sessions
from pulsegrid.operators.buckets import BUCKET
from pulsegrid.operators.rollup import r

#: Buckets of a continuous block that pass before power has settled: three minutes.
#: Fixed value: buckets of a block before its power counts, three minutes.
POWER_LAG = 9


def behind(records: DataFrame, allowed: list[str], through: str | None) -> DataFrame:
    """Raw rows of series that are not kept raw, on or before the watermark's day.

    Without a watermark there is no boundary and no such row."""
    held = ~F.col("metric").isin(allowed)
    return records.where(held & (F.lit(False) if through is None else F.col("local_date") <= F.lit(through).cast("date")))


def compaction_status(records: DataFrame, allowed: list[str], through: str | None) -> DataFrame:
    """One row: raw rows of series that are not kept raw, how many lie behind the
    watermark, and the state that follows."""
    late = F.lit(False) if through is None else F.col("local_date") <= F.lit(through).cast("date")
    counts = records.where(~F.col("metric").isin(allowed)).agg(F.count("*").alias("raw_total"), F.count_if(late).alias("raw_behind"))
    state = F.lit("never_compacted") if through is None else F.when(F.col("raw_behind") > 0, "compacted_violated").otherwise("compacted_clean")
    return counts.withColumn("status", state)


def sample_key(name: Column) -> Column:
    """The first 64 bits of the SHA-256 of a sample's name, in hex."""
    return F.substring(F.sha2(name.cast("string"), 256), 1, 16)


def compacted_keys(rows: DataFrame, name: str) -> DataFrame:
    """``key``, ``metric`` and ``local_date`` by which samples that no longer exist are known."""
    return rows.select(sample_key(F.col(name)).alias("key"), "metric", F.col("local_date").alias("stored_date")).dropDuplicates(["key"])


def offered_again(rows: DataFrame, name: str, compacted: DataFrame) -> DataFrame:
    """Rows whose sample was compacted away already, with the day that holds it.

    Rows without a name were never compacted."""
    return rows.withColumn("key", sample_key(F.col(name))).join(compacted.select("key", "stored_date"), "key")


def marked(sessions: DataFrame, marks: DataFrame, key: str, want: bool = True) -> DataFrame:
    """Sessions that have a mark, or (``want`` false) those that have none.

    Marks may repeat; a session without a key has none."""
    return sessions.join(marks.select(key), key, "left_semi" if want else "left_anti")


def weather_of(sessions: DataFrame, samples: DataFrame) -> DataFrame:
    """Means and extremes of the usable samples (``dew`` known) inside each session;
    sessions without one are left out."""
    inside = in_sessions(samples.where(F.col("dew").isNotNull()), sessions)
    return inside.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("n_samples"), r(F.avg("temp")).alias("temp"), F.max("temp").alias("temp_max"), r(F.avg("dew")).alias("dew"), F.max("dew").alias("dew_max"))


def unsettled(sessions: DataFrame, status: DataFrame, routes: DataFrame) -> DataFrame:
    """Sessions that enrichment has to visit: never seen, pending, or without a route
    then that have one now.  ``status`` has one row an id, ``routes`` any number."""
    routed = routes.select("id").distinct().withColumn("routed", F.lit(True))
    held = sessions.join(status, "id", "left").join(routed, "id", "left")
    late = (F.col("status") == "no_route") & F.coalesce("routed", F.lit(False))
    return held.where(F.col("status").isNull() | (F.col("status") == "pending") | late).drop("routed")


def settled_in_runs(runs: DataFrame, buckets: DataFrame, flag: str = "is_jog", lag: int = POWER_LAG) -> DataFrame:
    """Flagged buckets of each run (``id``, ``local_date``, ``bkt``, ``pace``) that come at
    least ``lag`` buckets after their block began.

    Only the run's own window is looked at: a block that it starts in begins there.  A
    flagged bucket right after one without the flag has waited one bucket already; after a
    gap, or first in the run, it hasn't waited at all.  A bucket after midnight may have a row
    of each day; the earlier day's comes first, so that reruns agree."""
    first, last = F.ceil(F.col("start_s") / BUCKET), F.ceil(F.col("end_s") / BUCKET) - 1
    laid = runs.where(last >= first).select("id", F.explode(F.sequence(first, last)).alias("bkt"))
    own = laid.join(buckets.select("local_date", "bkt", "pace", F.col(flag).alias("on")), "bkt")
    run, upto = Window.partitionBy("id").orderBy("bkt", "local_date"), Window.partitionBy("id").orderBy("bkt")
    beside = F.coalesce(F.lag("bkt").over(run) == F.col("bkt") - 1, F.lit(False))
    opens = F.col("on") & ~(beside & F.coalesce(F.lag("on").over(run), F.lit(False)))
    block = own.withColumns({"opens": opens, "beside": beside}).withColumn("block", F.count_if("opens").over(upto)).where("on")
    # the rows of one bucket are in one block, which waits by the first of them
    waited = F.first("beside").over(Window.partitionBy("id", "block").orderBy("bkt", "local_date")).cast("int")
    elapsed = F.col("bkt") - F.min("bkt").over(Window.partitionBy("id", "block")) + waited
    return block.withColumn("elapsed", elapsed).where(F.col("elapsed") >= lag).select("id", "local_date", "bkt", "pace")


def run_power(runs: DataFrame, buckets: DataFrame, power: DataFrame, low: float, high: float, flag: str = "is_jog", lag: int = POWER_LAG) -> DataFrame:
    """Mean power of each run over its settled buckets in a band of pace.

    Runs are laid over their buckets, power is averaged by day and bucket, and both meet
    by equality.  ``runs`` are those that count as evidence: outdoors, with a route."""
    by_bucket = power.groupBy("local_date", F.floor(F.col("start_s") / BUCKET).alias("bkt")).agg(F.avg("value").alias("power"))
    settled = settled_in_runs(runs, buckets, flag, lag).where(F.col("pace").between(low, high))
    return settled.join(by_bucket, ["local_date", "bkt"]).groupBy("id").agg(F.avg("power").alias("power"), F.count("*").alias("n_buckets"))


def monthly_power(runs: DataFrame, powers: DataFrame, least: int = 2) -> DataFrame:
    """Mean of the runs' means by month, null with fewer than ``least`` runs.

    Of runs with power, one that lies inside an earlier one does not count again."""
    held = runs.join(powers, "id").select("id", "start_s", "end_s", "local_date", "power")
    hours = F.explode(F.sequence(F.floor(F.col("start_s") / 3600), F.floor(F.col("end_s") / 3600)))
    outer = held.select(F.col("id").alias("o_id"), F.col("start_s").alias("o_start"), F.col("end_s").alias("o_end"), hours.alias("hour"))
    earlier = F.struct("o_start", "o_id") < F.struct("start_s", "id")
    inner = held.withColumn("hour", F.floor(F.col("start_s") / 3600)).join(outer, "hour").where((F.col("o_start") <= F.col("start_s")) & (F.col("end_s") <= F.col("o_end")) & earlier)
    alone = held.join(inner.select("id").distinct(), "id", "left_anti")
    month = F.trunc("local_date", "month").alias("month")
    return alone.groupBy(month).agg(F.count("*").alias("n_runs"), F.when(F.count("*") >= least, r(F.avg("power"), 2)).alias("power"))


def version_report(derived: DataFrame, version: int, needs: DataFrame, records: DataFrame) -> DataFrame:
    """Counts of derived rows by metric: made by this version, stale with all sources
    there, and stale without.

    ``needs`` lists the source metrics of each derived metric."""
    n_needs = needs.groupBy("metric").agg(F.count("*").alias("wanted"))
    there = records.select(F.col("metric").alias("source_metric"), F.col("local_date").alias("date")).distinct()
    stale = derived.where(~F.col("version").eqNullSafe(version)).select("metric", "date").distinct()
    met = stale.join(needs, "metric").join(there, ["source_metric", "date"]).groupBy("metric", "date").agg(F.count("*").alias("found"))
    held = derived.join(n_needs, "metric", "left").join(met, ["metric", "date"], "left")
    fresh = F.col("version").eqNullSafe(version)
    whole = F.coalesce(F.col("found") == F.col("wanted"), F.lit(False))
    return held.groupBy("metric").agg(F.count_if(fresh).alias("fresh"), F.count_if(~fresh & whole).alias("stale"), F.count_if(~fresh & ~whole).alias("unrecomputable"))


def days_to_reconcile(touched: DataFrame, session_days: DataFrame, heart: str) -> DataFrame:
    """Days that a batch touched or has sessions on, and the day before each day of heart
    samples: a session that runs past midnight is dated by its start."""
    days = touched.select(F.explode(F.when(F.col("metric") == heart, F.array("local_date", F.date_sub("local_date", 1))).otherwise(F.array("local_date"))).alias("local_date"))
    return days.unionByName(session_days.select("local_date")).where("local_date is not null").distinct()


def days_to_rederive(records: DataFrame, raw: list[str], sessions: DataFrame, derived: DataFrame) -> DataFrame:
    """Days with raw inputs, with sessions, or with a derived row left over."""
    days = records.where(F.col("metric").isin(raw)).select(F.col("local_date").alias("date"))
    return days.unionByName(sessions.select(F.col("local_date").alias("date"))).unionByName(derived.select("date")).where("date is not null").distinct()


def disagreements(claims: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest claim of each key where statement and computation differ, with the delta
    (positive: more was computed than stated)."""
    rest = [c for c in claims.columns if c not in keys]
    latest = claims.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("c")).select(*keys, "c.*")
    return latest.where(~F.col("agrees")).withColumn("delta", F.round(F.col("computed") - F.col("stated"), 6))


def revisions(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Dictionary of the different combinations of columns: a key made from their JSON,
    so that it needs no numbering and agrees between loads, with counts and first use."""
    text = F.to_json(F.struct(*columns))
    return rows.groupBy(text.alias("revision")).agg(F.count("*").alias("n"), F.min(order).alias("first_id")).withColumn("revision_key", F.md5("revision"))


def stale_days(derived: DataFrame, version: int, needs: DataFrame, records: DataFrame) -> DataFrame:
    """Days on which some derived row has another version and all its sources are there."""
    n_needs = needs.groupBy("metric").agg(F.count("*").alias("wanted"))
    there = records.select(F.col("metric").alias("source_metric"), F.col("local_date").alias("date")).distinct()
    old = derived.where(~F.col("version").eqNullSafe(version)).select("metric", "date").distinct()
    met = old.join(needs, "metric").join(there, ["source_metric", "date"]).groupBy("metric", "date").agg(F.count("*").alias("found"))
    return met.join(n_needs, "metric").where("found = wanted").select("date").distinct()
