"""Twenty-second buckets: interval expansion, cadence, classification and blocks.

An interval is expanded to the buckets it overlaps inside its own row, so expansion
needs no join; sessions are expanded the same way and met by equality on the bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.operators.rollup import r, week_of

BUCKET = 20
LONGEST_SAMPLE = 12 * 3600
# Fixed values of the jog and walk rules.
JOG_CADENCE, PLAUSIBLE_CADENCE, EFFORT_CADENCE, EFFORT_HR, FASTEST_PACE, SLOWEST_PACE = 140, 250, 130, 130, 5, 40
BRIDGE_BUCKETS, BRIDGE_PACE, BLOCK_HR = 2, 18, 150


def expanded(rows: DataFrame, value: str = "value", whole: Column | None = None) -> DataFrame:
    """A row per bucket that an interval overlaps, with its prorated share.

    Intervals of no length, and those for which ``whole`` holds, put everything into
    the bucket they start in.  Intervals of 12 hours and more are left out."""
    rows = rows.where(F.col("end_s") - F.col("start_s") < LONGEST_SAMPLE)
    whole = (F.col("end_s") <= F.col("start_s")) | (F.lit(False) if whole is None else whole)
    first, last = F.floor(F.col("start_s") / BUCKET), F.floor((F.col("end_s") - 1) / BUCKET)
    spread = rows.withColumn("__whole", whole).withColumn("bkt", F.explode(F.when(F.col("__whole"), F.array(first)).otherwise(F.sequence(first, last))))
    overlap = F.least("end_s", (F.col("bkt") + 1) * BUCKET) - F.greatest("start_s", F.col("bkt") * BUCKET)
    share = F.when(F.col("__whole"), F.col(value)).otherwise(F.col(value) * overlap / (F.col("end_s") - F.col("start_s")))
    return spread.withColumn("share", share).drop("__whole")


def cadence(steps: DataFrame) -> DataFrame:
    """Steps a minute of each bucket: the largest source's prorated sum, times 3."""
    by_source = expanded(steps).groupBy("bkt", "source").agg(F.sum("share").alias("s"))
    return by_source.groupBy("bkt").agg(r(F.max("s") * 3).alias("cadence"))


def session_buckets(sessions: DataFrame) -> DataFrame:
    """Buckets whose start lies in some session."""
    first = F.ceil(F.col("start_s") / BUCKET)
    last = F.ceil(F.col("end_s") / BUCKET) - 1
    return sessions.where(last >= first).select(F.explode(F.sequence(first, last)).alias("bkt")).distinct()


def jog(in_session: Column, pace: Column, cadence_: Column, hr: Column, least: float = JOG_CADENCE) -> Column:
    """Whether a bucket is jogged; unknown cadence is not, unknown pace does not matter."""
    fast = pace.isNull() | (pace >= FASTEST_PACE)
    steady = cadence_ >= least
    effort = (cadence_ >= EFFORT_CADENCE) & (hr >= EFFORT_HR)
    return F.coalesce(in_session & fast & (cadence_ <= PLAUSIBLE_CADENCE) & (steady | F.coalesce(effort, F.lit(False))), F.lit(False))


def impact_buckets(distance: DataFrame, steps: DataFrame, heart: DataFrame, sessions: DataFrame, cutoff: str | None = None, least: float = JOG_CADENCE) -> DataFrame:
    """Classified buckets with distance.

    Distance from ``cutoff`` on is prorated, before it stays whole.  Heart rate is the
    mean of samples that start in the bucket, by day; cadence joins by bucket alone."""
    whole = F.lit(False) if cutoff is None else F.col("local_date") < F.lit(cutoff).cast("date")
    dist = expanded(distance, whole=whole).groupBy("local_date", "bkt").agg(r(F.sum("share"), 9).alias("mi")).where("mi > 0")
    hr = heart.groupBy("local_date", F.floor(F.col("start_s") / BUCKET).alias("bkt")).agg(r(F.avg("value")).alias("hr"))
    inside = session_buckets(sessions).withColumn("in_session", F.lit(True))
    joined = dist.join(hr, ["local_date", "bkt"], "left").join(cadence(steps), "bkt", "left").join(inside, "bkt", "left")
    joined = joined.withColumn("in_session", F.coalesce("in_session", F.lit(False))).withColumn("pace", r(F.lit(BUCKET / 60) / F.col("mi")))
    joined = joined.withColumn("is_jog", jog(F.col("in_session"), F.col("pace"), F.col("cadence"), F.col("hr"), least))
    walk = ~F.col("is_jog") & (F.col("mi") >= F.lit(1 / 3) / SLOWEST_PACE) & (F.col("mi") <= F.lit(1 / 3) / FASTEST_PACE)
    return joined.withColumn("is_walk", walk)


def volume(buckets: DataFrame, by: str = "week") -> DataFrame:
    """Minutes and distance jogged and walked by day or week, with the change in jogged minutes."""
    period = week_of("local_date") if by == "week" else F.col("local_date")
    minutes = lambda flag: F.round(F.sum(F.when(F.col(flag), 1).otherwise(0)) / 3, 1)
    out = buckets.groupBy(period.alias("period")).agg(minutes("is_jog").alias("jog_min"), minutes("is_walk").alias("walk_min"), r(F.sum(F.when(F.col("is_jog"), F.col("mi")).otherwise(0.0)), 4).alias("jog_mi"), F.count("*").alias("n_buckets"))
    before = F.lag("jog_min").over(Window.orderBy("period"))  # a row per day or week at most
    return out.withColumn("before", before).withColumn("jog_change_pct", F.when(F.col("before") != 0, F.round((F.col("jog_min") - F.col("before")) * 100 / F.col("before"), 1))).drop("before")


def blocks(buckets: DataFrame, flag: str = "is_jog", bridge: str | None = None) -> DataFrame:
    """Maximal runs of flagged buckets of a day, bridged over up to two buckets that are
    all there and all fit for bridging.  Bridges count into a block's length."""
    day = Window.partitionBy("local_date").orderBy("bkt")
    joined = F.col(flag)
    if bridge is not None:
        before, after = F.col(flag) & F.lit(True), F.col(bridge) & ~F.col(flag)
        step = lambda k: F.lag("bkt", k).over(day) == F.col("bkt") - k
        ahead = lambda k: F.lead("bkt", k).over(day) == F.col("bkt") + k
        is_on = lambda k: F.coalesce((F.lag(flag, k) if k > 0 else F.lead(flag, -k)).over(day) & (step(k) if k > 0 else ahead(-k)), F.lit(False))
        fit = lambda k: F.coalesce((F.lag(bridge, k) if k > 0 else F.lead(bridge, -k)).over(day) & (step(k) if k > 0 else ahead(-k)), F.lit(False))
        one = is_on(1) & is_on(-1)
        two = (is_on(1) & fit(-1) & ~is_on(-1) & is_on(-2)) | (is_on(2) & fit(1) & ~is_on(1) & is_on(-1))
        joined = before | (after & (one | two))
    held = buckets.withColumn("__in", joined).where("__in")
    island = F.col("bkt") - F.row_number().over(day)
    return held.withColumn("island", island).groupBy("local_date", "island").agg(F.min("bkt").alias("first_bkt"), F.max("bkt").alias("last_bkt"), F.count("*").alias("n"), r(F.avg("hr")).alias("mean_hr")).withColumn("minutes", r(F.col("n") / 3, 4)).drop("island")


def longest_blocks(found: DataFrame, ceiling: float = BLOCK_HR) -> DataFrame:
    """Longest block of each day, and the longest whose mean heart rate stays under the ceiling."""
    return found.groupBy("local_date").agg(F.max("minutes").alias("longest_min"), F.max(F.when(F.col("mean_hr") <= ceiling, F.col("minutes"))).alias("qualified_min"))


def zone_minutes(samples: DataFrame, edges: list[float], window: list[str], max_gap: int = 60) -> DataFrame:
    """Minutes by band: a sample owns the time to the next one, 60 seconds at most."""
    order = Window.partitionBy(*window).orderBy("start_s", "id")
    owned = F.least(F.lead("start_s").over(order) - F.col("start_s"), F.lit(max_gap))
    band = F.lit(len(edges))
    for k, edge in reversed(list(enumerate(edges))):
        band = F.when(F.col("value") <= edge, k).otherwise(band)
    held = samples.withColumn("owned", F.coalesce(owned, F.lit(max_gap))).withColumn("band", band)
    return held.groupBy(*window, "band").agg(r(F.sum("owned") / 60, 4).alias("minutes"), F.count("*").alias("n"))
