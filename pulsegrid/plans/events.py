"""Queries over samples and sessions: buckets, arbitration, matching, folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import arbitration, buckets, folds, history, ledger, matching, rollup, sleep
from pulsegrid.operators import training
from pulsegrid.plans.daily import long_series, short_series
from pulsegrid.plans.registry import query, views
from pulsegrid.sources.adapters import DAILY_LONG, DAILY_SHORT, RECORDS, SERIES, SERIES_LONG, SESSIONS, records, sessions, table

EVENTS = views(RECORDS, SESSIONS)
CUTOFF = "2024-01-10"


def _parts(spark, sf_dir):
    """Distance, steps and heart rate read out of three event types."""
    rows = records(spark, sf_dir)
    distance = rows.where("metric = 'click'").withColumn("value", F.round(F.col("value") / 1000, 6))
    steps = rows.where("metric = 'view'").withColumn("value", F.round(F.col("value") * 2, 6))
    return distance, steps, rows.where("metric = 'purchase'").withColumn("value", F.col("value") + 80), sessions(spark, sf_dir)


BUCKETS = f""", d AS (SELECT *, round(value / 1000, 6) AS v FROM records WHERE metric = 'click'),
dx AS (SELECT local_date, start_s // 20 AS bkt, v AS share FROM d WHERE local_date < DATE '{CUTOFF}'
  UNION ALL SELECT local_date, b, v * (least(end_s, (b + 1) * 20) - greatest(start_s, b * 20)) / (end_s - start_s)
  FROM (SELECT *, unnest(range(start_s // 20, (end_s - 1) // 20 + 1)) AS b FROM d WHERE local_date >= DATE '{CUTOFF}')),
dist AS (SELECT local_date, bkt, round(sum(share), 9) AS mi FROM dx GROUP BY 1, 2 HAVING round(sum(share), 9) > 0),
hr AS (SELECT local_date, start_s // 20 AS bkt, round(avg(value + 80), 6) AS hr FROM records WHERE metric = 'purchase' GROUP BY 1, 2),
st AS (SELECT b AS bkt, source, sum(round(value * 2, 6) * (least(end_s, (b + 1) * 20) - greatest(start_s, b * 20)) / (end_s - start_s)) AS s
  FROM (SELECT *, unnest(range(start_s // 20, (end_s - 1) // 20 + 1)) AS b FROM records WHERE metric = 'view') GROUP BY 1, 2),
cad AS (SELECT bkt, round(max(s) * 3, 6) AS cadence FROM st GROUP BY 1),
j AS (SELECT local_date, bkt, mi, hr, cadence, EXISTS (SELECT 1 FROM sessions w WHERE w.start_s <= bkt * 20 AND bkt * 20 < w.end_s) AS in_session, round((20 / 60.0::DOUBLE) / mi, 6) AS pace
  FROM dist LEFT JOIN hr USING (local_date, bkt) LEFT JOIN cad USING (bkt)),
buckets AS (SELECT *, coalesce(in_session AND pace >= 5 AND cadence <= 250 AND (cadence >= LEAST OR coalesce(cadence >= 130 AND hr >= 130, false)), false) AS is_jog FROM j),
classified AS (SELECT *, NOT is_jog AND mi >= (1 / 3.0::DOUBLE) / 40 AND mi <= (1 / 3.0::DOUBLE) / 5 AS is_walk FROM buckets)
"""


def _bucketed(spark, sf_dir, least=60):
    return buckets.impact_buckets(*_parts(spark, sf_dir), cutoff=CUTOFF, least=least)


def _bucket_sql(least: int = 60) -> str:
    return EVENTS + BUCKETS.replace("LEAST", str(least))


@query(_bucket_sql() + "SELECT local_date, bkt, mi, hr, cadence, in_session, pace, is_jog, is_walk FROM classified")
def impact_buckets(spark, sf_dir):
    return _bucketed(spark, sf_dir).select("local_date", "bkt", "mi", "hr", "cadence", "in_session", "pace", "is_jog", "is_walk")


@query(_bucket_sql() + "SELECT * FROM cad")
def impact_cadence_max_source(spark, sf_dir):
    return buckets.cadence(_parts(spark, sf_dir)[1])


def _volume_sql(least: int) -> str:
    return f"""SELECT {least} AS least, period, jog_min, walk_min, jog_mi, n_buckets, CASE WHEN before <> 0 THEN round((jog_min - before) * 100 / before, 1) END AS jog_change_pct FROM (
  SELECT *, lag(jog_min) OVER (ORDER BY period) AS before FROM (SELECT CAST(date_trunc('week', local_date) AS DATE) AS period, round(count(*) FILTER (is_jog) / 3, 1) AS jog_min, round(count(*) FILTER (is_walk) / 3, 1) AS walk_min,
  round(sum(CASE WHEN is_jog THEN mi ELSE 0.0 END), 4) AS jog_mi, count(*) AS n_buckets FROM classified GROUP BY 1))"""


@query(_bucket_sql(60) + _volume_sql(60).replace("60 AS least, ", ""))
def impact_volume_week(spark, sf_dir):
    return buckets.volume(_bucketed(spark, sf_dir))


SENSITIVITY = (40, 80, 120)


@query("SELECT * FROM (" + ") UNION ALL SELECT * FROM (".join(_bucket_sql(k) + _volume_sql(k) for k in SENSITIVITY) + ")")
def impact_sensitivity(spark, sf_dir):
    out = None
    for k in SENSITIVITY:
        one = buckets.volume(_bucketed(spark, sf_dir, k)).withColumn("least", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


ISLANDS = """, f AS (SELECT local_date, bkt, hr, is_walk OR is_jog AS f, NOT (is_walk OR is_jog) AND pace BETWEEN 1 AND 18 AS g FROM classified),
e AS (SELECT local_date AS d, bkt AS b, f, g, FLAG AS inn, hr FROM f),
i AS (SELECT d, b, hr, b - row_number() OVER (PARTITION BY d ORDER BY b) AS island FROM e WHERE inn),
blocks AS (SELECT d AS local_date, min(b) AS first_bkt, max(b) AS last_bkt, count(*) AS n, round(avg(hr), 6) AS mean_hr, round(count(*) / 3, 4) AS minutes FROM i GROUP BY d, island)
"""
BRIDGED = """f OR (g AND ((EXISTS (SELECT 1 FROM f p WHERE p.local_date = f.local_date AND p.bkt = f.bkt - 1 AND p.f) AND EXISTS (SELECT 1 FROM f p WHERE p.local_date = f.local_date AND p.bkt = f.bkt + 1 AND p.f))
  OR (EXISTS (SELECT 1 FROM f p WHERE p.local_date = f.local_date AND p.bkt = f.bkt - 1 AND p.f) AND EXISTS (SELECT 1 FROM f p WHERE p.local_date = f.local_date AND p.bkt = f.bkt + 1 AND p.g AND NOT p.f) AND EXISTS (SELECT 1 FROM f p WHERE p.local_date = f.local_date AND p.bkt = f.bkt + 2 AND p.f))
  OR (EXISTS (SELECT 1 FROM f p WHERE p.local_date = f.local_date AND p.bkt = f.bkt - 2 AND p.f) AND EXISTS (SELECT 1 FROM f p WHERE p.local_date = f.local_date AND p.bkt = f.bkt - 1 AND p.g AND NOT p.f) AND EXISTS (SELECT 1 FROM f p WHERE p.local_date = f.local_date AND p.bkt = f.bkt + 1 AND p.f))))"""


def _flagged(spark, sf_dir):
    rows = _bucketed(spark, sf_dir).withColumn("foot", F.col("is_walk") | F.col("is_jog"))
    return rows.withColumn("fit", ~F.col("foot") & F.col("pace").between(1, 18))


@query(_bucket_sql() + ISLANDS.replace("FLAG", "f") + "SELECT local_date, max(minutes) AS longest_min, max(CASE WHEN mean_hr <= 150 THEN minutes END) AS qualified_min FROM blocks GROUP BY 1")
def longest_block(spark, sf_dir):
    return buckets.longest_blocks(buckets.blocks(_flagged(spark, sf_dir), "foot"))


@query(_bucket_sql() + ISLANDS.replace("FLAG", BRIDGED) + "SELECT * FROM blocks")
def bridged_blocks(spark, sf_dir):
    return buckets.blocks(_flagged(spark, sf_dir), "foot", "fit")


@query(
    views(RECORDS)
    + """, s AS (SELECT *, least(lead(start_s) OVER (PARTITION BY local_date ORDER BY start_s, id) - start_s, 60) AS owned FROM records WHERE metric = 'purchase')
SELECT local_date, CASE WHEN value <= 20 THEN 0 WHEN value <= 50 THEN 1 WHEN value <= 150 THEN 2 ELSE 3 END AS band, round(sum(coalesce(owned, 60)) / 60, 4) AS minutes, count(*) AS n FROM s GROUP BY 1, 2"""
)
def hr_zone_minutes(spark, sf_dir):
    return buckets.zone_minutes(records(spark, sf_dir).where("metric = 'purchase'"), [20, 50, 150], ["local_date"])


DAY_LOSERS = f"SELECT id FROM records r WHERE source = 'phone' AND EXISTS (SELECT 1 FROM records w WHERE w.metric = r.metric AND w.local_date = r.local_date AND w.source = 'watch' AND w.local_date >= DATE '{CUTOFF}')"
SESSION_LOSERS = """SELECT DISTINCT r.id FROM records r JOIN sessions w ON r.start_s >= w.start_s AND r.start_s < w.end_s
WHERE (r.source = 'phone' AND EXISTS (SELECT 1 FROM records o WHERE o.metric = r.metric AND o.source IN ('watch', 'mirror') AND o.start_s >= w.start_s AND o.start_s < w.end_s))
   OR (r.source = 'watch' AND EXISTS (SELECT 1 FROM records o WHERE o.metric = r.metric AND o.source = 'mirror' AND o.start_s >= w.start_s AND o.start_s < w.end_s))"""


@query(views(RECORDS) + DAY_LOSERS)
def arbitration_day_losers(spark, sf_dir):
    return arbitration.day_losers(records(spark, sf_dir), CUTOFF).select("id")


@query(EVENTS + SESSION_LOSERS)
def arbitration_session_losers(spark, sf_dir):
    return arbitration.session_losers(records(spark, sf_dir), sessions(spark, sf_dir))


@query(
    EVENTS
    + f""", lost AS ({DAY_LOSERS} UNION {SESSION_LOSERS})
SELECT metric, local_date, count(*) AS count, round(sum(value), 6) AS sum FROM records WHERE id NOT IN (SELECT id FROM lost) GROUP BY 1, 2"""
)
def arbitrated_rollup(spark, sf_dir):
    rows, spans = records(spark, sf_dir), sessions(spark, sf_dir)
    left = arbitration.survivors(rows, arbitration.day_losers(rows, CUTOFF), arbitration.session_losers(rows, spans))
    return rollup.daily_rollup(left).select("metric", "local_date", "count", "sum")


@query(
    views(RECORDS)
    + f"""SELECT id FROM records r WHERE (source = 'mirror') = (local_date >= DATE '{CUTOFF}')
  AND EXISTS (SELECT 1 FROM records o WHERE o.metric = r.metric AND o.local_date = r.local_date AND o.source = 'mirror') AND EXISTS (SELECT 1 FROM records o WHERE o.metric = r.metric AND o.local_date = r.local_date AND o.source <> 'mirror')"""
)
def mirror_cutoff(spark, sf_dir):
    return arbitration.mirror_losers(records(spark, sf_dir), CUTOFF).select("id")


@query(views(RECORDS) + "SELECT metric, local_date, count(*) AS n_dropped FROM records r WHERE value > 150 AND EXISTS (SELECT 1 FROM records o WHERE o.metric = r.metric AND o.local_date = r.local_date AND o.value <= 150) GROUP BY 1, 2")
def sample_ceiling(spark, sf_dir):
    return arbitration.ceiling_losers(records(spark, sf_dir), 150).groupBy("metric", "local_date").agg(F.count("*").alias("n_dropped"))


ITEMS = ", items AS (SELECT id + 7000000 AS id, source, start_s + id % 11 * 30 AS start_s, end_s - id % 5 * 40 AS end_s FROM sessions)"


def _items(spans):
    return spans.select((F.col("id") + 7000000).alias("id"), "source", (F.col("start_s") + F.col("id") % 11 * 30).alias("start_s"), (F.col("end_s") - F.col("id") % 5 * 40).alias("end_s"))


@query(
    EVENTS
    + ITEMS
    + """, o AS (SELECT i.id AS item_id, s.id AS parent_id, i.source = s.source AS same, least(i.end_s, s.end_s) - greatest(i.start_s, s.start_s) AS overlap, i.end_s - i.start_s AS a, s.end_s - s.start_s AS b
  FROM items i JOIN sessions s ON i.start_s < s.end_s AND s.start_s < i.end_s)
SELECT item_id, parent_id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, same DESC, parent_id) AS k FROM o WHERE overlap >= 0.9 * a AND overlap >= 0.9 * b) WHERE k = 1"""
)
def session_overlap_match(spark, sf_dir):
    spans = sessions(spark, sf_dir)
    return matching.best_overlap(_items(spans), spans)


@query(
    EVENTS
    + """SELECT id, container_id FROM (SELECT a.id, b.id AS container_id, row_number() OVER (PARTITION BY a.id ORDER BY b.start_s, b.end_s DESC, b.id) AS k FROM sessions a JOIN sessions b
  ON a.kind = b.kind AND a.source = b.source AND a.id <> b.id AND b.start_s <= a.start_s AND b.end_s >= a.end_s AND (b.start_s < a.start_s OR b.end_s > a.end_s)) WHERE k = 1"""
)
def session_containment(spark, sf_dir):
    return matching.hourly_containers(sessions(spark, sf_dir))


@query(
    EVENTS
    + """SELECT s.id AS session_id, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS max FROM sessions s JOIN records r ON r.metric = 'purchase' AND r.start_s >= s.start_s AND r.start_s < s.end_s
GROUP BY s.id, s.start_s, s.end_s HAVING count(*) >= 2 AND max(r.start_s) - min(r.start_s) >= 0.2 * (s.end_s - s.start_s)"""
)
def session_hr_reconcile(spark, sf_dir):
    return matching.session_statistics(records(spark, sf_dir).where("metric = 'purchase'"), sessions(spark, sf_dir), 2, 0.2)


@query(
    EVENTS
    + """, kept AS (SELECT * FROM (SELECT *, max(end_s) OVER (PARTITION BY local_date ORDER BY start_s, end_s DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sessions) WHERE reach IS NULL OR end_s > reach),
m AS (SELECT k.local_date, k.id, (k.end_s - k.start_s) / 60 AS minutes, avg(r.value) AS mean FROM kept k LEFT JOIN records r ON r.metric = 'purchase' AND r.start_s >= k.start_s AND r.start_s < k.end_s GROUP BY 1, 2, 3)
SELECT local_date, count(*) AS n_sessions, round(sum(minutes * mean / 100), 6) AS load, count(mean) = 0 AS unknown FROM m GROUP BY 1"""
)
def session_load(spark, sf_dir):
    kept = matching.not_nested(sessions(spark, sf_dir))
    inside = arbitration.in_sessions(records(spark, sf_dir).where("metric = 'purchase'").select("id", "value", "start_s"), kept.select("id", "start_s", "end_s"))
    means = inside.groupBy(F.col("session_id").alias("id")).agg(F.avg("value").alias("mean"))
    held = kept.join(means, "id", "left").withColumn("minutes", (F.col("end_s") - F.col("start_s")) / 60)
    return held.groupBy("local_date").agg(F.count("*").alias("n_sessions"), F.round(F.sum(F.col("minutes") * F.col("mean") / 100), 6).alias("load"), (F.count("mean") == 0).alias("unknown"))


GAPS = """, g AS (SELECT *, CASE WHEN start_s - max(end_s) OVER w > 5400 THEN 1 WHEN max(end_s) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM records
  WHERE metric = 'error' AND source = 'watch' WINDOW w AS (PARTITION BY metric, source ORDER BY start_s, end_s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT *, sum(new) OVER (PARTITION BY metric, source ORDER BY start_s, end_s, id ROWS UNBOUNDED PRECEDING) AS session FROM g)
"""


def _gapped(spark, sf_dir):
    return matching.gap_sessions(records(spark, sf_dir).where("metric = 'error' and source = 'watch'"), ["metric", "source"])


@query(
    views(RECORDS)
    + GAPS
    + "SELECT metric, source, session, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n, round(sum(value), 6) AS total, round((max(end_s) - min(start_s)) / 60, 4) AS span_min, max(end_s) - min(start_s) > 86400 AS too_long FROM n GROUP BY 1, 2, 3"
)
def gap_sessions(spark, sf_dir):
    return matching.session_spans(_gapped(spark, sf_dir), ["metric", "source"])


@query(views(RECORDS) + GAPS + "SELECT id, session, local_date, DATE '1970-01-01' + CAST(max(end_s) OVER (PARTITION BY session) // 86400 AS INTEGER) AS session_date FROM n")
def session_reattribution(spark, sf_dir):
    return matching.reattributed(_gapped(spark, sf_dir), ["metric", "source"]).select("id", "session", "local_date", "session_date")


@query(EVENTS + "SELECT id, kind, local_date, round((end_s - start_s) / 60, 3) AS minutes FROM sessions ORDER BY (end_s - start_s) DESC, start_s DESC, id LIMIT 25")
def top_sessions(spark, sf_dir):
    return ledger.top_sessions(sessions(spark, sf_dir), 25)


@query(EVENTS + "SELECT kind, count(*) AS n, arg_max(id, struct_pack(a := end_s - start_s, b := -id)) AS id, arg_max(local_date, struct_pack(a := end_s - start_s, b := -id)) AS local_date, max(end_s - start_s) AS seconds FROM sessions GROUP BY 1")
def longest_per_type(spark, sf_dir):
    return ledger.longest_per_kind(sessions(spark, sf_dir))


@query(EVENTS + "SELECT kind, count(*) AS n, round(sum((end_s - start_s) / 60), 3) AS minutes, round(sum((end_s - start_s) / 60) / (SELECT sum((end_s - start_s) / 60) FROM sessions), 4) AS share FROM sessions GROUP BY 1")
def workout_mix(spark, sf_dir):
    return ledger.mix(sessions(spark, sf_dir))


@query(views(RECORDS) + "SELECT metric, count(*) AS n, round(quantile_cont(value, 0.995), 4) AS hr_max FROM records WHERE local_date BETWEEN DATE '2024-01-29' - 364 AND DATE '2024-01-29' GROUP BY 1 HAVING count(*) >= 100")
def hr_max_percentile(spark, sf_dir):
    rows = records(spark, sf_dir).where("local_date between date_sub(date'2024-01-29', 364) and date'2024-01-29'")
    return rows.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.percentile("value", 0.995), 4).alias("hr_max")).where("n >= 100")


# Histories -----------------------------------------------------------------

GAP = 4  # days; the test series have few longer gaps
ERAS = views(DAILY_LONG, SERIES_LONG) + f""", e AS (SELECT *, sum(new) OVER (PARTITION BY metric ORDER BY date ROWS UNBOUNDED PRECEDING) AS era FROM (
  SELECT *, CASE WHEN datediff('day', lag(date) OVER (PARTITION BY metric ORDER BY date), date) <= {GAP} THEN 0 ELSE 1 END AS new FROM series))
"""
ROLL = """, r AS (SELECT *, datediff('day', DATE '1970-01-01', date) AS day FROM e),
roll AS (SELECT *, round(quantile_cont(value, 0.5) OVER w, 4) AS median, count(value) OVER w AS points, sum(CASE WHEN value >= 250000 THEN 1 ELSE 0 END) OVER w AS met, day - min(day) OVER (PARTITION BY metric, era) + 1 >= 30 AS full_window
  FROM r WINDOW w AS (PARTITION BY metric, era ORDER BY day RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)),
good AS (SELECT * FROM roll WHERE full_window AND points >= 21 AND points >= 0.7 * 30)
"""


def _eras(spark, sf_dir):
    return history.eras(long_series(spark, sf_dir), GAP)


@query(ERAS + "SELECT metric, era, min(date) AS first_date, max(date) AS last_date, count(*) AS n, datediff('day', min(date), max(date)) + 1 AS span_days, round(count(*) / (datediff('day', min(date), max(date)) + 1), 6) AS density FROM e GROUP BY 1, 2")
def eras(spark, sf_dir):
    return history.era_summary(_eras(spark, sf_dir))


@query(ERAS + "SELECT metric, era, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.95), 6) AS p95 FROM e GROUP BY 1, 2")
def reference_ranges(spark, sf_dir):
    return history.reference_ranges(_eras(spark, sf_dir))


@query(ERAS + ROLL + "SELECT metric, era, date, median, points FROM (SELECT *, row_number() OVER (PARTITION BY metric, era ORDER BY median DESC, day) AS k FROM good) WHERE k = 1")
def best_sustained(spark, sf_dir):
    return history.best_sustained(_eras(spark, sf_dir))


@query(
    ERAS
    + ROLL
    + """, p AS (SELECT *, sum(fresh) OVER (PARTITION BY metric, era ORDER BY day ROWS UNBOUNDED PRECEDING) AS period FROM (
  SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY metric, era ORDER BY day) <= 30 THEN 0 ELSE 1 END AS fresh FROM good WHERE met >= 0.6 * points))
SELECT metric, era, period, min(date) - 29 AS start, max(date) AS stop, count(*) AS n_windows FROM p GROUP BY 1, 2, 3"""
)
def sustained_periods(spark, sf_dir):
    return history.sustained_periods(_eras(spark, sf_dir), 250000, share=0.6)


@query(
    ERAS
    + """, t AS (SELECT metric, era, CAST(date_trunc('quarter', date) AS DATE) AS period, count(*) AS n, round(avg(value), 4) AS mean FROM e GROUP BY 1, 2, 3),
u AS (SELECT *, round(n / datediff('day', period, CAST(period + INTERVAL 3 MONTH AS DATE)), 6) AS density FROM t)
SELECT metric, era, period, n, density, CASE WHEN density >= 0.6 THEN mean END AS mean FROM u"""
)
def trajectory_quarter(spark, sf_dir):
    return history.trajectory(_eras(spark, sf_dir), density=0.6)


MONTHS = """WITH m AS (SELECT o_orderpriority AS metric, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderstatus AS source, count(*) AS n FROM orders GROUP BY 1, 2, 3),
t AS (SELECT *, sum(n) OVER (PARTITION BY metric, month) AS total, row_number() OVER (PARTITION BY metric, month ORDER BY n DESC, source) AS k FROM m),
top AS (SELECT metric, month, source, n, CAST(total AS BIGINT) AS total FROM t WHERE k = 1 AND total >= 5)
"""


def _months(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select(F.col("o_orderpriority").alias("metric"), F.to_date("o_orderdate").alias("local_date"), F.col("o_orderstatus").alias("source"))
    return history.dominant(history.source_months(rows))


@query(MONTHS + "SELECT * FROM top")
def dominant_source_months(spark, sf_dir):
    return _months(spark, sf_dir)


@query(
    MONTHS
    + """, h AS (SELECT *, source = lead(source) OVER w OR row_number() OVER w = 1 AS lasting FROM top WINDOW w AS (PARTITION BY metric ORDER BY month)),
b AS (SELECT *, lag(source) OVER (PARTITION BY metric ORDER BY month) AS before FROM h WHERE lasting)
SELECT metric, month AS boundary, before, source FROM b WHERE before <> source"""
)
def instrument_boundaries(spark, sf_dir):
    return history.boundaries(_months(spark, sf_dir))


@query(
    views(DAILY_LONG, SERIES_LONG)
    + """SELECT metric, date, n, CASE WHEN n >= 15 THEN round(sd, 4) END AS sd FROM (SELECT metric, date, count(value) OVER w AS n, stddev_samp(value) OVER w AS sd
  FROM series WINDOW w AS (PARTITION BY metric ORDER BY datediff('day', DATE '1970-01-01', date) RANGE BETWEEN 27 PRECEDING AND CURRENT ROW))"""
)
def rolling_sd_28d(spark, sf_dir):
    return sleep.rolling_sd(long_series(spark, sf_dir), least=15)


NIGHTS = "nights AS (SELECT local_date AS date, CAST(min(start_s % 86400) // 60 % 300 + 500 AS BIGINT) AS bed_min, CAST(max(end_s % 86400) // 60 % 300 + 900 AS BIGINT) AS wake_min FROM records WHERE metric = 'view' AND local_date <> DATE '2024-01-11' GROUP BY 1)"


def _nights(spark, sf_dir):
    rows = records(spark, sf_dir).where("metric = 'view' and local_date <> date'2024-01-11'")
    bed, wake = F.min(F.col("start_s") % 86400), F.max(F.col("end_s") % 86400)
    return rows.groupBy(F.col("local_date").alias("date")).agg((F.floor(bed / 60) % 300 + 500).alias("bed_min"), (F.floor(wake / 60) % 300 + 900).alias("wake_min"))


@query(
    views(RECORDS, NIGHTS)
    + """SELECT a.date, round(1 - ((a.wake_min - a.bed_min) + (b.wake_min - b.bed_min) - 2 * greatest(0, least(a.wake_min, b.wake_min) - greatest(a.bed_min, b.bed_min))) / 1440, 6) AS same_share FROM nights a JOIN nights b ON a.date = b.date + 1"""
)
def sleep_regularity_pairs(spark, sf_dir):
    return sleep.regularity_pairs(_nights(spark, sf_dir))


@query(
    views(RECORDS, DAILY_SHORT, SERIES)
    + "SELECT count(*) AS n, round(avg(a.value - b.value), 4) AS bias, round(stddev_samp(a.value - b.value), 4) AS sd, round(max(abs(a.value - b.value)), 4) AS max_abs FROM series a JOIN series b ON a.date = b.date AND a.metric = 'purchase' AND b.metric = 'signup'"
)
def midpoint_agreement(spark, sf_dir):
    series = short_series(spark, sf_dir)
    return sleep.agreement(series.where("metric = 'purchase'"), series.where("metric = 'signup'"))


@query(views(RECORDS, NIGHTS) + "SELECT CASE WHEN bed_min - 510 <= 15 THEN 'on_time' WHEN bed_min - 510 <= 45 THEN 'near' ELSE 'late' END AS band, count(*) AS n, round(count(*) / (SELECT count(*) FROM nights), 4) AS share FROM nights GROUP BY 1")
def compliance_bands(spark, sf_dir):
    return sleep.compliance(_nights(spark, sf_dir), 510)


# Folds ------------------------------------------------------------------------


@query(
    views(RECORDS)
    + """, a AS (SELECT metric, 2 * pi() / 86400 * (start_s % 86400) AS w, value AS y FROM records),
u AS (SELECT metric, count(*)::DOUBLE AS n, sum(y) AS y, sum(cos(w)) AS c, sum(sin(w)) AS s, sum(cos(w) * cos(w)) AS cc, sum(sin(w) * sin(w)) AS ss, sum(cos(w) * sin(w)) AS cs, sum(cos(w) * y) AS cy, sum(sin(w) * y) AS sy FROM a GROUP BY 1),
v AS (SELECT *, cc - c * c / n AS p, cs - c * s / n AS q, ss - s * s / n AS r, cy - c * y / n AS g, sy - s * y / n AS h FROM u WHERE n >= 8),
b AS (SELECT *, (g * r - h * q) / (p * r - q * q) AS bc, (h * p - g * q) / (p * r - q * q) AS bs FROM v),
k AS (SELECT *, atan2(bs, bc) * 24 / (2 * pi()) AS peak FROM b)
SELECT metric, CAST(n AS BIGINT) AS n, round((y - bc * c - bs * s) / n, 5) AS mesor, round(sqrt(bc * bc + bs * bs), 5) AS amplitude, round(CASE WHEN peak < 0 THEN peak + 24 ELSE peak END, 4) AS peak_hour FROM k"""
)
def cosinor(spark, sf_dir):
    return folds.cosinor(records(spark, sf_dir), "metric")


@query(
    views(RECORDS, SESSIONS).replace("WITH", "WITH RECURSIVE", 1)
    + """, seg AS (SELECT source, local_date, id, start_s, end_s, row_number() OVER (PARTITION BY source, local_date ORDER BY start_s, end_s, id) AS i FROM sessions),
f AS (SELECT source, local_date, i, [end_s] AS ends, CAST(1 AS BIGINT) AS chain FROM seg WHERE i = 1 UNION ALL
  SELECT source, local_date, i, CASE WHEN k IS NULL THEN list_append(ends, end_s) ELSE list_transform(range(1, len(ends) + 1), lambda j: CASE WHEN j = k THEN greatest(ends[j], end_s) ELSE ends[j] END) END, coalesce(k, len(ends) + 1)
  FROM (SELECT s.source, s.local_date, s.i, s.end_s, f.ends, list_sort(list_transform(list_filter(range(1, len(f.ends) + 1), lambda j: f.ends[j] <= s.start_s + 2), lambda j: struct_pack(d := abs(s.start_s - f.ends[j]), k := j)))[1].k AS k
    FROM f JOIN seg s ON s.source = f.source AND s.local_date = f.local_date AND s.i = f.i + 1)),
c AS (SELECT source, local_date, chain, row_number() OVER (PARTITION BY source, local_date ORDER BY round(sum((end_s - start_s) / 60), 2) DESC, count(*) DESC, chain) - 1 AS place FROM f JOIN seg USING (source, local_date, i) GROUP BY 1, 2, 3)
SELECT source, local_date, id, start_s, end_s, place AS chain FROM f JOIN seg USING (source, local_date, i) JOIN c USING (source, local_date, chain)"""
)
def segment_chains(spark, sf_dir):
    """Sessions of a source and day in chains; the SQL carries the chains' ends along."""
    return folds.segment_chains(sessions(spark, sf_dir), ["source", "local_date"])


@query(
    views(RECORDS, DAILY_SHORT, SERIES).replace("WITH", "WITH RECURSIVE", 1)
    + """, m AS (SELECT metric, date, (value - min(value) OVER (PARTITION BY metric)) * 100 / (max(value) OVER (PARTITION BY metric) - min(value) OVER (PARTITION BY metric)) AS score, max(date) OVER (PARTITION BY metric) AS latest FROM series),
k AS (SELECT metric, score, CASE WHEN score >= 67 THEN 'high' WHEN score >= 34 THEN 'mid' ELSE 'low' END AS plain, row_number() OVER (PARTITION BY metric ORDER BY date) AS i, count(*) OVER (PARTITION BY metric) AS n FROM m WHERE date >= latest - 7),
f AS (SELECT metric, i, n, plain AS band FROM k WHERE i = 1 UNION ALL
  SELECT k.metric, k.i, k.n, CASE WHEN band = 'low' AND score >= 37 OR band = 'mid' AND (score >= 70 OR score < 31) OR band = 'high' AND score < 64 THEN plain ELSE band END
  FROM f JOIN k ON k.metric = f.metric AND k.i = f.i + 1)
SELECT metric, band, n AS n_days FROM f WHERE i = n"""
)
def hysteresis_band(spark, sf_dir):
    scores = training.summary(short_series(spark, sf_dir)).select("metric", "min", "max").join(short_series(spark, sf_dir), "metric")
    return folds.hysteresis_band(scores.select("metric", "date", ((F.col("value") - F.col("min")) * 100 / (F.col("max") - F.col("min"))).alias("score")), "metric")


@query(
    """WITH RECURSIVE p AS (SELECT user_id, CAST(ts AS DATE) AS local_date, CAST(floor(epoch(ts)) AS BIGINT) % 86400 AS t, value % 40 AS a, event_id % 13 - 1 AS acc FROM events WHERE event_type = 'view'),
g AS (SELECT * FROM p WHERE a IS NOT NULL AND acc BETWEEN 0 AND 10),
s AS (SELECT user_id, local_date, t, quantile_cont(a, 0.5) OVER (PARTITION BY user_id ORDER BY t + 86400 * (local_date - DATE '2000-01-01') RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS v FROM g),
k AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY local_date, t, v) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM s),
f AS (SELECT user_id, i, n, v AS h, 0 AS way, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down FROM k WHERE i = 1 UNION ALL
  SELECT user_id, i, n, CASE WHEN c OR d THEN v ELSE h END, CASE WHEN c THEN 1 WHEN d THEN -1 ELSE way END, up + CASE WHEN c THEN v - h ELSE 0 END, down + CASE WHEN d THEN h - v ELSE 0 END
  FROM (SELECT k.user_id, k.i, k.n, k.v, f.h, f.way, f.up, f.down, CASE WHEN f.way = 1 THEN k.v > f.h ELSE k.v - f.h >= 3 END AS c, CASE WHEN f.way = -1 THEN k.v < f.h ELSE k.v - f.h <= -3 END AS d FROM f JOIN k ON k.user_id = f.user_id AND k.i = f.i + 1))
SELECT user_id, n, CASE WHEN n >= 10 THEN round(up, 4) ELSE 0 END AS gain_m, CASE WHEN n >= 10 THEN round(down, 4) ELSE 0 END AS loss_m FROM f WHERE i = n"""
)
def elevation_gain(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'view'")
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))
    day = F.datediff(F.to_date("ts"), F.lit("2000-01-01").cast("date"))
    points = rows.select("user_id", (second + 86400 * day).cast("double").alias("t"), (F.col("value") % 40).alias("altitude_m"), (F.col("event_id") % 13 - 1).cast("double").alias("accuracy_m"))
    return folds.elevation_gain(points, ["user_id"])
