"""Queries over running form, loads, plans, claims and ingest diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.stats import trimp
from pulsegrid.operators import arbitration, form, ledger, matching
from pulsegrid.operators.training import wear_hours
from pulsegrid.plans.daily import WEAR, long_series, short_series, spaced
from pulsegrid.plans.events import EVENTS, _bucket_sql, _flagged
from pulsegrid.plans.registry import query, views
from pulsegrid.sources.adapters import DAILY_LONG, DAILY_SHORT, RECORDS, SERIES, SERIES_LONG, records, sessions

FOOT = ", foot AS (SELECT local_date, bkt, pace, mi, is_walk OR is_jog AS f FROM classified)"


@query(
    _bucket_sql()
    + FOOT
    + """, k AS (SELECT *, row_number() OVER (PARTITION BY local_date ORDER BY bkt) AS k, count(*) OVER (PARTITION BY local_date) AS n FROM foot WHERE f),
a AS (SELECT local_date, count(*) AS n, round(avg(pace) FILTER (k <= n // 2), 4) AS first_half, round(avg(pace) FILTER (k > n // 2), 4) AS second_half FROM k GROUP BY 1)
SELECT *, CASE WHEN first_half <> 0 THEN round((second_half - first_half) * 100 / first_half, 2) END AS change_pct FROM a"""
)
def run_form_halves(spark, sf_dir):
    return form.halves(_flagged(spark, sf_dir), "foot")


@query(
    _bucket_sql()
    + FOOT
    + """, k AS (SELECT *, row_number() OVER (PARTITION BY local_date ORDER BY bkt) AS k, count(*) OVER (PARTITION BY local_date) AS n FROM foot WHERE f),
a AS (SELECT local_date, round(avg(pace) FILTER (k <= n // 2), 4) AS x, round(avg(pace) FILTER (k > n // 2), 4) AS y FROM k GROUP BY 1),
c AS (SELECT CAST(date_trunc('week', local_date) AS DATE) AS week, CASE WHEN x <> 0 AND day(local_date) % 9 <> 4 THEN round((y - x) * 100 / x, 2) END AS v FROM a),
g AS (SELECT week, count(v) AS n_sessions, median(v) AS m, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.9) AS hi, stddev_samp(v) AS sd FROM c GROUP BY 1)
SELECT week, CASE WHEN n_sessions >= 5 THEN 'ok' ELSE 'insufficient_sessions' END AS status, n_sessions, CASE WHEN n_sessions >= 5 THEN round(m, 4) END AS median, CASE WHEN n_sessions >= 5 THEN round(lo, 4) END AS p10,
  CASE WHEN n_sessions >= 5 THEN round(hi, 4) END AS p90, CASE WHEN n_sessions >= 5 THEN round(2 * sd / sqrt(n_sessions), 4) END AS least_change FROM g"""
)
def personal_reference(spark, sf_dir):
    """The usual change of pace inside a day, by week, without the days that are judged by it."""
    changes = form.halves(_flagged(spark, sf_dir), "foot").withColumn("week", F.to_date(F.trunc("local_date", "week")))
    return form.reference(changes, ["week"], F.dayofmonth("local_date") % 9 == 4)


@query(_bucket_sql() + FOOT + ", e AS (SELECT *, f AND NOT coalesce(lag(f) OVER (PARTITION BY local_date ORDER BY bkt), false) AS edge FROM foot) SELECT local_date, count(*) FILTER (edge) AS n_bouts, count(*) FILTER (f) AS n_buckets FROM e GROUP BY 1")
def walk_structure(spark, sf_dir):
    return form.bouts(_flagged(spark, sf_dir), "foot")


@query(_bucket_sql() + "SELECT CAST(date_trunc('week', local_date) AS DATE) AS week, count(*) AS n, round(avg(pace), 4) AS pace, round(avg(mi), 6) AS mi FROM classified WHERE pace BETWEEN 10 AND 30 GROUP BY 1 HAVING count(*) >= 10")
def banded_weekly(spark, sf_dir):
    return form.banded_weekly(_flagged(spark, sf_dir), 10, 30)


@query(
    EVENTS
    + """, m AS (SELECT s.id, s.local_date, (s.end_s - s.start_s) / 60 AS minutes, avg(r.value) + 80 AS hr FROM sessions s JOIN records r ON r.metric = 'purchase' AND r.start_s >= s.start_s AND r.start_s < s.end_s GROUP BY 1, 2, 3),
q AS (SELECT *, greatest(0.0, (hr - 60) / (190 - 60)) AS ratio FROM m)
SELECT id, local_date, round(minutes * ratio * 0.64 * exp(1.92 * ratio), 4) AS trimp FROM q"""
)
def session_trimp(spark, sf_dir):
    spans = sessions(spark, sf_dir)
    inside = arbitration.in_sessions(records(spark, sf_dir).where("metric = 'purchase'").select("id", "value", "start_s"), spans.select("id", "start_s", "end_s"))
    means = inside.groupBy(F.col("session_id").alias("id")).agg((F.avg("value") + 80).alias("hr"))
    minutes = (F.col("end_s") - F.col("start_s")) / 60
    return spans.join(means, "id").select("id", "local_date", F.round(trimp(minutes, F.col("hr"), 60, 190), 4).alias("trimp"))


@query(
    EVENTS
    + """, c AS (SELECT s.id, s.kind, count(r.id) AS n FROM sessions s LEFT JOIN records r ON r.metric = 'view' AND r.start_s >= s.start_s AND r.start_s < s.end_s GROUP BY 1, 2)
SELECT kind, count(*) AS n_sessions, count(*) FILTER (n > 0) AS n_with, count(*) FILTER (n = 0) AS n_without, CAST(sum(n) AS BIGINT) AS n_samples FROM c GROUP BY 1"""
)
def workout_coverage(spark, sf_dir):
    spans = sessions(spark, sf_dir)
    counts = arbitration.in_sessions(records(spark, sf_dir).where("metric = 'view'").select("id", "start_s"), spans.select("id", "start_s", "end_s")).groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("n"))
    held = spans.join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return held.groupBy("kind").agg(F.count("*").alias("n_sessions"), F.count_if(F.col("n") > 0).alias("n_with"), F.count_if(F.col("n") == 0).alias("n_without"), F.sum("n").alias("n_samples"))


@query(EVENTS + "SELECT id, kind, source, start_s, (SELECT count(*) > 15 FROM sessions WHERE start_s < 1706000000) AS truncated FROM sessions WHERE start_s < 1706000000 ORDER BY start_s DESC, id LIMIT 15")
def sessions_page(spark, sf_dir):
    rows = sessions(spark, sf_dir).select("id", "kind", "source", "start_s")
    return ledger.page_before(rows, F.col("start_s") < 1706000000, [F.col("start_s").desc(), F.col("id")], 15)


@query(views(RECORDS, DAILY_SHORT) + "SELECT metric, max(date) AS date, arg_max(last, date) AS last, arg_max(count, date) AS count FROM daily GROUP BY 1")
def latest_by_metric(spark, sf_dir):
    from pulsegrid.sources.adapters import daily_short

    return daily_short(spark, sf_dir).groupBy("metric").agg(F.max_by(F.struct("date", "last", "count"), "date").alias("b")).select("metric", "b.*")


@query(
    views(RECORDS)
    + """, j AS (SELECT *, CASE WHEN value IS NULL THEN 'missing_value' WHEN value > 150 THEN 'implausible' WHEN local_date <= DATE '2024-01-03' THEN 'behind_watermark' END AS reason FROM records)
SELECT source, metric, count(*) AS arrived, count(*) FILTER (reason IS NULL) AS stored, count(*) FILTER (reason IS NOT NULL) AS rejected, min(local_date) AS first_date, max(local_date) AS last_date FROM j GROUP BY 1, 2"""
)
def ingest_diagnostics(spark, sf_dir):
    judged = ledger.judged(records(spark, sf_dir), "2024-01-03", 150)
    return judged.groupBy("source", "metric").agg(F.count("*").alias("arrived"), F.count_if(F.col("reason").isNull()).alias("stored"), F.count_if(F.col("reason").isNotNull()).alias("rejected"), F.min("local_date").alias("first_date"), F.max("local_date").alias("last_date"))


@query(
    views(DAILY_LONG, SERIES_LONG)
    + """, n AS (SELECT metric, count(*) AS n FROM series GROUP BY 1)
SELECT metric, CASE WHEN n > 400 THEN CAST(date_trunc('week', date) AS DATE) ELSE date END AS date, round(avg(value), 6) AS value, count(*) AS n_days FROM series JOIN n USING (metric) GROUP BY 1, 2"""
)
def series_downsampled(spark, sf_dir):
    series = long_series(spark, sf_dir)
    counts = series.groupBy("metric").agg(F.count("*").alias("n"))
    day = F.when(F.col("n") > 400, F.trunc("date", "week").cast("date")).otherwise(F.col("date"))
    return series.join(counts, "metric").groupBy("metric", day.alias("date")).agg(F.round(F.avg("value"), 6).alias("value"), F.count("*").alias("n_days"))


@query(
    views(RECORDS, DAILY_SHORT, SERIES, WEAR)
    + "SELECT coalesce(s.date, w.date) AS date, coalesce(value, 0.0) AS value FROM (SELECT DATE '2024-01-01' + CAST((date - DATE '2024-01-01') * 2 AS INTEGER) AS date, value FROM series WHERE metric = 'click') s FULL JOIN (SELECT date FROM wear WHERE hours >= 12) w USING (date)"
)
def zero_filled_load(spark, sf_dir):
    wear = wear_hours(records(spark, sf_dir)).where("local_date <> date'2024-01-20'")
    days = short_series(spark, sf_dir).where(F.col("metric") == "click").select(spaced("date", 2).alias("date"), "value")
    return form.zero_filled(days, wear)


@query(
    views(RECORDS, DAILY_SHORT, SERIES)
    + """, s AS (SELECT metric, DATE '2024-01-01' + CAST((date - DATE '2024-01-01') * 4 AS INTEGER) AS date, value FROM series), b AS (SELECT metric, min(date) AS a, max(date) + 10 AS z FROM s GROUP BY 1),
g AS (SELECT metric, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM b)
SELECT metric, date, last_value(value IGNORE NULLS) OVER (PARTITION BY metric ORDER BY date ROWS UNBOUNDED PRECEDING) AS value FROM g LEFT JOIN s USING (metric, date)"""
)
def carried_forward(spark, sf_dir):
    return form.carried(short_series(spark, sf_dir).select("metric", spaced("date", 4).alias("date"), "value"), 10)


@query("WITH l AS (SELECT user_id AS scope, event_id AS seq, CASE WHEN event_type = 'error' THEN 'withdraw' ELSE 'rule' END AS kind, event_type AS rule FROM events) SELECT scope, seq, rule FROM l WHERE kind = 'rule' AND seq > coalesce((SELECT max(seq) FROM l w WHERE w.scope = l.scope AND w.kind = 'withdraw'), -1)")
def plan_projection(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = events.select(F.col("user_id").alias("scope"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "withdraw").otherwise("rule").alias("kind"), F.col("event_type").alias("rule"))
    return form.projected(log)


@query(
    views(RECORDS, DAILY_SHORT)
    + """, c AS (SELECT metric, date + CASE WHEN day(date) % 7 = 0 THEN 100 ELSE 0 END AS date, round(sum * CASE day(date) % 3 WHEN 0 THEN 1.004 WHEN 1 THEN 1.02 ELSE 1.0 END, 4) AS claimed FROM daily)
SELECT metric, date, claimed, sum AS actual, CASE WHEN sum IS NULL THEN 'no_basis' WHEN abs(claimed - sum) <= greatest(abs(sum) * 0.005, 0.05) THEN 'verified' ELSE 'wrong' END AS verdict FROM c LEFT JOIN daily USING (metric, date)"""
)
def verify_claims(spark, sf_dir):
    from pulsegrid.sources.adapters import daily_short

    daily = daily_short(spark, sf_dir).select("metric", "date", F.col("sum").alias("actual"))
    day = F.dayofmonth("date")
    factor = F.when(day % 3 == 0, 1.004).when(day % 3 == 1, 1.02).otherwise(1.0)
    claims = daily.select("metric", F.date_add("date", F.when(day % 7 == 0, 100).otherwise(0)).alias("date"), F.round(F.col("actual") * factor, 4).alias("claimed"))
    return form.checked(claims, daily, ["metric", "date"])


@query(views(RECORDS) + "SELECT metric, local_date, source, start_s // 20 AS bkt, round(sum(value), 6) AS value, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n FROM records GROUP BY 1, 2, 3, 4")
def bucket_downsample(spark, sf_dir):
    return form.downsampled(records(spark, sf_dir))


@query(views(RECORDS) + "SELECT metric, quantile_disc(value, 0.95) AS p FROM records GROUP BY 1")
def p95_nearest_rank(spark, sf_dir):
    return form.nearest_rank(records(spark, sf_dir), ["metric"], 0.95, F.col("value"))


@query(views(RECORDS) + "SELECT metric, source, start_s // 3600 AS hour, count(*) AS c FROM records GROUP BY 1, 2, 3 HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return records(spark, sf_dir).groupBy("metric", "source", F.floor(F.col("start_s") / 3600).alias("hour")).agg(F.count("*").alias("c")).where("c > 1")


@query(EVENTS + ", k AS (SELECT * FROM (SELECT *, max(end_s) OVER (PARTITION BY local_date ORDER BY start_s, end_s DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sessions) WHERE reach IS NULL OR end_s > reach) SELECT local_date, count(*) AS n, CAST(sum(end_s - start_s) AS BIGINT) AS seconds FROM k GROUP BY 1")
def unnested_sessions(spark, sf_dir):
    return matching.not_nested(sessions(spark, sf_dir)).groupBy("local_date").agg(F.count("*").alias("n"), F.sum(F.col("end_s") - F.col("start_s")).alias("seconds"))
