"""Queries over daily metrics: roll-up, weeks, summaries, overlays, change."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import rollup, training
from pulsegrid.plans.registry import query, views
from pulsegrid.sources.adapters import DAILY_LONG, DAILY_SHORT, RECORDS, SERIES, SERIES_LONG, daily_long, daily_short, records, with_value

SHORT = views(RECORDS, DAILY_SHORT, SERIES)
LONG = views(DAILY_LONG, SERIES_LONG)


def short_series(spark, sf_dir):
    return with_value(daily_short(spark, sf_dir)).select("metric", "date", "count", "value")


def long_series(spark, sf_dir):
    return daily_long(spark, sf_dir).select("metric", "date", "count", F.col("avg").alias("value"))


@query(views(RECORDS) + "SELECT metric, min(local_date) AS first_date, max(local_date) AS last_date, count(*) AS n, count(DISTINCT local_date) AS n_days, count(DISTINCT source) AS n_sources FROM records GROUP BY 1")
def metric_catalog(spark, sf_dir):
    return rollup.catalog(records(spark, sf_dir))


@query(views(RECORDS, DAILY_SHORT) + "SELECT metric, date AS local_date, count, sum, avg, min, max, last FROM daily")
def daily_rollup(spark, sf_dir):
    return rollup.daily_rollup(records(spark, sf_dir))


@query(
    views(RECORDS)
    + """SELECT metric, local_date, id, value, start_s, source FROM (
  SELECT *, row_number() OVER (PARTITION BY metric, local_date ORDER BY start_s DESC, end_s DESC, id DESC) AS k FROM records) WHERE k = 1"""
)
def daily_last_value(spark, sf_dir):
    return rollup.last_sample(records(spark, sf_dir))


@query(SHORT + "SELECT date, value FROM series WHERE metric = 'click' AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'")
def daily_series(spark, sf_dir):
    return short_series(spark, sf_dir).where("metric = 'click' and date between date'2024-01-05' and date'2024-01-25'").select("date", "value")


@query(
    SHORT
    + """SELECT metric, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median,
  min(value) AS min, arg_min(date, struct_pack(a := value, b := date)) AS min_date, max(value) AS max,
  arg_max(date, struct_pack(a := value, b := -datediff('day', DATE '1970-01-01', date))) AS max_date, round(stddev_samp(value), 6) AS sd
FROM series GROUP BY 1"""
)
def summary_stats(spark, sf_dir):
    return training.summary(short_series(spark, sf_dir))


@query(
    SHORT
    + """, k AS (SELECT *, count(*) OVER (PARTITION BY metric) AS n, row_number() OVER (PARTITION BY metric ORDER BY date DESC) AS k FROM series),
m AS (SELECT *, greatest(1, least(7, n // 3)) AS rn FROM k),
a AS (SELECT metric, first(n) AS n, first(rn) AS rn, round(avg(value) FILTER (k <= rn), 6) AS recent,
  coalesce(round(avg(value) FILTER (k > rn), 6), round(avg(value), 6)) AS baseline FROM m GROUP BY 1)
SELECT *, CASE WHEN baseline <> 0 THEN round((recent - baseline) * 100 / baseline, 2) END AS change_pct FROM a"""
)
def recent_vs_baseline(spark, sf_dir):
    return training.recent_vs_baseline(short_series(spark, sf_dir))


@query(LONG + "SELECT metric, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(regr_slope(value, CAST(datediff('day', DATE '2000-01-01', date) AS DOUBLE)) * 7, 5) END AS slope_per_week FROM series GROUP BY 1")
def trend_slope(spark, sf_dir):
    return training.slope(long_series(spark, sf_dir))


@query(
    SHORT
    + """, a AS (SELECT metric, count(*) FILTER (date BETWEEN DATE '2024-01-01' AND DATE '2024-01-14') AS n_a,
  count(*) FILTER (date BETWEEN DATE '2024-01-15' AND DATE '2024-01-28') AS n_b,
  round(avg(value) FILTER (date BETWEEN DATE '2024-01-01' AND DATE '2024-01-14'), 4) AS mean_a,
  round(avg(value) FILTER (date BETWEEN DATE '2024-01-15' AND DATE '2024-01-28'), 4) AS mean_b FROM series GROUP BY 1)
SELECT *, round(mean_b - mean_a, 4) AS diff, CASE WHEN mean_a <> 0 THEN round((mean_b - mean_a) * 100 / mean_a, 2) END AS change_pct FROM a"""
)
def period_compare(spark, sf_dir):
    return training.period_compare(short_series(spark, sf_dir), ("2024-01-01", "2024-01-14"), ("2024-01-15", "2024-01-28"))


WEEKS = """, b AS (SELECT metric, min(date) AS f, max(date) AS t FROM series GROUP BY 1),
w AS (SELECT metric, CAST(date_trunc('week', date) AS DATE) AS week, round(avg(value), 6) AS mean, count(value) AS n_days,
  round(sum(value), 6) AS total, arg_max(value, date) AS latest FROM series GROUP BY 1, 2),
weeks AS (SELECT metric, week, greatest(week, f) AS period_start, least(week + 6, t) AS period_end, n_days, mean, total, latest FROM w JOIN b USING (metric))
"""


@query(SHORT + WEEKS + "SELECT metric, week, CASE WHEN metric IN ('click', 'view', 'error') THEN total WHEN metric = 'signup' THEN latest ELSE mean END AS value FROM weeks")
def weekly_reduce_by_agg(spark, sf_dir):
    return _weeks(short_series(spark, sf_dir)).select("metric", "week", "value")


@query(SHORT + WEEKS + "SELECT metric, week, period_start, period_end, n_days, mean, datediff('day', period_start, period_end) < 6 AS partial FROM weeks")
def weekly_series_partial(spark, sf_dir):
    return _weeks(short_series(spark, sf_dir)).select("metric", "week", "period_start", "period_end", "n_days", "mean", "partial")


def _weeks(series):
    how = F.when(F.col("metric").isin("click", "view", "error"), "sum").when(F.col("metric") == "signup", "last").otherwise("mean")
    return rollup.weekly(series, how)


FLOOR = """, s AS (SELECT *, lag(value) OVER w AS before, datediff('day', lag(date) OVER w, date) AS gap FROM series
  WHERE date BETWEEN DATE '2000-12-31' - 364 AND DATE '2000-12-31' WINDOW w AS (PARTITION BY metric ORDER BY date)),
f AS (SELECT metric, count(CASE WHEN gap = 1 THEN value - before END) AS n_pairs, stddev_samp(CASE WHEN gap = 1 THEN value - before END) AS sd,
  corr(value, before) AS rho FROM s GROUP BY 1),
floors AS (SELECT metric, n_pairs, CASE WHEN n_pairs >= 20 THEN round(sd / sqrt(2.0), 2) END AS floor, CASE WHEN n_pairs >= 20 THEN round(rho, 2) END AS rho FROM f)
"""


@query(LONG + FLOOR + "SELECT * FROM floors")
def noise_floor(spark, sf_dir):
    return training.noise_floor(long_series(spark, sf_dir), "2000-12-31")


@query(LONG + FLOOR + "SELECT *, round(1.96 * sqrt(2.0) * floor / sqrt(7.0) * sqrt(CASE WHEN rho > 0 THEN (1 + rho) / (1 - least(rho, 0.99)) ELSE 1.0 END), 2) AS mdc95 FROM floors")
def mdc95(spark, sf_dir):
    return training.smallest_change(training.noise_floor(long_series(spark, sf_dir), "2000-12-31"), 7)


@query(
    LONG
    + FLOOR
    + """, c AS (SELECT metric, round(avg(value) FILTER (date BETWEEN DATE '2000-11-01' AND DATE '2000-11-30'), 4) AS mean_a,
  round(avg(value) FILTER (date BETWEEN DATE '2000-12-01' AND DATE '2000-12-30'), 4) AS mean_b,
  count(*) FILTER (date BETWEEN DATE '2000-11-01' AND DATE '2000-11-30') AS n_a, count(*) FILTER (date BETWEEN DATE '2000-12-01' AND DATE '2000-12-30') AS n_b FROM series GROUP BY 1)
SELECT metric, n_a, n_b, mean_a, mean_b, round(mean_b - mean_a, 4) AS diff, least(n_a, n_b) >= 0.75 * 30 AS covered,
  abs(round(mean_b - mean_a, 4)) > round(1.96 * sqrt(2.0) * floor / sqrt(30.0) * sqrt(CASE WHEN rho > 0 THEN (1 + rho) / (1 - least(rho, 0.99)) ELSE 1.0 END), 2) AS beyond_noise
FROM c JOIN floors USING (metric)"""
)
def block_comparison(spark, sf_dir):
    series = long_series(spark, sf_dir)
    both = training.period_compare(series, ("2000-11-01", "2000-11-30"), ("2000-12-01", "2000-12-30"))
    floor = training.smallest_change(training.noise_floor(series, "2000-12-31"), 30)
    return both.join(floor, "metric").select("metric", "n_a", "n_b", "mean_a", "mean_b", "diff", (F.least("n_a", "n_b") >= 0.75 * 30).alias("covered"), (F.abs("diff") > F.col("mdc95")).alias("beyond_noise"))


@query(
    views(RECORDS)
    + """SELECT metric, local_date, (start_s % 86400) // 3600 // 4 * 4 AS hour, count(*) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean
FROM records WHERE local_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' GROUP BY 1, 2, 3"""
)
def intraday_buckets(spark, sf_dir):
    rows = records(spark, sf_dir).where("local_date between date'2024-01-10' and date'2024-01-12'")
    hour = (F.floor(F.pmod("start_s", F.lit(86400)) / 3600 / 4) * 4).alias("hour")
    return rows.groupBy("metric", "local_date", hour).agg(F.count("*").alias("n"), rollup.r(F.sum("value")).alias("total"), rollup.r(F.avg("value")).alias("mean"))


def spaced(date: str, days: int):
    """Dates moved apart, so that a series gets gaps and loses no row."""
    start = F.lit("2024-01-01").cast("date")
    return F.date_add(start, F.datediff(date, start) * days)


TOTALS = "totals AS (SELECT metric, date + 1 AS date, round(sum * 2, 6) AS total FROM daily)"


@query(
    views(RECORDS, DAILY_SHORT, TOTALS)
    + """SELECT metric, date, coalesce(count, 0) AS count, coalesce(total, sum) AS sum, avg, min, max, last,
  CASE WHEN total IS NOT NULL THEN 'consolidated' ELSE 'samples' END AS source_kind FROM daily FULL JOIN totals USING (metric, date)"""
)
def overlay_totals(spark, sf_dir):
    daily = daily_short(spark, sf_dir)
    return rollup.overlay_totals(daily, _totals(daily))


def _totals(daily):
    return daily.select("metric", F.date_add("date", 1).alias("date"), F.round(F.col("sum") * 2, 6).alias("total"))


@query(
    views(RECORDS, DAILY_SHORT)
    + """, half AS (SELECT * REPLACE (DATE '2024-01-01' + CAST((date - DATE '2024-01-01') * 2 AS INTEGER) AS date) FROM daily), stats AS (SELECT metric, date, round(avg + 1, 6) AS stat FROM daily)
SELECT metric, date, coalesce(count, 0) AS count, CASE WHEN coalesce(count, 0) = 0 THEN coalesce(stat, avg) ELSE avg END AS avg,
  coalesce(count, 0) = 0 AND stat IS NOT NULL AS filled FROM half FULL JOIN stats USING (metric, date)"""
)
def overlay_fill_only(spark, sf_dir):
    daily = daily_short(spark, sf_dir)
    stats = daily.select("metric", "date", F.round(F.col("avg") + 1, 6).alias("stat"))
    return rollup.overlay_fill(daily.withColumn("date", spaced("date", 2)), stats)


@query(
    views(RECORDS, DAILY_SHORT)
    + """, other AS (SELECT metric, date, CASE WHEN day(date) = 7 THEN count + 1 ELSE count END AS count, CASE WHEN day(date) = 9 THEN round(sum + 1, 6) ELSE sum END AS sum FROM daily WHERE day(date) <> 5
  UNION ALL SELECT metric, date + 60, count, sum FROM daily WHERE day(date) = 11)
SELECT metric, date, CASE WHEN s.count IS NULL THEN 'missing' WHEN b.count IS NULL THEN 'extra' WHEN s.count <> b.count THEN 'count' ELSE 'sum' END AS kind,
  s.count AS stored_count, b.count AS rebuilt_count, s.sum AS stored_sum, b.sum AS rebuilt_sum
FROM other s FULL JOIN daily b USING (metric, date) WHERE s.count IS DISTINCT FROM b.count OR s.sum IS DISTINCT FROM b.sum"""
)
def verify_full_outer(spark, sf_dir):
    daily = daily_short(spark, sf_dir).select("metric", "date", "count", "sum")
    day = F.dayofmonth("date")
    other = daily.where(day != 5).select("metric", "date", F.when(day == 7, F.col("count") + 1).otherwise(F.col("count")).alias("count"), F.when(day == 9, F.round(F.col("sum") + 1, 6)).otherwise(F.col("sum")).alias("sum"))
    return rollup.differences(other.unionByName(daily.where(day == 11).withColumn("date", F.date_add("date", 60))), daily)


@query(
    """WITH writes AS (SELECT o_orderpriority AS metric, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, CAST(o_orderdate AS DATE) AS written_on, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2, 3),
s AS (SELECT *, lag(total) OVER (PARTITION BY metric, date ORDER BY written_on) AS before FROM writes)
SELECT metric, datediff('day', date, written_on) AS lag_days, count(*) AS n, round(max(abs(total - before)), 6) AS max_abs, round(quantile_cont(abs(total - before), 0.5), 6) AS median_abs
FROM s WHERE before IS NOT NULL GROUP BY 1, 2"""
)
def revision_lag_report(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    writes = orders.groupBy(F.col("o_orderpriority").alias("metric"), F.trunc("o_orderdate", "month").cast("date").alias("date"), F.to_date("o_orderdate").alias("written_on")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return rollup.revision_report(writes)


@query(
    views(RECORDS)
    + """, p AS (SELECT local_date AS period, count(*) AS n FROM records WHERE metric = 'error' AND day(local_date) % 4 <> 0 GROUP BY 1)
SELECT CAST(g AS DATE) AS period, n FROM generate_series(TIMESTAMP '2023-12-28', TIMESTAMP '2024-02-03', INTERVAL 1 DAY) t(g) LEFT JOIN p ON p.period = CAST(g AS DATE)"""
)
def gap_fill_periods(spark, sf_dir):
    days = records(spark, sf_dir).where((F.col("metric") == "error") & (F.dayofmonth("local_date") % 4 != 0)).groupBy(F.col("local_date").alias("period")).agg(F.count("*").alias("n"))
    return rollup.gap_filled(days, "2023-12-28", "2024-02-03", "1 day")


@query(
    LONG
    + """, s AS (SELECT *, CASE WHEN lag(date) OVER w >= DATE '2001-07-20' - 59 THEN datediff('day', lag(date) OVER w, date) END AS gap FROM series WHERE date <= DATE '2001-07-20' WINDOW w AS (PARTITION BY metric ORDER BY date)),
a AS (SELECT metric, min(date) AS first_date, max(date) AS last_date, count(*) AS n, round(count(*) FILTER (date > DATE '2001-07-20' - 14) / 14, 4) AS density, quantile_cont(gap, 0.5) AS typical_gap FROM s GROUP BY 1)
SELECT *, CASE WHEN datediff('day', last_date, DATE '2001-07-20') > 14 THEN 'stale' WHEN density < 0.7 THEN 'sparse' ELSE 'active' END AS status,
  coalesce(datediff('day', last_date, DATE '2001-07-20') > 0 AND datediff('day', last_date, DATE '2001-07-20') > typical_gap, false) AS behind FROM a"""
)
def coverage_status(spark, sf_dir):
    return training.coverage(long_series(spark, sf_dir), "2001-07-20")


WEAR = "wear AS (SELECT local_date AS date, count(DISTINCT (start_s % 86400) // 3600) AS hours FROM records WHERE source = 'watch' AND local_date <> DATE '2024-01-20' GROUP BY 1)"
WORN = """, ref AS (SELECT metric, count AS reference FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY count, date) AS k, count(*) OVER (PARTITION BY metric) AS n FROM series) WHERE k = CAST(floor(0.9 * (n - 1)) AS BIGINT) + 1),
worn AS (SELECT s.metric, s.date, s.value, s.count, hours, CASE WHEN hours IS NOT NULL THEN hours >= 12 ELSE count >= 0.25 * reference END AS worn FROM series s JOIN ref USING (metric) LEFT JOIN wear USING (date))
"""


def _worn(spark, sf_dir):
    wear = training.wear_hours(records(spark, sf_dir)).where("local_date <> date'2024-01-20'")
    return training.worn_days(short_series(spark, sf_dir), wear)


@query(views(RECORDS, DAILY_SHORT, SERIES, WEAR) + WORN + "SELECT metric, date, value, hours, worn FROM worn")
def wear_gate(spark, sf_dir):
    return _worn(spark, sf_dir).select("metric", "date", "value", "hours", "worn")


@query(
    views(RECORDS, DAILY_SHORT, SERIES, WEAR)
    + WORN
    + """, a AS (SELECT metric, count(*) AS rows, count(*) FILTER (worn) AS worn, count(*) FILTER (worn AND date > DATE '2024-01-29' - 7) AS worn_acute,
  round(avg(value) FILTER (worn AND date > DATE '2024-01-29' - 7) * 7, 4) AS acute, round(avg(value) FILTER (worn) * 7, 4) AS chronic
  FROM worn WHERE date BETWEEN DATE '2024-01-29' - 27 AND DATE '2024-01-29' GROUP BY 1),
g AS (SELECT *, CASE WHEN rows < 21 THEN 'insufficient_history' WHEN worn < ceil(0.75 * rows) THEN 'insufficient_wear' WHEN worn_acute < 5 THEN 'insufficient_recent_wear' END AS refusal FROM a),
q AS (SELECT *, CASE WHEN refusal IS NULL AND chronic > 0 THEN round(acute / chronic, 3) END AS ratio FROM g)
SELECT metric, rows, worn, worn_acute, refusal, acute, chronic, ratio, CASE WHEN ratio < 0.8 THEN 'low' WHEN ratio <= 1.3 THEN 'steady' WHEN ratio <= 1.5 THEN 'raised' WHEN ratio IS NOT NULL THEN 'high' END AS band FROM q"""
)
def acwr(spark, sf_dir):
    return training.load_ratio(_worn(spark, sf_dir), "2024-01-29")


@query(
    SHORT
    + """, k AS (SELECT *, count(*) OVER (PARTITION BY metric) AS n, row_number() OVER (PARTITION BY metric ORDER BY date DESC) AS k FROM series WHERE date BETWEEN DATE '2024-01-29' - 27 AND DATE '2024-01-29'),
a AS (SELECT metric, avg(value) FILTER (k <= greatest(1, least(7, n // 3))) AS recent, avg(value) FILTER (k > greatest(1, least(7, n // 3))) AS base, stddev_pop(value) FILTER (k > greatest(1, least(7, n // 3))) AS sd FROM k WHERE n >= 21 GROUP BY 1),
e AS (SELECT *, (recent - base) * 100 / abs(base) AS pct, (recent - base) / sd AS effect FROM a WHERE abs(base) >= 1e-6 AND sd > 0)
SELECT metric, round(recent, 4) AS recent, round(base, 4) AS baseline, round(greatest(-500, least(500, pct)), 2) AS pct, round(greatest(-99, least(99, effect)), 3) AS effect
FROM e WHERE abs(pct) BETWEEN 1 AND 10000 AND abs(effect) >= 0.1 ORDER BY abs(e.effect) DESC, abs(e.pct) DESC, metric LIMIT 8"""
)
def movers(spark, sf_dir):
    return training.movers(short_series(spark, sf_dir), "2024-01-29", least_pct=1, least_effect=0.1)


@query(
    LONG
    + """, a AS (SELECT metric, """
    + ", ".join(f"round(avg(value) FILTER (date BETWEEN DATE '2001-07-01' - {b + 29} AND DATE '2001-07-01' - {b}), 4) AS {n}" for b, n in ((0, "now"), (90, "ago_3m"), (180, "ago_6m"), (365, "ago_12m")))
    + """ FROM series GROUP BY 1)
SELECT *, CASE WHEN ago_12m <> 0 THEN round((now - ago_12m) * 100 / ago_12m, 2) END AS yoy_pct FROM a"""
)
def long_term_yoy(spark, sf_dir):
    return training.long_term(long_series(spark, sf_dir), "2001-07-01")


@query(
    SHORT
    + """SELECT * FROM (SELECT metric, arg_max(date, struct_pack(a := value, b := -datediff('day', DATE '1970-01-01', date))) AS date, max(value) AS value FROM series WHERE date <= DATE '2024-01-29' GROUP BY 1) WHERE date > DATE '2024-01-29' - 20"""
)
def all_time_highs(spark, sf_dir):
    return training.all_time_highs(short_series(spark, sf_dir), "2024-01-29", 20)


def _readiness_sql(day: str) -> str:
    return f"""(WITH h AS (SELECT *, max(date) OVER (PARTITION BY metric) AS latest FROM series WHERE date <= {day}),
k AS (SELECT *, date > latest - 3 AS now, row_number() OVER (PARTITION BY metric, date > latest - 3 ORDER BY date DESC) AS k FROM h),
a AS (SELECT metric, first(latest) AS latest, avg(value) FILTER (now) AS current, quantile_cont(CASE WHEN NOT now AND k <= 28 THEN value END, 0.5) AS baseline, count(CASE WHEN NOT now AND k <= 28 THEN 1 END) AS n_base FROM k GROUP BY 1)
SELECT metric, latest, round(current, 4) AS current, round(baseline, 4) AS baseline, n_base,
  CASE WHEN n_base >= 14 AND baseline > 0 THEN round(greatest(0.0, least(100.0, 50 + 1.25 * (current - baseline) * 100 / baseline)), 3) END AS score, datediff('day', latest, {day}) > 1 AS stale FROM a)"""


@query(SHORT + "SELECT * FROM " + _readiness_sql("DATE '2024-01-30'"))
def readiness_subscores(spark, sf_dir):
    return training.readiness(short_series(spark, sf_dir), "2024-01-30")


WEEK = [f"2024-01-{day}" for day in range(24, 31)]


@query(SHORT + "SELECT metric, count(score) AS n_days, round(avg(score), 2) AS weekly_score FROM (" + " UNION ALL ".join("SELECT metric, score FROM " + _readiness_sql(f"DATE '{day}'") for day in WEEK) + ") GROUP BY 1")
def weekly_readiness(spark, sf_dir):
    series = short_series(spark, sf_dir)
    days = training.readiness(series, WEEK[0])
    for day in WEEK[1:]:
        days = days.unionByName(training.readiness(series, day))
    return days.groupBy("metric").agg(F.count("score").alias("n_days"), F.round(F.avg("score"), 2).alias("weekly_score"))
