"""Queries that apply the scalar rules to whole tables."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from pulsegrid.functions import stats, times, windows
from pulsegrid.functions.significance import correlation_p_sql
from pulsegrid.operators import correlation
from pulsegrid.plans.daily import short_series
from pulsegrid.plans.other import COEFFICIENT, JUDGED, TOLD
from pulsegrid.plans.registry import query, views
from pulsegrid.sources.adapters import DAILY_SHORT, RECORDS, SERIES, SESSIONS, records, sessions, table

AS_OF = "2024-01-25"

# Clock and calendar ------------------------------------------------------------

STAMPS = """, stamps AS (SELECT id, start_s, local_date,
  strftime(make_timestamp(start_s * 1000000), '%Y-%m-%d %H:%M:%S') || CASE id % 4 WHEN 0 THEN ' +0000' WHEN 1 THEN ' -0500' WHEN 2 THEN ' +0530' ELSE ' GMT' END AS stamp FROM records)"""


def _stamps(spark, sf_dir):
    rows = records(spark, sf_dir)
    zone = F.when(F.col("id") % 4 == 0, " +0000").when(F.col("id") % 4 == 1, " -0500").when(F.col("id") % 4 == 2, " +0530").otherwise(" GMT")
    text = F.regexp_replace(F.substring(times.iso_utc(F.col("start_s")), 1, 19), "T", " ")
    return rows.select("id", "start_s", "local_date", F.concat(text, zone).alias("stamp"))


@query(
    views(RECORDS)
    + STAMPS
    + """, u AS (SELECT *, CASE id % 4 WHEN 0 THEN start_s WHEN 1 THEN start_s + 18000 WHEN 2 THEN start_s - 19800 END AS utc_s FROM stamps)
SELECT id, utc_s, strftime(make_timestamp(utc_s * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS utc_iso, CAST(substr(stamp, 1, 10) AS DATE) AS civil_day,
  replace(substr(stamp, 1, 19), ' ', 'T') AS naive FROM u"""
)
def stamps_parsed(spark, sf_dir):
    rows = _stamps(spark, sf_dir).withColumn("utc_s", times.utc_seconds(F.col("stamp")))
    return rows.select("id", "utc_s", times.iso_utc(F.col("utc_s")).alias("utc_iso"), times.local_date(F.col("stamp")).alias("civil_day"), times.local_naive(F.col("stamp")).alias("naive"))


@query(
    views(RECORDS)
    + f"""SELECT id, datediff('day', DATE '1970-01-01', local_date) AS day_number, start_s // 20 AS bucket, CAST(trunc((id - 500) / 7) AS BIGINT) AS quotient,
  strftime(make_timestamp(start_s * 1000000), '%H:%M') AS hhmm, strftime(make_timestamp(start_s * 1000000), '%H:%M:%S') AS hhmmss,
  datediff('day', local_date, DATE '{AS_OF}') AS age_days, CAST(date_trunc('week', local_date) AS DATE) AS monday,
  CAST(CASE WHEN id % 3 = 0 THEN local_date + 3 ELSE CAST(date_trunc('week', local_date) AS DATE) + 6 END AS DATE) AS span_end,
  date_sub('year', DATE '1980-01-15' + CAST(id % 9000 AS INTEGER), local_date) AS age FROM records"""
)
def calendar_rules(spark, sf_dir):
    rows = records(spark, sf_dir)
    monday = F.to_date(F.trunc("local_date", "week"))
    second = F.pmod(F.col("start_s"), F.lit(86400))
    born = F.date_add(F.lit("1980-01-15").cast("date"), (F.col("id") % 9000).cast("int"))
    return rows.select(
        "id",
        times.unix_day(F.col("local_date")).cast("long").alias("day_number"),
        times.bucket_index(F.col("start_s")).alias("bucket"),
        times.trunc_div(F.col("id") - 500, F.lit(7)).alias("quotient"),
        times.clock(second).alias("hhmm"),
        times.clock(second, True).alias("hhmmss"),
        F.datediff(F.lit(AS_OF).cast("date"), "local_date").cast("long").alias("age_days"),
        monday.alias("monday"),
        times.week_span_end(monday, F.when(F.col("id") % 3 == 0, F.date_add("local_date", 3))).alias("span_end"),
        times.age_on(born, F.col("local_date")).cast("long").alias("age"),
    )


@query(
    views(RECORDS)
    + """SELECT id, datediff('day', DATE '1970-01-01', local_date) * 86400 + CAST(round((id % 24) * 3600.0) AS BIGINT) - CASE WHEN id % 24 >= 12 THEN 86400 ELSE 0 END AS bed_s,
  datediff('day', DATE '1970-01-01', local_date) * 86400 + 25200 AS wake_s,
  strftime(timezone('America/New_York', timezone('UTC', make_timestamp(start_s * 1000000))), '%H:%M') AS new_york,
  CAST(CASE WHEN id % 5 = 0 THEN NULL ELSE local_date END AS DATE) AS strict FROM records"""
)
def zones_and_nights(spark, sf_dir):
    rows = records(spark, sf_dir)
    bed, wake = times.night_seconds(F.col("local_date"), F.col("id") % 24, F.lit(7))
    utc = F.to_timestamp_ntz(F.regexp_replace(F.substring(times.iso_utc(F.col("start_s")), 1, 19), "T", " "))
    there = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), utc)
    text = F.when(F.col("id") % 5 == 0, F.concat(F.date_format("local_date", "yyyy-MM-dd"), F.lit("T"))).otherwise(F.date_format("local_date", "yyyy-MM-dd"))
    return rows.select("id", bed.alias("bed_s"), wake.alias("wake_s"), F.date_format(there, "HH:mm").alias("new_york"), times.strict_date(text).alias("strict"))


PHRASES = ["today", "yesterday", "this week", "last  week", "the last week", "past week", "this month", "Last month", "the past month", "past 10 days", "past 1 day", "2024-01-05", "jan 9", "December 25", "Feb 29", "dec 1, 2023", "week starting January 3", "Jan 2 through Jan 6", "2023-12-28 to 2024-01-03", "some day", "past 0 days"]
_WINDOWS = """CASE p
  WHEN 'today' THEN {t: d, u: d, k: 'day'} WHEN 'yesterday' THEN {t: d - 1, u: d - 1, k: 'day'}
  WHEN 'this week' THEN {t: m, u: d, k: 'week'} WHEN 'last  week' THEN {t: m - 7, u: m - 1, k: 'week'}
  WHEN 'the last week' THEN {t: d - 6, u: d, k: NULL} WHEN 'past week' THEN {t: d - 6, u: d, k: NULL}
  WHEN 'this month' THEN {t: f, u: d, k: NULL} WHEN 'Last month' THEN {t: CAST(f - INTERVAL 1 MONTH AS DATE), u: f - 1, k: NULL}
  WHEN 'the past month' THEN {t: d - 29, u: d, k: NULL} WHEN 'past 10 days' THEN {t: d - 9, u: d, k: 'day'} WHEN 'past 1 day' THEN {t: d, u: d, k: 'day'}
  WHEN '2024-01-05' THEN {t: DATE '2024-01-05', u: DATE '2024-01-05', k: 'day'}
  WHEN 'jan 9' THEN {t: CASE WHEN d >= DATE '2024-01-09' THEN DATE '2024-01-09' ELSE DATE '2023-01-09' END, u: CASE WHEN d >= DATE '2024-01-09' THEN DATE '2024-01-09' ELSE DATE '2023-01-09' END, k: 'day'}
  WHEN 'December 25' THEN {t: DATE '2023-12-25', u: DATE '2023-12-25', k: 'day'} WHEN 'Feb 29' THEN {t: DATE '2020-02-29', u: DATE '2020-02-29', k: 'day'}
  WHEN 'dec 1, 2023' THEN {t: DATE '2023-12-01', u: DATE '2023-12-01', k: 'day'}
  WHEN 'week starting January 3' THEN {t: CASE WHEN d >= DATE '2024-01-03' THEN DATE '2024-01-03' ELSE DATE '2023-01-03' END, u: CASE WHEN d >= DATE '2024-01-03' THEN DATE '2024-01-09' ELSE DATE '2023-01-09' END, k: 'week'}
  WHEN 'Jan 2 through Jan 6' THEN {t: CASE WHEN d >= DATE '2024-01-02' THEN DATE '2024-01-02' ELSE DATE '2023-01-02' END, u: CASE WHEN d >= DATE '2024-01-02' THEN DATE '2024-01-06' ELSE DATE '2023-01-06' END, k: NULL}
  WHEN '2023-12-28 to 2024-01-03' THEN {t: DATE '2023-12-28', u: DATE '2024-01-03', k: NULL}
  ELSE {t: NULL, u: NULL, k: NULL} END"""


@query(
    views(RECORDS)
    + f""", days AS (SELECT DISTINCT local_date AS d, CAST(date_trunc('week', local_date) AS DATE) AS m, CAST(date_trunc('month', local_date) AS DATE) AS f FROM records),
w AS (SELECT d AS as_of, p AS phrase, {_WINDOWS} AS w FROM days, (VALUES {", ".join(f"('{p}')" for p in PHRASES)}) t(p))
SELECT as_of, phrase, CAST(w.t AS DATE) AS start, CAST(w.u AS DATE) AS stop, CAST(w.k AS VARCHAR) AS unit FROM w"""
)
def phrase_windows(spark, sf_dir):
    days = records(spark, sf_dir).select(F.col("local_date").alias("as_of")).distinct()
    asked = days.withColumn("phrase", F.explode(F.array(*map(F.lit, PHRASES))))
    return windows.with_windows(asked, "phrase", "as_of")


SPECS = {"30d": 30, "12w": 84, "6m": 180, " 1Y ": 365, "all": None, "lifetime": None, "june": None, "0d": None}


@query(
    views(RECORDS)
    + f""", days AS (SELECT DISTINCT local_date AS d FROM records)
SELECT d AS as_of, spec, CAST(d - CAST(n AS INTEGER) + 1 AS DATE) AS start, n IS NOT NULL OR spec IN ('all', 'lifetime') AS known
FROM days, (VALUES {", ".join(f"('{k}', {'NULL' if n is None else n})" for k, n in SPECS.items())}) t(spec, n)"""
)
def period_specs(spark, sf_dir):
    days = records(spark, sf_dir).select(F.col("local_date").alias("as_of")).distinct()
    asked = days.withColumn("spec", F.explode(F.array(*map(F.lit, SPECS))))
    return asked.select("as_of", "spec", windows.period_start(F.col("spec"), F.col("as_of")).alias("start"), windows.is_period(F.col("spec")).alias("known"))


@query(
    views(RECORDS, SESSIONS, DAILY_SHORT)
    + """, k AS (SELECT metric, min(date) AS first_day, max(date) AS known_through FROM daily GROUP BY 1), g AS (SELECT max(local_date) AS gradeable_through FROM sessions)
SELECT metric, first_day, known_through, gradeable_through, datediff('day', first_day, known_through) + 1 AS n_days FROM k, g"""
)
def horizons(spark, sf_dir):
    last = sessions(spark, sf_dir).agg(F.max("local_date").alias("gradeable_through"))
    known = records(spark, sf_dir).groupBy("metric").agg(F.min("local_date").alias("first_day"), F.max("local_date").alias("known_through"))
    days = (F.datediff("known_through", "first_day") + 1).cast("long").alias("n_days")
    return known.crossJoin(last).select("metric", "first_day", "known_through", "gradeable_through", days)  # one row


# Numbers -------------------------------------------------------------------------


@query(
    views(RECORDS)
    + """SELECT id, round(208 - 0.7::DOUBLE * (id % 80), 4) AS max_hr, round(60 + 0.7::DOUBLE * (120 + id % 70), 4) AS zone2_top,
  round(CASE WHEN id % 11 > 0 THEN value / (id % 11) END, 6) AS pace, round(CASE WHEN id % 11 > 0 THEN value * 100 / ((id % 11) * 1609.344::DOUBLE) END, 6) AS grade,
  round(CASE WHEN (id % 7) / 5 <= 1 THEN (id % 7) / 5 * 100 ELSE (id % 7) / 5 END, 6) AS share,
  round(greatest(10.0::DOUBLE, least(50.0::DOUBLE, value)), 6) AS clamped, round(CASE WHEN id % 5 <> 0 THEN (value - id % 5) / (id % 5) * 100 END, 4) AS change,
  CASE WHEN id % 13 = 0 THEN NULL WHEN value % 90 < 55 THEN 'dry' WHEN value % 90 < 60 THEN 'comfortable' WHEN value % 90 < 65 THEN 'sticky' WHEN value % 90 < 70 THEN 'humid' WHEN value % 90 < 75 THEN 'oppressive' ELSE 'dangerous' END AS dew,
  abs(value - round(value)) <= greatest(abs(round(value)) * 0.01::DOUBLE, 0.05::DOUBLE) AS near FROM records"""
)
def scalar_rules(spark, sf_dir):
    rows = records(spark, sf_dir)
    k, v = F.col("id"), F.col("value")
    dew = F.when(k % 13 != 0, v % 90)
    return rows.select(
        "id",
        F.round(stats.max_hr_from_age(k % 80), 4).alias("max_hr"),
        F.round(stats.zone2_top(F.lit(60), 180 + k % 70), 4).alias("zone2_top"),
        F.round(stats.pace(v, k % 11), 6).alias("pace"),
        F.round(stats.grade_pct(v, k % 11), 6).alias("grade"),
        F.round(stats.canonical_share(k % 7 / 5), 6).alias("share"),
        F.round(stats.clamp(v, 10.0, 50.0), 6).alias("clamped"),
        F.round(stats.pct_change(v, k % 5), 4).alias("change"),
        stats.dew_label(dew).alias("dew"),
        stats.close(v, F.round(v), 0.01, 0.05).alias("near"),
    )


@query(
    views(RECORDS)
    + f"""SELECT id, lower(regexp_replace(regexp_replace('HKType' || upper(metric[1]) || metric[2:] || 'RateAvg', '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS name,
  sha1(metric || '|' || start_s || '|' || end_s || '|' || source) AS record_key, sha1('bucket|' || metric || '|' || (start_s // 20)) AS bucket_key,
  CASE WHEN local_date > DATE '{AS_OF}' THEN 'future' WHEN id % 3 = 0 THEN 'recorded' ELSE 'not_recorded' END AS state,
  CASE WHEN abs(v - round(v)) <= 4e-16 * abs(v) THEN round(v) ELSE v END AS snapped FROM (SELECT *, id * 0.1::DOUBLE * 10 AS v FROM records)"""
)
def names_and_keys(spark, sf_dir):
    rows = records(spark, sf_dir)
    camel = F.concat(F.lit("HKType"), F.upper(F.substring("metric", 1, 1)), F.expr("substring(metric, 2)"), F.lit("RateAvg"))
    text = lambda c: F.col(c).cast("string")
    return rows.select(
        "id",
        stats.snake_case(camel).alias("name"),
        stats.key_of(F.col("metric"), text("start_s"), text("end_s"), F.col("source")).alias("record_key"),
        stats.key_of(F.lit("bucket"), F.col("metric"), times.bucket_index(F.col("start_s")).cast("string")).alias("bucket_key"),
        stats.day_state(F.col("local_date"), F.lit(AS_OF).cast("date"), F.col("id") % 3 == 0).alias("state"),
        stats.snapped(F.col("id") * 0.1 * 10).alias("snapped"),
    )


@query(
    views(RECORDS, SESSIONS)
    + """SELECT id, round(CASE WHEN 60 + id % 50 * 3 > 90 THEN m * greatest(0.0::DOUBLE, (120 - 90) / (60 + id % 50 * 3 - 90)::DOUBLE) * 0.64::DOUBLE * exp(1.92::DOUBLE * greatest(0.0::DOUBLE, (120 - 90) / (60 + id % 50 * 3 - 90)::DOUBLE)) END, 4) AS load
FROM (SELECT id, (end_s - start_s) / 60 AS m FROM sessions)"""
)
def degenerate_loads(spark, sf_dir):
    minutes = (F.col("end_s") - F.col("start_s")) / 60
    load = stats.trimp(minutes, F.lit(120.0), F.lit(90.0), (60 + F.col("id") % 50 * 3).cast("double"))
    return sessions(spark, sf_dir).select("id", F.round(load, 4).alias("load"))


@query(
    views(RECORDS, DAILY_SHORT)
    + f""", k AS (SELECT metric, last, row_number() OVER (PARTITION BY metric ORDER BY date DESC) AS k FROM daily WHERE date <= DATE '{AS_OF}' AND last IS NOT NULL)
SELECT metric, count(*) AS n, round(median(last), 4) AS resting FROM k WHERE k <= 28 GROUP BY 1"""
)
def resting_baseline(spark, sf_dir):
    """Median of the latest 28 days' last values up to a day."""
    from pulsegrid.sources.adapters import daily_short

    days = daily_short(spark, sf_dir).where((F.col("date") <= F.lit(AS_OF).cast("date")) & F.col("last").isNotNull())
    # days of one metric are few: the latest are cut from a sorted array
    latest = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("date", "last")))), 1, 28)
    held = days.groupBy("metric").agg(latest.alias("latest")).select("metric", F.explode("latest.last").alias("last"))
    return held.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.percentile("last", 0.5), 4).alias("resting"))


# Registered hypotheses ---------------------------------------------------------------

HYPOTHESES = [("h1", "click", "purchase", 0), ("h2", "click", "purchase", 1), ("h3", "view", "error", 0), ("h4", "signup", "view", 2), ("h5", "error", "click", 1), ("h6", "click", "purchase", 26), ("h7", "no_such_metric", "click", 0)]
TARGET, POWER = 0.35, 0.8


def pairs_needed(rho: float, tests: int, q: float = correlation.FDR, power: float = POWER) -> float:
    """Pairs (before rounding up) that show a rank correlation with the given power when
    the best of ``tests`` is held against q / tests."""
    import math

    z = NormalDist().inv_cdf(1 - q / tests / 2) + NormalDist().inv_cdf(power)
    return correlation.SPEARMAN_INFLATION * (z / math.atanh(rho)) ** 2 + 3


@query(
    views(RECORDS, DAILY_SHORT, SERIES)
    + f""", h AS (SELECT * FROM (VALUES {", ".join(map(str, HYPOTHESES))}) t(name, mx, my, lag)),
s AS (SELECT name, x.value AS x, y.value AS y FROM h JOIN series y ON y.metric = h.my JOIN series x ON x.metric = h.mx AND x.date = y.date - h.lag),
k AS (SELECT name, (rank() OVER (PARTITION BY name ORDER BY x) + (count(*) OVER (PARTITION BY name, x) - 1) / 2) AS x, (rank() OVER (PARTITION BY name ORDER BY y) + (count(*) OVER (PARTITION BY name, y) - 1) / 2) AS y FROM s),
a AS (SELECT h.*, coalesce(n, 0) AS n, coalesce(flat, false) AS flat, c FROM h LEFT JOIN (SELECT name, {COEFFICIENT} FROM k GROUP BY 1) USING (name)),
t AS (SELECT name, mx, my, lag, {TOLD.format(k="1.06")} FROM a),
{JUDGED},
tests AS (SELECT greatest(count(p), 1) AS m FROM t),
halved AS (
  WITH RECURSIVE g(name, n, low, high, step) AS (
    SELECT name, n, 0.0::DOUBLE, 1.0::DOUBLE, 0 FROM t WHERE n > 2
    UNION ALL
    SELECT name, n, CASE WHEN p > {correlation.FDR} / m THEN c ELSE low END, CASE WHEN p > {correlation.FDR} / m THEN high ELSE c END, step + 1
    FROM (SELECT *, {correlation_p_sql("c", "n")} AS p FROM (SELECT *, (low + high) / 2 AS c FROM g WHERE step < 40)), tests)
  SELECT name, round(high, 4) AS least_rho FROM g WHERE step = 40)
SELECT t.name, t.mx, t.my, CAST(t.lag AS INTEGER) AS lag, t.status, t.n, t.rho, t.p, round(qv, 4) AS q_value, coalesce(round(qv, 6) <= {correlation.FDR}, false) AS passed_fdr, least_rho,
  t.n >= {pairs_needed(TARGET, len(HYPOTHESES))!r}::DOUBLE AS enough, CAST(ceil({pairs_needed(TARGET, len(HYPOTHESES))!r}::DOUBLE) AS BIGINT) AS needed
FROM t LEFT JOIN j ON j.name = t.name LEFT JOIN halved ON halved.name = t.name"""
)
def registered_hypotheses(spark, sf_dir):
    """Rank correlations of the pairs that were named beforehand with p and q, the least one
    that could have shown, and whether there are days enough to see an effect of the size
    that was asked about.  Pairs that can't be tested say why."""
    rows = ", ".join(f"('{n}', '{x}', '{y}', {k})" for n, x, y, k in HYPOTHESES)
    named = spark.sql(f"SELECT * FROM VALUES {rows} AS t(name, mx, my, lag)")
    found = correlation.tested(named, short_series(spark, sf_dir))
    least = pairs_needed(TARGET, len(HYPOTHESES))
    return found.select("name", "mx", "my", "lag", "status", "n", "rho", "p", "q_value", "passed_fdr", "least_rho", (F.col("n") >= least).alias("enough"), F.ceil(F.lit(least)).cast("long").alias("needed"))


# Skip reasons --------------------------------------------------------------------------

#: Fixed value: days within which a total is pulled again and must not be backfilled.
REPULL_DAYS = 14


@query(
    views(RECORDS, DAILY_SHORT)
    + f""", given AS (SELECT metric, date, sum, CASE WHEN day(date) % 5 = 0 THEN 'partial' ELSE 'settled' END AS state FROM daily), held AS (SELECT metric, date FROM daily WHERE count > 60)
SELECT g.metric, g.date, CASE WHEN datediff('day', g.date, DATE '{AS_OF}') <= {REPULL_DAYS} THEN 'inside_window' WHEN h.date IS NOT NULL THEN 'existing' WHEN state <> 'settled' THEN 'not_settled' END AS reason
FROM given g LEFT JOIN held h ON h.metric = g.metric AND h.date = g.date"""
)
def backfill_reasons(spark, sf_dir):
    """Why a backfilled total is refused; null where it is taken."""
    from pulsegrid.sources.adapters import daily_short

    daily = daily_short(spark, sf_dir)
    state = F.when(F.dayofmonth("date") % 5 == 0, "partial").otherwise("settled")
    held = daily.where("count > 60").select("metric", "date", F.lit(True).alias("held"))
    recent = F.datediff(F.lit(AS_OF).cast("date"), "date") <= REPULL_DAYS
    reason = F.when(recent, "inside_window").when(F.col("held"), "existing").when(state != "settled", "not_settled")
    return daily.join(held, ["metric", "date"], "left").select("metric", "date", reason.alias("reason"))


# Plan weeks ----------------------------------------------------------------------------


@query(
    views(RECORDS)
    + """, d AS (SELECT DISTINCT local_date AS day FROM records),
w AS (SELECT CAST(date_trunc('week', day) AS DATE) AS start, CAST(CASE WHEN weekofyear(day) % 3 = 0 THEN date_trunc('week', day) + INTERVAL 8 DAY END AS DATE) AS declared FROM d GROUP BY ALL),
s AS (SELECT start, coalesce(declared, start + 6) AS stop, declared IS NOT NULL AS is_declared FROM w),
h AS (SELECT day, start, stop, is_declared FROM d JOIN s ON day BETWEEN start AND stop)
SELECT day, CASE WHEN max(CASE WHEN is_declared THEN start END) < max(start) THEN NULL ELSE max(start) END AS week, count(*) AS n_spans,
  coalesce(max(CASE WHEN is_declared THEN start END) < max(start), false) AS refused FROM h GROUP BY 1"""
)
def week_of_day(spark, sf_dir):
    """The plan week that holds a day.  Undeclared weeks of seven days yield to later ones;
    a declared week that runs into the next one makes its last days ambiguous: refused."""
    days = records(spark, sf_dir).select(F.col("local_date").alias("day")).distinct()
    monday = F.to_date(F.trunc("day", "week"))
    declared = F.when(F.weekofyear("day") % 3 == 0, F.date_add(monday, 8))
    spans = days.select(monday.alias("start"), declared.alias("declared")).distinct()
    spans = spans.select("start", times.week_span_end(F.col("start"), F.col("declared")).alias("stop"), F.col("declared").isNotNull().alias("is_declared"))
    # a span is met by each of its days, so the join is one of equal days
    by_day = spans.withColumn("day", F.explode(F.sequence("start", "stop")))
    held = days.join(by_day, "day").groupBy("day").agg(F.max("start").alias("last"), F.max(F.when(F.col("is_declared"), F.col("start"))).alias("fixed"), F.count("*").alias("n_spans"))
    refused = F.coalesce(F.col("fixed") < F.col("last"), F.lit(False))
    return held.select("day", F.when(~refused, F.col("last")).alias("week"), "n_spans", refused.alias("refused"))


@query(
    """WITH b AS (SELECT CAST(ts AS DATE) AS day, CAST(user_id % 6 + 1 AS INTEGER) AS stage, value, date_trunc('second', ts) AS t FROM events WHERE event_type = 'purchase'),
e AS (SELECT day, stage, max(t) AS stop FROM b GROUP BY 1, 2)
SELECT b.day, b.stage, count(*) AS n, round(median(value), 4) AS median_value FROM b JOIN e ON b.day = e.day AND b.stage = e.stage WHERE t >= stop - INTERVAL 2 HOUR GROUP BY 1, 2"""
)
def benchmark_series(spark, sf_dir):
    """Median over the last stretch of every stage and day."""
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    rows = rows.select(F.to_date("ts").alias("day"), (F.col("user_id") % 6 + 1).cast("int").alias("stage"), "value", (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))).alias("t"))
    stops = rows.groupBy("day", "stage").agg(F.max("t").alias("stop"))
    last = rows.join(stops, ["day", "stage"]).where("t >= stop - 7200")
    return last.groupBy("day", "stage").agg(F.count("*").alias("n"), F.round(F.percentile("value", 0.5), 4).alias("median_value"))
