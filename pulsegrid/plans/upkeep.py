"""Queries over watermarks, marks, enrichment, stale derivations and power by month."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import upkeep
from pulsegrid.plans.events import EVENTS, _bucket_sql, _flagged
from pulsegrid.plans.registry import query, views
from pulsegrid.sources.adapters import DAILY_SHORT, RECORDS, SESSIONS, daily_short, records, sessions

ALLOWED = ["purchase", "signup"]
THROUGH = "2024-01-10"
BEHIND = f"metric NOT IN ('purchase', 'signup') AND local_date <= DATE '{THROUGH}'"


@query(views(RECORDS) + f"SELECT id, metric, local_date FROM records WHERE {BEHIND}")
def uncompacted_rows(spark, sf_dir):
    return upkeep.behind(records(spark, sf_dir), ALLOWED, THROUGH).select("id", "metric", "local_date")


@query(
    views(RECORDS)
    + f"""SELECT count(*) AS raw_total, count(*) FILTER (local_date <= DATE '{THROUGH}') AS raw_behind,
CASE WHEN count(*) FILTER (local_date <= DATE '{THROUGH}') > 0 THEN 'compacted_violated' ELSE 'compacted_clean' END AS status FROM records WHERE metric NOT IN ('purchase', 'signup')"""
)
def compaction_status(spark, sf_dir):
    return upkeep.compaction_status(records(spark, sf_dir), ALLOWED, THROUGH)


@query(views(RECORDS) + f"SELECT substr(sha256(CAST(id AS VARCHAR)), 1, 16) AS key, id, local_date AS stored_date FROM records WHERE {BEHIND}")
def compacted_samples(spark, sf_dir):
    rows = records(spark, sf_dir)
    gone = upkeep.compacted_keys(upkeep.behind(rows, ALLOWED, THROUGH), "id")
    return upkeep.offered_again(rows, "id", gone).select("key", "id", "stored_date")


@query(views(RECORDS, SESSIONS, "marks AS (SELECT id + 1 AS id FROM records WHERE metric = 'error')") + "SELECT id, kind, id IN (SELECT id FROM marks) AS marked FROM sessions")
def session_marks(spark, sf_dir):
    marks = records(spark, sf_dir).where("metric = 'error'").select((F.col("id") + 1).alias("id"))
    found = sessions(spark, sf_dir).select("id", "kind")
    with_mark = upkeep.marked(found, marks, "id").withColumn("marked", F.lit(True))
    return with_mark.unionByName(upkeep.marked(found, marks, "id", False).withColumn("marked", F.lit(False)))


WEATHER = "weather AS (SELECT start_s, value AS temp, CASE WHEN value > 10 THEN value - 10 END AS dew FROM records WHERE metric = 'purchase')"


def _weather(spark, sf_dir):
    samples = records(spark, sf_dir).where("metric = 'purchase'")
    return samples.select("start_s", F.col("value").alias("temp"), F.when(F.col("value") > 10, F.col("value") - 10).alias("dew"))


@query(
    views(RECORDS, SESSIONS, WEATHER)
    + """SELECT s.id, count(*) AS n_samples, round(avg(temp), 6) AS temp, max(temp) AS temp_max, round(avg(dew), 6) AS dew, max(dew) AS dew_max
FROM sessions s JOIN weather w ON w.start_s >= s.start_s AND w.start_s < s.end_s WHERE dew IS NOT NULL GROUP BY 1"""
)
def session_weather(spark, sf_dir):
    return upkeep.weather_of(sessions(spark, sf_dir), _weather(spark, sf_dir))


@query(
    views(RECORDS, SESSIONS, WEATHER)
    + """, fetched AS (SELECT s.id, s.source, bool_or(dew IS NOT NULL) AS usable FROM sessions s JOIN weather w ON w.start_s >= s.start_s AND w.start_s < s.end_s GROUP BY 1, 2),
status AS (SELECT id, CASE WHEN source = 'mirror' THEN 'no_route' WHEN usable THEN 'ok' ELSE 'pending' END AS status FROM fetched),
routes AS (SELECT id - 1 AS id FROM records WHERE metric = 'view')
SELECT s.id, s.local_date, status FROM sessions s LEFT JOIN status USING (id)
WHERE status IS NULL OR status = 'pending' OR (status = 'no_route' AND s.id IN (SELECT id FROM routes))"""
)
def unsettled_sessions(spark, sf_dir):
    from pulsegrid.operators.arbitration import in_sessions

    found, rows = sessions(spark, sf_dir), records(spark, sf_dir)
    inside = in_sessions(_weather(spark, sf_dir), found).groupBy(F.col("session_id").alias("id")).agg(F.max(F.col("dew").isNotNull()).alias("usable"))
    state = F.when(F.col("source") == "mirror", "no_route").when(F.col("usable"), "ok").otherwise("pending")
    status = inside.join(found.select("id", "source"), "id").select("id", state.alias("status"))
    routes = rows.where("metric = 'view'").select((F.col("id") - 1).alias("id"))
    return upkeep.unsettled(found.select("id", "local_date"), status, routes)


#: The queries' days hold short blocks, so they wait one bucket in place of POWER_LAG.
LAG = 1
POWER = f""", outdoors AS (SELECT * FROM sessions WHERE kind = 'run' AND source <> 'mirror'),
laid AS (SELECT o.id, c.local_date, c.bkt, c.pace, c.is_walk OR c.is_jog AS held, lag(c.bkt) OVER r = c.bkt - 1 AS beside, lag(c.is_walk OR c.is_jog) OVER r AS held_before
  FROM outdoors o JOIN classified c ON c.bkt * 20 >= o.start_s AND c.bkt * 20 < o.end_s WINDOW r AS (PARTITION BY o.id ORDER BY c.bkt)),
blocks AS (SELECT *, sum(CASE WHEN held AND NOT coalesce(beside AND held_before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY bkt) AS block FROM laid),
waits AS (SELECT *, bkt - min(bkt) OVER b + CASE WHEN first_value(coalesce(beside, false)) OVER (b ORDER BY bkt) THEN 1 ELSE 0 END AS elapsed FROM blocks WHERE held WINDOW b AS (PARTITION BY id, block)),
pw AS (SELECT local_date, CAST(floor(start_s / 20) AS BIGINT) AS bkt, avg(value) AS power FROM records WHERE metric = 'purchase' GROUP BY 1, 2),
runs AS (SELECT o.id, o.start_s, o.end_s, o.local_date, avg(p.power) AS power, count(*) AS n_buckets FROM outdoors o JOIN waits w ON w.id = o.id AND elapsed >= {LAG} AND w.pace BETWEEN 5 AND 40 JOIN pw p ON p.local_date = w.local_date AND p.bkt = w.bkt GROUP BY 1, 2, 3, 4)
"""


def _outdoors(spark, sf_dir):
    return sessions(spark, sf_dir).where("kind = 'run' and source <> 'mirror'")


def _powers(spark, sf_dir):
    return upkeep.run_power(_outdoors(spark, sf_dir), _flagged(spark, sf_dir), records(spark, sf_dir).where("metric = 'purchase'"), 5, 40, "foot", LAG)


@query(_bucket_sql() + POWER + "SELECT id, n_buckets, round(power, 6) AS power FROM runs")
def matched_power(spark, sf_dir):
    return _powers(spark, sf_dir).withColumn("power", F.round("power", 6))


@query(
    _bucket_sql()
    + POWER
    + """, alone AS (SELECT * FROM runs a WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.start_s <= a.start_s AND a.end_s <= o.end_s AND (o.start_s < a.start_s OR (o.start_s = a.start_s AND o.id < a.id))))
SELECT CAST(date_trunc('month', local_date) AS DATE) AS month, count(*) AS n_runs, CASE WHEN count(*) >= 2 THEN round(avg(power), 2) END AS power FROM alone GROUP BY 1"""
)
def monthly_power(spark, sf_dir):
    return upkeep.monthly_power(_outdoors(spark, sf_dir), _powers(spark, sf_dir))


NEEDS = [("click", "view"), ("click", "purchase"), ("view", "view"), ("error", "error"), ("purchase", "purchase"), ("signup", "signup"), ("signup", "view")]
DERIVED = "derived AS (SELECT metric, date + 10 AS date, CASE WHEN date < DATE '2024-01-08' THEN 2 ELSE 1 END AS version FROM daily)"


def _derived(spark, sf_dir):
    days = daily_short(spark, sf_dir)
    return days.select("metric", F.date_add("date", 10).alias("date"), F.when(F.col("date") < F.lit("2024-01-08").cast("date"), 2).otherwise(1).alias("version"))


@query(
    views(RECORDS, DAILY_SHORT, DERIVED, "needs(metric, source_metric) AS (VALUES " + ", ".join(str(x) for x in NEEDS) + ")")
    + """, j AS (SELECT d.*, NOT EXISTS (SELECT 1 FROM needs n WHERE n.metric = d.metric AND NOT EXISTS (SELECT 1 FROM records r WHERE r.metric = n.source_metric AND r.local_date = d.date)) AS whole FROM derived d)
SELECT metric, count(*) FILTER (version = 2) AS fresh, count(*) FILTER (version <> 2 AND whole) AS stale, count(*) FILTER (version <> 2 AND NOT whole) AS unrecomputable FROM j GROUP BY 1"""
)
def derived_versions(spark, sf_dir):
    needs = spark.createDataFrame(NEEDS, "metric string, source_metric string")
    return upkeep.version_report(_derived(spark, sf_dir), 2, needs, records(spark, sf_dir))


@query(views(RECORDS, SESSIONS, DAILY_SHORT, DERIVED) + "SELECT local_date AS date FROM records WHERE metric IN ('view', 'purchase') UNION SELECT local_date FROM sessions UNION SELECT date FROM derived")
def rederived_days(spark, sf_dir):
    return upkeep.days_to_rederive(records(spark, sf_dir), ["view", "purchase"], sessions(spark, sf_dir), _derived(spark, sf_dir))


@query(
    views(RECORDS, SESSIONS)
    + """, touched AS (SELECT metric, local_date FROM records WHERE value > 150)
SELECT local_date FROM touched UNION SELECT local_date - 1 FROM touched WHERE metric = 'purchase' UNION SELECT local_date FROM sessions WHERE kind = 'run'"""
)
def reconciled_days(spark, sf_dir):
    touched = records(spark, sf_dir).where("value > 150").select("metric", "local_date").distinct()
    return upkeep.days_to_reconcile(touched, sessions(spark, sf_dir).where("kind = 'run'"), "purchase")


@query(
    views(RECORDS, DAILY_SHORT)
    + """, c AS (SELECT source, metric, local_date, id, value AS stated, avg AS computed, abs(value - avg) <= 10 AS agrees FROM records JOIN daily USING (metric) WHERE daily.date = local_date),
l AS (SELECT *, row_number() OVER (PARTITION BY source, metric, local_date ORDER BY id DESC) AS k FROM c)
SELECT source, metric, local_date, id, stated, computed, round(computed - stated, 6) AS delta FROM l WHERE k = 1 AND NOT agrees"""
)
def claim_disagreements(spark, sf_dir):
    days = daily_short(spark, sf_dir).select("metric", F.col("date").alias("local_date"), F.col("avg").alias("computed"))
    rows = records(spark, sf_dir).select("source", "metric", "local_date", "id", F.col("value").alias("stated"))
    claims = rows.join(days, ["metric", "local_date"]).withColumn("agrees", F.abs(F.col("stated") - F.col("computed")) <= 10)
    return upkeep.disagreements(claims, ["source", "metric", "local_date"], ["id"]).drop("agrees")


@query(EVENTS + """SELECT '{"source":"' || source || '","kind":"' || kind || '"}' AS revision, count(*) AS n, min(id) AS first_id, md5('{"source":"' || source || '","kind":"' || kind || '"}') AS revision_key FROM sessions GROUP BY source, kind""")
def source_revisions(spark, sf_dir):
    return upkeep.revisions(sessions(spark, sf_dir), ["source", "kind"], "id")
