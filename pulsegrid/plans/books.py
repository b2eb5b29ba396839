"""Queries over totals that settle, migrations that can be undone, rules in force, claims
that rest on claims, unit spellings and packed routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import quantities
from pulsegrid.operators import claims, intervals, journal
from pulsegrid.plans.registry import query, views
from pulsegrid.sources import routes
from pulsegrid.sources.adapters import DAILY_SHORT, RECORDS, daily_short, records, table
from pulsegrid.sources.shared import shared_path, written
from pulsegrid.streaming import settling

# Totals that settle --------------------------------------------------------------

#: Four pulls of every day, one of them after it settled; every fourth day never settles.
PULLS = """, pulls AS (SELECT metric, date AS local_date, round(CASE WHEN k = 0 THEN sum * 0.5 WHEN day(date) % 3 = 0 AND k = 3 THEN sum + 1 ELSE sum END, 4) AS value,
  CASE WHEN k >= 2 AND day(date) % 4 <> 0 THEN 'settled' ELSE 'provisional' END AS state, 'b' || (date - DATE '2024-01-01' + k) AS batch_id, CAST(date + k AS TIMESTAMP) AS queried_at
  FROM daily, unnest([0, 1, 2, 3]) t(k))
"""
FOLD = (
    views(RECORDS, DAILY_SHORT)
    + PULLS
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY metric, local_date ORDER BY queried_at) AS revision, count(*) OVER (PARTITION BY metric, local_date) AS version FROM pulls),
f AS (SELECT *, min(CASE WHEN state = 'settled' THEN revision END) OVER (PARTITION BY metric, local_date) AS fixed FROM n),
folded AS (SELECT f.metric, f.local_date, CAST(f.version AS INTEGER) AS version, CAST(f.revision AS INTEGER) AS revision, b.value AS from_value, f.value AS to_value, b.state AS from_state, f.state AS to_state,
  CAST(CAST(f.queried_at AS DATE) - f.local_date AS INTEGER) AS lag_days, f.batch_id,
  CASE WHEN f.revision = 1 THEN 'first' WHEN f.revision > f.fixed THEN 'refused' WHEN f.state = 'settled' THEN 'settled' WHEN b.value = f.value THEN 'same' ELSE 'changed' END AS outcome
  FROM f LEFT JOIN f b ON b.metric = f.metric AND b.local_date = f.local_date AND b.revision = least(f.revision - 1, coalesce(f.fixed, f.revision - 1)))
"""
)


def _pulls(spark, sf_dir):
    days = daily_short(spark, sf_dir).select("metric", F.col("date").alias("local_date"), "sum", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("k"))
    day = F.dayofmonth("local_date")
    value = F.when(F.col("k") == 0, F.col("sum") * 0.5).when((day % 3 == 0) & (F.col("k") == 3), F.col("sum") + 1).otherwise(F.col("sum"))
    state = F.when((F.col("k") >= 2) & (day % 4 != 0), "settled").otherwise("provisional")
    batch = F.concat(F.lit("b"), (F.datediff("local_date", F.lit("2024-01-01").cast("date")) + F.col("k")).cast("string"))
    return days.select("metric", "local_date", F.round(value, 4).alias("value"), state.alias("state"), batch.alias("batch_id"), F.date_add("local_date", F.col("k")).cast("timestamp").alias("queried_at"))


@query(FOLD + "SELECT * FROM folded")
def settling_log(spark, sf_dir):
    """Revisions of every day's total, by a stateful stream that gets its batches out of
    order and some of them twice."""
    return settling.settled_from(_pulls(spark, sf_dir), shared_path(spark, "settling"))


@query(FOLD + "SELECT metric, local_date, to_value AS value, to_state AS state, batch_id, n_revisions FROM (SELECT *, count(*) OVER d AS n_revisions, row_number() OVER (PARTITION BY metric, local_date ORDER BY revision DESC) AS k FROM folded WHERE outcome <> 'refused' WINDOW d AS (PARTITION BY metric, local_date)) WHERE k = 1")
def settled_totals(spark, sf_dir):
    """Totals of the days, as the batch fold has them."""
    return settling.totals(settling.folded(_pulls(spark, sf_dir)))


# Migrations ----------------------------------------------------------------------

#: Two migrations, of odd days and of days a year on that have no row; a third meets the second.
BATCHES = """, before AS (SELECT metric, date, sum, 'raw' AS source_kind, max FROM daily),
m1 AS (SELECT metric, date, round(sum + 10, 4) AS value FROM daily WHERE day(date) % 2 = 1),
m2 AS (SELECT metric, CAST(date + INTERVAL 1 YEAR AS DATE) AS date, round(sum * 2, 4) AS value FROM daily WHERE metric <> 'error' UNION ALL SELECT metric, date, 7.0 FROM daily WHERE day(date) % 4 = 2),
later AS (SELECT metric, date, CASE WHEN metric = 'click' THEN max + 1 ELSE max END AS max FROM before)
"""


def _books(spark, sf_dir):
    days = daily_short(spark, sf_dir)
    before = written(days.select("metric", "date", "sum", F.lit("raw").alias("source_kind"), "max"), "books")
    day = F.dayofmonth("date")
    m1 = days.where(day % 2 == 1).select("metric", "date", F.round(F.col("sum") + 10, 4).alias("value"))
    ahead = days.where("metric <> 'error'").select("metric", F.add_months("date", 12).alias("date"), F.round(F.col("sum") * 2, 4).alias("value"))
    m2 = ahead.unionByName(days.where(day % 4 == 2).select("metric", "date", F.lit(7.0).alias("value")))
    none = journal.Books(before, spark.createDataFrame([], journal.TOTALS), spark.createDataFrame([], journal.JOURNAL))
    return none, m1, m2


@query(
    views(RECORDS, DAILY_SHORT)
    + BATCHES
    + """SELECT b.metric, b.date, CASE WHEN m2.value IS NOT NULL THEN m2.value ELSE b.sum END AS sum, CASE WHEN m2.value IS NOT NULL THEN 'consolidated' ELSE 'raw' END AS source_kind, l.max
FROM before b JOIN later l ON l.metric = b.metric AND l.date = b.date LEFT JOIN m2 ON m2.metric = b.metric AND m2.date = b.date
UNION ALL SELECT metric, date, value, 'consolidated', NULL FROM m2 ANTI JOIN before USING (metric, date)"""
)
def migration_undone(spark, sf_dir):
    """Daily rows after two migrations, a change of another column, and the first one undone
    twice; a third migration that meets the second is refused as a whole."""
    books, m1, m2 = _books(spark, sf_dir)
    books = journal.migrated(journal.migrated(books, m1, "m1"), m2, "m2")
    books = journal.Books(*[written(x, "books") for x in (books.daily, books.totals, books.journal)])
    books = journal.migrated(books, m2.withColumn("value", F.lit(0.0)), "m3")
    changed = books.daily.withColumn("max", F.when((F.col("metric") == "click") & F.col("max").isNotNull(), F.col("max") + 1).otherwise(F.col("max")))
    return journal.reverted(journal.reverted(journal.Books(changed, books.totals, books.journal), "m1"), "m1").daily


@query(
    views(RECORDS, DAILY_SHORT)
    + BATCHES
    + """SELECT 'm2' AS migration_id, m2.metric, m2.date, b.sum AS prior_sum, b.source_kind AS prior_kind, m2.value AS new_sum FROM m2 LEFT JOIN before b ON b.metric = m2.metric AND b.date = m2.date
UNION ALL SELECT 'm1', m1.metric, m1.date, b.sum, b.source_kind, m1.value FROM m1 JOIN before b ON b.metric = m1.metric AND b.date = m1.date"""
)
def migration_journal(spark, sf_dir):
    """What two migrations wrote over."""
    books, m1, m2 = _books(spark, sf_dir)
    return journal.migrated(journal.migrated(books, m1, "m1"), m2, "m2").journal


# Rules in force --------------------------------------------------------------------

#: A rule for each supplier, whose interval, selector and withdrawals come from its key.
RULES = """WITH s AS (SELECT s_suppkey AS k, DATE '2023-12-01' + CAST(s_suppkey * 7 % 90 AS INTEGER) AS start FROM supplier),
rules AS (SELECT k AS rule_id, 't' || k % 5 AS topic, start, CASE WHEN k % 3 > 0 THEN start + CAST(k * 5 % 40 - 1 AS INTEGER) END AS stop, k % 4 <> 1 AS include_start, k % 7 <> 2 AS include_end,
  CASE k % 11 WHEN 0 THEN '5' WHEN 1 THEN '2024-W06' WHEN 2 THEN 'week-08' WHEN 3 THEN CAST(date_trunc('week', start + 7) AS DATE)::VARCHAR END AS week,
  CASE WHEN k % 6 = 0 THEN [start + 2, start + 20] END AS days, CASE WHEN k % 9 = 4 THEN k - 5 END AS withdraws FROM s),
weeks AS (SELECT CAST(g AS DATE) AS week_start, CAST(g AS DATE) + CASE WHEN weekofyear(g) % 4 = 0 THEN 8 ELSE 6 END AS week_end FROM generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-03-18', INTERVAL 7 DAY) t(g)),
bounds AS (SELECT *, CASE WHEN include_start THEN start ELSE start + 1 END AS first_day, CASE WHEN include_end THEN stop ELSE stop - 1 END AS last_day FROM rules
  WHERE NOT coalesce(stop < start OR (stop = start AND NOT (include_start AND include_end)), false)),
applies AS (SELECT * FROM bounds, weeks WHERE first_day <= week_end AND coalesce(last_day >= week_start, true) AND coalesce(first_day <= last_day, true)
  AND (week IS NULL OR week LIKE 'week-%' OR week IN (week_start::VARCHAR, strftime(week_start, '%G-W%V'), weekofyear(week_start)::VARCHAR))
  AND (days IS NULL OR len(list_filter(days, lambda d: d BETWEEN week_start AND week_end)) > 0))
"""


def _rules(spark, sf_dir):
    k = F.col("s_suppkey")
    start = F.date_add(F.lit("2023-12-01").cast("date"), (k * 7 % 90).cast("int"))
    base = table(spark, sf_dir, "supplier").select(k.alias("rule_id"), F.concat(F.lit("t"), (k % 5).cast("string")).alias("topic"), start.alias("start"), k.alias("k"))
    k, start = F.col("k"), F.col("start")
    week = F.when(k % 11 == 0, "5").when(k % 11 == 1, "2024-W06").when(k % 11 == 2, "week-08").when(k % 11 == 3, F.trunc(F.date_add(start, 7), "week").cast("string"))
    rules = base.select(
        "rule_id", "topic", "start", F.when(k % 3 > 0, F.date_add(start, (k * 5 % 40 - 1).cast("int"))).alias("stop"), (k % 4 != 1).alias("include_start"), (k % 7 != 2).alias("include_end"),
        week.alias("week"), F.when(k % 6 == 0, F.array(F.date_add(start, 2), F.date_add(start, 20))).alias("days"), F.when(k % 9 == 4, k - 5).alias("withdraws"),
    )
    monday = F.explode(F.sequence(F.lit("2023-12-25").cast("date"), F.lit("2024-03-18").cast("date"), F.expr("interval 7 days")))
    weeks = spark.range(1).select(monday.alias("week_start")).select("week_start", F.date_add("week_start", F.when(F.weekofyear("week_start") % 4 == 0, 8).otherwise(6)).alias("week_end"))
    return rules, weeks


@query(RULES + "SELECT rule_id, week_start FROM applies")
def rules_by_week(spark, sf_dir):
    """Weeks that each rule applies to: interval ends, selectors and named days."""
    return intervals.by_week(*_rules(spark, sf_dir)).select("rule_id", "week_start")


@query(
    RULES
    + """, gone AS (SELECT week_start, withdraws AS rule_id, max(first_day) AS ended_on FROM applies WHERE withdraws IS NOT NULL GROUP BY 1, 2)
SELECT a.week_start, topic, arg_max(a.rule_id, struct_pack(a := first_day, b := a.rule_id)) AS rule_id, count(*) AS n_rules FROM applies a LEFT JOIN gone g ON g.week_start = a.week_start AND g.rule_id = a.rule_id
WHERE withdraws IS NULL AND (ended_on IS NULL OR ended_on < first_day) GROUP BY 1, 2"""
)
def rules_in_force(spark, sf_dir):
    """The rule in force by week and topic."""
    return intervals.in_force(*_rules(spark, sf_dir))


@query(RULES + "SELECT rule_id, CASE WHEN stop < start THEN 'ends_before_start' ELSE 'empty_day' END AS reason FROM rules WHERE stop < start OR (stop = start AND NOT (include_start AND include_end))")
def refused_intervals(spark, sf_dir):
    rules, _ = _rules(spark, sf_dir)
    return rules.select("rule_id", intervals.interval_reason(rules).alias("reason")).where("reason is not null")


# Claims on claims ----------------------------------------------------------------------

#: Leaves (L) say a day's sum, D their differences from the day before, P the changes of
#: those, Q the differences of those: four storeys.  Some leaves ask for what isn't there,
#: and pairs of claims (C, E) rest on each other.
CLAIMS = """, leaves AS (SELECT 'L:' || metric || ':' || date AS claim_id, metric, date, CASE WHEN day(date) % 13 = 0 THEN 'mode' ELSE 'sum' END AS field,
  CASE WHEN day(date) % 13 = 0 THEN NULL ELSE sum END AS actual, sum, CASE WHEN day(date) % 13 = 0 THEN 'unknown_field' ELSE 'known' END AS status FROM daily),
d AS (SELECT 'D:' || a.metric || ':' || a.date AS claim_id, a.metric, a.date, round(a.actual - b.actual, 6) AS actual,
  CASE WHEN b.claim_id IS NULL THEN 'operand_missing' WHEN a.status <> 'known' OR b.status <> 'known' THEN 'operand_failed' ELSE 'known' END AS status FROM leaves a LEFT JOIN leaves b ON b.metric = a.metric AND b.date = a.date - 1),
p AS (SELECT 'P:' || a.metric || ':' || a.date AS claim_id, a.metric, a.date, CASE WHEN b.actual <> 0 THEN round((a.actual - b.actual) / b.actual * 100, 6) END AS actual,
  CASE WHEN b.claim_id IS NULL THEN 'operand_missing' WHEN a.status <> 'known' OR b.status <> 'known' THEN 'operand_failed' WHEN b.actual = 0 THEN 'undefined' ELSE 'known' END AS status FROM d a LEFT JOIN d b ON b.metric = a.metric AND b.date = a.date - 1),
q AS (SELECT 'Q:' || a.metric || ':' || a.date AS claim_id, a.metric, a.date, round(a.actual - b.actual, 6) AS actual,
  CASE WHEN b.claim_id IS NULL THEN 'operand_missing' WHEN a.status <> 'known' OR b.status <> 'known' THEN 'operand_failed' ELSE 'known' END AS status FROM p a LEFT JOIN d b ON b.metric = a.metric AND b.date = a.date - 1),
every AS (SELECT claim_id, actual, status, CASE WHEN day(date) % 4 = 0 THEN '12345' WHEN day(date) % 4 = 1 THEN NULL ELSE CAST(CAST(floor(sum) AS BIGINT) AS VARCHAR) END AS value FROM leaves
  UNION ALL SELECT claim_id, CASE WHEN status = 'known' THEN actual END, status, '0' FROM d UNION ALL SELECT claim_id, CASE WHEN status = 'known' THEN actual END, status, CASE WHEN day(date) % 2 = 0 THEN 'about 5' ELSE '0.0' END FROM p UNION ALL SELECT claim_id, CASE WHEN status = 'known' THEN actual END, status, '0.0' FROM q
  UNION ALL SELECT 'C:' || metric, NULL, 'cycle', '0' FROM daily GROUP BY metric UNION ALL SELECT 'E:' || metric, NULL, 'cycle', '0' FROM daily GROUP BY metric UNION ALL SELECT 'U:' || metric, NULL, 'unsupported_operation', '0' FROM daily GROUP BY metric),
n AS (SELECT *, TRY_CAST(value AS DOUBLE) AS number, CASE WHEN contains(value, '.') THEN 1 ELSE 0 END AS decimals FROM every)
SELECT claim_id, actual, CASE WHEN status <> 'known' THEN status WHEN number IS NULL THEN 'no_value'
  WHEN number = actual OR (abs(number - actual) <= pow(10.0::DOUBLE, -decimals) * 0.5 + 1e-9 AND NOT (decimals = 0 AND abs(actual) < 1)) THEN 'ok' ELSE 'mismatch' END AS verdict FROM n"""


@query(views(RECORDS, DAILY_SHORT) + CLAIMS)
def claims_on_claims(spark, sf_dir):
    """Verdicts on claims whose operands are claims, up to four storeys, with failures
    carried upwards and circles refused."""
    daily = written(daily_short(spark, sf_dir).select("metric", "date", "sum"), "daily")
    day = F.dayofmonth("date")
    named = lambda letter, at=F.col("date"): F.concat(F.lit(f"{letter}:"), "metric", F.lit(":"), at.cast("string"))
    before = F.date_sub("date", 1)
    none = F.lit(None).cast("string")

    def claim(letter, value, operation, a, b):
        return daily.select(named(letter).alias("claim_id"), value.alias("value"), F.lit(operation).alias("operation"), F.array(named(a), named(b, before)).alias("operands"), "metric", "date", none.alias("field"))

    said = F.when(day % 4 == 0, "12345").when(day % 4 == 1, none).otherwise(F.floor("sum").cast("string"))
    leaves = daily.select(named("L").alias("claim_id"), said.alias("value"), none.alias("operation"), F.lit(None).cast("array<string>").alias("operands"), "metric", "date", F.when(day % 13 == 0, "mode").otherwise("sum").alias("field"))
    metrics = daily.select("metric").distinct()

    def circle(letter, other, operation):
        names = F.array(F.concat(F.lit(f"{other}:"), "metric"), F.concat(F.lit(f"{other}:"), "metric"))
        return metrics.select(F.concat(F.lit(f"{letter}:"), "metric").alias("claim_id"), F.lit("0").alias("value"), F.lit(operation).alias("operation"), names.alias("operands"), "metric", F.lit(None).cast("date").alias("date"), none.alias("field"))

    every = leaves.unionByName(claim("D", F.lit("0"), "difference", "L", "L")).unionByName(claim("P", F.when(day % 2 == 0, "about 5").otherwise("0.0"), "pct_change", "D", "D")).unionByName(claim("Q", F.lit("0.0"), "difference", "P", "D"))
    every = written(every.unionByName(circle("C", "E", "difference")).unionByName(circle("E", "C", "difference")).unionByName(circle("U", "C", "root")), "claims")
    return claims.verdicts(every, claims.worked_out(every, claims.leaf_values(every, daily, ["sum"])))


# Units -------------------------------------------------------------------------------

#: Spellings, what they mean, and how many of the unit asked for they are.
SPELLINGS = [
    ("ml/(kg·min)", "mL/kg·min", 1.0), ("mL/min·kg", "mL/kg·min", 1.0), ("mL / kg / min", "mL/kg·min", 1.0), ("L/min*kg", "L/kg·min", 1000.0), ("ml/(lb·min)", "mL/lb·min", 1 / 0.45359237), ("L/(kg·h)", "L/h·kg", 1000 / 60),
    ("kcal/kg/min", "kcal/kg·min", None), ("CAL", None, None), ("furlong/min", None, None), ("mL·kg/min", "kg·mL/min", None), ("mL/kg^2", "mL/kg^2", None), ("", None, None),
]


@query(
    "WITH u(k, unit, canonical, factor) AS (VALUES "
    + ", ".join(f"({k}, '{u}', {'NULL' if c is None else repr(c)}, {'NULL::DOUBLE' if f is None else repr(f) + '::DOUBLE'})" for k, (u, c, f) in enumerate(SPELLINGS))
    + ") SELECT event_id, unit, canonical, round(value * factor, 6) AS value FROM events JOIN u ON k = event_id % "
    + str(len(SPELLINGS))
)
def unit_spellings(spark, sf_dir):
    """Values in mL a kg and minute, from rows whose units are spelt in many ways."""
    unit = F.element_at(F.array(*[F.lit(u) for u, _, _ in SPELLINGS]), (F.col("event_id") % len(SPELLINGS) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", "value", unit.alias("unit"))
    # a table has few spellings: each is looked at once
    known = rows.select("unit").distinct().select("unit", quantities.canonical(F.col("unit")).alias("canonical"), quantities.converted(F.lit(1.0), F.col("unit"), "mL/kg·min").alias("factor"))
    return rows.join(known, "unit").select("event_id", "unit", "canonical", F.round(F.col("value") * F.col("factor"), 6).alias("value"))


# Routes -------------------------------------------------------------------------------

POINTS = """, pts AS (SELECT source, local_date, id % 50 AS part, start_s - epoch(local_date)::BIGINT AS t, value, id FROM records)
"""


@query(
    views(RECORDS)
    + POINTS
    + """SELECT source, local_date, part, CAST(count(*) AS INTEGER) AS n_points, count(*) * 16 AS n_bytes, round(sum(CAST(t AS FLOAT)::DOUBLE), 3) AS t_sum, round(sum(CAST(value AS FLOAT)::DOUBLE), 3) AS altitude_sum,
  round(arg_max(CAST(value AS FLOAT)::DOUBLE, struct_pack(a := t, b := id)), 3) AS last_altitude, CASE WHEN part % 7 = 3 THEN 'bad_length' END AS damaged FROM pts GROUP BY 1, 2, 3"""
)
def packed_routes(spark, sf_dir):
    """Points of a day, packed into one binary and read again; cut blobs are refused."""
    day = F.datediff("local_date", F.lit("1970-01-01").cast("date")).cast("long") * 86400
    points = records(spark, sf_dir).select("source", "local_date", (F.col("id") % 50).alias("part"), (F.col("start_s") - day).alias("t"), "value", "id")
    ordered = F.array_sort(F.collect_list(F.struct("t", "id", "value"))).alias("p")
    column = lambda f: F.transform("p", f)
    held = points.groupBy("source", "local_date", "part").agg(ordered)
    arrays = [column(lambda x: x["t"].cast("float")), column(lambda x: x["value"].cast("float")), column(lambda x: F.lit(1.0).cast("float")), column(lambda x: F.lit(2.0).cast("float"))]
    blobs = written(routes.packed(held.select("source", "local_date", "part", *[a.alias(f) for a, f in zip(arrays, routes.FIELDS, strict=True)])), "routes")
    cut = F.when(F.col("part") % 7 == 3, F.expr("substring(points, 1, length(points) - 1)")).otherwise(F.col("points"))
    refused = routes.unpacked(blobs.withColumn("points", cut), refuse=True).select("source", "local_date", "part", F.col("reason").alias("damaged"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double")), 3)
    sizes = blobs.select("source", "local_date", "part", F.length("points").cast("long").alias("n_bytes"))
    keys = ["source", "local_date", "part"]
    back = routes.unpacked(blobs).select(*keys, "n_points", total("t_offset_s").alias("t_sum"), total("altitude_m").alias("altitude_sum"), F.round(F.element_at("altitude_m", -1).cast("double"), 3).alias("last_altitude"))
    return back.join(refused, keys).join(sizes, keys)
