"""Queries that write the given tables out as exports, read them back and merge them.

Exports lie in the shared folder; what they hold, and what is wrong with some rows, comes
from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import attachments, upkeep
from pulsegrid.plans.registry import query, views
from pulsegrid.sources import exports, sinks
from pulsegrid.sources.adapters import DAILY_SHORT, RECORDS, SESSIONS, daily_short, records, sessions
from pulsegrid.sources.shared import shared_path, written

# Exports --------------------------------------------------------------------------


def _stamp(seconds, offset=" +0000"):
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"), F.lit(offset))


def _utc(spark):
    """Export stamps are written in UTC, whatever the session's zone."""
    held = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return held


@query(
    views(RECORDS)
    + """SELECT metric, CASE WHEN id % 17 <> 5 THEN value END AS value, start_s + CASE WHEN id % 3 = 1 THEN 18000 ELSE 0 END AS start_s,
  CASE WHEN id % 19 = 7 THEN start_s - 60 ELSE end_s END + CASE WHEN id % 3 = 1 THEN 18000 ELSE 0 END AS end_s, local_date, source,
  CASE WHEN id % 17 = 5 THEN 'not_numeric' WHEN id % 19 = 7 THEN 'bad_interval' END AS reason FROM records"""
)
def xml_export_read(spark, sf_dir):
    """Records written as elements of XML files and read again, a third of them five hours
    west; a value that is no number and an end before its start have reasons."""
    held = _utc(spark)
    try:
        path = shared_path(spark, "xml")
        k = F.col("id")
        offset = lambda c: F.when(k % 3 == 1, _stamp(c, " -0500")).otherwise(_stamp(c))
        end = F.when(k % 19 == 7, F.col("start_s") - 60).otherwise(F.col("end_s"))
        rows = records(spark, sf_dir).select(
            F.col("metric").alias("_type"), F.when(k % 17 == 5, "n/a").otherwise(F.col("value").cast("string")).alias("_value"), F.lit("count").alias("_unit"), offset(F.col("start_s")).alias("_startDate"), offset(end).alias("_endDate"), F.col("source").alias("_sourceName")
        )
        rows.write.format("xml").option("rootTag", "HealthData").option("rowTag", "Record").save(path)
    finally:
        spark.conf.set("spark.sql.session.timeZone", held)
    return exports.xml_records(spark, path).select("metric", "value", "start_s", "end_s", "local_date", "source", "reason")


WORKOUTS = """, w AS (SELECT id, kind, start_s, end_s, local_date, source, round((end_s - start_s) / 60, 4) AS minutes, (id % 50 + 0.5)::DOUBLE AS energy, (CASE WHEN id % 3 > 0 THEN id % 9 + 0.25 ELSE 0.0 END)::DOUBLE AS distance FROM sessions)
"""


def _workouts(spark, sf_dir):
    held = _utc(spark)
    try:
        path = shared_path(spark, "workouts")
        k = F.col("id")
        seconds = (F.col("end_s") - F.col("start_s")).cast("double")
        stat = lambda kind, value: F.struct(F.lit(kind).alias("_type"), value.alias("_sum"), F.lit("kcal").alias("_unit"))
        stats = F.when(k % 3 > 0, F.array(stat("ActiveEnergyBurned", k % 50 + 0.5), stat("DistanceWalkingRunning", k % 9 + 0.25))).otherwise(F.array(stat("ActiveEnergyBurned", k % 50 + 0.5)))
        pause = F.struct(F.lit("HKWorkoutEventTypeMotionPaused").alias("_type"), _stamp(F.col("start_s") + 30).alias("_date"), F.lit(90.0).alias("_duration"), F.lit("s").alias("_durationUnit"))
        rows = sessions(spark, sf_dir).select(
            F.col("kind").alias("_workoutActivityType"), F.when(k % 2 == 0, seconds / 60).otherwise(seconds).alias("_duration"), F.when(k % 2 == 0, "min").otherwise("s").alias("_durationUnit"), _stamp(F.col("start_s")).alias("_startDate"), _stamp(F.col("end_s")).alias("_endDate"), F.col("source").alias("_sourceName"),
            F.when(k % 4 == 0, F.array(pause)).otherwise(F.array()).alias("WorkoutEvent"), stats.alias("WorkoutStatistics"),
        )
        rows.write.format("xml").option("rootTag", "HealthData").option("rowTag", "Workout").save(path)
    finally:
        spark.conf.set("spark.sql.session.timeZone", held)
    return exports.xml_workouts(spark, path)


@query(views(RECORDS, SESSIONS) + WORKOUTS + "SELECT kind, start_s, end_s, local_date, source, minutes, energy, distance FROM w")
def xml_workouts_read(spark, sf_dir):
    """Sessions written as workout elements and read again, in minutes or seconds."""
    return _workouts(spark, sf_dir).select("kind", "start_s", "end_s", "local_date", "source", F.round("minutes", 4).alias("minutes"), "energy", "distance")


@query(views(RECORDS, SESSIONS) + WORKOUTS + "SELECT kind, start_s, 'motion_paused' AS event, start_s + 30 AS at_s, 1.5 AS minutes FROM w WHERE id % 4 = 0")
def xml_workout_events_read(spark, sf_dir):
    return exports.workout_events(_workouts(spark, sf_dir)).select("kind", "start_s", "event", "at_s", "minutes")


@query(
    views(RECORDS)
    + """SELECT 'u' || id AS uuid, metric, CASE WHEN id % 23 <> 3 THEN value END AS value, start_s, end_s, local_date,
  CASE WHEN id % 23 = 3 THEN 'not_numeric' WHEN id % 29 = 4 THEN 'dedupe' WHEN local_date <= DATE '2024-01-04' THEN 'behind_watermark' END AS reason FROM records WHERE (id // 50) % 7 <> 6"""
)
def delta_batches_read(spark, sf_dir):
    """Samples of JSON batches, each batch written twice, one in seven by a protocol that is
    not known; deleted, unmeasured and settled samples have reasons."""
    held = _utc(spark)
    try:
        path = shared_path(spark, "delta")
        k = F.col("id")
        sample = F.struct(
            F.concat(F.lit("u"), k.cast("string")).alias("uuid"), "metric", F.when(k % 23 != 3, F.col("value")).alias("value"), F.lit("count").alias("unit"), _stamp(F.col("start_s")).alias("start"), _stamp(F.col("end_s")).alias("end"), "source"
        )
        batch = F.floor(k / 50).alias("b")
        rows = records(spark, sf_dir).groupBy(batch).agg(F.array_sort(F.collect_list(sample)).alias("samples"))
        lines = rows.select(F.when(F.col("b") % 7 == 6, 9).otherwise(1).alias("protocol_version"), F.concat(F.lit("b"), F.col("b").cast("string")).alias("batch_id"), F.struct(F.lit("d1").alias("id"), F.lit("phone").alias("name")).alias("device"), "samples", F.array().cast("array<string>").alias("deletions"))
        lines.unionByName(lines).write.json(path)
    finally:
        spark.conf.set("spark.sql.session.timeZone", held)
    dead = records(spark, sf_dir).where("id % 29 = 4").select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("uuid"))
    return exports.delta_samples(exports.delta_batches(spark, path), dead, "2024-01-04").select("uuid", "metric", "value", "start_s", "end_s", "local_date", "reason")


@query(
    views(RECORDS)
    + """SELECT 'b' || b AS batch_id, CASE WHEN b % 7 = 6 THEN 'unknown_protocol' END AS reason, n FROM (SELECT id // 50 AS b, count(*) AS n FROM records GROUP BY 1) UNION ALL SELECT NULL, 'malformed', NULL UNION ALL SELECT NULL, 'missing_batch_id', 0"""
)
def delta_batches_judged(spark, sf_dir):
    """Batches of a folder with a broken line and one without a name among them."""
    path = shared_path(spark, "delta")
    lines = records(spark, sf_dir).groupBy(F.floor(F.col("id") / 50).alias("b")).agg(F.count("*").alias("n"))
    blank = F.expr("transform(sequence(1, cast(n as int)), x -> named_struct('uuid', 'u'))")
    good = lines.select(F.to_json(F.struct(F.when(F.col("b") % 7 == 6, 9).otherwise(1).alias("protocol_version"), F.concat(F.lit("b"), F.col("b").cast("string")).alias("batch_id"), blank.alias("samples"))).alias("value"))
    good.unionByName(spark.createDataFrame([('{"batch_id": "x", "samples": [',), ('{"protocol_version": 1, "samples": []}',)], "value string")).write.text(path)
    return exports.delta_batches(spark, path).select(F.when(F.col("reason") == "malformed", None).otherwise(F.col("batch_id")).alias("batch_id"), "reason", F.when(F.coalesce(F.col("reason") != "malformed", F.lit(True)), F.size("samples").cast("long")).alias("n"))


@query(views(RECORDS) + "SELECT metric, value, start_s, end_s, source FROM records")
def csv_export_read(spark, sf_dir):
    path = shared_path(spark, "csv")
    records(spark, sf_dir).select("metric", "value", "start_s", "end_s", "source").write.option("header", True).csv(path)
    return exports.csv_records(spark, path)


@query(
    views(RECORDS)
    + """SELECT start_s AS t, round(45 + id % 100 / 13.0::DOUBLE, 1) AS lat, round(-7 - id % 70 / 11.0::DOUBLE, 1) AS lon, value AS altitude_m FROM records WHERE source = 'watch'"""
)
def gpx_points_read(spark, sf_dir):
    """Track points written as GPX elements, read with their places rounded."""
    held = _utc(spark)
    try:
        path = shared_path(spark, "gpx")
        k = F.col("id")
        time = F.date_format(F.timestamp_seconds("start_s"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        rows = records(spark, sf_dir).where("source = 'watch'").select((k % 100 / 13.0 + 45).alias("_lat"), (F.lit(-7) - k % 70 / 11.0).alias("_lon"), F.col("value").alias("ele"), time.alias("time"))
        rows.write.format("xml").option("rootTag", "trkseg").option("rowTag", "trkpt").save(path)
    finally:
        spark.conf.set("spark.sql.session.timeZone", held)
    return exports.gpx_points(spark, path)


# Keyed tables ---------------------------------------------------------------------

FIELDS = "metric string, local_date date, sum double, count long"


def _day_table(spark, sf_dir):
    days = daily_short(spark, sf_dir).select("metric", F.col("date").alias("local_date"), "sum", "count")
    table = sinks.DayTable(spark, shared_path(spark, "days"), FIELDS)
    table.create(days)
    return table, days


@query(
    views(RECORDS, DAILY_SHORT)
    + """, d AS (SELECT metric, date AS local_date, sum, count FROM daily), n AS (SELECT metric, local_date + CASE WHEN day(local_date) % 10 = 0 THEN 60 ELSE 0 END AS local_date, round(sum + 5, 4) AS sum, count + 1 AS count FROM d WHERE day(local_date) % 5 = 0)
SELECT metric, local_date, coalesce(n.sum, d.sum) AS sum, coalesce(n.count, d.count) AS count FROM d FULL JOIN n USING (metric, local_date)"""
)
def day_table_upserted(spark, sf_dir):
    """A table by day after a batch of changed and new rows, merged twice."""
    table, days = _day_table(spark, sf_dir)
    moved = F.date_add("local_date", F.when(F.dayofmonth("local_date") % 10 == 0, 60).otherwise(0))
    new = days.where(F.dayofmonth("local_date") % 5 == 0).select("metric", moved.alias("local_date"), F.round(F.col("sum") + 5, 4).alias("sum"), (F.col("count") + 1).alias("count"))
    for _ in range(2):
        table.upsert(new, ["metric", "local_date"], F.col("count"), shared_path(spark, "staging"))
    return table.read()


@query(views(RECORDS, DAILY_SHORT) + "SELECT metric, date AS local_date, sum, count FROM daily WHERE NOT (metric = 'click' AND day(date) % 2 = 0) AND day(date) <> 13")
def day_table_deleted(spark, sf_dir):
    """The same table after pairs, and all of one day, were deleted; twice changes nothing."""
    table, days = _day_table(spark, sf_dir)
    day = F.dayofmonth("local_date")
    gone = days.where(((F.col("metric") == "click") & (day % 2 == 0)) | (day == 13)).select("metric", "local_date")
    for _ in range(2):
        table.delete(gone, ["metric", "local_date"], shared_path(spark, "staging"))
    return table.read()


@query(views(RECORDS, DAILY_SHORT) + "SELECT metric, date AS local_date, sum, count FROM daily WHERE date > DATE '2024-01-10' OR metric IN ('signup', 'error')")
def day_table_compacted(spark, sf_dir):
    """The table without what was compacted up to a day, but for the metrics that are kept."""
    table, _ = _day_table(spark, sf_dir)
    table.compact("2024-01-10", ["signup", "error"], shared_path(spark, "staging"))
    return table.read()


@query(
    views(RECORDS, DAILY_SHORT)
    + """, o AS (SELECT metric, date, CASE WHEN day(date) % 3 <> 0 THEN sum END AS sum, CASE WHEN day(date) % 4 <> 0 THEN max END AS max FROM daily WHERE day(date) <> 7),
n AS (SELECT metric, date, -1.0 AS sum, -2.0 AS max FROM daily WHERE day(date) % 2 = 1)
SELECT metric, date, coalesce(o.sum, n.sum) AS sum, coalesce(o.max, n.max) AS max FROM o FULL JOIN n USING (metric, date)"""
)
def stats_filled(spark, sf_dir):
    """Daily statistics in which a backfill fills what is null, and adds days, but changes nothing."""
    days, day = daily_short(spark, sf_dir), F.dayofmonth("date")
    old = days.where(day != 7).select("metric", "date", F.when(day % 3 != 0, F.col("sum")).alias("sum"), F.when(day % 4 != 0, F.col("max")).alias("max"))
    new = days.where(day % 2 == 1).select("metric", "date", F.lit(-1.0).alias("sum"), F.lit(-2.0).alias("max"))
    return sinks.filled(old, new, ["metric", "date"])


@query(views(RECORDS) + "SELECT id, metric, value FROM records WHERE id % 3 <> 0 UNION ALL SELECT id, metric, value + 1 FROM records WHERE id % 3 = 0")
def records_appended(spark, sf_dir):
    """Records with those of a repeated, changed batch whose keys are new."""
    rows = records(spark, sf_dir).select("id", "metric", "value")
    old, again = rows.where("id % 3 <> 0"), rows.withColumn("value", F.col("value") + 1)
    return old.unionByName(sinks.appended(old, again.unionByName(again), ["id"]))


@query(
    views(RECORDS)
    + """, c AS (SELECT metric, CAST(date_trunc('month', local_date) AS DATE) AS month, source, count(*) AS n FROM records WHERE source <> 'phone' OR id % 2 = 0 GROUP BY ALL),
s AS (SELECT metric, CAST(date_trunc('month', local_date) AS DATE) AS month, source, count(*) AS n FROM records WHERE source <> 'mirror' GROUP BY ALL)
SELECT metric, month, source, CASE WHEN month <= DATE '2024-01-01' THEN greatest(c.n, s.n) ELSE c.n END AS n FROM c FULL JOIN s USING (metric, month, source) WHERE CASE WHEN month <= DATE '2024-01-01' THEN greatest(c.n, s.n) ELSE c.n END IS NOT NULL"""
)
def source_months_frozen(spark, sf_dir):
    """Records by metric, month and source, counted again after some are gone: a frozen
    month keeps what was stored."""
    rows = records(spark, sf_dir).withColumn("month", F.trunc("local_date", "month"))
    count = lambda df: df.groupBy("metric", "month", "source").agg(F.count("*").alias("n"))
    return sinks.frozen_months(count(rows.where("source <> 'mirror'")), count(rows.where("source <> 'phone' or id % 2 = 0")), "2024-01-01")


@query(
    views(RECORDS)
    + """, taken AS (SELECT * FROM records WHERE id % 5 < 3)
SELECT 'samples' AS name, metric, count(*) AS n, round(sum(value), 4) AS total FROM taken GROUP BY metric UNION ALL SELECT 'daily', metric, count(*), round(sum(s), 4) FROM (SELECT metric, local_date, id % 5 AS b, sum(value) AS s FROM taken GROUP BY ALL) GROUP BY metric"""
)
def one_commit_tables(spark, sf_dir):
    """Two tables that batches fill together: three are taken, one of them comes again, and
    a fourth stops between the tables."""
    rows = records(spark, sf_dir).select("id", "metric", "local_date", "value")
    ledger = sinks.Ledger(spark, shared_path(spark, "ledger"), {"samples": "id long, metric string, local_date date, value double", "daily": "metric string, local_date date, value double"})

    def batch(k):
        own = rows.where(F.col("id") % 5 == k)
        return {"samples": own, "daily": own.groupBy("metric", "local_date").agg(F.sum("value").alias("value"))}

    for k in (0, 1, 1, 2):
        ledger.take(f"b{k}", batch(k), f"part-{k}")
    ledger.put("samples", batch(3)["samples"], "part-3")
    sums = [ledger.read(t).groupBy("metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.lit(t).alias("name"), "metric", "n", "total") for t in ("samples", "daily")]
    return sums[0].unionByName(sums[1])


#: Sessions of even keys have uuids, and some climbs of their own; climbs come on their own
#: for all, by uuid or by overlap, and some for sessions that aren't there.
CHILDREN = """, parents AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'S' || id END AS uuid, source, start_s, end_s, CASE WHEN id % 5 = 0 THEN 100.0::DOUBLE END AS ascended, NULL::DOUBLE AS descended FROM sessions WHERE id % 7 <> 3),
children AS (SELECT id + 7000000 AS id, CASE WHEN id % 2 = 0 THEN 'S' || id END AS uuid, source, start_s + CASE WHEN id % 2 = 0 THEN 90000 ELSE id % 11 * 30 END AS start_s, end_s + CASE WHEN id % 2 = 0 THEN 90000 ELSE 0 END AS end_s,
  CASE WHEN id % 3 <> 0 THEN (id % 40)::DOUBLE END AS ascended, (id % 30)::DOUBLE AS descended FROM sessions),
named AS (SELECT c.id AS child_id, min(p.id) AS parent_id FROM children c JOIN parents p USING (uuid) GROUP BY 1),
lapping AS (SELECT c.id AS child_id, p.id AS parent_id, row_number() OVER (PARTITION BY c.id ORDER BY least(c.end_s, p.end_s) - greatest(c.start_s, p.start_s) DESC, c.source = p.source DESC, p.id) AS k
  FROM children c ANTI JOIN named ON named.child_id = c.id JOIN parents p ON c.start_s < p.end_s AND p.start_s < c.end_s AND least(c.end_s, p.end_s) - greatest(c.start_s, p.start_s) >= 0.9 * (c.end_s - c.start_s) AND least(c.end_s, p.end_s) - greatest(c.start_s, p.start_s) >= 0.9 * (p.end_s - p.start_s)),
matched AS (FROM named UNION ALL SELECT child_id, parent_id FROM lapping WHERE k = 1)
"""


def _families(spark, sf_dir):
    spans, k = sessions(spark, sf_dir), F.col("id")
    uuid = F.when(k % 2 == 0, F.concat(F.lit("S"), k.cast("string"))).alias("uuid")
    parents = spans.where("id % 7 <> 3").select("id", uuid, "source", "start_s", "end_s", F.when(k % 5 == 0, 100.0).alias("ascended"), F.lit(None).cast("double").alias("descended"), F.lit(None).cast("string").alias("origin"))
    far = F.when(k % 2 == 0, 90000)
    children = spans.select((k + 7000000).alias("id"), uuid, "source", (F.col("start_s") + F.coalesce(far, k % 11 * 30)).alias("start_s"), (F.col("end_s") + F.coalesce(far, F.lit(0))).alias("end_s"), F.when(k % 3 != 0, (k % 40).cast("double")).alias("ascended"), (k % 30).cast("double").alias("descended"))
    return written(parents, "parents"), written(children.unionByName(children), "children")


@query(
    views(RECORDS, SESSIONS)
    + CHILDREN
    + """, said AS (SELECT parent_id, arg_min(ascended, child_id) FILTER (ascended IS NOT NULL) AS up, arg_min(descended, child_id) FILTER (descended IS NOT NULL) AS down FROM matched JOIN children ON children.id = child_id GROUP BY 1)
SELECT p.id, coalesce(p.ascended, up) AS ascended, coalesce(p.descended, down) AS descended, CASE WHEN (p.ascended IS NULL AND up IS NOT NULL) OR (p.descended IS NULL AND down IS NOT NULL) THEN 'device' END AS origin FROM parents p LEFT JOIN said ON parent_id = p.id"""
)
def climbs_attached(spark, sf_dir):
    """Sessions with the climbs that came on their own, each of them twice."""
    parents, children = _families(spark, sf_dir)
    return attachments.attached(parents, children, ["ascended", "descended"]).select("id", "ascended", "descended", "origin")


@query(views(RECORDS, SESSIONS) + CHILDREN + "SELECT id, start_s, end_s FROM children ANTI JOIN matched ON child_id = id")
def climbs_waiting(spark, sf_dir):
    """Climbs whose session has not come yet."""
    return attachments.orphans(*_families(spark, sf_dir)).select("id", "start_s", "end_s")


@query(
    views(RECORDS, DAILY_SHORT)
    + """, needs(metric, source_metric) AS (VALUES ('click', 'view'), ('click', 'purchase'), ('view', 'view'), ('error', 'error')),
derived AS (SELECT metric, date + 25 AS date, CASE WHEN day(date) % 3 = 0 THEN 2 ELSE 1 END AS version, sum AS value FROM daily WHERE metric IN ('click', 'view', 'error')),
stale AS (SELECT DISTINCT d.date FROM derived d WHERE version <> 2 AND NOT EXISTS (SELECT 1 FROM needs n WHERE n.metric = d.metric AND NOT EXISTS (SELECT 1 FROM records r WHERE r.metric = n.source_metric AND r.local_date = d.date)))
SELECT d.metric, d.date AS local_date, CASE WHEN s.date IS NOT NULL THEN 2 ELSE version END AS version, CASE WHEN s.date IS NOT NULL THEN -value ELSE value END AS value FROM derived d LEFT JOIN stale s ON s.date = d.date"""
)
def rederived_table(spark, sf_dir):
    """A table of derived values of which only the days with another formula version, and
    with their sources there, were written again."""
    needs = spark.createDataFrame([("click", "view"), ("click", "purchase"), ("view", "view"), ("error", "error")], "metric string, source_metric string")
    days = daily_short(spark, sf_dir).where("metric in ('click', 'view', 'error')")
    derived = days.select("metric", F.date_add("date", 25).alias("local_date"), F.when(F.dayofmonth("date") % 3 == 0, 2).otherwise(1).alias("version"), F.col("sum").alias("value"))
    table = sinks.DayTable(spark, shared_path(spark, "derived"), "metric string, local_date date, version int, value double")
    table.create(derived)
    stale = upkeep.stale_days(table.read().withColumnRenamed("local_date", "date"), 2, needs, records(spark, sf_dir))
    stale = written(stale.withColumnRenamed("date", "local_date"), "stale")
    again = table.read().join(stale, "local_date", "left_semi").select("metric", "local_date", F.lit(2).alias("version"), (-F.col("value")).alias("value"))
    table.replace(again, stale, shared_path(spark, "staging"))
    return table.read()
