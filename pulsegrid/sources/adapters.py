"""Domain relations read out of the test tables, and the same relations in SQL.

Times are epoch seconds, so that no session time zone can change a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SESSION_SECONDS = 45 * 60
SESSION_TYPE = "signup"
CUMULATIVE = ("click", "view", "error")
METRIC_AGG = {"click": "sum", "view": "sum", "error": "sum", "purchase": "mean", "signup": "last"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, metric, value, start_s, end_s, local_date, source."""
    events = table(spark, sf_dir, "events")
    days = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))
    start = days.cast("long") * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))
    return events.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("metric"),
        "value",
        start.alias("start_s"),
        (start + F.col("event_id") % 90 + 1).alias("end_s"),
        F.to_date("ts").alias("local_date"),
        F.when(F.col("user_id") % 3 == 0, "watch").when(F.col("user_id") % 3 == 1, "phone").otherwise("mirror").alias("source"),
    )


RECORDS = """records AS (
  SELECT event_id AS id, event_type AS metric, value,
         CAST(floor(epoch(ts)) AS BIGINT) AS start_s, CAST(floor(epoch(ts)) AS BIGINT) + event_id % 90 + 1 AS end_s,
         CAST(ts AS DATE) AS local_date,
         CASE user_id % 3 WHEN 0 THEN 'watch' WHEN 1 THEN 'phone' ELSE 'mirror' END AS source
  FROM events)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, start_s, end_s, local_date, source of 45-minute sessions."""
    kind = F.when(F.col("id") % 4 == 0, "run").when(F.col("id") % 4 == 1, "ride").otherwise("walk")
    return records(spark, sf_dir).where(F.col("metric") == SESSION_TYPE).select("id", kind.alias("kind"), "start_s", (F.col("start_s") + SESSION_SECONDS - F.col("id") % 7 * 300).alias("end_s"), "local_date", "source")


SESSIONS = f"""sessions AS (
  SELECT id, CASE id % 4 WHEN 0 THEN 'run' WHEN 1 THEN 'ride' ELSE 'walk' END AS kind,
         start_s, start_s + {SESSION_SECONDS} - id % 7 * 300 AS end_s, local_date, source
  FROM records WHERE metric = '{SESSION_TYPE}')"""


def daily_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """metric, date, count, sum, avg, min, max, last over about 2,400 days."""
    orders = table(spark, sf_dir, "orders").withColumn("date", F.to_date("o_orderdate"))
    return orders.groupBy(F.col("o_orderpriority").alias("metric"), "date").agg(
        F.count("*").alias("count"),
        F.round(F.sum("o_totalprice"), 2).alias("sum"),
        F.round(F.avg("o_totalprice"), 4).alias("avg"),
        F.min("o_totalprice").alias("min"),
        F.max("o_totalprice").alias("max"),
        F.max_by("o_totalprice", "o_orderkey").alias("last"),
    )


DAILY_LONG = """daily AS (
  SELECT o_orderpriority AS metric, CAST(o_orderdate AS DATE) AS date, count(*) AS count,
         round(sum(o_totalprice), 2) AS sum, round(avg(o_totalprice), 4) AS avg, min(o_totalprice) AS min,
         max(o_totalprice) AS max, arg_max(o_totalprice, o_orderkey) AS last
  FROM orders GROUP BY 1, 2)"""


def daily_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.operators.rollup import daily_rollup

    return daily_rollup(records(spark, sf_dir)).withColumnRenamed("local_date", "date")


DAILY_SHORT = """daily AS (
  SELECT metric, local_date AS date, count(*) AS count, round(sum(value), 6) AS sum, round(avg(value), 6) AS avg,
         min(value) AS min, max(value) AS max, arg_max(value, struct_pack(a := start_s, b := end_s, c := id)) AS last
  FROM records GROUP BY 1, 2)"""


def with_value(daily: DataFrame, aggs: dict[str, str] = METRIC_AGG) -> DataFrame:
    """``value`` by each metric's own reducer; days without one are left out."""
    how = F.create_map(*[F.lit(x) for pair in aggs.items() for x in pair])[F.col("metric")]
    value = F.when(how == "sum", F.col("sum")).when(how == "last", F.col("last")).otherwise(F.col("avg"))
    return daily.withColumn("value", value).where(F.col("value").isNotNull())


SERIES = """series AS (
  SELECT metric, date, count, CASE metric WHEN 'click' THEN sum WHEN 'view' THEN sum WHEN 'error' THEN sum
         WHEN 'signup' THEN last ELSE avg END AS value FROM daily)"""
SERIES_LONG = "series AS (SELECT metric, date, count, avg AS value FROM daily)"
