"""Measurement exports: XML files, JSON delta batches, CSV and GPX, as DataFrames.

Parsing is declared by schema and done by Spark's readers; rows that break a rule are
not dropped but come back with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

RECORD_XML = "_type string, _value string, _unit string, _startDate string, _endDate string, _sourceName string"
WORKOUT_XML = (
    "_workoutActivityType string, _duration double, _durationUnit string, _startDate string, _endDate string, _sourceName string, "
    "WorkoutEvent array<struct<_type:string,_date:string,_duration:double,_durationUnit:string>>, WorkoutStatistics array<struct<_type:string,_sum:double,_unit:string>>"
)
SAMPLE = "struct<uuid:string,metric:string,value:double,unit:string,start:string,end:string,source:string>"
BATCH = f"protocol_version int, batch_id string, device struct<id:string,name:string>, samples array<{SAMPLE}>, deletions array<string>"
PROTOCOL = 1
MINUTES = {"s": 1 / 60, "sec": 1 / 60, "min": 1.0, "hr": 60.0}


def civil(text: Column) -> tuple[Column, Column, Column]:
    """UTC seconds, wall clock and civil day of ``YYYY-MM-DD HH:MM:SS +ZZZZ``.

    The day is that of the text's own offset, which is why it is cut before the zone."""
    offset = F.regexp_extract(text, r"([+-]\d{2}):?(\d{2})$", 0)
    seconds = (F.substring(offset, 2, 2).cast("long") * 3600 + F.substring(F.regexp_replace(offset, ":", ""), 4, 2).cast("long") * 60) * F.when(offset.startswith("-"), -1).otherwise(1)
    wall = F.try_to_timestamp(F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.lit("Z")))
    return F.unix_seconds(wall) - F.coalesce(seconds, F.lit(0)), F.substring(text, 12, 8), F.substring(text, 1, 10).try_cast("date")


def xml_records(spark: SparkSession, path: str) -> DataFrame:
    """Record elements of export files: metric, value, unit, times, civil day, source, reason."""
    raw = spark.read.format("xml").option("rowTag", "Record").schema(RECORD_XML).load(path)
    start, _, day = civil(F.col("_startDate"))
    end, _, _ = civil(F.col("_endDate"))
    out = raw.select(F.col("_type").alias("metric"), F.col("_value").try_cast("double").alias("value"), F.col("_unit").alias("unit"), start.alias("start_s"), end.alias("end_s"), day.alias("local_date"), F.col("_sourceName").alias("source"))
    reason = F.when(F.col("metric").isNull(), "missing_metric").when(F.col("start_s").isNull() | F.col("end_s").isNull(), "bad_time").when(F.col("value").isNull(), "not_numeric").when(F.col("end_s") < F.col("start_s"), "bad_interval")
    return out.withColumn("reason", reason)


def xml_workouts(spark: SparkSession, path: str) -> DataFrame:
    """Workout elements with their energy, distance and events."""
    raw = spark.read.format("xml").option("rowTag", "Workout").schema(WORKOUT_XML).load(path)
    start, _, day = civil(F.col("_startDate"))
    end, _, _ = civil(F.col("_endDate"))
    total = lambda word: F.aggregate(F.filter(F.coalesce("WorkoutStatistics", F.array()), lambda s: s["_type"].contains(word)), F.lit(0.0), lambda a, s: a + F.coalesce(s["_sum"], F.lit(0.0)))
    return raw.select(
        F.col("_workoutActivityType").alias("kind"), start.alias("start_s"), end.alias("end_s"), day.alias("local_date"), F.col("_sourceName").alias("source"), in_minutes(F.col("_duration"), F.col("_durationUnit")).alias("minutes"), total("Energy").alias("energy"), total("Distance").alias("distance"), F.col("WorkoutEvent").alias("events")
    )


def in_minutes(value: Column, unit: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, factor in MINUTES.items():
        out = F.when(unit == name, value * factor).otherwise(out)
    return out


def workout_events(workouts: DataFrame) -> DataFrame:
    """A row per event of each workout, its kind in snake case."""
    spread = workouts.select("kind", "start_s", F.posexplode("events").alias("position", "e"))
    at, _, _ = civil(F.col("e._date"))
    name = F.lower(F.regexp_replace(F.regexp_replace("e._type", "^.*EventType", ""), "(?<=[a-z])(?=[A-Z])", "_"))
    return spread.select("kind", "start_s", "position", name.alias("event"), at.alias("at_s"), in_minutes(F.col("e._duration"), F.col("e._durationUnit")).alias("minutes"))


def delta_batches(spark: SparkSession, path: str) -> DataFrame:
    """JSON batches, one a line; broken lines keep their text and a reason."""
    schema = T.StructType.fromDDL(BATCH + ", _broken string")
    raw = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_broken").json(path)
    reason = F.when(F.col("_broken").isNotNull(), "malformed").when(F.col("batch_id").isNull(), "missing_batch_id").when(~F.col("protocol_version").eqNullSafe(F.lit(PROTOCOL)), "unknown_protocol")
    return raw.withColumn("reason", reason)


def delta_samples(batches: DataFrame, tombstones: DataFrame, behind: str) -> DataFrame:
    """Samples of sound batches with the reason for which one is refused, or null.

    Batches and samples that came before are replayed, not counted twice: the first of
    each (batch_id, position) and then of each uuid stays."""
    good = batches.where("reason is null").select("batch_id", F.col("device.id").alias("device"), F.posexplode("samples").alias("position", "s")).dropDuplicates(["batch_id", "position"])
    start, _, day = civil(F.col("s.start"))
    end, _, _ = civil(F.col("s.end"))
    rows = good.select("batch_id", "device", "position", "s.uuid", "s.metric", "s.value", "s.unit", "s.source", start.alias("start_s"), end.alias("end_s"), day.alias("local_date"))
    gone = tombstones.select("uuid").distinct().withColumn("dead", F.lit(True))
    reason = (
        F.when(F.col("uuid").isNull() | F.col("metric").isNull(), "missing_field")
        .when(F.col("value").isNull() | F.isnan("value"), "not_numeric")
        .when(F.col("start_s").isNull() | (F.col("end_s") < F.col("start_s")), "bad_interval")
        .when(F.col("dead"), "dedupe")
        .when(F.col("local_date") <= F.lit(behind).cast("date"), "behind_watermark")
    )
    return rows.join(gone, "uuid", "left").withColumn("reason", reason).drop("dead")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """metric, value, start and end columns of a CSV file with a header."""
    return spark.read.schema("metric string, value double, start_s long, end_s long, source string").option("header", True).csv(path)


def gpx_points(spark: SparkSession, path: str) -> DataFrame:
    """Track points: seconds, coordinates rounded to a tenth of a degree, elevation."""
    raw = spark.read.format("xml").option("rowTag", "trkpt").schema("_lat double, _lon double, ele double, time string").load(path)
    return raw.select(F.unix_seconds(F.try_to_timestamp("time")).alias("t"), F.round("_lat", 1).alias("lat"), F.round("_lon", 1).alias("lon"), F.col("ele").alias("altitude_m"))


def every_half_hour(points: DataFrame) -> DataFrame:
    """The first point of each half hour of a track."""
    first = points.agg(F.min("t").alias("t0"))
    slot = F.floor((F.col("t") - F.col("t0")) / 1800)
    return points.crossJoin(F.broadcast(first)).groupBy(slot.alias("slot")).agg(F.min_by(F.struct("t", "lat", "lon"), "t").alias("p")).select("slot", "p.*")
