"""Daily roll-up of a stream of samples, kept as a table.

Every micro-batch adds its rows to a table by day; the days that it touches are rolled
up again from all their rows, each sample once, as a new version.  A repeated batch
overwrites what it wrote before, so it changes nothing.  Rows behind a fixed boundary
are not dropped in silence but kept aside with the reason, as the batch rule asks.
Nothing is held on the driver, and no state grows with the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.operators.rollup import daily_rollup
from pulsegrid.sources.shared import shared_path

MEASURES = ["count", "sum", "avg", "min", "max", "last"]


def samples(stream: DataFrame) -> DataFrame:
    """Records of a stream of events."""
    start = F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp")))
    source = F.when(F.col("user_id") % 3 == 0, "watch").when(F.col("user_id") % 3 == 1, "phone").otherwise("mirror")
    return stream.select(F.col("event_id").alias("id"), F.col("event_type").alias("metric"), "value", start.alias("start_s"), (start + F.col("event_id") % 90 + 1).alias("end_s"), F.to_date("ts").alias("local_date"), source.alias("source"))


def refuse_late(batch: DataFrame, boundary: str | None) -> tuple[DataFrame, DataFrame]:
    """A micro-batch in two: what may be merged, and what lies behind the boundary."""
    late = F.coalesce(F.col("local_date") <= F.lit(boundary).cast("date"), F.lit(False))
    return batch.where(~late), batch.where(late).withColumn("reason", F.lit("behind_watermark"))


def merge_batch(path: str, boundary: str | None):
    """A foreachBatch function that merges a micro-batch into the tables under ``path``."""

    def merge(batch: DataFrame, number: int) -> None:
        good, late = refuse_late(batch, boundary)
        good.write.mode("overwrite").partitionBy("local_date").parquet(f"{path}/accepted/batch={number}")
        late.write.mode("overwrite").parquet(f"{path}/refused/batch={number}")
        spark = batch.sparkSession
        fields = "id long, metric string, value double, start_s long, end_s long, source string, batch long, local_date date"
        held = spark.read.schema(fields).option("basePath", f"{path}/accepted").parquet(f"{path}/accepted")
        touched = held.where(F.col("batch") == number).select("local_date").distinct()
        days = held.join(touched, "local_date", "left_semi").dropDuplicates(["id"])
        daily_rollup(days).write.mode("overwrite").parquet(f"{path}/rolled/batch={number}")

    return merge


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of every metric and day."""
    rolled = spark.read.option("basePath", f"{path}/rolled").parquet(f"{path}/rolled")
    newest = rolled.groupBy("metric", "local_date").agg(F.max_by(F.struct(*MEASURES), "batch").alias("v"))
    return newest.select("metric", "local_date", "v.*")


def rolled_from_files(spark: SparkSession, sf_dir: str, boundary: str | None = None, files_per_batch: int = 64) -> DataFrame:
    """Streams the events table, a file or a folder of them, to its end and returns the
    daily roll-up."""
    where = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(where).schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/events.parque[t]")  # a pattern may also name a single file
    path = shared_path(spark, "rolled")
    writer = samples(stream).writeStream.foreachBatch(merge_batch(path, boundary)).option("checkpointLocation", f"{path}/progress")
    writer.trigger(availableNow=True).start().awaitTermination()
    return current(spark, path)
