"""Keyed tables on Parquet: upserts, fills, deletions and retention by partition rewrite.

Parquet has no MERGE.  A table is kept partitioned by day; a batch reads the days it
touches, merges them with its rows and writes those partitions again, so a merge costs
what it changes and a repeated batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def merged(old: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Newest row of each key; a new row wins over an old one."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("__new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("__new", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col("__new"), order)).alias("b")).select(*keys, "b.*").select(*old.columns)


def filled(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old values stay; what is null is filled from the new row, and new keys come in."""
    rest = [c for c in old.columns if c not in keys]
    other = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in rest])
    return old.join(other, keys, "full_outer").select(*keys, *[F.coalesce(c, f"__{c}").alias(c) for c in rest]).select(*old.columns)


def appended(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new keys only; what was there is never touched."""
    return new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys)


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def frozen_months(stored: DataFrame, counted: DataFrame, through: str) -> DataFrame:
    """Counts by (metric, month, source): recounted, but a frozen month never shrinks."""
    keys = ["metric", "month", "source"]
    both = counted.select(*keys, F.col("n").alias("new")).join(stored.select(*keys, F.col("n").alias("old")), keys, "full_outer")
    frozen = F.col("month") <= F.lit(through).cast("date")
    n = F.when(frozen, F.greatest("new", "old")).otherwise(F.col("new"))
    return both.select(*keys, n.alias("n")).where("n is not null")


class DayTable:
    """A Parquet table partitioned by ``local_date``.

    A rewrite cannot take a partition away, so a day that loses all its rows keeps one
    marked as not live, which ``read`` leaves out."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def _all(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, live boolean").parquet(self.path)

    def read(self) -> DataFrame:
        return self._all().where("live").drop("live")

    def create(self, rows: DataFrame) -> None:
        rows.withColumn("live", F.lit(True)).write.partitionBy("local_date").parquet(self.path)

    def upsert(self, new: DataFrame, keys: list[str], order: Column, staging: str) -> None:
        """Merges rows into the days they belong to and swaps those partitions."""
        days = new.select("local_date").distinct()
        self._swap(merged(self._of(days), new, keys, order), days, staging)

    def delete(self, gone: DataFrame, keys: list[str], staging: str) -> None:
        days = gone.select("local_date").distinct()
        self._swap(without(self._of(days), gone, keys), days, staging)

    def compact(self, through: str, keep: list[str], staging: str) -> None:
        """Drops raw rows up to a day, but for the metrics that are kept."""
        old = self.read().where(F.col("local_date") <= F.lit(through).cast("date"))
        self._swap(old.where(F.col("metric").isin(keep)), old.select("local_date").distinct(), staging)

    def _of(self, days: DataFrame) -> DataFrame:
        return self.read().join(days, "local_date", "left_semi")

    def _swap(self, rows: DataFrame, days: DataFrame, staging: str) -> None:
        live = rows.withColumn("live", F.lit(True))
        emptied = days.join(rows.select("local_date").distinct(), "local_date", "left_anti").withColumn("live", F.lit(False))
        live.unionByName(emptied, allowMissingColumns=True).write.mode("overwrite").parquet(staging)
        held = self.spark.read.schema(f"{self.schema}, live boolean").parquet(staging)
        held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("local_date").parquet(self.path)

    def replace(self, rows: DataFrame, days: DataFrame, staging: str) -> None:
        """All rows of the given days, and no others, are written again."""
        self._swap(rows, days, staging)


class Ledger:
    """Several Parquet tables that take a batch together or not at all.

    A batch writes its rows into a folder of its own in every table; the last thing it
    writes is a row of the ledger.  Only what the ledger names is read: a writer that stops
    half-way leaves nothing to be seen, and a batch whose key is there is not taken again."""

    ENTRY = "batch_key string, part string"

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str]):
        self.spark, self.path, self.schemas = spark, path, schemas
        spark.createDataFrame([], self.ENTRY).write.mode("append").parquet(f"{path}/ledger")
        for name, schema in schemas.items():
            spark.createDataFrame([], f"{schema}, part string").write.mode("append").parquet(f"{path}/{name}")

    def entries(self) -> DataFrame:
        return self.spark.read.schema(self.ENTRY).parquet(f"{self.path}/ledger")

    def take(self, batch_key: str, tables: dict[str, DataFrame], part: str) -> bool:
        """Writes a batch under the name ``part``; False, and nothing written, for a known key."""
        if not self.entries().where(F.col("batch_key") == batch_key).isEmpty():
            return False
        for name, rows in tables.items():
            self.put(name, rows, part)
        self.spark.createDataFrame([(batch_key, part)], self.ENTRY).coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")
        return True

    def put(self, name: str, rows: DataFrame, part: str) -> None:
        rows.withColumn("part", F.lit(part)).write.mode("append").parquet(f"{self.path}/{name}")

    def read(self, name: str) -> DataFrame:
        rows = self.spark.read.schema(f"{self.schemas[name]}, part string").parquet(f"{self.path}/{name}")
        return rows.join(self.entries().select("part").distinct(), "part", "left_semi").drop("part")
