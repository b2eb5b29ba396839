"""Totals that a migration writes over daily rows, with a journal by which it is undone.

``daily``: metric, date, sum, source_kind and any other columns.  ``totals``: metric, date,
value, migration_id, one row a pair.  ``journal``: migration_id, metric, date, prior_sum,
prior_kind, new_sum; a null prior_kind says that there was no daily row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

PAIR = ["metric", "date"]
JOURNAL = "migration_id string, metric string, date date, prior_sum double, prior_kind string, new_sum double"
TOTALS = "metric string, date date, value double, migration_id string"
KIND = "consolidated"


@dataclass(frozen=True)
class Books:
    daily: DataFrame
    totals: DataFrame
    journal: DataFrame


def conflicts(totals: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs of a batch that some total has already, whoever wrote it, or that come twice."""
    again = rows.groupBy(*PAIR).agg(F.count("*").alias("times")).where("times > 1").select(*PAIR, F.lit("repeated").alias("reason"))
    held = rows.select(*PAIR).distinct().join(totals.select(*PAIR), PAIR, "left_semi").withColumn("reason", F.lit("held"))
    return again.unionByName(held)


def migrated(books: Books, rows: DataFrame, migration_id: str) -> Books:
    """The books after a migration wrote ``rows`` (metric, date, value).

    All of its pairs have to be free: one conflict refuses the whole batch, and the books
    stay as they are.  Of a daily row only the sum and its kind change; a pair without one
    gets one."""
    blocked = conflicts(books.totals, rows).agg((F.count("*") > 0).alias("blocked"))
    taken = rows.crossJoin(F.broadcast(blocked)).where(~F.col("blocked")).select(*PAIR, "value")  # one row
    prior = taken.join(books.daily.select(*PAIR, F.col("sum").alias("prior_sum"), F.col("source_kind").alias("prior_kind")), PAIR, "left")
    entries = prior.select(F.lit(migration_id).alias("migration_id"), *PAIR, "prior_sum", "prior_kind", F.col("value").alias("new_sum"))
    joined = books.daily.join(taken, PAIR, "full_outer")
    new = F.col("value").isNotNull()
    daily = joined.withColumns({"sum": F.when(new, F.col("value")).otherwise(F.col("sum")), "source_kind": F.when(new, KIND).otherwise(F.col("source_kind"))}).select(*books.daily.columns)
    totals = taken.select(*PAIR, "value", F.lit(migration_id).alias("migration_id"))
    return Books(daily, books.totals.unionByName(totals), books.journal.unionByName(entries))


def reverted(books: Books, migration_id: str) -> Books:
    """The books after one migration was undone: what it wrote over is there again, what it
    made is gone, with its totals and its journal.  What else changed since stays; an
    unknown migration, or one undone before, changes nothing."""
    own = F.col("migration_id").eqNullSafe(migration_id)
    undo = books.journal.where(own).select(*PAIR, "prior_sum", "prior_kind", F.lit(True).alias("undone"))
    joined = books.daily.join(undo, PAIR, "left")
    gone = F.coalesce("undone", F.lit(False))
    kept = joined.where(~(gone & F.col("prior_kind").isNull()))
    daily = kept.withColumns({"sum": F.when(gone, F.col("prior_sum")).otherwise(F.col("sum")), "source_kind": F.when(gone, F.col("prior_kind")).otherwise(F.col("source_kind"))}).select(*books.daily.columns)
    return Books(daily, books.totals.where(~own), books.journal.where(~own))
