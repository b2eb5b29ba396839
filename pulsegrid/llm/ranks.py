"""Places of rows in a global order, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.llm.storage import written


def placed(df: DataFrame, order: list[Column], sums: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``place``: how many rows stand before a row in the order of ``order``,
    and for every ``column: name`` of ``sums`` the sum of that column over those rows.

    Rows are dealt to ranges and counted inside them; what the ranges before hold is one
    row a range, so the only window without a key is over as many rows as there are
    shuffle partitions.  Rows that are equal in ``order`` take places next to each other,
    in any order; nulls come first as usual, or last where ``order`` says so.  An empty
    frame stays empty."""
    sums = sums or {}
    ranges = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = {"place": F.coalesce(F.count("*").over(inside), F.lit(0))} | {name: F.coalesce(F.sum(c).over(inside), F.lit(0)) for c, name in sums.items()}
    held = ranges.groupBy("__part").agg(F.count("*").alias("__place"), *[F.sum(c).alias(f"__{name}") for c, name in sums.items()])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("__part", *[F.coalesce(F.sum(f"__{name}").over(earlier), F.lit(0)).alias(f"__{name}") for name in within])
    return ranges.withColumns(within).join(F.broadcast(before), "__part").select(*df.columns, *[(F.col(name) + F.col(f"__{name}")).alias(name) for name in within])
