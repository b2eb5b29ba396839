"""Joins with keys that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SHARE = 1000
FEW = 1000


def met(left: DataFrame, right: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row for each key and counts
    in ``n`` how many rows of ``left`` have it; ``n`` is left out of the result.

    Keys of more than FEW rows and of more than one in SHARE of all ``total`` rows are
    fewer than SHARE, whatever the input: these are broadcast and their rows never
    shuffled.  The rest is an ordinary join, in which no key is large."""
    hot = right.where(F.col("n") > max(FEW, total // SHARE))
    cold = right.where(F.col("n") <= max(FEW, total // SHARE))
    few = left.join(F.broadcast(hot.drop("n")), keys)
    return left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold.drop("n"), keys).select(*few.columns).unionByName(few)
