"""Claims that rest on data or on other claims, worked out from the leaves up.

A claim: claim_id, value (as written), operation and operands (claim ids, in order); a leaf
has no operation, and its metric, date and field say what it is about.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions.labels import rounds_to
from pulsegrid.functions.stats import pct_change
from pulsegrid.operators.rollup import r
from pulsegrid.sources.shared import written

PAIRWISE = ("difference", "pct_change", "pct_down")
DEPTH = 16


def leaf_values(claims: DataFrame, daily: DataFrame, fields: list[str]) -> DataFrame:
    """``claim_id``, ``actual`` and ``status`` of leaves: the field of the metric's day."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("actual")) for f in fields])).alias("at")
    known = daily.select("metric", "date", pairs).select("metric", "date", "at.field", "at.actual")
    leaves = claims.where("operation is null").select("claim_id", "metric", "date", "field")
    joined = leaves.join(known, ["metric", "date", "field"], "left")
    status = F.when(~F.coalesce(F.col("field").isin(fields), F.lit(False)), "unknown_field").when(F.col("actual").isNull(), "no_data").otherwise("known")
    return joined.select("claim_id", "actual", status.alias("status"))


def _derived(operation: Column, a: Column, b: Column) -> Column:
    return r(F.when(operation == "difference", a - b).when(operation == "pct_change", pct_change(a, b)).when((operation == "pct_down") & (b != 0), (b - a) / b * 100))


def worked_out(claims: DataFrame, leaves: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``claim_id``, ``actual`` and ``status`` of every claim.

    A round works out the claims whose operands are all known, and says so of those with an
    operand that failed; it ends when no claim was settled.  Claims left then rest on
    themselves (``cycle``), or on each other deeper than ``depth`` (``too_deep``)."""
    done = written(leaves.select("claim_id", "actual", "status"), "claims")
    open_ = claims.where("operation is not null").select("claim_id", "operation", "operands")
    bad = F.when(~F.col("operation").isin(*PAIRWISE), "unsupported_operation").when(F.coalesce(F.size("operands"), F.lit(0)) != 2, "needs_two")
    done = written(done.unionByName(open_.where(bad.isNotNull()).select("claim_id", F.lit(None).cast("double").alias("actual"), bad.alias("status"))), "claims")
    known_ids = claims.select(F.col("claim_id").alias("operand")).distinct()
    open_ = written(open_.where(bad.isNull()), "claims")
    edges = open_.select("claim_id", "operation", F.posexplode("operands").alias("place", "operand"))
    lost = edges.join(known_ids, "operand", "left_anti").select("claim_id").distinct().withColumn("lost", F.lit(True))
    edges = written(edges.join(lost, "claim_id", "left").withColumn("lost", F.coalesce("lost", F.lit(False))), "edges")
    left = open_.count()
    for _ in range(depth):
        if not left:
            break
        todo = edges.join(done.select("claim_id"), "claim_id", "left_anti")
        joined = todo.join(done.select(F.col("claim_id").alias("operand"), "actual", "status"), "operand", "left")
        fits = F.col("status") == "known"
        at = lambda k: F.max(F.when(F.col("place") == k, F.col("actual")))
        state = joined.groupBy("claim_id", "operation").agg(at(0).alias("a"), at(1).alias("b"), F.count_if(fits).alias("known"), F.count_if(F.col("status").isNotNull() & ~fits).alias("failed"), F.max("lost").alias("lost"))
        actual = _derived(F.col("operation"), F.col("a"), F.col("b"))
        status = F.when(F.col("lost"), "operand_missing").when(F.col("failed") > 0, "operand_failed").when(actual.isNull(), "undefined").otherwise("known")
        new = state.where("lost or failed > 0 or known = 2").select("claim_id", F.when(status == "known", actual).alias("actual"), status.alias("status"))
        new = written(new, "claims")
        settled = new.count()
        if not settled:
            break
        done, left = written(done.unionByName(new), "claims"), left - settled
    else:
        if left:
            return done.unionByName(open_.join(done, "claim_id", "left_anti").select("claim_id", F.lit(None).cast("double").alias("actual"), F.lit("too_deep").alias("status")))
    return done.unionByName(open_.join(done, "claim_id", "left_anti").select("claim_id", F.lit(None).cast("double").alias("actual"), F.lit("cycle").alias("status")))


def verdicts(claims: DataFrame, found: DataFrame) -> DataFrame:
    """``claim_id``, ``actual`` and ``verdict``: ok, mismatch or no_value of what is known,
    and the reason of what isn't."""
    held = claims.select("claim_id", "value").join(found, "claim_id")
    number = F.replace(F.regexp_replace(F.trim("value"), "[.,]+$", ""), F.lit(","), F.lit("")).try_cast("double")
    verdict = F.when(F.col("status") != "known", F.col("status")).when(number.isNull(), "no_value").when(rounds_to(F.col("value"), F.col("actual")), "ok").otherwise("mismatch")
    return held.select("claim_id", "actual", verdict.alias("verdict"))
