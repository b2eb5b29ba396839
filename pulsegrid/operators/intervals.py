"""Rules with effective intervals, laid over weeks.

A rule: rule_id, topic, start, stop (null: no end decided), include_start, include_end,
week (a selector: the week's first day, ``2024-W05``, ``5``, or an authored ``week-...``
label, which any week bears), days (dates) and withdraws (the rule_id that it ends).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def interval_reason(rules: DataFrame) -> Column:
    """Why an interval is none, or null."""
    both = F.col("include_start") & F.col("include_end")
    return F.when(F.col("start").isNull(), "no_start").when(F.col("stop") < F.col("start"), "ends_before_start").when((F.col("stop") == F.col("start")) & ~both, "empty_day")


def day_bounds(rules: DataFrame) -> DataFrame:
    """Rules with ``first_day`` and ``last_day``, both inside; an open end stays null."""
    first = F.when(F.col("include_start"), F.col("start")).otherwise(F.date_add("start", 1))
    last = F.when(F.col("include_end"), F.col("stop")).otherwise(F.date_sub("stop", 1))
    return rules.withColumns({"first_day": first, "last_day": last})


def _selects(week: Column, start: Column) -> Column:
    number = F.weekofyear(start)
    # the year of a week is that of its Thursday
    iso = F.format_string("%d-W%02d", F.year(F.date_add(start, 3 - F.weekday(start))), number)
    return week.isNull() | week.startswith("week-") | (week == start.cast("string")) | (week == iso) | (week == number.cast("string"))


def by_week(rules: DataFrame, weeks: DataFrame) -> DataFrame:
    """Rules in each week (week_start, week_end) that they apply to: some day of the week
    lies inside the interval, the week is the one selected, and one of the days, if any are
    named, is in it.

    A rule is laid over the months that its interval touches, up to the last week; weeks
    over the months that they touch: the two meet by month, and no rule meets weeks that
    its interval is far from."""
    bounds = day_bounds(rules.where(interval_reason(rules).isNull()))
    horizon = weeks.agg(F.min("week_start").alias("opens"), F.max("week_end").alias("closes"))
    held = bounds.crossJoin(F.broadcast(horizon))  # one row
    low, high = F.greatest("first_day", "opens"), F.least(F.coalesce("last_day", F.col("closes")), F.col("closes"))
    month = lambda a, b: F.explode(F.sequence(F.trunc(a, "month"), F.trunc(b, "month"), F.expr("interval 1 month"))).alias("month")
    laid = held.withColumns({"low": low, "high": high}).where("low <= high").select(*rules.columns, "first_day", "last_day", month("low", "high"))
    spans = weeks.select("week_start", "week_end", month("week_start", "week_end"))
    joined = laid.join(spans, "month")
    inside = (F.col("first_day") <= F.col("week_end")) & F.coalesce(F.col("last_day") >= F.col("week_start"), F.lit(True))
    named = F.col("days").isNull() | (F.size("days") == 0) | F.exists("days", lambda d: (d >= F.col("week_start")) & (d <= F.col("week_end")))
    applies = joined.where(inside & named & _selects(F.col("week"), F.col("week_start")))
    return applies.dropDuplicates(["rule_id", "week_start"]).select(*rules.columns, "first_day", "week_start", "week_end")


def in_force(rules: DataFrame, weeks: DataFrame) -> DataFrame:
    """The rule in force by week and topic: of those that apply and that no later rule of
    the week withdraws, the one stated last; ties by id."""
    applies = by_week(rules, weeks)
    ended = applies.where("withdraws is not null").select("week_start", F.col("withdraws").alias("rule_id"), F.col("first_day").alias("ended_on"))
    ended = ended.groupBy("week_start", "rule_id").agg(F.max("ended_on").alias("ended_on"))
    left = applies.where("withdraws is null").join(ended, ["week_start", "rule_id"], "left").where("ended_on is null or ended_on < first_day")
    best = left.groupBy("week_start", "topic").agg(F.max_by("rule_id", F.struct("first_day", "rule_id")).alias("rule_id"), F.count("*").alias("n_rules"))
    return best.select("week_start", "topic", "rule_id", "n_rules")
