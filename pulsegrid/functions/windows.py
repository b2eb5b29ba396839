"""Periods, ranges and phrases to inclusive date ranges.

On the driver for a caller's own arguments, and as column expressions for tables of
questions.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, functions as F

#: Days that one of each unit counts for, and the words for no limit.
DAYS = {"d": 1, "w": 7, "m": 30, "y": 365}
OPEN = ("all", "max", "lifetime")
#: Days of a rolling week and month.
ROLLING = {"week": 7, "month": 30}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def parse_period(spec: str, end: dt.date, first: dt.date | None = None) -> tuple[dt.date, dt.date]:
    """``30d``, ``12w``, ``6m``, ``1y`` or a word for no limit, ending at ``end``; anything
    else is an error."""
    text = spec.strip().lower()
    if text in OPEN:
        return first or dt.date.min, end
    if not (m := re.fullmatch(r"(\d+)([dwmy])", text)) or not int(m[1]):
        raise ValueError(f"no period: {spec!r}")
    return end - dt.timedelta(days=int(m[1]) * DAYS[m[2]] - 1), end


def parse_range(spec: str, end: dt.date) -> tuple[dt.date, dt.date]:
    """A period, or ``YYYY-MM-DD:YYYY-MM-DD``."""
    if ":" not in spec:
        return parse_period(spec, end)
    a, b = (dt.date.fromisoformat(x.strip()) for x in spec.split(":", 1))
    if b < a:
        raise ValueError(f"{spec!r}: last day before first day")
    return a, b


def period_start(spec: Column, end: Column) -> Column:
    """First day of a period that ends at ``end``: null where the period has no limit or
    the text is no period (``is_period`` tells which)."""
    text = F.lower(F.trim(spec))
    size = F.regexp_extract(text, r"^(\d+)([dwmy])$", 1)
    unit = F.regexp_extract(text, r"^(\d+)([dwmy])$", 2)
    days = F.coalesce(*[F.when(unit == u, F.lit(n)) for u, n in DAYS.items()])
    return F.when((size != "") & (size.cast("int") > 0), F.date_add(end, F.lit(1) - size.cast("int") * days))


def is_period(spec: Column) -> Column:
    return F.lower(F.trim(spec)).rlike(r"^(0*[1-9]\d*[dwmy]|all|max|lifetime)$")


def with_day_named(rows: DataFrame, token: Column, today: str, into: str) -> DataFrame:
    """``rows`` with the day of ``YYYY-MM-DD``, ``July 4`` or ``Jul 4, 2023``; without a
    year the latest one that is not after ``today``.  Null for anything else."""
    names = {n: k for k, m in enumerate(MONTHS, 1) for n in (m, m[:3])} | {"sept": 9}
    months = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    pattern = r"^([a-z]{3,9})\s+(\d{1,2})(?:,?\s+(\d{4}))?$"
    out = rows.withColumn("__token", F.lower(F.trim(token)))
    out = out.withColumns({"__month": F.try_element_at(months, F.regexp_extract("__token", pattern, 1)), "__day": F.regexp_extract("__token", pattern, 2), "__year": F.regexp_extract("__token", pattern, 3)})
    on = lambda year: F.try_to_date(F.concat_ws("-", year.cast("string"), F.lpad(F.col("__month").cast("string"), 2, "0"), F.lpad(F.col("__day"), 2, "0")), "yyyy-MM-dd")
    # a leap day lies at most eight years back
    tries = F.filter(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: on(F.year(today) - k)), lambda d: d <= F.col(today))
    plain = F.col("__token").rlike(r"^\d{4}-\d{2}-\d{2}$")
    found = F.when(plain, F.try_to_date("__token", "yyyy-MM-dd")).when(F.col("__month").isNotNull(), F.when(F.col("__year") != "", on(F.col("__year"))).otherwise(F.get(tries, F.lit(0))))
    return out.withColumn(into, found).drop("__token", "__month", "__day", "__year")


def with_windows(rows: DataFrame, phrase: str, today: str) -> DataFrame:
    """``rows`` with ``start``, ``stop`` and ``unit`` of phrases such as ``last week``,
    ``past 10 days``, ``week starting July 4`` or ``Jul 1 through Jul 7``; nulls where a
    text is no such phrase.

    ``last month`` is the calendar month before; with ``the`` or ``past`` it is the
    30 days up to today, and a week the seven.  An end without a year lies in the year of
    its start where that has none either."""
    span = r"^(.+?) (?:through|to|-) (.+)$"
    out = rows.withColumn("__text", F.regexp_replace(F.lower(F.trim(phrase)), r"\s+", " "))
    out = with_day_named(out, F.regexp_extract("__text", span, 1), today, "__low")
    end = F.regexp_extract("__text", span, 2)
    dated = F.regexp_extract("__text", span, 1).rlike(r"\d{4}") | end.rlike(r"\d{4}")
    out = with_day_named(out, F.when(dated, end).otherwise(F.concat(end, F.lit(" "), F.year("__low").cast("string"))), today, "__high")
    out = with_day_named(out, F.regexp_extract("__text", r"^(?:the )?week starting (.+)$", 1), today, "__week")
    out = with_day_named(out, F.col("__text"), today, "__one")
    text, now = F.col("__text"), F.col(today)
    monday, first = F.trunc(now, "week"), F.trunc(now, "month")
    window = lambda a, b, unit: F.struct(a.alias("start"), b.alias("stop"), F.lit(unit).cast("string").alias("unit"))
    rolling = F.regexp_extract(text, r"^(?:the (?:last|past)|past) (week|month)$", 1)
    days = F.regexp_extract(text, r"^past ([1-9]\d*) days?$", 1)
    nothing = window(F.lit(None).cast("date"), F.lit(None).cast("date"), None)
    found = (
        F.when(rolling == "week", window(F.date_add(now, 1 - ROLLING["week"]), now, None))
        .when(rolling == "month", window(F.date_add(now, 1 - ROLLING["month"]), now, None))
        .when(text == "today", window(now, now, "day"))
        .when(text == "yesterday", window(F.date_sub(now, 1), F.date_sub(now, 1), "day"))
        .when(text == "this week", window(monday, now, "week"))
        .when(text == "last week", window(F.date_sub(monday, 7), F.date_sub(monday, 1), "week"))
        .when(text == "this month", window(first, now, None))
        .when(text == "last month", window(F.add_months(first, -1), F.date_sub(first, 1), None))
        .when(days != "", window(F.date_add(now, F.lit(1) - days.cast("int")), now, "day"))
        .when(F.col("__week").isNotNull(), window(F.col("__week"), F.date_add("__week", 6), "week"))
        .when(F.col("__high") >= F.col("__low"), window(F.col("__low"), F.col("__high"), None))
        .when(F.col("__one").isNotNull(), window(F.col("__one"), F.col("__one"), "day"))
        .otherwise(nothing)
    )
    return out.withColumn("__found", found).select(*rows.columns, "__found.*")
