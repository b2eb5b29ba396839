"""Clock and calendar rules, as column expressions that read no session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BUCKET_SECONDS = 20
EPOCH = "1970-01-01"


def unix_day(day: Column) -> Column:
    return F.datediff(day, F.lit(EPOCH).cast("date"))


def _wall_seconds(stamp: Column) -> Column:
    """Seconds since the epoch that a wall clock of ``YYYY-MM-DD HH:MM:SS`` shows."""
    part = lambda at, n: F.substring(stamp, at, n).cast("long")
    return unix_day(F.to_date(F.substring(stamp, 1, 10))).cast("long") * 86400 + part(12, 2) * 3600 + part(15, 2) * 60 + part(18, 2)


def offset_seconds(stamp: Column) -> Column:
    """Offset of ``... ±HHMM`` from UTC."""
    size = F.substring(stamp, 22, 2).cast("long") * 3600 + F.substring(stamp, 24, 2).cast("long") * 60
    return F.when(F.substring(stamp, 21, 1) == "-", -size).otherwise(size)


def utc_seconds(stamp: Column) -> Column:
    """Epoch seconds of ``YYYY-MM-DD HH:MM:SS ±HHMM``; null where the text has another form."""
    whole = stamp.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} [+-]\d{4}$")
    return F.when(whole, _wall_seconds(stamp) - offset_seconds(stamp))


def iso_utc(seconds: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ`` of epoch seconds."""
    day = F.date_add(F.lit(EPOCH).cast("date"), F.floor(seconds / 86400).cast("int"))
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), clock(F.pmod(seconds, F.lit(86400)), True), F.lit("Z"))


def clock(second_of_day: Column, seconds: bool = False) -> Column:
    """HH:MM, or HH:MM:SS, of a second of a day."""
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    parts = [two(second_of_day / 3600), two(F.pmod(second_of_day, F.lit(3600)) / 60)]
    return F.concat_ws(":", *parts, *([two(F.pmod(second_of_day, F.lit(60)))] if seconds else []))


def local_date(stamp: Column) -> Column:
    """Civil day in the stamp's own offset."""
    return F.to_date(F.substring(stamp, 1, 10))


def local_naive(stamp: Column) -> Column:
    """Wall clock without its offset."""
    return F.concat(F.substring(stamp, 1, 10), F.lit("T"), F.substring(stamp, 12, 8))


def strict_date(text: Column) -> Column:
    """A date of exactly ``YYYY-MM-DD``; null for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def bucket_index(seconds: Column) -> Column:
    """Number of the bucket that holds epoch seconds."""
    return F.floor(seconds / BUCKET_SECONDS)


def trunc_div(a: Column, b: Column) -> Column:
    """Whole quotient, cut towards zero."""
    return F.when(b != 0, F.signum(a) * F.signum(b) * F.floor(F.abs(a) / F.abs(b))).cast("long")


def age_on(born: Column, day: Column) -> Column:
    """Whole years of age."""
    before = (F.month(day) * 100 + F.dayofmonth(day)) < (F.month(born) * 100 + F.dayofmonth(born))
    return F.year(day) - F.year(born) - before.cast("int")


def week_span_end(start: Column, declared: Column) -> Column:
    """Declared last day of a week, or the seventh."""
    return F.coalesce(declared, F.date_add(start, 6))


def night_seconds(day: Column, bedtime_h: Column, wake_h: Column) -> tuple[Column, Column]:
    """Epoch seconds of a night that ends on ``day``; a bedtime after noon is on the day before."""
    base = unix_day(day).cast("long") * 86400
    bed = base + F.round(bedtime_h * 3600).cast("long") - F.when(bedtime_h >= 12, 86400).otherwise(0)
    return bed, base + F.round(wake_h * 3600).cast("long")
