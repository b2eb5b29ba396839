"""Scalar rules of the domain, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def pct_change(recent: Column, base: Column) -> Column:
    """Change in percent; null on a zero base."""
    return F.when(base != 0, (recent - base) / base * 100)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def composite(parts: dict[str, float]) -> Column:
    """Weighted mean of the columns that are there."""
    total = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in parts.items()), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in parts.items()), F.lit(0.0))
    return F.when(weight > 0, total / weight)


#: Weight and exponent of the training impulse, the line of maximal heart rate
#: by age, and the relative size of a float tail.
IMPULSE, EXPONENT, MOST_AT_BIRTH, LESS_A_YEAR, TAIL = 0.64, 1.92, 208, 0.7, 4e-16


def trimp(minutes: Column, mean_hr: Column, rest: Column | float, most: Column | float) -> Column:
    """Training impulse of a session: minutes, by how far heart rate rose to its maximum.

    Null unless the maximum is above the resting rate."""
    rest, most = (x if isinstance(x, Column) else F.lit(float(x)) for x in (rest, most))
    ratio = F.greatest(F.lit(0.0), F.try_divide(mean_hr - rest, most - rest))
    return F.when(most > rest, minutes * ratio * IMPULSE * F.exp(EXPONENT * ratio))


def max_hr_from_age(age: Column) -> Column:
    return MOST_AT_BIRTH - LESS_A_YEAR * age


def zone2_top(rest: Column, most: Column, fraction: float = 0.7) -> Column:
    return rest + fraction * (most - rest)


def pace(minutes: Column, distance: Column) -> Column:
    return F.try_divide(minutes, distance)


def grade_pct(climb_m: Column, miles: Column) -> Column:
    return F.try_divide(climb_m * 100, miles * 1609.344)


def canonical_share(value: Column) -> Column:
    """Shares between 0 and 1 become percent."""
    return F.when((value >= 0) & (value <= 1), value * 100).otherwise(value)


def snapped(value: Column, eps: float = TAIL) -> Column:
    """Whole numbers where a conversion left a float tail."""
    return F.when(F.abs(value - F.round(value)) <= eps * F.abs(value), F.round(value)).otherwise(value)


#: Dew points in Fahrenheit below which each word holds.
DEW_BANDS = ((55, "dry"), (60, "comfortable"), (65, "sticky"), (70, "humid"), (75, "oppressive"))


def dew_label(dew_f: Column) -> Column:
    """Comfort word of a dew point; null for null."""
    out = F.when(dew_f.isNull(), F.lit(None).cast("string"))
    for ceiling, word in DEW_BANDS:
        out = out.when(dew_f < ceiling, word)
    return out.otherwise("dangerous")


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "(.)([A-Z][a-z]+)", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


def key_of(*parts: Column) -> Column:
    """SHA-1 identity of the parts in a row."""
    return F.sha1(F.concat_ws("|", *parts))


def close(value: Column, reference: Column, rel: float, floor: float) -> Column:
    return F.abs(value - reference) <= F.greatest(F.abs(reference) * rel, F.lit(floor))


def day_state(day: Column, as_of: Column, known: Column) -> Column:
    return F.when(day > as_of, "future").when(known, "recorded").otherwise("not_recorded")
