"""Rules over names and figures in text: licences, keys of facts, machines, shown units."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Licences that allow a text to be passed on.
OPEN_LICENCES = ("CC0", "CC BY")
#: How a fitness machine may be spelled, and its stored kind.
MACHINE_PREFIX, MACHINE_LENGTH, MACHINE_SHAPE = "fitnessmachinemodel.", 64, "^[a-z0-9][a-z0-9 ._-]*$"
MACHINES = {"treadmill": "treadmill", "indoorbike": "indoor_bike", "elliptical": "elliptical", "stairstepper": "stair_stepper", "rower": "rower"}
#: Stored unit, unit of the metric system, factor.  Degrees move by -32 first.
METRIC_TWINS = {
    "mi": ("km", 1.609344),
    "kcal": ("kJ", 4.184),
    "lb": ("kg", 0.45359237),
    "degF": ("degC", 5.0 / 9.0),
    "mi/hr": ("km/hr", 1.609344),
    "min/mi": ("min/km", 1.0 / 1.609344),
    "ft": ("m", 0.3048),
    "in": ("cm", 2.54),
}


def one_spaced(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def licence_name(raw: Column) -> Column:
    """A licence in capitals, words apart by blanks, without trailing version numbers.

    Null is empty.  Other words stay, so a longer licence never becomes a shorter one."""
    folded = F.trim(F.regexp_replace(F.upper(raw), "[^A-Z0-9]+", " "))
    return F.coalesce(F.trim(F.regexp_replace(folded, r"(^| )\d+( \d+)*$", "")), F.lit(""))


def machine_kind(value: Column) -> Column:
    """The kind of a fitness machine, or null where the text is no usable name."""
    text = F.lower(F.trim(value))
    bare = F.trim(F.when(text.contains(MACHINE_PREFIX), F.substring_index(text, MACHINE_PREFIX, -1)).otherwise(text))
    squashed = F.regexp_replace(bare, "[-_ ]", "")
    kinds = F.create_map(*[F.lit(x) for pair in MACHINES.items() for x in pair])
    return F.when(bare.rlike(MACHINE_SHAPE) & (F.length(bare) <= MACHINE_LENGTH), F.coalesce(F.try_element_at(kinds, squashed), bare))


def escaped(text: Column) -> Column:
    """Percent-escapes all but letters, digits and ``-_.~:``."""
    out = F.url_encode(text)
    for coded, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%3A", ":")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def fact_key(metric: Column, period: Column, field: Column) -> Column:
    """One text for a metric, period and field; null where one is missing or blank."""
    whole = (F.trim(metric) != "") & (F.trim(field) != "") & period.isNotNull()
    part = lambda name, value: F.concat(F.lit(f"|{name}="), escaped(value))
    return F.when(whole, F.concat(F.lit("fact"), part("metric", metric), part("period", period), part("field", field)))


def fact_part(key: Column, name: str) -> Column:
    """One part of a key made by ``fact_key``; null where the text is no such key."""
    sound = key.rlike(r"^fact\|metric=[^|]*\|period=[^|]*\|field=[^|]*$")
    return F.when(sound, F.url_decode(F.replace(F.regexp_extract(key, rf"\|{name}=([^|]*)", 1), F.lit("+"), F.lit("%2B"))))


def metric_unit(unit: Column) -> Column:
    """The metric system's unit for a stored one; others stay."""
    out = unit
    for stored, (shown, _) in METRIC_TWINS.items():
        out = F.when(unit == stored, shown).otherwise(out)
    return out


def metric_value(value: Column, unit: Column) -> Column:
    """A stored value in the metric system's unit; values of other units stay."""
    out = value
    for stored, (_, factor) in METRIC_TWINS.items():
        out = F.when(unit == stored, (value - 32.0 if stored == "degF" else value) * F.lit(factor)).otherwise(out)
    return out


def swim_metres(miles: Column) -> Column:
    """Miles as whole metres, halves up."""
    return F.floor(miles * 1609.344 + 0.5)


def rounds_to(token: Column, value: Column) -> Column:
    """Whether a number as written equals a value or is the value, rounded to as many decimals.

    A number without decimals does not stand for a value below one; text that is no
    number, and null, do not match."""
    text = F.regexp_replace(F.trim(token), "[.,]+$", "")
    number = F.replace(text, F.lit(","), F.lit("")).try_cast("double")
    decimals = F.when(text.contains("."), F.length(F.substring_index(text, ".", -1))).otherwise(0)
    near = F.abs(number - value) <= F.pow(F.lit(10.0), -decimals) * 0.5 + 1e-9
    return F.coalesce((number == value) | (near & ~((decimals == 0) & (F.abs(value) < 1))), F.lit(False))
