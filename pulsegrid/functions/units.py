"""Unit conversion and source roles, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What one of the unit is in the canonical unit.
FACTORS = {("km", "mi"): 0.621371192, ("m", "mi"): 0.000621371192, ("kg", "lb"): 2.2046226218, ("kJ", "kcal"): 0.2390057361, ("cm", "in"): 0.3937007874}


def convert(value: Column, unit: Column, target: str) -> Column:
    """Value in the target unit; null where the unit is not known."""
    out = F.when(unit == target, value)
    for (a, b), factor in FACTORS.items():
        if b == target:
            out = out.when(unit == a, value * factor)
    if target == "degF":
        out = out.when(unit == "degC", value * 1.8 + 32)
    return out


def source_role(name: Column) -> Column:
    """watch, machine, mirror or phone, from the text of a source's name."""
    low = F.lower(name)
    return F.when(low.contains("watch"), "watch").when(low.rlike("treadmill|machine|bike"), "machine").when(low.rlike("mirror|sync|connect"), "mirror").when(low.contains("phone"), "phone").otherwise("other")


def rounded_coordinate(value: Column) -> Column:
    return F.round(value, 1)
