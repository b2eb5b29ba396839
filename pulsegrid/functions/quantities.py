"""Compound units by their structure: numerators, denominators and powers.

``ml/(kg·min)``, ``mL/min·kg`` and ``ml/kg/min`` are one unit.  A unit is a product of
tokens with powers; all that follows the first stroke is below it.  The canonical spelling
sorts tokens, and the factor to base units is the product of theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Base dimension and size in base units (g, m, s, kcal, count) of each token.
TOKENS = {
    "g": ("mass", 1.0), "kg": ("mass", 1000.0), "mg": ("mass", 1e-3), "ug": ("mass", 1e-6), "lb": ("mass", 453.59237), "oz": ("mass", 28.349523125),
    "m": ("length", 1.0), "cm": ("length", 0.01), "mm": ("length", 1e-3), "km": ("length", 1000.0), "mi": ("length", 1609.344), "ft": ("length", 0.3048), "in": ("length", 0.0254), "yd": ("length", 0.9144),
    "s": ("time", 1.0), "ms": ("time", 1e-3), "min": ("time", 60.0), "h": ("time", 3600.0), "hr": ("time", 3600.0), "d": ("time", 86400.0),
    "L": ("volume", 1.0), "dL": ("volume", 0.1), "mL": ("volume", 1e-3),
    "kcal": ("energy", 1.0), "Cal": ("energy", 1.0), "cal": ("energy", 1e-3), "kJ": ("energy", 0.2390057361376673), "J": ("energy", 0.0002390057361376673),
    "count": ("count", 1.0), "beats": ("count", 1.0),
}
DIMENSIONS = ("mass", "length", "time", "volume", "energy", "count")


def _folded() -> dict[str, str]:
    """Tokens by their lower-case spelling, where that leaves no choice of size."""
    by: dict[str, set] = {}
    for token in TOKENS:
        by.setdefault(token.lower(), set()).add(TOKENS[token])
    return {t.lower(): t for t in reversed(TOKENS) if len(by[t.lower()]) == 1}


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def powers(unit: Column) -> Column:
    """Tokens of a unit as an array of (token, power), powers below the stroke negative."""
    plain = F.regexp_replace(F.regexp_replace(F.translate(unit, "µμ²³", "uu23"), r"[()\s]", ""), r"[*⋅×·]", "·")
    sides = F.split(plain, "/")
    tokens = lambda s: F.filter(F.split(s, "·"), lambda t: t != "")
    above, below = tokens(F.element_at(sides, 1)), tokens(F.array_join(F.slice(sides, 2, F.lit(100)), "·"))

    def one(sign: int):
        return lambda t: F.struct(F.regexp_replace(t, r"\^?-?[0-9]+$", "").alias("token"), (F.lit(sign) * F.coalesce(F.nullif(F.regexp_extract(t, r"\^?(-?[0-9]+)$", 1), F.lit("")).cast("int"), F.lit(1))).alias("power"))

    return F.concat(F.transform(above, one(1)), F.transform(below, one(-1)))


def known_powers(unit: Column) -> Column:
    """The same with tokens as they are spelt here: exact first, and by lower case where
    only one size is meant; null where a token is unknown."""
    exact = {t: t for t in TOKENS}
    held = F.transform(powers(unit), lambda p: F.struct(F.coalesce(F.try_element_at(_map(exact), p["token"]), F.try_element_at(_map(_folded()), F.lower(p["token"]))).alias("token"), p["power"].alias("power")))
    return F.when((F.size(held) > 0) & ~F.exists(held, lambda p: p["token"].isNull()), held)


def canonical(unit: Column) -> Column:
    """One spelling of all spellings of a unit, null where it isn't known."""

    def spelt(sign: int) -> Column:
        own = F.filter(known_powers(unit), lambda p: (p["power"] * sign) > 0)
        return F.array_join(F.array_sort(F.transform(own, lambda p: F.concat(p["token"], F.when(F.abs(p["power"]) > 1, F.concat(F.lit("^"), F.abs(p["power"]).cast("string"))).otherwise("")))), "·")

    above, below = spelt(1), spelt(-1)
    head = F.when(above == "", "1").otherwise(above)
    return F.when(known_powers(unit).isNotNull(), F.when(below == "", head).otherwise(F.concat(head, F.lit("/"), below)))


def factor(unit: Column) -> Column:
    """Size of a unit in base units: the product of its tokens' sizes."""
    sizes = {t: s for t, (_, s) in TOKENS.items()}
    return F.aggregate(known_powers(unit), F.lit(1.0), lambda f, p: f * F.pow(F.try_element_at(_map(sizes), p["token"]), p["power"]))


def dimension(unit: Column) -> Column:
    """Powers of the base dimensions, in their order; null for an unknown unit."""
    kinds = {t: d for t, (d, _) in TOKENS.items()}
    of = lambda d: F.aggregate(known_powers(unit), F.lit(0), lambda n, p: n + F.when(F.try_element_at(_map(kinds), p["token"]) == d, p["power"]).otherwise(0))
    return F.when(known_powers(unit).isNotNull(), F.array_join(F.array(*[of(d).cast("string") for d in DIMENSIONS]), ","))


def converted(value: Column, unit: Column, to: str) -> Column:
    """The value in the unit ``to``; null where the units don't measure one thing."""
    fits = dimension(unit) == dimension(F.lit(to))
    return F.when(fits, value * factor(unit) / factor(F.lit(to)))
