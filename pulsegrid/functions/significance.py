"""Student's t and the correlation test, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: The published Lanczos coefficients of the gamma function (g = 7, nine terms).
LANCZOS_G = 7
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)

STEPS = 200  # of the continued fraction; it needs about the root of the larger parameter
HALVINGS = 45


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def ln_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive number."""
    terms = sum((c / (x + (k - 1)) for k, c in enumerate(LANCZOS[1:], 1)), F.lit(LANCZOS[0]))
    t = x + (LANCZOS_G - 0.5)
    return F.lit(0.9189385332046727) + (x - 0.5) * F.log(t) - t + F.log(terms)


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its first term on."""

    def step(s: Column, k: Column) -> Column:
        even = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        odd = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        d1, c1 = 1 / (1 + even * s["d"]), 1 + even / s["c"]
        half = bound(F.struct(d1.alias("d"), c1.alias("c"), (s["h"] * d1 * c1).alias("h")), lambda t: bound(F.struct((1 / (1 + odd * t["d"])).alias("d"), (1 + odd / t["c"]).alias("c"), t["h"].alias("h")), lambda u: F.struct(u["d"].alias("d"), u["c"].alias("c"), (u["h"] * u["d"] * u["c"]).alias("h"))))
        return half

    d = 1 / (1 - (a + b) * x / (a + 1))
    start = F.struct(d.alias("d"), F.lit(1.0).alias("c"), d.alias("h"))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(STEPS)), lambda k: k.cast("double")), start, step, lambda s: s["h"])


def beta_share(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b)."""

    def inside(s: Column) -> Column:
        front = F.exp(ln_gamma(s["a"] + s["b"]) - ln_gamma(s["a"]) - ln_gamma(s["b"]) + s["a"] * F.log(s["x"]) + s["b"] * F.log(1 - s["x"]))
        value = front * _fraction(s["x"], s["a"], s["b"]) / s["a"]
        return F.when(s["turned"], 1 - value).otherwise(value)

    # the fraction converges fast below the mean; above it the other tail is taken
    turned = x > (a + 1) / (a + b + 2)
    sides = F.struct(F.when(turned, 1 - x).otherwise(x).alias("x"), F.when(turned, b).otherwise(a).alias("a"), F.when(turned, a).otherwise(b).alias("b"), turned.alias("turned"))
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(bound(sides, inside))


def t_tail(t: Column, df: Column) -> Column:
    """Probability that Student's t is at least as far from 0 as ``t``."""
    df = df.cast("double")
    return beta_share(df / (df + t * t), df / 2, F.lit(0.5))


def correlation_p(rho: Column, n: Column) -> Column:
    """Two-sided p of a correlation of ``n`` pairs; null for fewer than three."""
    df = (n - 2).cast("double")
    return F.when(df > 0, beta_share(1 - rho * rho, df / 2, F.lit(0.5)))


def least_rho(n: Column, tests: Column, q: float) -> Column:
    """The smallest correlation of ``n`` pairs whose p is at most q / tests, the bound for
    the best of them; null for fewer than three pairs or no tests."""
    alpha = F.lit(q) / tests

    def halve(s: Column, _: Column) -> Column:
        middle = (s["low"] + s["high"]) / 2
        return bound(F.struct(middle.alias("m"), (correlation_p(middle, n) > alpha).alias("short")), lambda at: F.struct(F.when(at["short"], at["m"]).otherwise(s["low"]).alias("low"), F.when(at["short"], s["high"]).otherwise(at["m"]).alias("high")))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    return F.when((n > 2) & (tests > 0), F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda s: s["high"]))


def correlation_p_sql(rho: str, n: str) -> str:
    """The same p in DuckDB, by the finite series that holds for whole degrees of freedom."""
    odd = f"2 / pi() * (asin(abs({rho})) + abs({rho}) * sqrt(1 - {rho} * {rho}) * coalesce(list_sum(list_transform(range(0, ({n} - 3) // 2), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5)) * pow(1 - {rho} * {rho}, k))), 0))"
    even = f"abs({rho}) * list_sum(list_transform(range(0, ({n} - 2) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow(1 - {rho} * {rho}, k)))"
    return f"(1 - CASE WHEN {n} % 2 = 1 THEN {odd} ELSE {even} END)"
