"""Rules in force, claims on claims, unit spellings, packed routes, significance."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import quantities, significance
from pulsegrid.operators import claims, correlation, intervals
from pulsegrid.sources import routes

RULE = "rule_id long, topic string, start date, stop date, include_start boolean, include_end boolean, week string, days array<date>, withdraws long"
MON = dt.date(2024, 1, 29)  # of week 5
D = dt.timedelta


def weeks(spark, *starts):
    return spark.createDataFrame([(s, s + D(6)) for s in starts or (MON - D(7), MON, MON + D(7))], "week_start date, week_end date")


def rule(k, start, stop=None, a=True, b=True, week=None, days=None, withdraws=None, topic="t"):
    return (k, topic, start, stop, a, b, week, days, withdraws)


@pytest.mark.parametrize(
    "r, held",
    [
        (rule(1, MON), {0, 7}),  # no end decided
        (rule(1, MON - D(99), MON - D(8)), set()),
        (rule(1, MON - D(99), MON), {-7, 0}),
        (rule(1, MON - D(99), MON, b=False), {-7}),
        (rule(1, MON + D(6)), {0, 7}),
        (rule(1, MON + D(6), a=False), {7}),
        (rule(1, MON, MON), {0}),
        (rule(1, MON, MON, b=False), set()),  # refused
        (rule(1, MON, MON - D(1)), set()),  # refused
        (rule(1, MON, MON + D(1), a=False, b=False), set()),
        (rule(1, MON - D(60), week="5"), {0}),
        (rule(1, MON - D(60), week="2024-W06"), {7}),
        (rule(1, MON - D(60), week="2024-01-22"), {-7}),
        (rule(1, MON - D(60), week="week-08"), {-7, 0, 7}),
        (rule(1, MON - D(60), days=[MON + D(2), MON + D(20)]), {0}),
        (rule(1, MON - D(60), days=[]), {-7, 0, 7}),
    ],
)
def test_ends_selectors_and_days(spark, r, held):
    got = intervals.by_week(spark.createDataFrame([r], RULE), weeks(spark)).collect()
    assert {(x.week_start - MON).days for x in got} == held


def test_the_rule_stated_last_is_in_force_until_it_ends(spark):
    rows = [rule(1, MON - D(30)), rule(2, MON, MON + D(6)), rule(3, MON - D(7), withdraws=1), rule(4, MON - D(30), topic="u"), rule(5, MON - D(30), topic="u")]
    got = intervals.in_force(spark.createDataFrame(rows, RULE), weeks(spark)).collect()
    assert {((x.week_start - MON).days, x.topic): (x.rule_id, x.n_rules) for x in got} == {(0, "t"): (2, 1), (-7, "u"): (5, 2), (0, "u"): (5, 2), (7, "u"): (5, 2)}
    assert {r.reason for r in spark.createDataFrame([rule(1, MON, MON - D(1)), rule(2, MON, MON, b=False), rule(3, None)], RULE).select(intervals.interval_reason(None).alias("reason")).collect()} == {"ends_before_start", "empty_day", "no_start"}
    assert intervals.in_force(spark.createDataFrame([], RULE), weeks(spark)).count() == 0


CLAIM = "claim_id string, value string, operation string, operands array<string>, metric string, date date, field string"


def judge(spark, rows, daily, depth=claims.DEPTH):
    every = spark.createDataFrame(rows, CLAIM)
    return {r.claim_id: (r.actual, r.verdict) for r in claims.verdicts(every, claims.worked_out(every, claims.leaf_values(every, daily, ["sum"]), depth)).collect()}


def test_claims_from_the_leaves_up(spark):
    daily = spark.createDataFrame([("m", MON, 10.0), ("m", MON + D(1), 4.0), ("m", MON + D(2), 0.0)], "metric string, date date, sum double")
    leaf = lambda k, d, value="10", field="sum", metric="m": (k, value, None, None, metric, MON + D(d), field)
    on = lambda k, op, *of, value="6": (k, value, op, list(of), "m", MON, "x")
    rows = [
        leaf("a", 0), leaf("b", 1, "5"), leaf("z", 2, None), leaf("gone", 9), leaf("odd", 0, field="mode"),
        on("d", "difference", "a", "b"), on("dd", "difference", "d", "b", value="2.0"), on("ddd", "pct_change", "dd", "d", value="-66.7"), on("down", "pct_down", "b", "a", value="60"),
        on("zero", "pct_change", "a", "z"), on("over_zero", "difference", "zero", "a"), on("lost", "difference", "a", "nowhere"), on("bad", "difference", "a", "gone"), on("worse", "difference", "bad", "a"),
        on("odd_one", "difference", "odd", "a"), on("root", "root", "a", "b"), on("three", "difference", "a", "b", "z"), on("none", "difference"),
        on("c1", "difference", "c2", "a"), on("c2", "difference", "c1", "a"), on("self", "difference", "self", "self"), on("upon", "difference", "c1", "a"), on("same", "difference", "a", "a", value="0"),
    ]
    got = judge(spark, rows, daily)
    assert got == {
        "a": (10.0, "ok"), "b": (4.0, "mismatch"), "z": (0.0, "no_value"), "gone": (None, "no_data"), "odd": (None, "unknown_field"), "d": (6.0, "ok"), "dd": (2.0, "ok"), "ddd": (pytest.approx(-66.6667, abs=1e-3), "ok"), "down": (60.0, "ok"),
        "zero": (None, "undefined"), "over_zero": (None, "operand_failed"), "lost": (None, "operand_missing"), "bad": (None, "operand_failed"), "worse": (None, "operand_failed"), "odd_one": (None, "operand_failed"),
        "root": (None, "unsupported_operation"), "three": (None, "needs_two"), "none": (None, "needs_two"), "c1": (None, "cycle"), "c2": (None, "cycle"), "self": (None, "cycle"), "upon": (None, "cycle"), "same": (0.0, "ok"),
    }
    chain = [leaf("k0", 0), *[on(f"k{k}", "difference", f"k{k - 1}", "k0") for k in range(1, 7)]]
    assert judge(spark, chain, daily, depth=3)["k6"] == (None, "too_deep") and judge(spark, chain, daily)["k6"][0] == -50.0


def test_every_order_and_stroke_of_a_unit_is_one_spelling(spark):
    spellings = set()
    for a, b in itertools.permutations(["kg", "min"]):
        spellings |= {f"ml/({a}·{b})", f"mL/{a}*{b}", f"ML / {a} / {b}", f"ml/{a}⋅{b}", f"mL/({a} × {b})"}
    got = spark.createDataFrame([(s,) for s in spellings], "u string").select(quantities.canonical(F.col("u"))).distinct().collect()
    assert [r[0] for r in got] == ["mL/kg·min"]


@pytest.mark.parametrize(
    "unit, to, value",
    [("km/h", "m/s", 1 / 3.6), ("mi/h", "km/h", 1.609344), ("mg/dL", "g/L", 0.01), ("cal", "kcal", 0.001), ("Cal", "kcal", 1.0), ("kg/m^2", "g/m²", 1000.0), ("lb/in2", "kg/m^2", 0.45359237 / 0.0254**2), ("beats/min", "count/s", 1 / 60), ("µg", "mg", 0.001), ("CAL", "kcal", None), ("km", "kg", None), ("parsec", "m", None), ("", "m", None)],
)
def test_factors_are_products(spark, unit, to, value):
    got = spark.createDataFrame([(unit,)], "u string").select(quantities.converted(F.lit(1.0), F.col("u"), to)).first()[0]
    assert got == (None if value is None else pytest.approx(value, rel=1e-12))


ROUTE = "id long, " + ", ".join(f"{f} array<float>" for f in routes.FIELDS)


def test_routes_come_back_as_they_were(spark):
    rows = [(1, [0.0, 1.5], [10.1, 10.2], [1.0, 2.0], [3.0, 4.0]), (2, [], [], [], []), (3, None, None, None, None), (4, [7.25], [-1.0], [0.0], [float("inf")])]
    blobs = routes.packed(spark.createDataFrame(rows, ROUTE))
    held = {r.id: r for r in blobs.collect()}
    assert bytes(held[1].points) == np.array(rows[0][1:], "<f4").tobytes() and held[3].n_points == 0
    got = {r.id: tuple(r[f] for f in routes.FIELDS) for r in routes.unpacked(blobs).collect()}
    assert got == {r[0]: tuple([float(np.float32(x)) for x in c or []] for c in r[1:]) for r in rows}


def test_damaged_routes_are_loud(spark):
    from pyspark.errors import PythonException

    bad = spark.createDataFrame([(1, 2, bytearray(31)), (2, 0, bytearray()), (3, -1, bytearray()), (4, 1, None), (5, 20_001, bytearray(20_001 * 16))], "id long, n_points int, points binary")
    assert {r.id: r.reason for r in routes.unpacked(bad, refuse=True).collect()} == {1: "bad_length", 2: None, 3: "bad_count", 4: "bad_length", 5: "bad_count"}
    with pytest.raises(PythonException, match="bad_length"):
        routes.unpacked(bad.where("id = 1")).collect()
    with pytest.raises(PythonException, match="differ in length"):
        routes.packed(spark.createDataFrame([(1, [1.0], [1.0, 2.0], [1.0], [1.0])], ROUTE)).collect()
    with pytest.raises(PythonException, match="more than"):
        routes.packed(spark.createDataFrame([(1, *[[0.0] * 20_001] * 4)], ROUTE)).collect()


def test_significance_against_tables(spark):
    one = spark.range(1)
    #: critical values of t at 5 % and 1 %, two-sided, as printed in tables
    for df, t, p in [(1, 12.7062, 0.05), (5, 2.5706, 0.05), (30, 2.0423, 0.05), (120, 1.9799, 0.05), (10, 3.1693, 0.01), (1000, 2.5808, 0.01)]:
        assert one.select(significance.t_tail(F.lit(t), F.lit(df)).alias("p")).first().p == pytest.approx(p, rel=1e-3)
    rows = spark.createDataFrame([(30, 6), (30, 1), (2, 1), (30, 0)], "n long, tests long")
    got = [r.least for r in rows.select(significance.least_rho(F.col("n"), F.col("tests"), 0.1).alias("least")).collect()]
    assert got[:2] == [pytest.approx(0.4336, abs=1e-4), pytest.approx(0.3061, abs=1e-4)] and got[2:] == [None, None]


def test_pairs_that_cannot_be_tested_keep_their_row(spark):
    series = [("x", MON + D(k), float(k * k % 11)) for k in range(20)] + [("y", MON + D(k), float(k * k % 11 + k % 3)) for k in range(20)] + [("flat", MON + D(k), 5.0) for k in range(20)]
    named = spark.createDataFrame([("good", "x", "y", 0), ("flat", "x", "flat", 0), ("few", "x", "y", 15), ("none", "x", "w", 0)], "name string, mx string, my string, lag int")
    got = {r.name: r for r in correlation.tested(named, spark.createDataFrame(series, "metric string, date date, value double")).collect()}
    assert {k: r.status for k, r in got.items()} == {"good": "ok", "flat": "undefined_constant_series", "few": "insufficient_data", "none": "insufficient_data"}
    assert got["good"].p < 0.001 and got["good"].q_value == got["good"].p and got["good"].passed_fdr
    assert all(got[k].p is None and got[k].q_value is None and not got[k].passed_fdr for k in ("flat", "few", "none"))
    assert (got["few"].n, got["none"].n, got["none"].least_rho) == (5, 0, None)
