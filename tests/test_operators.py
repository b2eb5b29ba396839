"""Literal cases of the operators that are most easily got wrong."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import windows
from pulsegrid.operators import arbitration, buckets, folds, history, ledger, matching
from pulsegrid.streaming import rollup as stream


def test_expansion_keeps_totals_and_edges(spark):
    rows = spark.createDataFrame([(1, 0, 50, 10.0), (2, 20, 40, 4.0), (3, 30, 30, 7.0), (4, 0, 13 * 3600, 9.0), (5, 39, 41, 2.0)], "id long, start_s long, end_s long, value double")
    got = {}
    for r in buckets.expanded(rows).collect():
        got.setdefault(r.id, {})[r.bkt] = round(r.share, 6)
    assert got == {1: {0: 4.0, 1: 4.0, 2: 2.0}, 2: {1: 4.0}, 3: {1: 7.0}, 5: {1: 1.0, 2: 1.0}}


@pytest.mark.parametrize(
    ("inside", "pace", "cadence", "hr", "want"),
    [(True, 8, 150, None, True), (True, None, 140, None, True), (True, 4.9, 150, None, False), (True, 8, 251, None, False), (True, 8, 130, 130, True), (True, 8, 130, None, False), (True, 8, None, 150, False), (False, 8, 150, 150, False)],
)
def test_jog_rule(spark, inside, pace, cadence, hr, want):
    row = spark.createDataFrame([(inside, pace and float(pace), cadence and float(cadence), hr and float(hr))], "i boolean, p double, c double, h double")
    assert row.select(buckets.jog(F.col("i"), F.col("p"), F.col("c"), F.col("h")).alias("j")).first().j is want


def test_blocks_bridge_up_to_two_fit_buckets(spark):
    def run(flags):
        rows = [(dt.date(2024, 1, 1), k, f == "J", f == "b", 120.0) for k, f in enumerate(flags) if f != "_"]
        frame = spark.createDataFrame(rows, "local_date date, bkt long, is_jog boolean, fit boolean, hr double")
        return sorted((r.first_bkt, r.last_bkt, r.n) for r in buckets.blocks(frame, "is_jog", "fit").collect())

    assert run("JJbJ.J") == [(0, 3, 4), (5, 5, 1)]
    assert run("JbbJbbbJ") == [(0, 3, 4), (7, 7, 1)]
    assert run("JJ_JJ") == [(0, 1, 2), (3, 4, 2)]
    assert run("bJb") == [(1, 1, 1)]


def test_gap_sessions_follow_the_running_end(spark):
    rows = [(1, 0, 10000), (2, 100, 200), (3, 15400, 15500), (4, 20901, 21000)]
    frame = spark.createDataFrame([(*r, 1.0, "m") for r in rows], "id long, start_s long, end_s long, value double, metric string")
    got = {r.id: r.session for r in matching.gap_sessions(frame, ["metric"]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 2}  # exactly 5400 seconds do not split


def test_eras_split_after_fourteen_days(spark):
    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 15), dt.date(2024, 1, 30)]
    frame = spark.createDataFrame([("m", d, 1.0) for d in days], "metric string, date date, value double")
    assert [r.era for r in history.eras(frame).orderBy("date").collect()] == [1, 1, 2]


def test_arbitration_inside_sessions(spark):
    rows = [(1, "m", "phone", 10), (2, "m", "watch", 15), (3, "m", "mirror", 18), (4, "m", "phone", 40), (5, "k", "phone", 12)]
    frame = spark.createDataFrame(rows, "id long, metric string, source string, start_s long")
    spans = spark.createDataFrame([(9, 10, 40)], "id long, start_s long, end_s long")
    assert sorted(r.id for r in arbitration.session_losers(frame, spans).collect()) == [1, 2]


def test_session_losers_equal_all_pairs_without_meeting_them(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice(["a", "b", None]), rng.choice(["phone", "watch", "mirror", "other", None]), rng.choice([None, *(rng.randrange(-7200, 40000, 50) for _ in range(20))])) for k in range(300)]
    starts = [rng.randrange(-7200, 40000, 50) for _ in range(60)]
    held = [(k, s, s + rng.choice([-50, 0, 50, 100, 600, 2000, 9000])) for k, s in enumerate(starts)] + [(99, None, 5), (98, 5, None)]
    frame = spark.createDataFrame(rows, "id long, metric string, source string, start_s long")
    got = arbitration.session_losers(frame, spark.createDataFrame(held, "id long, start_s long, end_s long"))
    beats = {"phone": ("watch", "mirror"), "watch": ("mirror",)}
    inside = lambda t, s, e: None not in (t, s, e) and s <= t < e
    want = {i for i, m, src, t in rows for _, s, e in held if m and inside(t, s, e) and any(m == m2 and src2 in beats.get(src, ()) and inside(t2, s, e) for _, m2, src2, t2 in rows)}
    assert sorted(r.id for r in got.collect()) == sorted(want) and 20 < len(want) < 200
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_meal_macros_are_null_if_one_item_lacks_them(spark):
    foods = spark.createDataFrame([(1, 100.0, 5.0), (2, 50.0, None)], "item long, kcal double, protein double")
    items = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 1.0), ("b", 1, 1.0), ("c", 2, 0.0)], "meal string, item long, servings double")
    got = {r.meal: (r.kcal, r.protein) for r in ledger.meal_totals(items, foods).collect()}
    assert got == {"a": (250.0, None), "b": (100.0, 5.0), "c": (0.0, None)}


def test_hysteresis_and_elevation(spark):
    scores = [(k, dt.date(2024, 1, 1) + dt.timedelta(n), float(s)) for k, seq in {"a": [60, 68, 69], "b": [60, 70], "c": [80, 65, 63]}.items() for n, s in enumerate(seq)]
    frame = spark.createDataFrame(scores, "k string, date date, score double")
    assert {r.k: r.band for r in folds.hysteresis_band(frame, "k").collect()} == {"a": "mid", "b": "high", "c": "mid"}
    heights = [0.0] * 5 + [10.0] * 5 + [8.0] * 5 + [2.0] * 5
    points = spark.createDataFrame([("r", t * 100.0, h, None) for t, h in enumerate(heights)] + [("r", 5.0, 500.0, 99.0)], "k string, t double, altitude_m double, accuracy_m double")
    row = folds.elevation_gain(points, ["k"]).first()
    assert (row.n, row.gain_m, row.loss_m) == (20, 10.0, 8.0)
    # the first height is the reference until a move reaches the threshold
    low = spark.createDataFrame([("r", t * 100.0, h, None) for t, h in enumerate([10.0, 8.0, 11.0] + [11.0] * 9)], "k string, t double, altitude_m double, accuracy_m double")
    assert folds.elevation_gain(low, ["k"]).first().gain_m == 0.0


def test_bands_fold_over_the_days_before_only(spark):
    day = dt.date(2024, 1, 1)
    frame = spark.createDataFrame([("a", day, 90.0), ("a", day + dt.timedelta(20), 66.0)], "k string, date date, score double")
    assert folds.hysteresis_band(frame, "k").first().band == "mid"


def test_segment_chains_take_the_closest_end(spark):
    rows = [("w", 1, 0, 100), ("w", 2, 0, 50), ("w", 3, 51, 90), ("w", 4, 102, 120)]
    frame = spark.createDataFrame(rows, "k string, id long, start_s long, end_s long")
    assert {r.id: r.chain for r in folds.segment_chains(frame, ["k"]).collect()} == {1: 0, 2: 1, 3: 1, 4: 0}
    # ends 99 and 102 lie within the tolerance of 100: the nearer one is joined
    near = spark.createDataFrame([("w", 1, 0, 99), ("w", 2, 0, 102), ("w", 3, 100, 150)], "k string, id long, start_s long, end_s long")
    got = {r.id: r.chain for r in folds.segment_chains(near, ["k"]).collect()}
    assert got[3] == got[1] != got[2]


def test_periods():
    end = dt.date(2024, 3, 1)
    assert windows.parse_period("30d", end)[0] == dt.date(2024, 2, 1)
    assert windows.parse_period("1m", end)[0] == dt.date(2024, 2, 1)
    assert windows.parse_period("Lifetime", end, dt.date(2020, 1, 1)) == (dt.date(2020, 1, 1), end)
    assert windows.parse_range("2024-01-01:2024-01-02", end) == (dt.date(2024, 1, 1), dt.date(2024, 1, 2))
    for bad in ("", "0d", "3q", "2024-02-01:2024-01-01"):
        with pytest.raises(ValueError):
            windows.parse_range(bad, end)


def test_late_rows_are_refused_not_lost(spark):
    frame = spark.createDataFrame([(1, dt.date(2024, 1, 1)), (2, dt.date(2024, 1, 9))], "id long, local_date date")
    good, late = stream.refuse_late(frame, "2024-01-05")
    assert [r.id for r in good.collect()] == [2] and [(r.id, r.reason) for r in late.collect()] == [(1, "behind_watermark")]


def test_reference_needs_sessions_and_leaves_the_judged_one_out(spark):
    from pulsegrid.operators import form

    rows = [("a", float(k)) for k in range(1, 7)] + [("a", None), ("a", 900.0), ("b", 1.0)]
    got = {r.who: r for r in form.reference(spark.createDataFrame(rows, "who string, change_pct double"), ["who"], F.col("change_pct") == 900).collect()}
    assert (got["a"].status, got["a"].n_sessions, got["a"].median, got["a"].p10, got["a"].p90) == ("ok", 6, 3.5, 1.5, 5.5)
    assert abs(got["a"].least_change - 2 * 1.870829 / 6**0.5) < 1e-3
    assert (got["b"].status, got["b"].n_sessions, got["b"].median) == ("insufficient_sessions", 1, None)
