"""Literal cases of watermarks, marks, enrichment, power by month and stale derivations."""

import datetime as dt
import random

import duckdb
import pytest

from pulsegrid.operators import upkeep
from pulsegrid.plans.upkeep import POWER

DAY = dt.date(2024, 1, 5)


def test_watermark_states(spark):
    rows = spark.createDataFrame([(1, "steps", DAY), (2, "steps", DAY + dt.timedelta(1)), (3, "heart", DAY), (4, "steps", None)], "id long, metric string, local_date date")
    assert [r.id for r in upkeep.behind(rows, ["heart"], "2024-01-05").collect()] == [1]
    assert upkeep.behind(rows, ["heart"], None).count() == 0
    status = lambda through: tuple(upkeep.compaction_status(rows, ["heart"], through).first())
    assert status(None) == (3, 0, "never_compacted")
    assert status("2024-01-05") == (3, 1, "compacted_violated")
    assert status("2024-01-04") == (3, 0, "compacted_clean")


def test_compacted_samples_are_known_again(spark):
    rows = spark.createDataFrame([("a", "steps", DAY), ("a", "steps", DAY), (None, "steps", DAY)], "name string, metric string, local_date date")
    keys = upkeep.compacted_keys(rows.where("name is not null"), "name")
    assert keys.count() == 1
    assert upkeep.offered_again(rows, "name", keys).count() == 2


def test_marks_and_settling(spark):
    found = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5)], "id long")
    marks = spark.createDataFrame([(2,), (2,), (None,)], "id long")
    assert [r.id for r in upkeep.marked(found, marks, "id").collect()] == [2]
    assert sorted(r.id for r in upkeep.marked(found, marks, "id", False).collect()) == [1, 3, 4, 5]
    status = spark.createDataFrame([(1, "ok"), (2, "pending"), (3, "no_route"), (4, "no_route")], "id long, status string")
    routes = spark.createDataFrame([(4,), (4,), (1,)], "id long")
    assert sorted(r.id for r in upkeep.unsettled(found, status, routes).collect()) == [2, 4, 5]


def test_power_waits_and_nested_runs_count_once(spark):
    flags = spark.createDataFrame([(DAY, k, k != 4, 8.0) for k in (0, 1, 2, 3, 4, 5, 6, 8, 9, 10)], "local_date date, bkt long, is_jog boolean, pace double")
    spans = spark.createDataFrame([(1, 0, 400, DAY), (2, 20, 80, DAY), (3, 81, 140, DAY), (4, 100, 140, DAY)], "id long, start_s long, end_s long, local_date date")
    settled = {(r.id, r.bkt) for r in upkeep.settled_in_runs(spans, flags, lag=2).collect()}
    # 1: a jog after a walk has waited a bucket (6), after a gap none (10); 2: its block begins
    # with the run, in the middle of the day's; 3 starts inside the walk, which isn't its own
    assert settled == {(1, 2), (1, 3), (1, 6), (1, 10), (2, 3)}
    assert {(r.id, r.bkt) for r in upkeep.settled_in_runs(spans, flags, lag=1).collect()} >= {(1, 5), (3, 6), (4, 6)}
    watts = spark.createDataFrame([(DAY, 40, 100.0), (DAY, 45, 200.0), (DAY, 125, 400.0), (DAY, 200, 900.0)], "local_date date, start_s long, value double")
    assert {r.id: (r.power, r.n_buckets) for r in upkeep.run_power(spans, flags, watts, 5, 9, lag=2).collect()} == {1: (pytest.approx((150 + 400 + 900) / 3), 3)}
    runs = spark.createDataFrame([(1, 0, 100, DAY), (2, 20, 80, DAY), (3, 0, 100, DAY), (4, 5000, 5100, dt.date(2024, 2, 1))], "id long, start_s long, end_s long, local_date date")
    powers = spark.createDataFrame([(1, 200.0), (2, 900.0), (3, 300.0), (4, 100.0)], "id long, power double")
    got = {r.month.month: (r.n_runs, r.power) for r in upkeep.monthly_power(runs, powers).collect()}
    assert got == {1: (1, None), 2: (1, None)}
    apart = spark.createDataFrame([(1, 0, 100, DAY), (2, 90, 180, DAY)], "id long, start_s long, end_s long, local_date date")
    assert tuple(upkeep.monthly_power(apart, powers).first())[1:] == (2, 550.0)


def test_versions_need_all_sources(spark):
    derived = spark.createDataFrame([("load", DAY, 2), ("load", DAY + dt.timedelta(1), 1), ("load", DAY + dt.timedelta(2), None)], "metric string, date date, version int")
    needs = spark.createDataFrame([("load", "heart"), ("load", "steps")], "metric string, source_metric string")
    raw = spark.createDataFrame([("heart", DAY + dt.timedelta(1)), ("steps", DAY + dt.timedelta(1)), ("heart", DAY + dt.timedelta(2))], "metric string, local_date date")
    assert tuple(upkeep.version_report(derived, 2, needs, raw).first()) == ("load", 1, 1, 1)


def test_reconciled_days_reach_back_for_heart_rate(spark):
    touched = spark.createDataFrame([("heart", DAY), ("steps", dt.date(2024, 1, 9)), ("heart", None)], "metric string, local_date date")
    none = spark.createDataFrame([], "local_date date")
    assert sorted(r.local_date.day for r in upkeep.days_to_reconcile(touched, none, "heart").collect()) == [4, 5, 9]


def test_a_bucket_of_two_days_waits_as_in_sql_with_the_earlier_day_first(spark):
    rng = random.Random(4)
    held, next_day = [], DAY + dt.timedelta(1)
    for k in range(400):
        on = rng.random() < 0.8
        if rng.random() < 0.9:
            held += [(d, k, on, 8.0) for d in ((DAY, next_day) if rng.random() < 0.3 else (DAY,))]
    spans = [(k, s, s + rng.randrange(20, 900), DAY, "run", "watch") for k, s in enumerate(rng.randrange(0, 8000) for _ in range(40))]
    flags = spark.createDataFrame(held, "local_date date, bkt long, is_jog boolean, pace double")
    runs = spark.createDataFrame(spans, "id long, start_s long, end_s long, local_date date, kind string, source string")
    con = duckdb.connect()
    con.execute("create table sessions (id bigint, start_s bigint, end_s bigint, local_date date, kind varchar, source varchar)")
    con.execute("create table classified (local_date date, bkt bigint, is_jog boolean, pace double, is_walk boolean default false)")
    con.executemany("insert into sessions values (?, ?, ?, ?, ?, ?)", spans)
    con.executemany("insert into classified (local_date, bkt, is_jog, pace) values (?, ?, ?, ?)", held)
    rng.shuffle(held)
    # the SQL leaves open which of a bucket's rows comes first
    closed = POWER[: POWER.index(",\npw AS")].lstrip(", ").replace("ORDER BY c.bkt)", "ORDER BY c.bkt, c.local_date)").replace("OVER (b ORDER BY bkt)", "OVER (b ORDER BY bkt, local_date)")
    assert closed.count(", local_date)") == 1 and closed.count(", c.local_date)") == 1
    want = con.execute("WITH " + closed + " SELECT id, local_date, bkt FROM waits WHERE elapsed >= 1").fetchall()
    got = [(r.id, r.local_date, r.bkt) for r in upkeep.settled_in_runs(runs, flags, lag=1).collect()]
    assert sorted(got) == sorted(want) and len(want) > 100
    # 3, 4 and 4 again: the second row of 4 opens a block for both, right beside 3
    small = spark.createDataFrame([(DAY, 3, True, 8.0), (DAY, 4, True, 8.0), (next_day, 4, True, 8.0)], "local_date date, bkt long, is_jog boolean, pace double")
    assert upkeep.settled_in_runs(runs.limit(1).selectExpr("id", "0L as start_s", "400L as end_s", "local_date"), small, lag=1).count() == 2
