import datetime as dt
import json

from pyspark.sql import functions as F

from pulsegrid.sources import exports, sinks

XML = """<?xml version="1.0"?><HealthData>
<Record type="steps" value="12" unit="count" startDate="2024-01-02 23:30:00 -0500" endDate="2024-01-02 23:31:00 -0500" sourceName="w"/>
<Record type="hr" value="x" unit="bpm" startDate="2024-01-02 10:00:00 +0000" endDate="2024-01-02 10:00:00 +0000" sourceName="w"/>
<Record type="hr" value="70" unit="bpm" startDate="2024-01-02 10:00:00 +0000" endDate="2024-01-02 09:00:00 +0000" sourceName="w"/>
<Workout workoutActivityType="run" duration="90" durationUnit="s" startDate="2024-01-02 10:00:00 +0000" endDate="2024-01-02 10:01:30 +0000" sourceName="w">
<WorkoutEvent type="HKWorkoutEventTypeMotionPaused" date="2024-01-02 10:00:30 +0000" duration="1" durationUnit="min"/>
<WorkoutStatistics type="ActiveEnergyBurned" sum="12.5" unit="kcal"/><WorkoutStatistics type="DistanceRun" sum="0.4" unit="mi"/></Workout></HealthData>"""


def test_xml(spark, tmp_path):
    (tmp_path / "e.xml").write_text(XML)
    rows = exports.xml_records(spark, str(tmp_path / "e.xml")).collect()
    assert [(r.metric, r.value, r.reason) for r in rows] == [("steps", 12.0, None), ("hr", None, "not_numeric"), ("hr", 70.0, "bad_interval")]
    assert rows[0].local_date == dt.date(2024, 1, 2) and rows[0].start_s == int(dt.datetime(2024, 1, 3, 4, 30, tzinfo=dt.timezone.utc).timestamp())
    workouts = exports.xml_workouts(spark, str(tmp_path / "e.xml"))
    w = workouts.first()
    assert (w.kind, w.minutes, w.energy, w.distance) == ("run", 1.5, 12.5, 0.4)
    e = exports.workout_events(workouts).first()
    assert (e.event, e.minutes, e.at_s - w.start_s) == ("motion_paused", 1.0, 30)


def test_delta_batches(spark, tmp_path):
    def sample(uuid, **more):
        return {"uuid": uuid, "metric": "hr", "value": 60.0, "unit": "bpm", "start": "2024-03-02 10:00:00 +0000", "end": "2024-03-02 10:00:05 +0000", "source": "w"} | more

    one = {"protocol_version": 1, "batch_id": "b1", "device": {"id": "d"}, "samples": [sample("a"), sample("dead"), sample("c", value=None), sample("d", start="2023-01-01 10:00:00 +0000")], "deletions": []}
    lines = [json.dumps(one), json.dumps(one), json.dumps(one | {"batch_id": "b2", "protocol_version": 9}), "{broken"]
    (tmp_path / "b.json").write_text("\n".join(lines))
    batches = exports.delta_batches(spark, str(tmp_path / "b.json"))
    assert sorted(str(r.reason) for r in batches.cache().collect()) == ["None", "None", "malformed", "unknown_protocol"]
    dead = spark.createDataFrame([("dead",)], "uuid string")
    got = {r.uuid: r.reason for r in exports.delta_samples(batches, dead, "2024-01-01").collect()}
    assert got == {"a": None, "dead": "dedupe", "c": "not_numeric", "d": "behind_watermark"}


def test_gpx_and_csv(spark, tmp_path):
    points = "".join(f'<trkpt lat="51.{k}6" lon="-0.12"><ele>{k}</ele><time>2024-01-01T10:{k * 10:02d}:00Z</time></trkpt>' for k in range(6))
    (tmp_path / "t.gpx").write_text(f"<gpx><trk><trkseg>{points}</trkseg></trk></gpx>")
    found = exports.gpx_points(spark, str(tmp_path / "t.gpx"))
    assert found.count() == 6 and found.orderBy("t").first().lat == 51.1
    assert [r.slot for r in exports.every_half_hour(found).orderBy("slot").collect()] == [0, 1]
    (tmp_path / "r.csv").write_text("metric,value,start_s,end_s,source\nhr,1.5,1,2,w\n")
    assert exports.csv_records(spark, str(tmp_path / "r.csv")).first().value == 1.5


def test_day_table(spark, tmp_path):
    schema = "k long, metric string, value double, at long, local_date date"
    day = [dt.date(2024, 1, n) for n in (1, 2, 3)]
    table = sinks.DayTable(spark, str(tmp_path / "t"), schema)
    table.create(spark.createDataFrame([(1, "m", 1.0, 1, day[0]), (2, "m", 2.0, 1, day[1]), (3, "n", 3.0, 1, day[0])], schema))
    new = spark.createDataFrame([(1, "m", 9.0, 2, day[0]), (4, "m", 4.0, 2, day[2])], schema)
    for _ in range(2):
        table.upsert(new, ["k", "local_date"], F.col("at"), str(tmp_path / "s"))
        assert sorted((r.k, r.value) for r in table.read().collect()) == [(1, 9.0), (2, 2.0), (3, 3.0), (4, 4.0)]
    table.delete(spark.createDataFrame([(4, day[2])], "k long, local_date date"), ["k"], str(tmp_path / "s"))
    table.compact("2024-01-01", ["n"], str(tmp_path / "s"))
    assert sorted(r.k for r in table.read().collect()) == [2, 3]


def test_fill_append_and_frozen_counts(spark):
    old = spark.createDataFrame([(1, 5.0, None), (2, None, None)], "k long, a double, b double")
    new = spark.createDataFrame([(1, 7.0, 8.0), (3, 1.0, 1.0)], "k long, a double, b double")
    assert sorted(tuple(r) for r in sinks.filled(old, new, ["k"]).collect()) == sorted([(1, 5.0, 8.0), (2, None, None), (3, 1.0, 1.0)])
    assert [r.k for r in sinks.appended(old, new, ["k"]).collect()] == [3]
    month = lambda n: dt.date(2024, n, 1)
    stored = spark.createDataFrame([("m", month(1), "w", 10), ("m", month(2), "w", 10)], "metric string, month date, source string, n long")
    counted = spark.createDataFrame([("m", month(1), "w", 4), ("m", month(2), "w", 4)], stored.schema)
    assert sorted(r.n for r in sinks.frozen_months(stored, counted, "2024-01-31").collect()) == [4, 10]


def test_children_attach_in_any_order_of_batches(spark):
    import itertools

    from pulsegrid.operators import attachments

    parents = [(1, "a", "w", 0, 1000, 5.0, None, None), (2, None, "w", 5000, 6000, None, None, None), (3, "c", "w", 9000, 9900, None, None, "route")]
    kids = [(11, "a", "w", 70_000, 71_000, 7.0, 2.0), (12, None, "w", 5010, 6000, 3.0, None), (13, None, "p", 5000, 5990, 4.0, 1.0), (14, "zz", "w", 30_000, 31_000, 8.0, 8.0), (15, None, "w", 9000, 9100, 9.0, 9.0)]
    p = "id long, uuid string, source string, start_s long, end_s long, ascended double, descended double, origin string"
    c = "id long, uuid string, source string, start_s long, end_s long, ascended double, descended double"
    want = None
    for some, order in itertools.product((parents, parents[::-1]), (kids, kids[::-1], kids + kids[:3])):
        a, b = spark.createDataFrame(some, p), spark.createDataFrame(order, c)
        got = (sorted(map(tuple, attachments.attached(a, b, ["ascended", "descended"]).collect()), key=repr), sorted(r.id for r in attachments.orphans(a, b).collect()))
        want = want or got
        assert got == want
    assert want[0] == sorted([(1, "a", "w", 0, 1000, 5.0, 2.0, "device"), (2, None, "w", 5000, 6000, 3.0, 1.0, "device"), (3, "c", "w", 9000, 9900, None, None, "route")], key=repr)
    assert want[1] == [14, 15]
    # an orphan is taken up when its session comes
    later = spark.createDataFrame([*parents, (4, "zz", "w", 1, 2, None, None, None)], p)
    assert [r.id for r in attachments.orphans(later, spark.createDataFrame(kids, c)).collect()] == [15]
    derived = spark.createDataFrame([(1, 50.0, 50.0, 99), (2, 10.0, 11.0, 10), (3, 1.0, 1.0, 9)], "id long, ascended double, descended double, n_used long")
    basis = {r.id: (r.ascended, r.descended, r.basis) for r in attachments.climbs(later.select("id", "ascended", "descended"), derived).collect()}
    assert basis == {1: (5.0, None, "device"), 2: (10.0, 11.0, "route"), 3: (None, None, "too_few_points"), 4: (None, None, "no_route")}


def test_a_batch_is_taken_by_all_tables_or_none(spark, tmp_path):
    ledger = sinks.Ledger(spark, f"file://{tmp_path}/t", {"a": "x long", "b": "y long"})
    rows = lambda name, *v: spark.createDataFrame([(k,) for k in v], f"{name} long")
    held = lambda: ([r.x for r in ledger.read("a").orderBy("x").collect()], [r.y for r in ledger.read("b").orderBy("y").collect()])
    assert held() == ([], [])
    assert ledger.take("k1", {"a": rows("x", 1, 2), "b": rows("y", 3)}, "p1") and held() == ([1, 2], [3])
    assert not ledger.take("k1", {"a": rows("x", 9), "b": rows("y", 9)}, "p2") and held() == ([1, 2], [3])
    ledger.put("a", rows("x", 7), "p3")  # a writer that stops before the second table
    assert held() == ([1, 2], [3])
    assert ledger.take("k3", {"a": rows("x", 7), "b": rows("y", 8)}, "p4") and held() == ([1, 2, 7], [3, 8])
