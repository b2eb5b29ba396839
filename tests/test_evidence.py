"""Literal cases of citations, licences, gates, alerts, coupled metrics, spans and registers."""

import datetime as dt

from pyspark.sql import functions as F

from pulsegrid.functions import labels
from pulsegrid.operators import evidence, retrieval

DAY = dt.date(2024, 1, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_citations(spark):
    bodies = spark.createDataFrame([(1, "a  long\nway  home"), (2, None)], "id long, body string")
    claims = spark.createDataFrame([(1, "long\nway"), (1, "long way home"), (1, "Long way"), (2, "a"), (3, "a")], "id long, span string")
    assert [r.verdict for r in evidence.cited(claims, bodies, ["id"]).orderBy("id", F.desc("span")).collect()] == ["verbatim", "verbatim", "changed", "no_basis", "no_basis"]


def test_licences(spark):
    rows = [("cc_by 4.0", None, None, "ok"), ("CC BY-SA", "CC0", None, "licence_closed"), ("", "cc0 1.0", "false", "ok"), (None, None, None, "licence_absent"), ("CC BY", None, "TRUE ", "retracted"), ("4.0", None, None, "licence_absent")]
    entries = spark.createDataFrame(rows, "licence string, other_licence string, retracted string, want string")
    assert all(r.code == r.want for r in evidence.licensed(entries).collect())


def test_gate_and_expression(spark):
    asked = spark.createDataFrame([(1, "How was my sleeping?"), (2, "stocks"), (3, ""), (4, None), (1, "again")], "id long, text string")
    known = spark.createDataFrame([("sleep",), ("sleep",)], "stem string")
    assert {r.id: r.in_domain for r in evidence.in_domain(asked, ["id"], known).collect()} == {1: True, 2: False, 3: False, 4: False}
    assert not evidence.in_domain(asked, ["id"], known.limit(0)).where("in_domain").count()
    assert one(spark, evidence.match_expression(F.lit('VO2 "max" 1.6'))) == '"vo2" OR "max" OR "1" OR "6"'
    assert one(spark, evidence.match_expression(F.lit("?!"))) == ""


def test_span_around_the_first_hit(spark):
    body = " ".join(f"w{i}" for i in range(200))
    assert one(spark, evidence.span_around(F.lit(body.replace("w100", "(W100),")), ["w100"])).split()[0] == "w84"
    assert one(spark, evidence.span_around(F.lit(body), ["w199"])).split()[0] == "w136"
    assert one(spark, evidence.span_around(F.lit(body), ["none"])).split()[-1] == "w63"
    # an exact slice of the body, and the first word whose stem is asked for
    assert one(spark, evidence.span_around(F.lit(" two  words\n\tand more "), ["none"])) == "two  words\n\tand more"
    assert one(spark, evidence.span_around(F.lit(body.replace("w100", "Runnings!")), ["run"])).split()[16] == "Runnings!"
    assert one(spark, evidence.span_around(F.lit(""), ["none"])) == ""


def test_alerts_need_days_running(spark):
    rows = [("hr", DAY, 6.0), ("hr", DAY + dt.timedelta(1), 5.0), ("hr", DAY + dt.timedelta(3), 9.0), ("hrv", DAY, -20.0), ("hrv", DAY + dt.timedelta(1), -9.0), ("other", DAY, 50.0)]
    scores = spark.createDataFrame(rows + rows, "metric string, date date, pct double")
    assert [(r.metric, r.date) for r in evidence.alerts(scores, {"hr": (5.0, 1), "hrv": (-10.0, -1)}).collect()] == [("hr", DAY + dt.timedelta(1))]
    assert one(spark, evidence.crosses(F.lit("2024-01-01"), F.lit("2024-01-08"), "2024-01-08")) is True
    assert one(spark, evidence.crosses(F.lit("2024-01-08"), F.lit("2024-01-15"), "2024-01-08")) is False


def test_coupled_pairs(spark):
    rows = [("mass", "body", None), ("fat", "body", "mass"), ("lean", "other", "mass"), ("steps", None, None), ("floors", None, None)]
    found = evidence.coupled(spark.createDataFrame(rows, "metric string, family string, derived_from string"))
    assert {(r.metric_x, r.metric_y): r.reason for r in found.collect()} == {("fat", "mass"): "derived", ("lean", "mass"): "derived", ("fat", "lean"): "same_source"}


def test_conflicting_spans(spark):
    d = lambda n: DAY + dt.timedelta(n)
    rows = [(1, 1, d(0), None), (2, 1, d(3), d(5)), (3, 1, d(5), d(6)), (4, 1, d(7), None), (5, 2, d(0), None), (6, 2, d(0), d(1)), (7, 3, d(0), None)]
    found = evidence.conflicting(spark.createDataFrame(rows, "id long, scope long, start date, stop date"), "scope")
    assert {r.id: r.conflict for r in found.collect()} == {1: False, 2: True, 3: True, 4: False, 5: True, 6: True, 7: False}


def test_register_and_catalogue(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (5, "e"), (5, "e")], "doc_id long, text string")
    entries = texts.select("doc_id", F.sha2("text", 256).alias("sha")).distinct().unionByName(spark.createDataFrame([(2, "x"), (4, "x")], "doc_id long, sha string"))
    assert sorted((r.doc_id, r.reason) for r in evidence.registered(entries, texts).collect() if r.reason) == [(2, "duplicate_id"), (2, "duplicate_id"), (3, "missing_text"), (4, "missing_text")]
    reason = lambda key, source, kcal, grams: one(spark, evidence.entry_reason(F.lit(key), F.lit(source), F.lit(kcal).cast("double"), F.lit(grams).cast("double"), ["web"]))
    assert reason("oat-milk", "web", 0, None) is None
    assert [reason("Oat", "web", 1, 1), reason("oat milk", "web", 1, 1), reason(None, "web", 1, 1)] == ["bad_key"] * 3
    assert [reason("o", None, 1, 1), reason("o", "web", None, 1), reason("o", "web", -1, 1), reason("o", "web", 1, 0)] == ["bad_source", "energy_missing", "energy_negative", "bad_serving"]


def test_names_and_figures(spark):
    key = one(spark, labels.fact_key(F.lit("a|b +%"), F.lit("2024-01-01"), F.lit("avg")))
    assert key == "fact|metric=a%7Cb%20%2B%25|period=2024-01-01|field=avg"
    assert one(spark, labels.fact_part(F.lit(key), "metric")) == "a|b +%"
    assert one(spark, labels.fact_key(F.lit(" "), F.lit("x"), F.lit("y"))) is None and one(spark, labels.fact_part(F.lit("fact|x"), "metric")) is None
    assert [one(spark, labels.machine_kind(F.lit(x))) for x in ("FitnessMachineModel.Indoor_Bike", "Ski Erg", "a/b", "", "x" * 65)] == ["indoor_bike", "ski erg", None, None, None]
    match = lambda token, value: one(spark, labels.rounds_to(F.lit(token), F.lit(value)))
    assert [match("3", 3.18), match("3.0", 3.18), match("3.2.", 3.18), match("1,200", 1200.4), match("0", 0.3), match("0", 0.0), match("x", 1.0)] == [True, False, True, True, False, True, False]
    assert [one(spark, labels.swim_metres(F.lit(x))) for x in (0.932056788, None)] == [1500, None]


def test_words_stay_in_their_rows(spark):
    rows = [(1, "ponies pony cats"), (1, "pony cat"), (2, "cats"), (None, "cat"), (None, "cats")]
    chunked = spark.createDataFrame(rows, "doc_id long, body string")
    counted = retrieval.stem_frequency(chunked)
    assert {r.stem: r.df for r in counted.collect()} == {"poni": 1, "cat": 3}
    assert "Join" not in counted._jdf.queryExecution().optimizedPlan().toString()
    scored = retrieval.bm25(chunked.where("doc_id is not null").withColumn("k", F.monotonically_increasing_id()), ["k"], ["poni", "cat"])
    assert scored.count() == 3
    scored.collect()
    # the words are looked for once, for the scores and for the frequencies
    assert "ReusedExchange" in scored._jdf.queryExecution().executedPlan().toString()
    spans = chunked.select(evidence.span_around(F.col("body"), ["poni"], 1, 0).alias("s"))
    assert sorted(r.s for r in spans.collect()) == ["cat", "cats", "cats", "ponies", "pony"]
    assert "ArrowEvalPython" in spans._jdf.queryExecution().executedPlan().toString()
