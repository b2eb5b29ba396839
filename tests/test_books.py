import datetime as dt
import random

from pyspark.sql import functions as F

from pulsegrid.operators import journal
from pulsegrid.streaming import settling

DAY = dt.date(2024, 3, 1)


def at(day, hour=0):
    return dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=day, hours=hour)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_pulls_in_any_order_settle_like_the_fold(spark, tmp_path):
    rng = random.Random(4)
    pulls = [("m", DAY + dt.timedelta(days=d), float(rng.randint(1, 3)), rng.choice(["provisional", "provisional", "settled"]), f"b{k}", at(d + k)) for d in range(8) for k in range(rng.randint(1, 5))]
    frame = spark.createDataFrame(pulls, settling.PULL)
    want = rows(settling.folded(frame))
    assert {r[-1] for r in want} == {"first", "settled", "refused", "same", "changed"}
    got = settling.settled_from(frame, f"file://{tmp_path}/a", batches=4)
    assert rows(got) == want
    # by hand: one day, settled by its second pull
    one = spark.createDataFrame([("m", DAY, 5.0, "settled", "b2", at(2)), ("m", DAY, 4.0, "provisional", "b1", at(1)), ("m", DAY, 4.0, "provisional", "b1", at(1)), ("m", DAY, 9.0, "settled", "b3", at(3))], settling.PULL)
    log = [(r.revision, r.from_value, r.to_value, r.lag_days, r.outcome) for r in settling.folded(one).orderBy("revision").collect()]
    assert log == [(1, None, 4.0, 1, "first"), (2, 4.0, 5.0, 2, "settled"), (3, 5.0, 9.0, 3, "refused")]
    assert [tuple(r) for r in settling.totals(settling.folded(one)).collect()] == [("m", DAY, 5.0, "settled", "b2", 2)]


def test_a_day_closes_by_event_time(spark, tmp_path):
    early = [("m", DAY, 4.0, "provisional", "b1", at(1))]
    later = [("m", DAY + dt.timedelta(days=2000), 1.0, "provisional", "b2", at(2000))]
    after = [("m", DAY + dt.timedelta(days=2001), 1.0, "provisional", "b3", at(2001)), ("m", DAY, 8.0, "provisional", "b4", at(1300))]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", settling.STORE)
    try:
        for k, batch in enumerate((early, later, after)):
            spark.createDataFrame(batch, settling.PULL).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = settling.settling(spark.readStream.schema(settling.PULL).parquet(f"{tmp_path}/in"))
            stream.writeStream.format("parquet").option("path", f"{tmp_path}/log").option("checkpointLocation", f"{tmp_path}/p").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    log = settling.newest(spark.read.schema(settling.LOG).parquet(f"{tmp_path}/log"))
    assert [(r.to_value, r.outcome) for r in log.where(F.col("local_date") == DAY).orderBy("to_value").collect()] == [(4.0, "first"), (8.0, "closed")]


def books(spark):
    daily = spark.createDataFrame([("m", DAY, 1.0, "raw", 10.0), ("n", DAY, 2.0, "raw", 20.0)], "metric string, date date, sum double, source_kind string, max double")
    return journal.Books(daily, spark.createDataFrame([("n", DAY, 2.5, None)], journal.TOTALS), spark.createDataFrame([], journal.JOURNAL))


def batch(spark, *items):
    return spark.createDataFrame([(m, DAY + dt.timedelta(days=d), v) for m, d, v in items], "metric string, date date, value double")


def test_a_migration_is_undone_and_later_changes_stay(spark):
    start = books(spark)
    held = journal.migrated(start, batch(spark, ("m", 0, 5.0), ("m", 1, 6.0)), "one")
    held = journal.migrated(held, batch(spark, ("k", 0, 7.0)), "two")
    assert rows(held.journal) == rows(spark.createDataFrame([("one", "m", DAY, 1.0, "raw", 5.0), ("one", "m", DAY + dt.timedelta(days=1), None, None, 6.0), ("two", "k", DAY, None, None, 7.0)], journal.JOURNAL))
    held = journal.Books(held.daily.withColumn("max", F.when(F.col("metric") == "m", 99.0).otherwise(F.col("max"))), held.totals, held.journal)
    undone = journal.reverted(held, "one")
    want = [("k", DAY, 7.0, "consolidated", None), ("m", DAY, 1.0, "raw", 99.0), ("n", DAY, 2.0, "raw", 20.0)]
    assert rows(undone.daily) == sorted(want, key=repr)
    again = journal.reverted(undone, "one")
    assert [rows(getattr(again, x)) for x in ("daily", "totals", "journal")] == [rows(getattr(undone, x)) for x in ("daily", "totals", "journal")]
    assert {r.migration_id for r in undone.totals.collect()} == {None, "two"}
    unknown = journal.reverted(held, "never")
    assert rows(unknown.daily) == rows(held.daily)


def test_one_conflict_refuses_the_whole_batch(spark):
    start = books(spark)
    for bad in ([("m", 0, 5.0), ("n", 0, 6.0)], [("m", 3, 1.0), ("m", 3, 2.0)]):
        held = journal.migrated(start, batch(spark, *bad), "one")
        assert [rows(getattr(held, x)) for x in ("daily", "totals", "journal")] == [rows(getattr(start, x)) for x in ("daily", "totals", "journal")]
    assert {r.reason for r in journal.conflicts(start.totals, batch(spark, ("n", 0, 1.0), ("m", 3, 1.0), ("m", 3, 2.0))).collect()} == {"held", "repeated"}
