"""Totals of a day that are pulled again and again until they settle, as a stateful stream.

A pull of a day's total is provisional or settled.  Pulls come in batches, late, out of
order and more than once.  The state of a (metric, day) is its pulls, each once; when a new
one comes they are folded in the order of the time at which they were asked for, so the
outcome doesn't depend on the order in which they came:

* each pull is a revision, from the value and state before it to its own;
* a settled total is fixed: pulls asked for after it are refused;
* a day closes ``WINDOW_DAYS`` after its date by event time: a timer drops its pulls and
  keeps only that it is closed, so state doesn't grow with the history of the stream.

A day's log is emitted with a version, the number of its pulls; the newest version holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WINDOW_DAYS = 400
#: Pulls further behind the newest one are dropped by the watermark; days close long before.
DELAY = "800 days"
PULL = "metric string, local_date date, value double, state string, batch_id string, queried_at timestamp"
LOG = "metric string, local_date date, version int, revision int, from_value double, to_value double, from_state string, to_state string, lag_days int, batch_id string, outcome string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LOG_NAMES = [x.split()[0] for x in LOG.split(", ")]


def _outcome(held: tuple | None, value: float, state: str) -> str:
    if held is None:
        return "first"
    if held[1] == "settled":
        return "refused"
    if state == "settled":
        return "settled"
    return "same" if held[0] == value else "changed"


class Settling(StatefulProcessor):
    """Pulls of one (metric, day)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pulls = handle.getListState("pulls", "queried_us long, batch_id string, value double, state string")
        self.closed = handle.getValueState("closed", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        metric, day = key
        new = pd.concat(list(rows))
        arrived = [(int(pd.Timestamp(q).value // 1000), b, float(v), s) for q, b, v, s in zip(new["queried_at"], new["batch_id"], new["value"], new["state"], strict=True)]
        if self.closed.exists():
            yield self._log([(metric, day, 0, 0, None, v, None, s, self._lag(q, day), b, "closed") for q, b, v, s in arrived])
            return
        held = {(q, b): (q, b, v, s) for q, b, v, s in self.pulls.get()} if self.pulls.exists() else {}
        before = len(held)
        for pull in sorted(arrived):
            held.setdefault(pull[:2], pull)
        if len(held) == before:
            return  # repeated batches
        if not before:
            closing = pd.Timestamp(day) + pd.Timedelta(days=WINDOW_DAYS)
            self.handle.registerTimer(int(closing.value // 1_000_000))
        pulls = sorted(held.values())
        self.pulls.put(pulls)
        log, now = [], None
        for k, (q, b, v, s) in enumerate(pulls, 1):
            outcome = _outcome(now, v, s)
            log.append((metric, day, len(pulls), k, now and now[0], v, now and now[1], s, self._lag(q, day), b, outcome))
            now = now if outcome == "refused" else (v, s)
        yield self._log(log)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.pulls.clear()
        self.closed.update((int(expiredTimerInfo.getExpiryTimeInMs()),))
        return iter([])

    def close(self) -> None:
        pass

    @staticmethod
    def _lag(queried_us: int, day) -> int:
        return (pd.Timestamp(queried_us, unit="us").normalize() - pd.Timestamp(day)).days

    @staticmethod
    def _log(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=_LOG_NAMES)
        return out.astype({"version": "int32", "revision": "int32", "lag_days": "int32", "from_value": "float64", "to_value": "float64"})


def settling(pulls: DataFrame, delay: str = DELAY) -> DataFrame:
    """The log of a stream of pulls.  The session's state store has to be RocksDB."""
    return pulls.withWatermark("queried_at", delay).groupBy("metric", "local_date").transformWithStateInPandas(statefulProcessor=Settling(), outputStructType=LOG, outputMode="Append", timeMode="EventTime")


def newest(log: DataFrame) -> DataFrame:
    """The log in the newest version of every day, and every pull that came too late."""
    open_ = log.where("outcome <> 'closed'")
    best = open_.groupBy("metric", "local_date").agg(F.max("version").alias("version"))
    return open_.join(best, ["metric", "local_date", "version"]).dropDuplicates(["metric", "local_date", "revision"]).unionByName(log.where("outcome = 'closed'"))


def totals(log: DataFrame) -> DataFrame:
    """The total of every day, from the newest version of the log."""
    taken = log.where(~F.col("outcome").isin("refused", "closed"))
    last = taken.groupBy("metric", "local_date").agg(F.max_by(F.struct("to_value", "to_state", "batch_id"), "revision").alias("v"), F.count("*").alias("n_revisions"))
    return last.select("metric", "local_date", F.col("v.to_value").alias("value"), F.col("v.to_state").alias("state"), F.col("v.batch_id").alias("batch_id"), "n_revisions")


def folded(pulls: DataFrame) -> DataFrame:
    """The same log of a table of pulls, by windows over the pulls of a day."""
    once = pulls.groupBy("metric", "local_date", "queried_at", "batch_id").agg(F.min(F.struct("value", "state")).alias("v")).select("*", "v.value", "v.state").drop("v")
    order = Window.partitionBy("metric", "local_date").orderBy("queried_at", "batch_id")
    whole = Window.partitionBy("metric", "local_date")
    k = once.withColumn("revision", F.row_number().over(order)).withColumn("fixed", F.min(F.when(F.col("state") == "settled", F.col("revision"))).over(whole))
    refused = F.coalesce(F.col("revision") > F.col("fixed"), F.lit(False))
    at = F.least(F.col("revision") - 1, F.coalesce("fixed", F.col("revision") - 1))
    said = F.collect_list(F.struct("value", "state")).over(order)
    before = F.when(F.col("revision") > 1, F.element_at("said", at))
    out = k.withColumns({"said": said, "version": F.count("*").over(whole).cast("int")}).withColumn("before", before)
    outcome = F.when(F.col("revision") == 1, "first").when(refused, "refused").when(F.col("state") == "settled", "settled").when(F.col("before.value") == F.col("value"), "same").otherwise("changed")
    return out.select("metric", "local_date", "version", "revision", F.col("before.value").alias("from_value"), F.col("value").alias("to_value"), F.col("before.state").alias("from_state"), F.col("state").alias("to_state"), F.datediff("queried_at", "local_date").alias("lag_days"), "batch_id", outcome.alias("outcome"))


def settled_from(pulls: DataFrame, path: str, batches: int = 3) -> DataFrame:
    """Streams a table of pulls through the state in ``batches`` files and reads its log.

    Pulls are dealt to the files by a hash of their batch, some to two of them, so they
    come out of order and more than once."""
    spark = pulls.sparkSession
    part = F.pmod(F.xxhash64("batch_id"), F.lit(batches)).cast("int")
    dealt = pulls.withColumn("part", F.explode(F.array_distinct(F.array(part, F.pmod(part + F.pmod(F.xxhash64("metric", "local_date"), F.lit(2)).cast("int"), F.lit(batches))))))
    for k in range(batches):
        dealt.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{path}/pulls")
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        stream = spark.readStream.schema(PULL).option("maxFilesPerTrigger", 1).parquet(f"{path}/pulls")
        settling(stream).writeStream.format("parquet").option("path", f"{path}/log").option("checkpointLocation", f"{path}/progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        if held:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return newest(spark.read.schema(LOG).parquet(f"{path}/log"))
