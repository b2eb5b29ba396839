"""Append-only logs: current rows, pages, pairs, identities, meals and rejections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.operators.rollup import r


def latest_per_key(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Newest row of each key, by partial aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("b")).select(*keys, "b.*")


def current(rows: DataFrame, key: str, supersedes: str) -> DataFrame:
    """Rows that no other row supersedes."""
    gone = rows.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias(key)).distinct()
    return rows.join(gone, key, "left_anti")


def turn_pairs(turns: DataFrame) -> DataFrame:
    """Each answer with the question of the turn before it, if that was one."""
    ask = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.length("text").alias("question_chars"))
    answer = turns.where("role = 'assistant'").select("conv_id", "turn", F.length("text").alias("answer_chars"))
    return answer.join(ask, ["conv_id", "turn"], "left")


def page_before(rows: DataFrame, cursor: Column, order: list[Column], size: int) -> DataFrame:
    """The next ``size`` rows after a cursor; ``truncated`` tells whether more follow."""
    held = rows.where(cursor).orderBy(*order).limit(size + 1)
    more = held.agg(F.count("*").alias("held"))
    return held.orderBy(*order).limit(size).crossJoin(F.broadcast(more)).withColumn("truncated", F.col("held") > size).drop("held")


def meal_totals(items: DataFrame, foods: DataFrame) -> DataFrame:
    """Totals by meal: energy always adds up, a macro is null if any eaten item lacks it.

    ``items``: meal, item, servings; ``foods``: item, kcal, protein."""
    joined = items.join(foods, "item", "left")
    lacks = F.max(((F.col("servings") > 0) & F.col("protein").isNull()).cast("int")) == 1
    return joined.groupBy("meal").agg(
        F.count("*").alias("n_items"),
        r(F.sum(F.col("servings") * F.col("kcal")), 3).alias("kcal"),
        F.when(~lacks, r(F.sum(F.col("servings") * F.col("protein")), 3)).alias("protein"),
        F.sum(F.col("kcal").isNull().cast("long")).alias("n_unknown"),
    )


def identity(records: DataFrame, cumulative: list[str]) -> DataFrame:
    """Identity hash: metric, times and source, with the value unless the metric adds up."""
    parts = [F.col("metric"), F.col("start_s").cast("string"), F.col("end_s").cast("string"), F.col("source")]
    text = F.concat_ws("|", *parts, F.when(~F.col("metric").isin(cumulative), F.round("value", 2).cast("decimal(18,2)").cast("string")))
    return records.withColumn("identity", F.sha1(text))


def upserted(rows: DataFrame, arrival: str) -> DataFrame:
    """One row for each identity, with the newest arrival's values."""
    return latest_per_key(rows, ["identity"], F.col(arrival))


def judged(records: DataFrame, watermark: str, ceiling: float) -> DataFrame:
    """Records with the reason for which they are rejected, or null."""
    reason = F.when(F.col("value").isNull(), "missing_value").when(F.col("value") > ceiling, "implausible").when(F.col("local_date") <= F.lit(watermark).cast("date"), "behind_watermark").when(F.col("end_s") < F.col("start_s"), "bad_interval")
    return records.withColumn("reason", reason)


def cadence_windows(values: DataFrame, start: str, as_of: str, days: int = 14) -> DataFrame:
    """Fixed windows from a start, each complete, due or missed."""
    spark = values.sparkSession
    begin, end = F.lit(start).cast("date"), F.lit(as_of).cast("date")
    grid = spark.range(1).select(F.explode(F.sequence(begin, end, F.expr(f"interval {days} days"))).alias("window_start"))
    offset = F.floor(F.datediff("date", begin) / days).cast("int")
    counts = values.where(F.col("date").between(begin, end)).groupBy(F.date_add(begin, offset * days).alias("window_start")).agg(F.count("*").alias("n"))
    stop = F.date_add("window_start", days - 1)
    state = F.when(F.col("n").isNotNull(), "complete").when(stop >= end, "due").otherwise("missed")
    return grid.join(counts, "window_start", "left").select("window_start", stop.alias("window_end"), F.coalesce("n", F.lit(0)).alias("n"), state.alias("status"))


def top_sessions(sessions: DataFrame, size: int) -> DataFrame:
    return sessions.withColumn("minutes", r((F.col("end_s") - F.col("start_s")) / 60, 3)).orderBy(F.col("minutes").desc(), F.col("start_s").desc(), "id").limit(size).select("id", "kind", "local_date", "minutes")


def longest_per_kind(sessions: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("id", "local_date", (F.col("end_s") - F.col("start_s")).alias("seconds")), F.struct(F.col("end_s") - F.col("start_s"), -F.col("id")))
    return sessions.groupBy("kind").agg(F.count("*").alias("n"), best.alias("b")).select("kind", "n", "b.*")


def mix(sessions: DataFrame) -> DataFrame:
    """Sessions and minutes of each kind, and their share of all minutes."""
    minutes = F.sum((F.col("end_s") - F.col("start_s")) / 60)
    out = sessions.groupBy("kind").agg(F.count("*").alias("n"), minutes.alias("m"))
    return out.withColumn("share", r(F.col("m") / F.sum("m").over(Window.partitionBy(F.lit(1))), 4)).select("kind", "n", r("m", 3).alias("minutes"), "share")
