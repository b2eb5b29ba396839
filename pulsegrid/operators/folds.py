"""Order-dependent folds, by key: hysteresis, elevation, segment chains, cosinor."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Least accuracy of a point in metres, seconds of smoothing, metres of climb
#: that count, least points of a route, and seconds between chained segments.
ACCURACY, SMOOTH_S, CLIMB, LEAST_POINTS, SEAM = 10.0, 15, 3.0, 10, 2


def hysteresis_band(scores: DataFrame, key: str, high: float = 67, low: float = 34, slack: float = 3, days: int = 7) -> DataFrame:
    """Band of each key's latest score, which changes only past an edge by the slack.

    The band before it is the fold of the same rule over the ``days`` calendar days
    before the latest one; what lies further back does not count."""
    plain = lambda s: F.when(s >= high, "high").when(s >= low, "mid").otherwise("low")

    def step(band: Column, s: Column) -> Column:
        up = F.when(band == "low", F.when(s >= low + slack, plain(s))).when(band == "mid", F.when(s >= high + slack, plain(s)))
        down = F.when(band == "high", F.when(s < high - slack, plain(s))).when(band == "mid", F.when(s < low - slack, plain(s)))
        return F.when(band == "", plain(s)).otherwise(F.coalesce(up, down, band))

    known = scores.where("score is not null")
    latest = known.groupBy(key).agg(F.max("date").alias("latest"))
    near = known.join(latest, key).where(F.col("date") >= F.date_sub("latest", days))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("date", "score"))), lambda x: x["score"])
    return near.groupBy(key).agg(F.aggregate(ordered, F.lit(""), step).alias("band"), F.count("*").alias("n_days"))


def elevation_gain(points: DataFrame, keys: list[str], threshold: float = CLIMB) -> DataFrame:
    """Metres climbed and descended: moves count once they reach the threshold.

    ``points``: keys of a route, t (seconds), altitude_m, accuracy_m.  Points of bad
    accuracy go, altitudes are medians of 15 seconds.  The reference height is the first
    one until a move away from it reaches the threshold.  Routes of under LEAST_POINTS
    points have no gain.  A route is folded as one array, so it should be one outing."""
    good = points.where(F.col("altitude_m").isNotNull() & (F.col("accuracy_m").isNull() | F.col("accuracy_m").between(0, ACCURACY)))
    ms = (F.col("t") * 1000).cast("long")
    frame = Window.partitionBy(*keys).orderBy(ms).rangeBetween(-SMOOTH_S * 500, SMOOTH_S * 500)
    smooth = good.withColumn("altitude", F.percentile("altitude_m", 0.5).over(frame))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("t", "altitude"))), lambda x: x["altitude"])
    start = F.struct(F.col("line")[0].alias("at"), F.lit(0).alias("way"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down"))

    def step(s: Column, v: Column) -> Column:
        move = v - s["at"]
        climbs = F.when(s["way"] == 1, move > 0).otherwise(move >= threshold)
        falls = F.when(s["way"] == -1, move < 0).otherwise(move <= -threshold)
        way = F.when(climbs, 1).when(falls, -1).otherwise(s["way"])
        return F.struct(
            F.when(climbs | falls, v).otherwise(s["at"]).alias("at"), way.alias("way"), (s["up"] + F.when(climbs, move).otherwise(0.0)).alias("up"), (s["down"] - F.when(falls, move).otherwise(0.0)).alias("down")
        )

    routes = smooth.groupBy(*keys).agg(F.count("*").alias("n"), ordered.alias("line"))
    folded = routes.select(*keys, "n", F.when(F.col("n") >= LEAST_POINTS, F.aggregate("line", start, step)).alias("s"))
    return folded.select(*keys, "n", F.coalesce(F.round("s.up", 4), F.lit(0.0)).alias("gain_m"), F.coalesce(F.round("s.down", 4), F.lit(0.0)).alias("loss_m"))


def segment_chains(events: DataFrame, keys: list[str], tolerance: float = SEAM) -> DataFrame:
    """Greedy chains of segments that do not overlap: each joins the chain whose end is
    nearest to its start, or opens one; a chain ends where its last segment to end does.

    ``chain`` numbers the chains of a group from the one that covers most minutes (of
    equals the one of more segments).  A group is a session, whose segments are few."""
    names = [f"`{k}` {events.schema[k].dataType.simpleString()}" for k in keys]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_s", "end_s", "id"])
        ends: list[float] = []
        chain = []
        for start, stop in zip(pdf["start_s"], pdf["end_s"], strict=True):
            fit = [(abs(start - end), k) for k, end in enumerate(ends) if end <= start + tolerance]
            k = min(fit)[1] if fit else len(ends)
            if fit:
                ends[k] = max(ends[k], stop)
            else:
                ends.append(stop)
            chain.append(k)
        minutes = ((pdf["end_s"] - pdf["start_s"]) / 60).groupby(np.array(chain)).agg(["sum", "size"])
        best = sorted(minutes.index, key=lambda k: (-round(minutes["sum"][k], 2), -minutes["size"][k], k))
        return pdf.assign(chain=[best.index(k) for k in chain])[[*keys, "id", "start_s", "end_s", "chain"]]

    return events.select(*keys, "id", "start_s", "end_s").groupBy(*keys).applyInPandas(fold, ", ".join([*names, "id long, start_s long, end_s long, chain long"]))


def cosinor(samples: DataFrame, key: str, period_s: float = 86400.0) -> DataFrame:
    """Least-squares mean, amplitude and peak hour of a daily cosine, from sums alone."""
    angle = F.lit(2 * np.pi / period_s) * F.pmod("start_s", F.lit(int(period_s)))
    c, s, y = F.cos(angle), F.sin(angle), F.col("value")
    sums = samples.groupBy(key).agg(
        F.count(y).alias("n"), F.sum(y).alias("y"), F.sum(c).alias("c"), F.sum(s).alias("s"), F.sum(c * c).alias("cc"), F.sum(s * s).alias("ss"), F.sum(c * s).alias("cs"), F.sum(c * y).alias("cy"), F.sum(s * y).alias("sy")
    )
    n = F.col("n")
    a11, a12, a22 = F.col("cc") - F.col("c") ** 2 / n, F.col("cs") - F.col("c") * F.col("s") / n, F.col("ss") - F.col("s") ** 2 / n
    b1, b2 = F.col("cy") - F.col("c") * F.col("y") / n, F.col("sy") - F.col("s") * F.col("y") / n
    det = a11 * a22 - a12 * a12
    out = sums.where(n >= 8).withColumn("bc", (b1 * a22 - b2 * a12) / det).withColumn("bs", (b2 * a11 - b1 * a12) / det)
    peak = F.pmod(F.atan2("bs", "bc") * (period_s / 3600) / F.lit(2 * np.pi), F.lit(period_s / 3600))
    mean = (F.col("y") - F.col("bc") * F.col("c") - F.col("bs") * F.col("s")) / n
    return out.select(key, "n", F.round(mean, 5).alias("mesor"), F.round(F.sqrt(F.col("bc") ** 2 + F.col("bs") ** 2), 5).alias("amplitude"), F.round(peak, 4).alias("peak_hour"))
