"""What statements rest on: cited spans, licences, gates of retrieval, alerts, coupled
metrics, spans of days that conflict, and entries of a register."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.functions.labels import OPEN_LICENCES, licence_name, one_spaced
from pulsegrid.functions.stems import stems_of
from pulsegrid.operators.retrieval import terms

#: Words of a cited span, and how many of them stand before the hit; the
#: signs that don't belong to a word at its edges.
SPAN_WORDS, SPAN_BEFORE = 64, 16
EDGES = r"""^[.,;:!?()\[\]{}"']+|[.,;:!?()\[\]{}"']+$"""
WEEK = 7


def cited(claims: DataFrame, bodies: DataFrame, keys: list[str]) -> DataFrame:
    """Claims (keys, span) with a verdict: ``verbatim`` where the text of the keys holds
    the span, as it is or with white space collapsed, ``changed`` or ``no_basis``."""
    joined = claims.join(bodies.select(*keys, "body"), keys, "left")
    held = F.col("body").contains(F.col("span")) | one_spaced(F.col("body")).contains(one_spaced(F.col("span")))
    return joined.withColumn("verdict", F.when(F.col("body").isNull(), "no_basis").when(held, "verbatim").otherwise("changed")).drop("body")


def licensed(entries: DataFrame) -> DataFrame:
    """Entries (licence, other_licence, retracted) with ``code`` and ``name``.

    What is retracted never passes; the second licence counts only where the first is
    empty; a licence that is not known to be open is refused."""
    first, second = licence_name(F.col("licence")), licence_name(F.col("other_licence"))
    name = F.when(first != "", first).otherwise(second)
    gone = F.lower(F.trim(F.coalesce(F.col("retracted").cast("string"), F.lit("")))) == "true"
    code = F.when(gone, "retracted").when(name == "", "licence_absent").when(~name.isin(*OPEN_LICENCES), "licence_closed").otherwise("ok")
    return entries.withColumns({"name": name, "code": code})


def in_domain(questions: DataFrame, keys: list[str], lexicon: DataFrame) -> DataFrame:
    """Keys of every question and whether a word of it has a stem of the lexicon.

    Questions without words, and all of them with an empty lexicon, are outside."""
    asked = questions.select(*keys, F.explode(F.array_distinct(stems_of(F.array_distinct(terms(F.col("text")))))).alias("stem"))
    inside = asked.join(lexicon.select("stem"), "stem", "left_semi").select(*keys).distinct().withColumn("inside", F.lit(True))
    return questions.select(*keys).distinct().join(inside, keys, "left").select(*keys, F.coalesce("inside", F.lit(False)).alias("in_domain"))


def match_expression(text: Column) -> Column:
    """All terms of a question, quoted and joined by OR; empty without terms."""
    found = terms(text)
    return F.when(F.size(found) > 0, F.concat(F.lit('"'), F.array_join(found, '" OR "'), F.lit('"'))).otherwise("")


def span_around(body: Column, stems: list[str], size: int = SPAN_WORDS, before: int = SPAN_BEFORE) -> Column:
    """The slice of a body with ``size`` words around the first whose stem is asked for, or
    the first ones: exactly as it stands there, from its first word to its last."""
    parts = F.regexp_extract_all(body, F.lit(r"(\S+\s*)"), F.lit(1))

    # rules change ends, so that all of a stem but its last letter starts the word
    starts = r"""^[.,;:!?()\[\]{}"']*(?:""" + "|".join(re.escape(x[:-1]) for x in stems) + ")"

    def likely(w: Column) -> Column:
        word = F.lower(w)
        return F.when(word.rlike(starts), F.regexp_replace(F.regexp_replace(word, r"\s+$", ""), EDGES, ""))

    at = F.array_position(F.transform(stems_of(F.transform(parts, likely)), lambda t: F.coalesce(t.isin(stems), F.lit(False))), True).cast("int")
    start = F.greatest(F.lit(0), F.least(at - 1 - before, F.size(parts) - size))
    return F.regexp_replace(F.array_join(F.slice(parts, start + 1, F.lit(size)), ""), r"\s+$", "")


def alerts(scores: DataFrame, rules: dict[str, tuple[float, int]], days: int = 2) -> DataFrame:
    """Days on which a metric lies beyond its threshold for the ``days``-th day running.

    ``scores``: metric, date, pct.  A rule is (threshold, sign): 1 alerts from the
    threshold up, -1 from it down.  Days without a score break a run."""
    beyond = F.lit(False)
    for metric, (threshold, sign) in rules.items():
        beyond = beyond | ((F.col("metric") == metric) & ((F.col("pct") - threshold) * sign >= 0))
    run = Window.partitionBy("metric").orderBy(F.unix_date("date")).rangeBetween(1 - days, 0)
    return scores.where(beyond).dropDuplicates(["metric", "date"]).withColumn("running", F.count("*").over(run)).where(F.col("running") >= days).drop("running")


def crosses(a: Column, b: Column, boundary: str) -> Column:
    """Whether an instrument changed between two days, so that they do not compare."""
    day = F.lit(boundary).cast("date")
    return (a < day) != (b < day)


def coupled(catalog: DataFrame) -> DataFrame:
    """Pairs of a catalogue (metric, family, derived_from) whose correlation is no finding.

    One is derived from the other, both from the same, or both are of one family; the
    first reason counts.  A catalogue has a row a metric, not a row a measurement."""
    a = catalog.select(F.col("metric").alias("x"), F.col("family").alias("fx"), F.col("derived_from").alias("dx"))
    b = catalog.select(F.col("metric").alias("y"), F.col("family").alias("fy"), F.col("derived_from").alias("dy"))
    ways = [(F.col("dx") == F.col("y"), 1), (F.col("dx") == F.col("dy"), 2), (F.col("fx") == F.col("fy"), 3)]
    low, high = F.least("x", "y").alias("metric_x"), F.greatest("x", "y").alias("metric_y")
    found = [a.join(b, on).where("x <> y").select(low, high, F.lit(n).alias("way")) for on, n in ways]
    best = found[0].unionByName(found[1]).unionByName(found[2]).groupBy("metric_x", "metric_y").agg(F.min("way").alias("way"))
    return best.select("metric_x", "metric_y", F.when(F.col("way") == 1, "derived").when(F.col("way") == 2, "same_source").otherwise("same_family").alias("reason"))


def conflicting(spans: DataFrame, scope: str, least: int = WEEK) -> DataFrame:
    """Spans (scope, start, stop) with ``last_day`` and whether another one claims a day too.

    A span without a stop lasts ``least`` days and yields to a later start; a declared
    stop never yields; of two spans that start together both conflict."""
    day, last = F.unix_date("start"), F.unix_date("last_day")
    ordered = Window.partitionBy(scope).orderBy(day)
    before, after = ordered.rangeBetween(Window.unboundedPreceding, -1), ordered.rangeBetween(1, Window.unboundedFollowing)
    declared = F.col("stop").isNotNull()
    held = F.coalesce(F.max(F.when(declared, last)).over(before) >= day, F.lit(False))
    holds = declared & F.coalesce(F.min(day).over(after) <= last, F.lit(False))
    together = F.count("*").over(Window.partitionBy(scope, "start")) > 1
    closed = spans.withColumn("last_day", F.coalesce("stop", F.date_add("start", least - 1)))
    return closed.withColumn("conflict", held | holds | together)


def registered(entries: DataFrame, texts: DataFrame) -> DataFrame:
    """Entries (doc_id, sha) with the reason for which one is refused, or null.

    ``duplicate_id``: the id is registered more than once; ``missing_text``: no text of
    that id, or a null one; ``bad_checksum``: the text has another hash."""
    # one row an id: a repeated id of the texts does not multiply entries
    hashes = texts.groupBy("doc_id").agg(F.min(F.sha2("text", 256)).alias("held_sha"))
    counts = entries.groupBy("doc_id").agg(F.count("*").alias("times"))
    joined = entries.join(counts, "doc_id").join(hashes, "doc_id", "left")
    reason = F.when(F.col("times") > 1, "duplicate_id").when(F.col("held_sha").isNull(), "missing_text").when(~F.col("sha").eqNullSafe(F.col("held_sha")), "bad_checksum")
    return joined.withColumn("reason", reason).drop("times", "held_sha")


def entry_reason(key: Column, source: Column, kcal: Column, serving_g: Column, sources: list[str]) -> Column:
    """Why an entry of a food catalogue is refused, or null: the first rule that it breaks."""
    number = lambda c: c.isNotNull() & ~F.isnan(c)
    return (
        F.when(key.isNull() | (key == "") | (key != F.lower(key)) | key.rlike(r"\s"), "bad_key")
        .when(source.isNull() | ~source.isin(sources), "bad_source")
        .when(~number(kcal), "energy_missing")
        .when(kcal < 0, "energy_negative")
        .when(serving_g.isNotNull() & (F.isnan(serving_g) | (serving_g <= 0)), "bad_serving")
    )
