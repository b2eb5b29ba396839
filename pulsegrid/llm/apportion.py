"""Mixing sources to target weights by Sainte-Lague apportionment.

Each source has a target in words: a weighted share of the whole mix, stopped where its
documents would be repeated too often, with the excess shared again among the others.
The mix is made of blocks of ``block_words`` words.  Sources win blocks by the highest
quotients target / (1, 3, 5, ...).  A source lies in shards of about ``shard_words``
words, to which its blocks go by the same rule, so that every shard has an integer quota
and is dealt with by itself, whatever the size of its source.

In a shard the documents stand one after another in a seeded order and are cut into
blocks of equal size.  Whole passes over the shard are taken first; the blocks of the
pass that is left are every n-th of the shard, from a seeded start.  What a document
gives is a number of passes and spans of its words, found from the places where it
starts and stops: no row is made for a block.

All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.llm.ranks import placed
from pulsegrid.llm.skew import met
from pulsegrid.llm.storage import dropped, written

SEED = 42
BLOCK_WORDS = 64
SHARD_WORDS = 1 << 20
WEIGHTS = (5, 2, 1)
SHARE = 1.5  # words of the mix for each word of the documents
MOST = 2  # times that a document may be taken
SPACES = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """Runs of characters other than blanks, tabs and line ends; none of null.

    Each run and the blanks after it become one letter, which are then counted."""
    marks = F.regexp_replace(F.ltrim(text, F.lit(SPACES)), F.lit(r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"), F.lit("x"))
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def _number(digest: Column) -> Column:
    """The first 32 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Rows of ``source_key`` and ``source_size`` with ``target``, in words.

    ``weights`` go to the sources in their order, again and again.  Targets are the level
    of a mix times the weight, or ``most`` times the source where that is less.  With the
    sources ordered by the level at which they are full, the level of the mix is the first
    one that the sources from there on can bear."""
    cap = (F.lit(float(most)) * F.col("source_size")).alias("cap")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).alias("weight")
    weighed = placed(sources, [F.col("source_key")]).select("source_key", "source_size", cap, weight).withColumn("full", F.col("cap") / F.col("weight"))
    filled = placed(weighed, [F.col("full"), F.col("source_key")], {"cap": "cap_before", "weight": "weight_before"})
    all_words, all_weight = sources.agg(F.sum("source_size")).first()[0] or 0, filled.agg(F.sum("weight")).first()[0] or 0.0
    level = (F.lit(share * all_words) - F.col("cap_before")) / (F.lit(all_weight) - F.col("weight_before"))
    at = filled.withColumn("level", level).where("level <= full").agg(F.min_by("level", "place")).first()[0]
    target = F.col("cap") if at is None else F.least("cap", F.lit(at) * F.col("weight"))
    return filled.select("source_key", "source_size", target.alias("target"))


def apportioned(parties: DataFrame, by: str, party: str) -> DataFrame:
    """``seats`` of every row of ``by``, ``party``, ``weight`` and ``house``: how many of
    the ``house`` seats of its group ``by`` go to a party by the highest quotients of its
    weight by 1, 3, 5, ...; of equal quotients the smaller party's comes first.

    A group of n parties fills a house of s seats by a divisor between its weights over
    s + n/2 and over s - n/2.  Both give each party a number of seats; only the quotients
    between the two, fewer than 4 n with a seat to spare at each end, are put in order."""
    groups = parties.groupBy(by).agg(F.sum("weight").alias("weights"), F.count("*").alias("n"), F.max("house").alias("house")).where("weights > 0")
    total = parties.count()
    known = met(parties.drop("house"), groups.withColumn("parties", F.col("n")), [by], total).where("weight > 0")
    seats = lambda house: F.floor(F.col("weight") * house / F.col("weights") + 0.5)
    low = F.greatest(F.lit(0), seats(F.col("house") - F.col("parties") / 2) - 1).cast("long")
    high = (seats(F.col("house") + F.col("parties") / 2) + 1).cast("long")
    known = written(known.select(by, party, "weight", "house", low.alias("low"), high.alias("high")), "parties")
    claims = known.select(by, party, F.explode(F.sequence(F.col("low") + 1, "high")).alias("k"), "weight").select(by, party, (F.col("weight") / (2 * F.col("k") - 1)).alias("quotient"))
    ordered = placed(claims, [F.col(by), F.col("quotient").desc(), F.col(party)])
    first = ordered.groupBy(by).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    open_ = known.groupBy(by).agg((F.max("house") - F.sum("low")).alias("open"))
    won = met(ordered, first.join(open_, by), [by], 4 * total).where(F.col("place") - F.col("first") < F.col("open")).groupBy(by, party).agg(F.count("*").alias("won"))
    held = known.join(won, [by, party], "left").select(by, party, (F.col("low") + F.coalesce("won", F.lit(0))).alias("seats"))
    # parties without weight, and groups without any, have no seats
    return written(parties.select(by, party).join(held, [by, party], "left").fillna(0, ["seats"]), "seats")


def mixed(
    docs: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, text: bool = False
) -> DataFrame:
    """What the mix takes of every document: ``doc_id``, ``source``, ``size`` in words,
    ``source_size``, ``target`` of its source, ``passes`` (times the whole document is
    taken), ``spans`` (ranges of words taken once more) and ``taken``, the words in all;
    with ``text`` the document's text too.

    Null texts and texts of blanks have no words and give none.  Documents without a
    source are one source, the last.  Equal rows are told apart by nothing and may give
    different spans; which ones is fixed as a set.  The order of documents comes from
    hashes of seed, id and text, so reruns agree whatever the partitions.  Other columns
    of ``docs`` are not looked at.  An empty table gives an empty mix."""
    content = F.coalesce("text", F.lit(""))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(content)))
    kept = ["doc_id", "source", "size", *(["text"] if text else [])]
    sized = docs.select("doc_id", "source", F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source")).alias("source_key"), n_words(F.col("text")).alias("size"), key.alias("key"), *(["text"] if text else []))
    sized = written(sized, "sized")
    found = written(sized.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sources")
    n_docs, all_words = (x or 0 for x in found.agg(F.sum("n"), F.sum("source_size")).first())
    aimed = written(targets(found.drop("n"), weights, share, most), "targets")
    house = F.floor(F.lit(share * all_words / block_words + 0.5)).cast("long")
    seats = apportioned(aimed.select(F.lit(0).alias("mix"), "source_key", F.col("target").alias("weight"), house.alias("house")), "mix", "source_key").select("source_key", F.col("seats").alias("house"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long").alias("shards")
    plan = written(aimed.join(seats, "source_key").join(found.select("source_key", "n"), "source_key").select("*", shards), "plan")
    dealt = written(met(sized, plan.drop("house"), ["source_key"], n_docs).withColumn("shard", F.pmod(_number(F.col("key")), F.col("shards"))).drop("shards"), "dealt")
    cells = written(dealt.where("size > 0").groupBy("source_key", "shard").agg(F.sum("size").alias("words")), "cells")
    per_source = cells.groupBy("source_key").agg(F.count("*").alias("n")).join(plan.select("source_key", "house"), "source_key")
    parties = written(met(cells, per_source, ["source_key"], cells.count()).select("source_key", "shard", F.col("words").cast("double").alias("weight"), "house"), "quotas")
    quota = apportioned(parties, "source_key", "shard")
    n, size = F.col("words"), F.col("size")
    blocks = F.greatest(F.lit(1), F.floor(n / block_words + 0.5)).cast("long").alias("blocks")
    uses = F.least(most * F.col("blocks"), F.floor((F.col("seats") * block_words * F.col("blocks")) / n + 0.5).cast("long")).alias("uses")
    begin = _number(F.md5(F.concat(F.lit(f"{seed}:"), "source_key", F.lit(":"), F.col("shard").cast("string"))))
    dealing = cells.join(quota, ["source_key", "shard"]).select("*", blocks).select("*", uses)
    dealing = dealing.select("source_key", "shard", "words", "blocks", F.expr("uses div blocks").alias("passes"), F.expr("uses % blocks").alias("extra"), F.pmod(begin, F.col("blocks")).alias("begin"))
    order = Window.partitionBy("source_key", "shard").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    at = dealt.where("size > 0").join(dealing, ["source_key", "shard"]).withColumn("stop", F.sum("size").over(order)).withColumn("start", F.col("stop") - size)
    block_of = lambda word: f"(({word} + 1) * blocks - 1) div words"
    chosen = F.filter(F.sequence(F.expr(block_of("start")), F.expr(block_of("stop - 1"))), lambda k: F.floor(((k + 1) * F.col("extra") + F.col("begin")) / F.col("blocks")) > F.floor((k * F.col("extra") + F.col("begin")) / F.col("blocks")))
    edge = lambda k: F.floor(k * n / F.col("blocks"))
    spans = F.transform(chosen, lambda k: F.struct((F.greatest(edge(k), "start") - F.col("start")).alias("start"), (F.least(edge(k + 1), "stop") - F.col("start")).alias("stop")))
    none = F.lit(None).cast("array<struct<start:bigint,stop:bigint>>")
    gives = at.select(*kept, "source_size", "target", "passes", F.when(F.col("extra") > 0, spans).otherwise(none).alias("spans"))
    empty = dealt.where("size = 0").select(*kept, "source_size", "target", F.lit(0).cast("long").alias("passes"), none.alias("spans"))
    out = gives.unionByName(empty).withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>")))
    dropped(sized, found)
    return out.withColumn("taken", F.col("passes") * size + F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"]))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix as texts: ``doc_id``, ``source``, ``piece``, ``text`` and ``size`` in words;
    a row for each pass over a whole document and for each span of it.

    Texts keep the blanks inside them; those after the last word of a piece go."""
    held = mixed(docs, text=True, **options).where("taken > 0")
    parts = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]++[\x20\x09-\x0D]*+)"), F.lit(1))
    cut = lambda s: F.rtrim(F.array_join(F.slice("parts", (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")), ""), F.lit(SPACES))
    whole = F.array_repeat(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("stop")), F.col("passes").cast("int"))
    pieces = held.withColumn("parts", parts).select("doc_id", "source", F.posexplode(F.transform(F.concat(whole, "spans"), lambda s: F.struct(cut(s).alias("text"), (s["stop"] - s["start"]).alias("size")))).alias("piece", "of"))
    return pieces.select("doc_id", "source", "piece", "of.text", "of.size")


def digest(docs: DataFrame, **options) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words taken.

    Null and empty texts have size 0 and give nothing; repeated rows are taken one by one."""
    return mixed(docs, **options).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS source_key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
sources AS (SELECT source_key, sum(size)::BIGINT AS source_size FROM sized GROUP BY source_key),
whole AS (SELECT coalesce(sum(source_size), 0)::BIGINT AS words FROM sources),
weighed AS (
  SELECT *, {float(MOST)}::DOUBLE * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source_key) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sources),
levels AS (
  SELECT *, cap / weight AS fullness, row_number() OVER by_full AS place,
         ({SHARE}::DOUBLE * words - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed, whole
  WINDOW by_full AS (ORDER BY cap / weight, source_key),
         before AS (ORDER BY cap / weight, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
mix AS (SELECT arg_min(level, place) AS level FROM levels WHERE level <= fullness),
aimed AS (SELECT source_key, source_size, least(cap, coalesce(mix.level * weight, cap)) AS target FROM levels, mix),
house AS (SELECT floor({SHARE}::DOUBLE * words / {BLOCK_WORDS} + 0.5)::BIGINT AS seats FROM whole),
seats AS (
  SELECT source_key, count(*) AS seats
  FROM (SELECT source_key, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, source_key) AS place
        FROM aimed, (SELECT unnest(range(1, (SELECT seats + 1 FROM house))) AS k) WHERE target > 0), house
  WHERE place <= house.seats GROUP BY source_key),
plan AS (SELECT aimed.*, coalesce(seats, 0) AS seats, greatest(1, ceil(source_size / {SHARD_WORDS}::DOUBLE))::BIGINT AS shards FROM aimed LEFT JOIN seats USING (source_key)),
dealt AS (SELECT sized.*, source_size, target, ('0x' || substr(key, 1, 8))::BIGINT % shards AS shard FROM sized JOIN plan USING (source_key)),
cells AS (SELECT source_key, shard, sum(size)::BIGINT AS words FROM dealt WHERE size > 0 GROUP BY ALL),
quotas AS (
  SELECT source_key, shard, count(*) AS quota
  FROM (SELECT source_key, shard, seats, row_number() OVER (PARTITION BY source_key ORDER BY words::DOUBLE / (2 * k - 1) DESC, shard) AS place
        FROM (SELECT *, unnest(range(1, seats + 1)) AS k FROM cells JOIN plan USING (source_key)))
  WHERE place <= seats GROUP BY ALL),
blocked AS (
  SELECT cells.*, coalesce(quota, 0) AS quota, greatest(1, floor(words / {BLOCK_WORDS}::DOUBLE + 0.5))::BIGINT AS blocks
  FROM cells LEFT JOIN quotas USING (source_key, shard)),
used AS (SELECT *, least({MOST} * blocks, floor((quota * {BLOCK_WORDS} * blocks) / words::DOUBLE + 0.5)::BIGINT) AS uses FROM blocked),
dealing AS (
  SELECT source_key, shard, words, blocks, uses // blocks AS passes, uses % blocks AS extra,
         ('0x' || substr(md5('{SEED}:' || source_key || ':' || shard::VARCHAR), 1, 8))::BIGINT % blocks AS start
  FROM used),
blocks AS (
  SELECT source_key, shard, floor(k * words / blocks::DOUBLE)::BIGINT AS low, floor((k + 1) * words / blocks::DOUBLE)::BIGINT AS high
  FROM (SELECT *, unnest(range(0, blocks)) AS k FROM dealing)
  WHERE ((k + 1) * extra + start) // blocks > (k * extra + start) // blocks),
laid AS (
  SELECT *, sum(size) OVER (PARTITION BY source_key, shard ORDER BY key, size ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM dealt WHERE size > 0),
extra AS (
  SELECT l.source_key, l.shard, l.key, l.stop, sum(least(high, l.stop) - greatest(low, l.stop - size))::BIGINT AS extra
  FROM laid l JOIN blocks b ON l.source_key = b.source_key AND l.shard = b.shard AND low < l.stop AND high > l.stop - size GROUP BY ALL)
SELECT doc_id, size, source_size, target, (passes * size + coalesce(e.extra, 0))::BIGINT AS taken
FROM laid JOIN dealing USING (source_key, shard) LEFT JOIN extra e USING (source_key, shard, key, stop)
UNION ALL SELECT doc_id, size, source_size, target, 0::BIGINT FROM dealt WHERE size = 0
"""
