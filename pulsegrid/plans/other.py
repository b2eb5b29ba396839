"""Queries over logs, catalogues, correlations and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import stems, units
from pulsegrid.functions.significance import correlation_p_sql
from pulsegrid.functions.stems import stem_table_sql
from pulsegrid.operators import correlation, ledger, retrieval
from pulsegrid.operators.training import wear_hours
from pulsegrid.plans.daily import WEAR, short_series
from pulsegrid.plans.registry import query, views
from pulsegrid.sources.adapters import CUMULATIVE, DAILY_SHORT, RECORDS, SERIES, records, table

SHORT = views(RECORDS, DAILY_SHORT, SERIES)
PAIRS = """, pairs AS (SELECT y.date, x.date AS x_date, x.value AS x, y.value AS y FROM series x JOIN series y ON y.date = x.date + 1 AND x.metric = 'click' AND y.metric = 'purchase'
  LEFT JOIN wear wx ON wx.date = x.date LEFT JOIN wear wy ON wy.date = y.date WHERE coalesce(wx.hours, 24) >= 12 AND coalesce(wy.hours, 24) >= 12)
"""
#: What a correlation is told with, from n, its coefficient c and whether a series is flat.
TOLD = """CASE WHEN n < 8 THEN 'insufficient_data' WHEN flat THEN 'undefined_constant_series' ELSE 'ok' END AS status, n, round(c, 5) AS rho,
  round(tanh(atanh(greatest(-0.999999, least(0.999999, c))) - 1.96 * sqrt({k} / (n - 3))), 4) AS low,
  round(tanh(atanh(greatest(-0.999999, least(0.999999, c))) + 1.96 * sqrt({k} / (n - 3))), 4) AS high, round(""" + correlation_p_sql("c", "n") + ", 4) AS p"
COEFFICIENT = "count(*) AS n, min(x) = max(x) OR min(y) = max(y) AS flat, CASE WHEN count(*) >= 8 AND min(x) < max(x) AND min(y) < max(y) THEN greatest(-1.0, least(1.0, corr(x, y))) END AS c"
#: Benjamini-Hochberg over the rows of ``t`` that have a p.
JUDGED = """j AS (SELECT *, least(1.0, min(p * m / k) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS qv
  FROM (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () AS m FROM t WHERE p IS NOT NULL))"""


def _pairs(spark, sf_dir):
    series = short_series(spark, sf_dir)
    wear = wear_hours(records(spark, sf_dir)).where("local_date <> date'2024-01-20'")
    return correlation.lagged_pairs(series.where("metric = 'click'"), series.where("metric = 'purchase'"), 1, wear)


@query(views(RECORDS, DAILY_SHORT, SERIES, WEAR) + PAIRS + "SELECT * FROM pairs")
def lagged_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(views(RECORDS, DAILY_SHORT, SERIES, WEAR) + PAIRS + f", a AS (SELECT 'click' AS metric, {COEFFICIENT} FROM pairs) SELECT metric, " + TOLD.format(k="1.0") + " FROM a")
def pearson(spark, sf_dir):
    return correlation.correlations(_pairs(spark, sf_dir).withColumn("metric", F.lit("click")), ["metric"])


RANKED = "(rank() OVER ({p}ORDER BY {c}) + (count(*) OVER (PARTITION BY {q}{c}) - 1) / 2)"


@query(
    views(RECORDS, DAILY_SHORT, SERIES, WEAR)
    + PAIRS
    + f", k AS (SELECT {RANKED.format(p='', q='', c='x')} AS x, {RANKED.format(p='', q='', c='y')} AS y FROM pairs), a AS (SELECT 'click' AS metric, {COEFFICIENT} FROM k) SELECT metric, "
    + TOLD.format(k="1.06")
    + " FROM a"
)
def spearman(spark, sf_dir):
    return correlation.correlations(_pairs(spark, sf_dir).withColumn("metric", F.lit("click")), ["metric"], ranked=True)


LAGS = [0, 1, 2, 3]


@query(
    SHORT
    + f""", p AS (SELECT x.metric, CAST(lag AS INTEGER) AS lag, x.value AS x, y.value AS y FROM series x, unnest([0, 1, 2, 3]) t(lag), series y WHERE y.metric = 'purchase' AND x.metric <> 'purchase' AND y.date = x.date + CAST(lag AS INTEGER)),
k AS (SELECT metric, lag, {RANKED.format(p='PARTITION BY metric, lag ', q='metric, lag, ', c='x')} AS x, {RANKED.format(p='PARTITION BY metric, lag ', q='metric, lag, ', c='y')} AS y FROM p),
a AS (SELECT metric, lag, {COEFFICIENT} FROM k GROUP BY 1, 2),
t AS (SELECT metric, lag, """
    + TOLD.format(k="1.06")
    + " FROM a WHERE c IS NOT NULL), "
    + JUDGED
    + " SELECT metric, lag, status, n, rho, low, high, p, round(qv, 4) AS q_value, round(qv, 6) <= 0.1 AS passed_fdr FROM j"
)
def correlation_scan(spark, sf_dir):
    return correlation.scan(short_series(spark, sf_dir), "purchase", LAGS)


@query(
    """WITH t AS (SELECT l_suppkey AS test, round(((l_suppkey * 7919) % 1000) / 1000 * ((l_suppkey * 31) % 7) / 7, 4) AS p FROM (SELECT DISTINCT l_suppkey FROM lineitem)),
k AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS rank, count(*) OVER () AS m FROM t)
SELECT test, p, round(least(min(p * m / rank) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0), 6) AS q,
  round(least(min(p * m / rank) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0), 6) <= 0.1 AS significant FROM k"""
)
def bh_qvalues(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").select("l_suppkey").distinct()
    tests = keys.select(F.col("l_suppkey").alias("test"), ((F.col("l_suppkey") * 7919 % 1000) / 1000 * (F.col("l_suppkey") * 31 % 7) / 7).alias("p"))
    return correlation.q_values(tests).select("test", "p", "q", "significant")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return ledger.latest_per_key(rows, ["user_id", "event_type"], F.struct("ts", "event_id")).select("user_id", "event_type", "event_id", "value")


@query("WITH f AS (SELECT o_orderkey AS fact_id, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey - 3 END AS supersedes, o_totalprice AS value FROM orders) SELECT fact_id, value FROM f WHERE fact_id NOT IN (SELECT supersedes FROM f WHERE supersedes IS NOT NULL)")
def superseded_anti_join(spark, sf_dir):
    facts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fact_id"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") - 3).alias("supersedes"), F.col("o_totalprice").alias("value"))
    return ledger.current(facts, "fact_id", "supersedes").select("fact_id", "value")


@query("SELECT a.conv_id, a.turn, length(q.text) AS question_chars, length(a.text) AS answer_chars FROM conversations a LEFT JOIN conversations q ON q.conv_id = a.conv_id AND q.turn + 1 = a.turn AND q.role = 'user' WHERE a.role = 'assistant'")
def turn_pairs(spark, sf_dir):
    return ledger.turn_pairs(table(spark, sf_dir, "conversations"))


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) > 21 FROM orders) AS truncated FROM orders WHERE o_orderkey < (SELECT max(o_orderkey) FROM orders) ORDER BY o_orderkey DESC LIMIT 20")
def keyset_page(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    cursor = rows.agg(F.max("o_orderkey")).first()[0]  # the page before the newest entry
    return ledger.page_before(rows, F.col("o_orderkey") < cursor, [F.col("o_orderkey").desc()], 20)


MEALS = """WITH foods AS (SELECT p_partkey + 3 AS item, p_retailprice AS kcal, CASE WHEN p_size % 10 <> 0 THEN CAST(p_size AS DOUBLE) END AS protein FROM part)
SELECT l_orderkey AS meal, count(*) AS n_items, round(sum(l_quantity * kcal), 3) AS kcal,
  CASE WHEN max(CASE WHEN l_quantity > 0 AND protein IS NULL THEN 1 ELSE 0 END) = 0 THEN round(sum(l_quantity * protein), 3) END AS protein, CAST(sum(CASE WHEN kcal IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unknown
FROM lineitem LEFT JOIN foods ON item = l_partkey GROUP BY 1"""


@query(MEALS)
def meal_totals(spark, sf_dir):
    # keys moved by three leave some items of the meals unknown
    foods = table(spark, sf_dir, "part").select((F.col("p_partkey") + 3).alias("item"), F.col("p_retailprice").alias("kcal"), F.when(F.col("p_size") % 10 != 0, F.col("p_size").cast("double")).alias("protein"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("meal"), F.col("l_partkey").alias("item"), F.col("l_quantity").alias("servings"))
    return ledger.meal_totals(items, foods)


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%red%' OR lower(p_brand) LIKE '%#1'")
def catalog_search(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return parts.where(F.lower("p_name").contains("red") | F.lower("p_brand").endswith("#1")).select("p_partkey", "p_name")


UNIT = "CASE event_id % 4 WHEN 0 THEN 'km' WHEN 1 THEN 'm' WHEN 2 THEN 'mi' ELSE 'furlong' END"


@query(f"SELECT event_id, {UNIT} AS unit, round(CASE event_id % 4 WHEN 0 THEN value * 0.621371192::DOUBLE WHEN 1 THEN value * 0.000621371192::DOUBLE WHEN 2 THEN value END, 7) AS miles FROM events")
def unit_conversion(spark, sf_dir):
    k = F.col("event_id") % 4
    rows = table(spark, sf_dir, "events").withColumn("unit", F.when(k == 0, "km").when(k == 1, "m").when(k == 2, "mi").otherwise("furlong"))
    return rows.select("event_id", "unit", F.round(units.convert(F.col("value"), F.col("unit"), "mi"), 7).alias("miles"))


@query("SELECT o_orderstatus, CASE WHEN o_clerk LIKE '%watch%' THEN 'watch' WHEN o_clerk LIKE '%bike%' THEN 'machine' WHEN o_clerk LIKE '%sync%' THEN 'mirror' WHEN o_clerk LIKE '%phone%' THEN 'phone' ELSE 'other' END AS role, count(*) AS n FROM (SELECT o_orderstatus, CASE o_orderkey % 5 WHEN 0 THEN 'old watch' WHEN 1 THEN 'a phone' WHEN 2 THEN 'bike 4' WHEN 3 THEN 'app sync' ELSE 'pen' END AS o_clerk FROM orders) GROUP BY 1, 2")
def source_roles(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    name = F.when(k == 0, "Old Watch").when(k == 1, "a Phone").when(k == 2, "Bike 4").when(k == 3, "App Sync").otherwise("pen")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", units.source_role(name).alias("role")).agg(F.count("*").alias("n"))


IDENTITY = ", i AS (SELECT *, sha1(concat_ws('|', metric, start_s - start_s % 3600, end_s - end_s % 3600, source, CASE WHEN metric NOT IN ('click', 'view', 'error') THEN CAST(CAST(round(value, 2) AS DECIMAL(18, 2)) AS VARCHAR) END)) AS identity FROM records)"


@query(views(RECORDS) + IDENTITY + "SELECT identity, metric, id, value FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY id DESC) AS k FROM i) WHERE k = 1")
def identity_hash_dedupe(spark, sf_dir):
    rows = records(spark, sf_dir).withColumns({"start_s": F.col("start_s") - F.col("start_s") % 3600, "end_s": F.col("end_s") - F.col("end_s") % 3600})
    return ledger.upserted(ledger.identity(rows, list(CUMULATIVE)), "id").select("identity", "metric", "id", "value")


@query(views(RECORDS) + "SELECT metric, CASE WHEN value IS NULL THEN 'missing_value' WHEN value > 150 THEN 'implausible' WHEN local_date <= DATE '2024-01-03' THEN 'behind_watermark' END AS reason, count(*) AS n, min(id) AS first_id FROM records WHERE value IS NULL OR value > 150 OR local_date <= DATE '2024-01-03' GROUP BY 1, 2")
def rejected_rows(spark, sf_dir):
    judged = ledger.judged(records(spark, sf_dir), "2024-01-03", 150)
    return judged.where("reason is not null").groupBy("metric", "reason").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(
    views(RECORDS)
    + """, v AS (SELECT DISTINCT local_date AS date FROM records WHERE metric = 'error' AND (day(local_date) BETWEEN 3 AND 9 OR day(local_date) > 24)),
w AS (SELECT CAST(g AS DATE) AS window_start FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-20', INTERVAL 7 DAY) t(g)),
c AS (SELECT window_start, count(date) AS n FROM w LEFT JOIN v ON date BETWEEN window_start AND window_start + 6 AND date <= DATE '2024-02-20' GROUP BY 1)
SELECT window_start, window_start + 6 AS window_end, n, CASE WHEN n > 0 THEN 'complete' WHEN window_start + 6 >= DATE '2024-02-20' THEN 'due' ELSE 'missed' END AS status FROM c"""
)
def cadence_windows(spark, sf_dir):
    day = F.dayofmonth("local_date")
    days = records(spark, sf_dir).where((F.col("metric") == "error") & (day.between(3, 9) | (day > 24))).select(F.col("local_date").alias("date")).distinct()
    return ledger.cadence_windows(days, "2024-01-01", "2024-02-20", 7)


CHUNKS = """WITH c AS (SELECT doc_id, text, CAST(unnest(range(0, CAST(greatest(1, ceil((length(text) - 200) / 1000)) AS BIGINT))) AS INTEGER) AS chunk_no FROM documents WHERE text IS NOT NULL),
chunks AS (SELECT doc_id, chunk_no, substr(text, chunk_no * 1000 + 1, 1200) AS body FROM c),
control AS (SELECT item_id, text AS body FROM benchmark),
terms AS (SELECT doc_id, chunk_no, regexp_extract_all(lower(body), '[a-z0-9]+') AS t FROM chunks),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM terms) GROUP BY 1)
"""


def _chunks(spark, sf_dir):
    return retrieval.chunks(table(spark, sf_dir, "documents"))


@query(CHUNKS + "SELECT doc_id, chunk_no, length(body) AS chars, sha256(body) AS sha FROM chunks")
def chunk_text(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "chunk_no", F.length("body").alias("chars"), F.sha2("body", 256).alias("sha"))


@query(CHUNKS + "SELECT * FROM df")
def term_document_frequency(spark, sf_dir):
    return retrieval.document_frequency(_chunks(spark, sf_dir))


#: Document frequencies of stems, of chunks (``df``) and of control texts (``cdf``).
STEMS = (
    """, words AS (SELECT doc_id, chunk_no, unnest(list_distinct(t)) AS term FROM terms),
cwords AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(body), '[a-z0-9]+'))) AS term FROM control),
every_word AS (SELECT term FROM words UNION SELECT term FROM cwords UNION SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) FROM conversations),
"""
    + stem_table_sql("every_word")
    + """,
sdf AS (SELECT stem, count(*) AS df FROM (SELECT DISTINCT doc_id, chunk_no, stem FROM words JOIN stems USING (term)) GROUP BY 1),
cdf AS (SELECT stem, count(*) AS control_df FROM (SELECT DISTINCT item_id, stem FROM cwords JOIN stems USING (term)) GROUP BY 1)
"""
)


@query(
    CHUNKS
    + STEMS
    + "SELECT stem, df, coalesce(control_df, 0) AS control_df FROM sdf LEFT JOIN cdf USING (stem) WHERE df >= 3 AND df * (SELECT count(*) FROM control) >= 3 * coalesce(control_df, 0) * (SELECT count(*) FROM chunks)"
)
def domain_lexicon(spark, sf_dir):
    control = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("body"))
    return retrieval.lexicon(_chunks(spark, sf_dir), control)


@query(CHUNKS + STEMS + "SELECT stem, count(*) AS n_words, min(term) AS first_word, max(term) AS last_word FROM stems SEMI JOIN words USING (term) GROUP BY 1")
def stem_families(spark, sf_dir):
    """Stems of the corpus with the number of words that have them."""
    words = _chunks(spark, sf_dir).select(F.explode(F.array_distinct(retrieval.terms(F.col("body")))).alias("term"))
    return stems.stem_table(words).groupBy("stem").agg(F.count("*").alias("n_words"), F.min("term").alias("first_word"), F.max("term").alias("last_word"))


#: Stems of a query's words.
WORDS = ["ting", "shin", "queue", "einung", "thing", "er", "queu"]
BM25 = (
    CHUNKS
    + STEMS
    + f""", tot AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM terms),
tf AS (SELECT doc_id, chunk_no, len(t) AS dl, stem, count(*) AS tf FROM (SELECT doc_id, chunk_no, t, unnest(t) AS term FROM terms) JOIN stems USING (term) WHERE stem IN ({", ".join(f"'{w}'" for w in WORDS)}) GROUP BY 1, 2, 3, 4),
tdf AS (SELECT stem, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT doc_id, chunk_no, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN tdf USING (stem), tot GROUP BY 1, 2)
"""
)


@query(BM25 + "SELECT *, row_number() OVER (ORDER BY score DESC, doc_id, chunk_no) AS rank FROM bm ORDER BY score DESC, doc_id, chunk_no LIMIT 40")
def bm25_topk(spark, sf_dir):
    return retrieval.ranked(retrieval.bm25(_chunks(spark, sf_dir), ["doc_id", "chunk_no"], WORDS), ["doc_id", "chunk_no"], 40)


COSINE = """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
cs AS (SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q::DOUBLE[], q::DOUBLE[])), 5) AS score FROM embeddings, q)
"""


def _cosine(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return retrieval.cosine(vectors, vectors.where("vec_id = 0"))


@query(COSINE + "SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM cs ORDER BY score DESC, vec_id LIMIT 30")
def cosine_topk(spark, sf_dir):
    return retrieval.ranked(_cosine(spark, sf_dir), ["vec_id"], 30)


@query(
    BM25.replace("WITH c AS", COSINE.strip() + ", c AS", 1)
    + """, a AS (SELECT doc_id AS key, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, max(score) AS score FROM bm GROUP BY 1) ORDER BY score DESC, doc_id LIMIT 40),
b AS (SELECT vec_id AS key, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM cs ORDER BY score DESC, vec_id LIMIT 40)
SELECT key, a.rank AS rank_a, b.rank AS rank_b, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 8) AS score FROM a FULL JOIN b USING (key)"""
)
def rrf_fusion(spark, sf_dir):
    best = retrieval.bm25(_chunks(spark, sf_dir), ["doc_id", "chunk_no"], WORDS).groupBy(F.col("doc_id").alias("key")).agg(F.max("score").alias("score"))
    near = _cosine(spark, sf_dir).withColumnRenamed("vec_id", "key")
    return retrieval.fused(retrieval.ranked(best, ["key"], 40), retrieval.ranked(near, ["key"], 40), "key")


@query(views(RECORDS, DAILY_SHORT) + "SELECT metric, date AS local_date, count, sum, avg, min, max, last FROM daily")
def streaming_rollup(spark, sf_dir):
    from pulsegrid.streaming.rollup import rolled_from_files

    return rolled_from_files(spark, sf_dir)
