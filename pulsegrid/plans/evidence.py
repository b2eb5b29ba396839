"""Queries over cited spans, licences, gates, alerts, spans of days and registers."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import labels
from pulsegrid.operators import evidence, retrieval
from pulsegrid.plans.daily import short_series
from pulsegrid.plans.other import CHUNKS, STEMS, WORDS, _chunks
from pulsegrid.plans.registry import query, views
from pulsegrid.sources.adapters import DAILY_SHORT, RECORDS, SERIES, records, table

# Texts -------------------------------------------------------------------------


@query(
    CHUNKS
    + r""", claims AS (SELECT doc_id, chunk_no, body, CASE doc_id % 3 WHEN 0 THEN substr(body, 21, 60) WHEN 1 THEN trim(regexp_replace(substr(body, 21, 60), '\s+', ' ', 'g'), ' ') ELSE substr(body, 21, 60) || '§' END AS span FROM chunks),
moved AS (SELECT doc_id + CASE WHEN doc_id % 11 = 0 THEN 1000000000 ELSE 0 END AS doc_id, chunk_no, span FROM claims)
SELECT m.doc_id, m.chunk_no, length(span) AS chars, CASE WHEN body IS NULL THEN 'no_basis'
  WHEN contains(body, span) OR contains(trim(regexp_replace(body, '\s+', ' ', 'g'), ' '), trim(regexp_replace(span, '\s+', ' ', 'g'), ' ')) THEN 'verbatim' ELSE 'changed' END AS verdict
FROM moved m LEFT JOIN chunks c ON c.doc_id = m.doc_id AND c.chunk_no = m.chunk_no"""
)
def citations_checked(spark, sf_dir):
    bodies = _chunks(spark, sf_dir)
    cut = F.substring("body", 21, 60)
    span = F.when(F.col("doc_id") % 3 == 0, cut).when(F.col("doc_id") % 3 == 1, labels.one_spaced(cut)).otherwise(F.concat(cut, F.lit("§")))
    moved = F.col("doc_id") + F.when(F.col("doc_id") % 11 == 0, 1000000000).otherwise(0)
    claims = bodies.select(moved.alias("doc_id"), "chunk_no", span.alias("span"))
    return evidence.cited(claims, bodies, ["doc_id", "chunk_no"]).select("doc_id", "chunk_no", F.length("span").alias("chars"), "verdict")


@query(
    """WITH r AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'cc by' WHEN 1 THEN 'CC-BY 4.0' WHEN 2 THEN 'CC BY-SA' WHEN 3 THEN ' cc0_1.0' WHEN 4 THEN '' WHEN 5 THEN 'CC BY NC SA 3.0 IGO' END AS licence,
  CASE WHEN doc_id % 2 = 0 THEN 'CC BY 3.0' END AS other_licence, CASE WHEN doc_id % 9 = 0 THEN ' True' WHEN doc_id % 9 < 5 THEN 'false' END AS retracted FROM documents),
n AS (SELECT *, CASE doc_id % 7 WHEN 0 THEN 'CC BY' WHEN 1 THEN 'CC BY' WHEN 2 THEN 'CC BY SA' WHEN 3 THEN 'CC0' WHEN 5 THEN 'CC BY NC SA 3 0 IGO' ELSE CASE WHEN doc_id % 2 = 0 THEN 'CC BY' ELSE '' END END AS name FROM r)
SELECT doc_id, name, CASE WHEN retracted = ' True' THEN 'retracted' WHEN name = '' THEN 'licence_absent' WHEN name NOT IN ('CC0', 'CC BY') THEN 'licence_closed' ELSE 'ok' END AS code FROM n"""
)
def licence_gate(spark, sf_dir):
    k = F.col("doc_id") % 7
    licence = F.when(k == 0, "cc by").when(k == 1, "CC-BY 4.0").when(k == 2, "CC BY-SA").when(k == 3, " cc0_1.0").when(k == 4, "").when(k == 5, "CC BY NC SA 3.0 IGO")
    gone = F.when(F.col("doc_id") % 9 == 0, " True").when(F.col("doc_id") % 9 < 5, "false")
    entries = table(spark, sf_dir, "documents").select("doc_id", licence.alias("licence"), F.when(F.col("doc_id") % 2 == 0, "CC BY 3.0").alias("other_licence"), gone.alias("retracted"))
    return evidence.licensed(entries).select("doc_id", "name", "code")


@query(
    CHUNKS
    + STEMS
    + """, lexicon AS (SELECT stem FROM cdf LEFT JOIN sdf USING (stem) WHERE control_df >= 3 AND control_df * (SELECT count(*) FROM chunks) >= 3 * coalesce(df, 0) * (SELECT count(*) FROM control)),
asked AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM conversations)
SELECT DISTINCT conv_id, turn, (conv_id, turn) IN (SELECT (conv_id, turn) FROM asked JOIN stems USING (term) SEMI JOIN lexicon USING (stem)) AS in_domain FROM conversations"""
)
def question_gate(spark, sf_dir):
    # the benchmark's own words, against those of all documents: some questions lie outside
    own = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("body"))
    lexicon = retrieval.lexicon(own, _chunks(spark, sf_dir))
    return evidence.in_domain(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], lexicon)


@query("""SELECT conv_id, turn, CASE WHEN len(t) > 0 THEN '"' || array_to_string(t, '" OR "') || '"' ELSE '' END AS expression FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM conversations WHERE text IS NOT NULL)""")
def match_expressions(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").where("text is not null")
    return asked.select("conv_id", "turn", evidence.match_expression(F.col("text")).alias("expression"))


@query(
    CHUNKS
    + STEMS.replace("UNION SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) FROM conversations", r"""UNION SELECT lower(regexp_replace(w, '^[.,;:!?()\[\]{}"'']+|[.,;:!?()\[\]{}"'']+$', '', 'g')) FROM (SELECT unnest(regexp_extract_all(body, '\S+')) AS w FROM chunks)""")
    + r""", w AS (SELECT doc_id, chunk_no, regexp_extract_all(body, '\S+\s*') AS parts FROM chunks),
u AS (SELECT doc_id, chunk_no, unnest(parts) AS word, generate_subscripts(parts, 1) AS i FROM w),
hit AS (SELECT doc_id, chunk_no, min(i) AS i FROM u JOIN stems ON term = lower(regexp_replace(regexp_replace(word, '\s+$', ''), '^[.,;:!?()\[\]{}"'']+|[.,;:!?()\[\]{}"'']+$', '', 'g')) WHERE stem IN ("""
    + ", ".join(f"'{x}'" for x in WORDS)
    + r""") GROUP BY 1, 2),
s AS (SELECT doc_id, chunk_no, parts, greatest(0, least(coalesce(hit.i, 0) - 17, len(parts) - 64)) AS start FROM w LEFT JOIN hit USING (doc_id, chunk_no))
SELECT doc_id, chunk_no, md5(regexp_replace(array_to_string(parts[start + 1 : start + 64], ''), '\s+$', '')) AS span_md5 FROM s"""
)
def spans_around(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "chunk_no", F.md5(evidence.span_around(F.col("body"), WORDS)).alias("span_md5"))


REGISTER = """WITH e AS (SELECT doc_id + CASE WHEN doc_id % 17 = 0 THEN 1000000000 ELSE 0 END AS doc_id, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END || sha256(text) AS sha, 1 AS entry FROM documents
  UNION ALL SELECT doc_id + 1, sha256(text), 2 FROM documents WHERE lang = 'de'),
h AS (SELECT doc_id, min(sha256(text)) AS held FROM documents GROUP BY 1)
"""


@query(
    REGISTER
    + """SELECT doc_id, entry, CASE WHEN count(*) OVER (PARTITION BY doc_id) > 1 THEN 'duplicate_id' WHEN held IS NULL THEN 'missing_text' WHEN sha IS DISTINCT FROM held THEN 'bad_checksum' END AS reason FROM e LEFT JOIN h USING (doc_id)"""
)
def register_checked(spark, sf_dir):
    texts = table(spark, sf_dir, "documents")
    sha = F.sha2("text", 256)
    moved = F.col("doc_id") + F.when(F.col("doc_id") % 17 == 0, 1000000000).otherwise(0)
    once = texts.select(moved.alias("doc_id"), F.concat(F.when(F.col("doc_id") % 5 == 0, "x").otherwise(""), sha).alias("sha"), F.lit(1).alias("entry"))
    again = texts.where("lang = 'de'").select((F.col("doc_id") + 1).alias("doc_id"), sha.alias("sha"), F.lit(2).alias("entry"))
    return evidence.registered(once.unionByName(again), texts.select("doc_id", "text")).select("doc_id", "entry", "reason")


@query(CHUNKS + "SELECT doc_id, chunk_no FROM chunks WHERE doc_id NOT IN (SELECT doc_id + 3 FROM documents)")
def orphan_chunks(spark, sf_dir):
    known = table(spark, sf_dir, "documents").select((F.col("doc_id") + 3).alias("doc_id"))
    return _chunks(spark, sf_dir).select("doc_id", "chunk_no").join(known, "doc_id", "left_anti")


# Figures and names ---------------------------------------------------------------

TOKENS = """, t AS (SELECT id, CASE WHEN id % 5 = 0 THEN value / 200 ELSE value END AS value,
  CASE id % 4 WHEN 0 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) WHEN 1 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '.0' WHEN 2 THEN ' ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '.5,' ELSE 'about' END AS token FROM records),
n AS (SELECT *, TRY_CAST(replace(regexp_replace(trim(token), '[.,]+$', ''), ',', '') AS DOUBLE) AS number, CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS decimals FROM t)
"""


@query(views(RECORDS) + TOKENS + "SELECT id, token, coalesce(number = value OR (abs(number - value) <= pow(10.0::DOUBLE, -decimals) * 0.5 + 1e-9 AND NOT (decimals = 0 AND abs(value) < 1)), false) AS matches FROM n")
def rounded_claims(spark, sf_dir):
    whole, k = F.floor("value").cast("string"), F.col("id") % 4
    token = F.when(k == 0, whole).when(k == 1, F.concat(whole, F.lit(".0"))).when(k == 2, F.concat(F.lit(" "), whole, F.lit(".5,"))).otherwise("about")
    rows = records(spark, sf_dir).select("id", F.when(F.col("id") % 5 == 0, F.col("value") / 200).otherwise(F.col("value")).alias("value"), token.alias("token"))
    return rows.select("id", "token", labels.rounds_to(F.col("token"), F.col("value")).alias("matches"))


@query(
    views(RECORDS)
    + """, k AS (SELECT id, metric, local_date, source, metric || ' / ' || source || '*' AS name, CAST(local_date AS VARCHAR) || ':' || id % 3 AS period, CASE WHEN id % 6 > 0 THEN 'avg~' || id % 6 ELSE ' ' END AS field FROM records)
SELECT id, CASE WHEN id % 6 > 0 THEN 'fact|metric=' || metric || '%20%2F%20' || source || '%2A|period=' || period || '|field=' || field END AS key, CASE WHEN id % 6 > 0 THEN name END AS name, CASE WHEN id % 6 > 0 THEN period END AS period FROM k"""
)
def fact_keys(spark, sf_dir):
    name = F.concat("metric", F.lit(" / "), "source", F.lit("*"))
    period = F.concat(F.col("local_date").cast("string"), F.lit(":"), (F.col("id") % 3).cast("string"))
    field = F.when(F.col("id") % 6 > 0, F.concat(F.lit("avg~"), (F.col("id") % 6).cast("string"))).otherwise(" ")
    keyed = records(spark, sf_dir).select("id", labels.fact_key(name, period, field).alias("key"))
    return keyed.select("id", "key", labels.fact_part(F.col("key"), "metric").alias("name"), labels.fact_part(F.col("key"), "period").alias("period"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'treadmill' WHEN 1 THEN 'indoor_bike' WHEN 2 THEN 'stair_stepper' WHEN 3 THEN 'ski 2000.b' END AS kind FROM orders"""
)
def machine_kinds(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    raw = F.when(k == 0, " FitnessMachineModel.Treadmill").when(k == 1, "Indoor-Bike").when(k == 2, "stair stepper").when(k == 3, "Ski 2000.b").when(k == 4, "  ")
    return table(spark, sf_dir, "orders").select("o_orderkey", labels.machine_kind(raw).alias("kind"))


SHOWN = ["mi", "kcal", "lb", "degF", "mi/hr", "min/mi", "ft", "in", "bpm"]
_UNIT = "CASE id % 9 " + " ".join(f"WHEN {i} THEN '{u}'" for i, u in enumerate(SHOWN)) + " END"
_TWIN = "CASE id % 9 WHEN 0 THEN 'km' WHEN 1 THEN 'kJ' WHEN 2 THEN 'kg' WHEN 3 THEN 'degC' WHEN 4 THEN 'km/hr' WHEN 5 THEN 'min/km' WHEN 6 THEN 'm' WHEN 7 THEN 'cm' ELSE 'bpm' END"
_SHOWN = "CASE id % 9 WHEN 0 THEN value * 1.609344::DOUBLE WHEN 1 THEN value * 4.184::DOUBLE WHEN 2 THEN value * 0.45359237::DOUBLE WHEN 3 THEN (value - 32) * 5 / 9 WHEN 4 THEN value * 1.609344::DOUBLE WHEN 5 THEN value / 1.609344::DOUBLE WHEN 6 THEN value * 0.3048::DOUBLE WHEN 7 THEN value * 2.54::DOUBLE ELSE value END"


@query(views(RECORDS) + f"SELECT id, {_UNIT} AS unit, {_TWIN} AS shown_unit, round({_SHOWN}, 6) AS shown, CAST(floor(value * 1609.344::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS swim_m FROM records")
def shown_in_metric(spark, sf_dir):
    unit = F.element_at(F.array(*[F.lit(u) for u in SHOWN]), (F.col("id") % 9 + 1).cast("int"))
    rows = records(spark, sf_dir).select("id", "value", unit.alias("unit"))
    return rows.select("id", "unit", labels.metric_unit(F.col("unit")).alias("shown_unit"), F.round(labels.metric_value(F.col("value"), F.col("unit")), 6).alias("shown"), labels.swim_metres(F.col("value")).alias("swim_m"))


FOODS = ["estimate", "web", "label_text", "label_photo"]


@query(
    r"""WITH f AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE lower(replace(p_name, ' ', '-')) END AS key, CASE p_partkey % 5 WHEN 0 THEN 'web' WHEN 1 THEN 'estimate' WHEN 2 THEN 'label_text' WHEN 3 THEN 'label_photo' ELSE 'hearsay' END AS source,
  CASE WHEN p_size % 10 > 0 THEN p_retailprice - 950 END AS kcal, CASE WHEN p_size % 3 > 0 THEN CAST(p_size % 7 AS DOUBLE) END AS serving FROM part)
SELECT p_partkey, CASE WHEN key IS NULL OR key = '' OR key <> lower(key) OR regexp_matches(key, '\s') THEN 'bad_key' WHEN source = 'hearsay' THEN 'bad_source' WHEN kcal IS NULL THEN 'energy_missing' WHEN kcal < 0 THEN 'energy_negative' WHEN serving <= 0 THEN 'bad_serving' END AS reason FROM f"""
)
def catalog_entries(spark, sf_dir):
    k = F.col("p_partkey") % 5
    key = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))))
    source = F.when(k == 0, "web").when(k == 1, "estimate").when(k == 2, "label_text").when(k == 3, "label_photo").otherwise("hearsay")
    kcal = F.when(F.col("p_size") % 10 > 0, F.col("p_retailprice") - 950)
    serving = F.when(F.col("p_size") % 3 > 0, (F.col("p_size") % 7).cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", evidence.entry_reason(key, source, kcal, serving, FOODS).alias("reason"))


# Series and spans ------------------------------------------------------------------

RULES = {"click": (5.0, 1), "view": (-5.0, -1), "purchase": (3.0, 1), "error": (-8.0, -1)}


@query(
    views(RECORDS, DAILY_SHORT, SERIES)
    + """, p AS (SELECT metric, date, round((value - avg(value) OVER (PARTITION BY metric)) * 100 / avg(value) OVER (PARTITION BY metric), 4) AS pct FROM series WHERE value IS NOT NULL),
b AS (SELECT * FROM p WHERE metric = 'click' AND pct >= 5 OR metric = 'view' AND pct <= -5 OR metric = 'purchase' AND pct >= 3 OR metric = 'error' AND pct <= -8)
SELECT metric, date, pct, (date - 7 < DATE '2024-01-15') <> (date < DATE '2024-01-15') AS rescaled FROM b WHERE EXISTS (SELECT 1 FROM b o WHERE o.metric = b.metric AND o.date = b.date - 1)"""
)
def two_day_alerts(spark, sf_dir):
    series = short_series(spark, sf_dir).select("metric", "date", "value")
    means = series.groupBy("metric").agg(F.avg("value").alias("mean"))
    scores = series.join(means, "metric").select("metric", "date", F.round((F.col("value") - F.col("mean")) * 100 / F.col("mean"), 4).alias("pct"))
    found = evidence.alerts(scores, RULES)
    return found.select("metric", "date", "pct", evidence.crosses(F.date_sub("date", 7), F.col("date"), "2024-01-15").alias("rescaled"))


@query(
    """WITH c AS (SELECT n.n_name AS metric, n.n_regionkey AS family, d.n_name AS derived_from FROM nation n LEFT JOIN nation d ON n.n_nationkey % 4 = 1 AND d.n_nationkey = n.n_nationkey // 8),
p AS (SELECT a.metric AS metric_x, b.metric AS metric_y, CASE WHEN a.derived_from = b.metric OR b.derived_from = a.metric THEN 'derived' WHEN a.derived_from = b.derived_from THEN 'same_source' WHEN a.family = b.family THEN 'same_family' END AS reason FROM c a JOIN c b ON a.metric < b.metric)
SELECT * FROM p WHERE reason IS NOT NULL"""
)
def coupled_metrics(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    origin = nations.select(F.col("n_nationkey").alias("origin"), F.col("n_name").alias("derived_from"))
    from_ = F.when(F.col("n_nationkey") % 4 == 1, F.floor(F.col("n_nationkey") / 8).cast("int"))
    catalog = nations.select(F.col("n_name").alias("metric"), F.col("n_regionkey").alias("family"), from_.alias("origin")).join(origin, "origin", "left")
    return evidence.coupled(catalog.select("metric", "family", "derived_from"))


SPANS = """WITH s AS (SELECT event_id AS id, user_id, CAST(ts AS DATE) AS start, CASE WHEN event_id % 3 > 0 THEN CAST(ts AS DATE) + CAST(event_id % 4 AS INTEGER) END AS stop FROM events WHERE event_type = 'signup'),
c AS (SELECT *, coalesce(stop, start + 6) AS last_day FROM s)
"""


@query(
    SPANS
    + """SELECT id, last_day, EXISTS (SELECT 1 FROM c o WHERE o.user_id = c.user_id AND o.id <> c.id AND (o.start = c.start OR o.start < c.start AND o.stop >= c.start OR c.start < o.start AND c.stop >= o.start)) AS conflict FROM c"""
)
def conflicting_weeks(spark, sf_dir):
    start = F.to_date("ts")
    rows = table(spark, sf_dir, "events").where("event_type = 'signup'")
    spans = rows.select(F.col("event_id").alias("id"), "user_id", start.alias("start"), F.when(F.col("event_id") % 3 > 0, F.date_add(start, (F.col("event_id") % 4).cast("int"))).alias("stop"))
    return evidence.conflicting(spans, "user_id").select("id", "last_day", "conflict")
