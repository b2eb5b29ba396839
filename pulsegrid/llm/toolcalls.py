"""Tool-call linking for chat logs, in DataFrame operations only.

Calls and results are joined by identifier, calls are ordered topologically by the
references in their arguments, arguments are checked against the tools' schemas, and
every call is serialised as canonical JSON (keys sorted, no spaces).  Nothing is
gathered by conversation, so one endless conversation spreads like any other rows:
the order of a conversation's calls is (level, turn, position).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrid.llm.storage import written

#: A reference in canonical JSON, its id still escaped.  A quote inside a string is
#: escaped there, so no string value can look like a key.
REF = r'"\$ref"\s*:\s*"([^"\\]*+(?:\\.[^"\\]*+)*+)"'


def first_by(df: DataFrame, keys: list[str], order: Column, name: str = "first") -> DataFrame:
    """The smallest ``order`` of each key."""
    return df.groupBy(*keys).agg(F.min(order).alias(name))


def levels(edges: DataFrame) -> DataFrame:
    """``node`` and ``level`` of every child of the edges (node, parent).

    The level is the longest way down from a node without parents, which have level 0;
    it is null in and behind cycles.  A round puts a parent's own edges in its place
    where it has at most one that is still open, so chains halve and every round
    settles at least one generation; settled ways are kept as edges to null."""
    now = written(edges.select("node", "parent", F.lit(1).cast("long").alias("d")).where("node is not null and parent is not null").distinct(), "levels")
    left = None
    while True:
        still = now.where("parent is not null").select("node").distinct().count()
        if still == 0 or still == left:
            break
        left = still
        own = now.groupBy(F.col("node").alias("parent")).agg(
            F.count("parent").alias("open"),
            F.max(F.when(F.col("parent").isNull(), F.col("d"))).alias("settled"),
            F.max_by("parent", F.when(F.col("parent").isNotNull(), F.col("d"))).alias("next"),
            F.max(F.when(F.col("parent").isNotNull(), F.col("d"))).alias("step"),
        )
        ways = F.when(F.col("open").isNull(), F.array(F.struct(F.lit(None).cast("string").alias("p"), F.lit(0).cast("long").alias("e"))))
        ways = ways.when(F.col("open") > 1, F.array(F.struct(F.col("parent").alias("p"), F.lit(0).cast("long").alias("e"))))
        ways = ways.otherwise(
            F.filter(
                F.array(F.struct(F.lit(None).cast("string").alias("p"), F.col("settled").alias("e")), F.struct(F.col("next").alias("p"), F.col("step").alias("e"))),
                lambda w: w["e"].isNotNull(),
            )
        )
        moved = now.where("parent is not null").join(own, "parent", "left").withColumn("w", F.explode(ways)).select("node", F.col("w.p").alias("parent"), (F.col("d") + F.col("w.e")).alias("d"))
        now = written(now.where("parent is null").unionByName(moved).groupBy("node", "parent").agg(F.max("d").alias("d")), "levels")
    return now.groupBy("node").agg(F.when(F.count("parent") == 0, F.max("d")).alias("level"))


def _kind(found: Column) -> Column:
    """JSON schema type of what schema_of_variant says."""
    name = F.regexp_extract(found, "^[A-Z]+", 0)
    return (
        F.when(name == "STRING", "string")
        .when((name == "BIGINT") | found.rlike("^DECIMAL\\(\\d+,0\\)"), "integer")
        .when(name.isin("DECIMAL", "DOUBLE", "FLOAT"), "number")
        .when(name == "BOOLEAN", "boolean")
        .when(name == "OBJECT", "object")
        .when(name == "ARRAY", "array")
        .otherwise("null")
    )


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with ``parsed`` (a variant), and ``errors``: sorted words such as
    ``missing:x``, ``type:x``, ``unknown:x``, or ``malformed``, ``not_object``, ``no_schema``.

    ``schemas`` has a row for each parameter: tool, param, type, required."""
    known = schemas.where("tool is not null and param is not null").groupBy("tool").agg(F.collect_set(F.struct("param", "type", "required")).alias("params"))
    rows = calls.withColumn("parsed", F.try_parse_json("arguments"))
    rows = rows.withColumn("kinds", F.transform_values(F.try_variant_get("parsed", "$", "map<string,variant>"), lambda _, v: F.coalesce(_kind(F.schema_of_variant(v)), F.lit("null"))))
    rows = rows.join(known, "tool", "left")
    wrong = lambda p: F.element_at("kinds", p["param"]).isNotNull() & (F.element_at("kinds", p["param"]) != p["type"]) & ~((p["type"] == "number") & (F.element_at("kinds", p["param"]) == "integer"))
    found = F.concat(
        F.transform(F.filter("params", lambda p: p["required"] & ~F.map_contains_key("kinds", p["param"])), lambda p: F.concat(F.lit("missing:"), p["param"])),
        F.transform(F.filter("params", wrong), lambda p: F.concat(F.lit("type:"), p["param"])),
        F.transform(F.array_except(F.map_keys("kinds"), F.transform("params", lambda p: p["param"])), lambda k: F.concat(F.lit("unknown:"), k)),
    )
    errors = (
        F.when(F.col("parsed").isNull(), F.array(F.lit("malformed")))
        .when(F.col("kinds").isNull(), F.array(F.lit("not_object")))
        .when(F.col("params").isNull(), F.array(F.lit("no_schema")))
        .otherwise(F.array_sort(found))
    )
    return rows.withColumn("errors", errors).drop("kinds", "params")


def references(parsed: Column) -> Column:
    """Different ids that a variant refers to, at any depth, as they read unescaped."""
    raw = F.regexp_extract_all(F.coalesce(F.to_json(parsed), F.lit("")), F.lit(REF), F.lit(1))
    read = F.from_json(F.concat(F.lit('["'), F.array_join(raw, '","'), F.lit('"]')), "array<string>")
    return F.when(F.size(raw) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(read))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call: its level, result, errors and canonical JSON.

    ``calls``: conv_id, call_id, turn, position, tool, arguments.  ``results``: conv_id,
    call_id, turn, text.  A call's result is the first one after it with its id in its
    conversation; where an id repeats, the first call gets it and the others are
    ``duplicate``, of equal calls all but one.  Calls without a result are ``pending``,
    calls without an id or conversation ``unlinked``: those are met by nothing and never
    join.  ``level`` is null in and behind cycles of references; references to unknown
    ids don't count and are listed in ``dangling``.  Empty tables give no rows.

    Joins run over thin rows (hashes in place of arguments); a call's arguments are
    shuffled once to count its copies and once to meet what was found about it."""
    named = ["conv_id", "call_id", "turn", "position", "tool", "arguments"]
    key = F.to_json(F.array(F.col("conv_id").cast("string"), F.col("call_id")))
    place = F.struct("turn", "position", "tool", F.md5("arguments").alias("body"))
    kinds = calls.select(*named).groupBy(*named).agg(F.count("*").cast("int").alias("copies"))
    held = validated(kinds, schemas).withColumn("node", F.when(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull(), key))
    held = held.withColumns({"refs": F.when(F.col("parsed").isNotNull(), references(F.col("parsed"))).otherwise(F.array().cast("array<string>")), "place": place})
    nodes = F.col("node").isNotNull()
    thin = written(held.where(nodes).select("node", "conv_id", "place", "refs"), "calls")
    heads = first_by(thin, ["node"], F.col("place"), "head")
    edges = thin.select("node", "conv_id", F.explode("refs").alias("call_id")).select("node", "call_id", key.alias("parent"))
    met = edges.join(heads.select(F.col("node").alias("parent"), F.lit(True).alias("found")), "parent", "left")
    ranked = levels(met.where("found").select("node", "parent")).withColumn("ordered", F.lit(True))
    missing = met.where("found is null").groupBy("node").agg(F.array_sort(F.collect_set("call_id")).alias("dangling"))
    # results of one id and turn meet before the join: a call asked often costs one row a turn
    answers = results.where("conv_id is not null and call_id is not null").withColumn("node", key).groupBy("node", F.col("turn").alias("result_turn")).agg(F.min("text").alias("result"))
    timely = answers.hint("shuffle_hash").join(heads, "node").where("result_turn > head.turn or head.turn is null")
    answers = timely.groupBy("node").agg(F.min(F.struct("result_turn", "result")).alias("answer"))
    facts = heads.join(ranked, "node", "left").join(missing, "node", "left").join(answers, "node", "left")
    linked = held.where(nodes).join(facts, "node")
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in facts.schema.fields if f.name != "node"}
    joined = linked.unionByName(held.where(~nodes).withColumns(nothing)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    primary = nodes & F.col("place").eqNullSafe(F.col("head")) & (F.col("copy") == 1)
    state = F.when(~nodes, "unlinked").when(~primary, "duplicate").when(F.col("answer").isNull(), "pending").otherwise("answered")
    result = F.when(state == "answered", F.col("answer.result"))
    canonical = F.to_json(F.struct(F.col("parsed").alias("arguments"), F.array_sort("refs").alias("depends_on"), F.col("call_id").alias("id"), F.col("tool").alias("name"), result.alias("result")))
    return joined.select(
        "conv_id",
        "call_id",
        "turn",
        "position",
        "tool",
        F.when(F.col("ordered").isNull(), F.lit(0).cast("long")).otherwise(F.col("level")).alias("level"),
        state.alias("state"),
        F.when(state == "answered", F.col("answer.result_turn")).alias("result_turn"),
        "errors",
        F.coalesce("dangling", F.array().cast("array<string>")).alias("dangling"),
        canonical.alias("canonical"),
    )


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results that no call of their conversation asked for."""
    ids = calls.where("conv_id is not null and call_id is not null").select("conv_id", "call_id")
    return results.join(ids, ["conv_id", "call_id"], "left_anti")


SCHEMAS = [("search", "text", "string", True), ("search", "limit", "integer", True), ("search", "after", "object", False), ("note", "text", "string", True), ("note", "limit", "number", False), ("note", "after", "object", False)]


def schema_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{t}', '{p}', '{k}', {str(r).lower()})" for t, p, k, r in SCHEMAS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(tool, param, type, required)")


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read out of plain conversations.

    Every assistant turn is a call whose arguments hold its text, the turn after it the
    result.  Outside the first two of every 16 turns a call refers to the call two
    turns earlier.  Lengths divisible by 5, 7, 11 and 13 give an unknown argument, a
    missing one, one of a wrong type and broken JSON."""
    size = F.length("text")
    quoted = F.to_json(F.array("text"))
    quoted = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    ident = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    has = lambda k: size % k == 0
    parts = [
        F.when(~has(7), F.concat(F.lit('"text" : '), quoted)),
        F.when(has(11), F.concat(F.lit('"limit":"'), (size % 9).cast("string"), F.lit('"'))).otherwise(F.concat(F.lit('"limit":'), (size % 9).cast("string"))),
        F.when(has(5), F.lit('"debug":true')),
        F.when(F.col("turn") % 16 > 1, F.concat(F.lit('"after":{"$ref":"'), ident(F.col("turn") - 2), F.lit('"}'))),
    ]
    body = F.concat(F.lit("{ "), F.concat_ws(", ", *parts), F.when(has(13), "").otherwise("}"))
    calls = turns.where("role = 'assistant' and text is not null").select("conv_id", ident(F.col("turn")).alias("call_id"), "turn", F.lit(0).alias("position"), F.when(size % 2 == 0, "search").otherwise("note").alias("tool"), body.alias("arguments"))
    results = turns.where("turn is not null").select("conv_id", ident(F.col("turn") - 1).alias("call_id"), "turn", "text")
    return calls, results


def digest(turns: DataFrame) -> DataFrame:
    """One row per assistant turn with a text: how its call was linked, ordered and judged.

    Turns without a text make no call, and none is their result; a repeated turn is a
    repeated call, which ``link`` tells; an empty table has no calls."""
    calls, results = from_conversations(turns)
    rows = link(calls, results, schema_table(turns.sparkSession))
    return rows.select("conv_id", "call_id", "turn", "tool", "level", "state", "result_turn", F.array_join("errors", ",").alias("errors"), F.array_join("dangling", ",").alias("dangling"), F.sha2("canonical", 256).alias("canonical_sha256"))


ORACLE = """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, text, length(text) AS n,
         'c' || conv_id || '-' || turn AS call_id,
         CASE WHEN turn % 16 > 1 THEN 'c' || conv_id || '-' || (turn - 2) END AS ref,
         CASE WHEN length(text) % 2 = 0 THEN 'search' ELSE 'note' END AS tool
  FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
judged AS (
  SELECT c.*, n % 13 = 0 AS broken, CASE WHEN n % 13 <> 0 THEN ref END AS used FROM calls c),
ranked AS (
  SELECT j.call_id, CAST(0 AS BIGINT) AS level FROM judged j
  WHERE used IS NULL OR used NOT IN (SELECT call_id FROM judged)
  UNION ALL
  SELECT j.call_id, r.level + 1 FROM judged j JOIN ranked r ON j.used = r.call_id)
SELECT j.conv_id, j.call_id, j.turn, j.tool, r.level,
  CASE WHEN t.turn IS NULL THEN 'pending' ELSE 'answered' END AS state,
  t.turn AS result_turn,
  CASE WHEN broken THEN 'malformed' ELSE concat_ws(',',
    CASE WHEN n % 7 = 0 THEN 'missing:text' END,
    CASE WHEN n % 11 = 0 THEN 'type:limit' END,
    CASE WHEN n % 5 = 0 THEN 'unknown:debug' END) END AS errors,
  CASE WHEN used IS NOT NULL AND used NOT IN (SELECT call_id FROM judged) THEN used ELSE '' END AS dangling,
  sha256('{' || CASE WHEN broken THEN '' ELSE '"arguments":{' || concat_ws(',',
      CASE WHEN used IS NOT NULL THEN '"after":{"$ref":"' || used || '"}' END,
      CASE WHEN n % 5 = 0 THEN '"debug":true' END,
      CASE WHEN n % 11 = 0 THEN '"limit":"' || (n % 9) || '"' ELSE '"limit":' || (n % 9) END,
      CASE WHEN n % 7 <> 0 THEN '"text":' || CAST(to_json(j.text) AS VARCHAR) END) || '},' END
    || '"depends_on":[' || CASE WHEN used IS NOT NULL THEN '"' || used || '"' ELSE '' END || '],"id":"' || j.call_id || '","name":"' || tool || '"'
    || CASE WHEN t.text IS NOT NULL THEN ',"result":' || CAST(to_json(t.text) AS VARCHAR) ELSE '' END || '}') AS canonical_sha256
FROM judged j JOIN ranked r USING (call_id) LEFT JOIN conversations t ON t.conv_id = j.conv_id AND t.turn = j.turn + 1
"""
