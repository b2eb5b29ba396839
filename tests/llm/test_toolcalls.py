import json
import random

import duckdb

from pulsegrid.llm import toolcalls as t


def test_levels_are_longest_ways(spark):
    rng = random.Random(1)
    edges = {(f"n{i}", f"n{rng.randrange(i)}") for i in range(1, 60) for _ in range(rng.randint(1, 3))}
    edges |= {(f"k{i}", f"k{i - 1}") for i in range(1, 70)} | {("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("d", "n3"), ("s", "s")}
    parents = {}
    for c, p in edges:
        parents.setdefault(c, []).append(p)

    def level(x, seen=()):
        if x in seen:
            return None
        below = [level(p, (*seen, x)) for p in parents.get(x, [])]
        return None if None in below else 1 + max(below, default=-1)

    import sys

    sys.setrecursionlimit(5000)
    memo = {}

    def fast(x):
        if x not in memo:
            memo[x] = None
            below = [fast(p) for p in parents.get(x, [])]
            memo[x] = None if None in below else 1 + max(below, default=-1)
        return memo[x]

    got = {r.node: r.level for r in t.levels(spark.createDataFrame(sorted(edges), "node string, parent string")).collect()}
    assert got == {c: (fast(c) if c[0] in "nk" else None) for c in parents}
    assert level("d") is None
    assert t.levels(spark.createDataFrame([], "node string, parent string")).count() == 0


CALLS = [
    (1, "a", 1, 0, "search", '{"limit": 3, "text":"x"}'),
    (1, "b", 3, 0, "search", '{"text":"x\\n\\u00e9","limit":1.5,"after":{"$ref":"a"}}'),
    (1, "b", 5, 0, "note", '{"text":null}'),
    (1, "c", 7, 0, "note", '{"text":"q","after":{"$ref":"zz"},"z":[1,{"b":1,"a":2}]}'),
    (1, "d", 9, 0, "nosuch", "{}"),
    (1, "e", 9, 1, "note", "[1]"),
    (1, "f", 9, 2, "note", '{"text":'),
    (2, "a", 1, 0, "note", '{"text":"", "after":{"$ref":"b"}}'),
    (2, "b", 2, 0, "note", '{"text":"", "after":{"$ref":"a"}}'),
    (None, "a", 1, 0, "note", None),
    (3, None, None, 0, None, "{}"),
]
RESULTS = [(1, "a", 2, "r1"), (1, "a", 4, "r2"), (1, "b", 2, "early"), (1, "b", 6, None), (9, "a", 1, "lost"), (None, "a", 1, "x")]


def test_linking_validation_and_form(spark):
    calls = spark.createDataFrame(CALLS, "conv_id long, call_id string, turn long, position int, tool string, arguments string")
    results = spark.createDataFrame(RESULTS, "conv_id long, call_id string, turn long, text string")
    got = {(r.conv_id, r.call_id, r.turn): r for r in t.link(calls, results, t.schema_table(spark)).collect()}
    assert len(got) == len(CALLS)
    state = {k: (r.state, r.level, r.result_turn, r.errors) for k, r in got.items()}
    assert state[1, "a", 1] == ("answered", 0, 2, [])
    assert state[1, "b", 3] == ("answered", 1, 6, ["type:limit"])
    assert state[1, "b", 5][0] == "duplicate" and state[1, "b", 5][3] == ["type:text"]
    assert state[1, "c", 7] == ("pending", 0, None, ["unknown:z"]) and got[1, "c", 7].dangling == ["zz"]
    assert [state[1, x, 9][3] for x in "def"] == [["no_schema"], ["not_object"], ["malformed"]]
    assert state[2, "a", 1][1] is None and state[2, "b", 2][1] is None
    assert state[None, "a", 1][0] == state[3, None, None][0] == "unlinked"
    assert got[1, "c", 7].canonical == json.dumps({"arguments": {"after": {"$ref": "zz"}, "text": "q", "z": [1, {"a": 2, "b": 1}]}, "depends_on": ["zz"], "id": "c", "name": "note"}, separators=(",", ":"))
    assert json.loads(got[1, "b", 3].canonical)["arguments"]["text"] == "x\né"
    lost = t.orphans(calls, results).collect()
    assert sorted(str(r.conv_id) for r in lost) == ["9", "None"]
    assert t.link(calls.limit(0), results, t.schema_table(spark)).count() == 0
    assert "Python" not in t.link(calls, results, t.schema_table(spark))._jdf.queryExecution().executedPlan().toString()


def test_query_equals_sql(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = t.digest(turns)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    names = sorted(got.columns)
    want = con.execute(f"select {', '.join(names)} from ({t.ORACLE})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(*names).collect())


def test_ids_of_any_characters_equal_calls_and_extra_columns(spark):
    odd = ["b\\q", 'say "hi"', "tab\there", "é\u0001", "", '","', "$ref"]
    calls = [(1, x, 1, 0, "note", '{"text":"t"}', 5) for x in odd]
    calls += [(1, "user", 2, 0, "note", json.dumps({"text": 'not a "$ref":"zz" one', "after": {"$ref": x, "deep": [{"$ref": "b\\q"}]}}), 5) for x in odd]
    calls += [(2, "twin", 1, 0, "note", "{}", 5)] * 3 + [(None, None, None, None, None, None, None)] * 2
    calls = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, position int, tool string, arguments string, node int")
    results = spark.createDataFrame([(2, "twin", 2, "r")] * 2 + [(2, "twin", k, "later") for k in range(3, 50)], "conv_id long, call_id string, turn long, text string")
    got = t.link(calls, results, t.schema_table(spark)).collect()
    assert len(got) == calls.count()
    users = [r for r in got if r.call_id == "user"]
    assert {r.level for r in users} == {1} and all(r.dangling == [] for r in users)
    assert sorted(x for r in users for x in json.loads(r.canonical)["depends_on"] if x != "b\\q") == sorted(odd[1:])
    assert sorted(r.state for r in got if r.conv_id == 2) == ["answered", "duplicate", "duplicate"]
    assert [r.state for r in got if r.conv_id is None] == ["unlinked"] * 2
