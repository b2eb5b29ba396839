import random
import sqlite3

import duckdb
import pytest

from pulsegrid.functions import stems

#: Worked examples of the published algorithm, step by step, as whole stems.
KNOWN = """caresses caress, ponies poni, ties ti, caress caress, cats cat, feed feed, agreed agre, plastered plaster, bled bled, motoring motor, sing sing, conflated conflat, troubled troubl,
sized size, hopping hop, tanned tan, falling fall, hissing hiss, fizzed fizz, failing fail, filing file, happy happi, sky sky, relational relat, conditional condit, rational ration,
valenci valenc, digitizer digit, conformabli conform, radicalli radic, vietnamization vietnam, predication predic, operator oper, feudalism feudal, decisiveness decis, hopefulness hope,
callousness callous, formaliti formal, sensitiviti sensit, sensibiliti sensibl, triplicate triplic, formative form, formalize formal, electriciti electr, electrical electr, hopeful hope,
goodness good, revival reviv, allowance allow, inference infer, airliner airlin, gyroscopic gyroscop, adjustable adjust, defensible defens, irritant irrit, replacement replac, adjustment adjust,
dependent depend, adoption adopt, homologou homolog, communism commun, activate activ, angulariti angular, homologous homolog, effective effect, bowdlerize bowdler, probate probat, rate rate,
cease ceas, controll control, roll roll, does doe, are ar, was wa, this thi, they thei, being be, by by, say sai, enjoys enjoi, toying toi, yyyy yyyi, syzygy syzygi"""


@pytest.fixture(scope="module")
def words():
    rng = random.Random(5)
    ends = [*stems.SECOND, *stems.THIRD, *stems.FOURTH, "ed", "ing", "s", "es", "y", "e", "ll", "ion", "eed", ""]
    made = {"".join(rng.choice("abcdeilmnorstuvyz") for _ in range(rng.randint(1, 6))) + rng.choice(ends) + rng.choice(["", "", "s", "ly"]) for _ in range(4000)}
    return sorted(made | {"a", "is", "x" * 70, "1990s", "b2b"})


def test_worked_examples(spark):
    pairs = dict(x.split() for x in KNOWN.replace("\n", " ").split(", "))
    got = {r.term: r.stem for r in stems.stem_table(spark.createDataFrame([(w,) for w in pairs], "term string")).collect()}
    assert {w: got[w] for w in pairs if w not in ("yyyy",)} == {w: s for w, s in pairs.items() if w not in ("yyyy",)}


def test_agrees_with_another_implementation(spark, words):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table t using fts5(body, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("this SQLite has no full-text search")
    con.execute("create virtual table v using fts5vocab('t', 'instance')")
    con.executemany("insert into t(rowid, body) values (?, ?)", list(enumerate(words)))
    want = {words[doc]: term for term, doc in con.execute("select term, doc from v")}
    got = {r.term: r.stem for r in stems.stem_table(spark.createDataFrame([(w,) for w in words], "term string")).collect()}
    differ = {w: (got[w], want[w]) for w in words if got[w] != want[w]}
    assert not differ, (len(differ), dict(list(differ.items())[:20]))


def test_sql_agrees(spark, words):
    con = duckdb.connect()
    con.execute("create table words (term varchar)")
    con.executemany("insert into words values (?)", [(w,) for w in words])
    want = dict(con.execute("WITH " + stems.stem_table_sql("words") + " SELECT term, stem FROM stems").fetchall())
    got = [(r.term, r.stem) for r in stems.stem_table(spark.createDataFrame([(w,) for w in words + words[:9]], "term string")).collect()]
    assert dict(got) == want and len(got) == len(words)
    # what the cheap test of a word rests on
    assert all(w.startswith(s[:-1]) for w, s in got)


def test_words_in_rows_agree(spark, words):
    assert {w: stems.stem_of(w) for w in words} == {r.term: r.stem for r in stems.stem_table(spark.createDataFrame([(w,) for w in words], "term string")).collect()}
    rows = [(1, ["ponies", None, "cats", "ponies"]), (2, None), (3, []), (4, ["x" * 70, "by"])]
    frame = spark.createDataFrame(rows, "id long, t array<string>").where("id > 0")
    got = {r.id: r.s for r in frame.select("id", stems.stems_of("t").alias("s")).collect()}
    assert got == {1: ["poni", None, "cat", "poni"], 2: None, 3: [], 4: ["x" * 70, "by"]}
