import random
from fractions import Fraction

import duckdb
import pytest

from pulsegrid.llm import apportion as a

SCHEMA = "doc_id long, text string, source string, passes string, spans string, key string, n long"


def seats_by_hand(weights, house):
    """The highest quotients, one seat after another."""
    won = dict.fromkeys(weights, 0)
    for _ in range(house):
        best = min(weights, key=lambda k: (-weights[k] / (2 * won[k] + 1), k))
        won[best] += 1
    return won


@pytest.mark.parametrize("case", ["mixed", "one giant and many small", "few seats", "ties"])
def test_seats_are_the_highest_quotients(spark, case):
    rng = random.Random(case)
    weights, house = {
        "mixed": ({f"p{k:03}": float(rng.randint(0, 10_000)) for k in range(40)}, 500),
        "one giant and many small": ({f"p{k:03}": 60.0 if k else 1_000_000.0 for k in range(200)}, 10_000),
        "few seats": ({f"p{k:03}": float(rng.randint(1, 9)) for k in range(50)}, 7),
        "ties": ({f"p{k:03}": 5.0 for k in range(9)}, 13),
    }[case]
    rows = [("g", k, w, house) for k, w in weights.items()] + [("h", k, w, 3) for k, w in weights.items()]
    got = a.apportioned(spark.createDataFrame(rows, "g string, party string, weight double, house long"), "g", "party").collect()
    want = {k: w for k, w in weights.items() if w > 0}
    for group, seats in (("g", house), ("h", 3)):
        by_hand = dict.fromkeys(weights, 0) | seats_by_hand(want, seats)
        assert {r.party: r.seats for r in got if r.g == group} == by_hand


def test_targets_stop_at_the_cap_and_are_shared_again(spark):
    sizes = {"0a": 10, "0b": 1000, "0c": 700, "0d": 0, "0e": 40, "1": 300}
    weights = dict(zip(sorted(sizes), [5, 2, 1, 5, 2, 1], strict=True))
    left, full = Fraction(3, 2) * sum(sizes.values()), {}
    while True:
        level = left / sum(w for k, w in weights.items() if k not in full)
        over = {k: 2 * sizes[k] for k in sizes if k not in full and level * weights[k] > 2 * sizes[k]}
        if not over:
            break
        full |= over
        left -= sum(over.values())
    want = {k: float(full.get(k, level * weights[k])) for k in sizes}
    got = {r.source_key: r.target for r in a.targets(spark.createDataFrame(list(sizes.items()), "source_key string, source_size long")).collect()}
    assert got == pytest.approx(want)


def documents(rng, n):
    rows = [(k, " \t".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(0, 400))), "hot" if rng.random() < 0.4 else f"s{rng.randrange(6)}", "x", "y", "z", 7) for k in range(n)]
    return rows + [(None, "a b", None, None, None, None, None), (5, None, None, None, None, None, None), (7, "", "empty", None, None, None, None), (7, " \n\x0b ", "empty", None, None, None, None)] + [(9, "one two three", "twin", None, None, None, None)] * 5


def test_every_source_comes_near_its_target(spark):
    docs = spark.createDataFrame(documents(random.Random(3), 400), SCHEMA).repartition(5)
    options = {"block_words": 16, "shard_words": 4000}
    got = a.mixed(docs, **options).collect()
    assert len(got) == 409
    assert [r.size for r in got if r.doc_id == 7 and r.source == "empty"] == [0, 0]
    sums = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        assert r.taken == r.passes * r.size + sum(s.stop - s.start for s in r.spans)
        assert all(0 <= s.start < s.stop <= r.size for s in r.spans) and all(x.stop <= y.start for x, y in zip(r.spans, r.spans[1:], strict=False))
        held = sums.setdefault(r.source, [0, r.target, 0])
        held[0] += r.taken
        held[2] += r.size
    for taken, target, size in sums.values():
        # at most a block a shard
        assert abs(taken - target) <= 16 * (1 + size // 4000)
    again = a.mixed(docs.repartition(2, "text"), **options).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_pieces_are_the_words_taken(spark):
    docs = spark.createDataFrame(documents(random.Random(4), 60), SCHEMA)
    told_apart, taken = "doc_id is not null and source not in ('twin', 'empty')", {}
    texts = {x[0]: x[1] for x in documents(random.Random(4), 60)[:60]}
    for r in a.mixed(docs, block_words=8).where(told_apart).collect():
        words = texts[r.doc_id].split()
        taken[r.doc_id] = sorted([words] * r.passes + [words[s.start : s.stop] for s in r.spans]) if r.taken else []
    pieces = {}
    for r in a.mixture(docs, block_words=8).where(told_apart).collect():
        assert len(r.text.split()) == r.size and r.text == r.text.strip()
        pieces.setdefault(r.doc_id, []).append(r.text.split())
    assert {k: sorted(v) for k, v in pieces.items()} == {k: v for k, v in taken.items() if v}


def test_agrees_with_sql_on_awkward_rows(spark):
    rows = documents(random.Random(5), 300)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [r[:3] for r in rows])
    got = [tuple(r) for r in a.digest(spark.createDataFrame(rows, SCHEMA)).collect()]
    want = con.execute(a.ORACLE).fetchall()
    order = lambda r: tuple((x is None, x) for x in r)
    # equal rows may share the words of a block otherwise in SQL, which joins them by their places
    assert sorted(got, key=order) == sorted(want, key=order)


def test_empty_tables_and_blank_texts(spark):
    assert a.mixed(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = a.digest(spark.createDataFrame([(1, "  ", "s", *[None] * 4), (2, None, None, *[None] * 4)], SCHEMA)).collect()
    assert sorted(tuple(r) for r in blank) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_words_of_blanks_are_counted_in_one_way(spark):
    texts = ["", " ", "a", " a", "a ", "a\tb", "\n\n a  b\x0b\x0cc \r", "a\xa0b", "é ü x", "\x1fa \x00"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(a.n_words(__import__("pyspark").sql.functions.col("t"))).collect()
    import re

    assert [r[0] for r in got] == [len(re.findall("[^\x20\x09-\x0d]+", t)) for t in texts]
