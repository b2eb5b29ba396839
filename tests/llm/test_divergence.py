import random

import duckdb
import numpy as np
import pytest

from pulsegrid.llm import divergence as d

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, rank int, block int"


def rows(rng, n):
    vocabulary = [f"{a}{b}" for a in ("x", "Y", "zä", "Ünd", "q") for b in "abcdefghij"]
    pick = lambda k: rng.choices(vocabulary, [1 + (i * k) % 7 for i in range(len(vocabulary))], k=rng.randint(0, 40))
    out = [(k, " 1".join(pick(k)), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "ü", None]), "t", 1, 2, 3) for k in range(n)]
    return out + [(1, None, "en", "none", *[None] * 4), (2, "!? 12", "xx", "a", *[None] * 4), (2, "", "xx", "b", *[None] * 4), (None, "lone", "xx", "c", *[None] * 4)] + [(4, "same Same same", "de", "b", *[None] * 4)] * 6


def by_sql(data):
    con = duckdb.connect()
    con.execute("create table documents (text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [r[1:4] for r in data])
    return sorted(con.execute(d.ORACLE).fetchall())


@pytest.mark.parametrize("options", [{}, {"block_rows": 7, "run_bytes": 60}])
def test_equals_sql(spark, options):
    data = rows(random.Random(2), 150)
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in d.digest(docs, **options).collect())
    assert got == by_sql(data)
    assert {r[0] for r in got} == {"", "de", "en", "xx"}
    assert [r for r in got if r[0] == "xx"] == [("xx", s, "pair", o, 0, k) for s in "abc" for k, o in enumerate("abc".replace(s, ""), 1)]


def test_many_terms_stop_at_the_last_rank(spark):
    data = [(k, " ".join(chr(97 + i // 26) + chr(97 + i % 26) * (1 + k % 2) for i in range(300)), "en", f"s{k % 2}", *[None] * 4) for k in range(8)]
    got = sorted(tuple(r) for r in d.digest(spark.createDataFrame(data, SCHEMA)).collect())
    assert got == by_sql(data)
    assert max(r[5] for r in got if r[2] == "term") == d.TOP_TERMS


def test_equal_hashes_of_different_terms_are_told_apart():
    raw = "alpha beta alpha gamma delta beta epsil gamma".encode()
    low = np.frombuffer(raw, np.uint8)
    starts, stops = d.bounds(d.TERM_BYTE[low], np.array([0, len(low)]))
    for weak in (len, lambda s: 0, d.xxhash.xxh3_64_intdigest):
        term, first = d.grouped_slices(low, starts, stops, weak)
        names = [raw[starts[first[t]] : stops[first[t]]] for t in term]
        assert names == raw.split()
        assert len(first) == 5


def test_shares_and_distances_are_exact():
    rng = random.Random(1)
    n = np.array([0, 1, 10**12, *[rng.randrange(10**14) for _ in range(50)]], np.int64)
    whole = np.array([1, 7, 10**12 + 1, *[int(x) + 1 + rng.randrange(10**14) for x in n[3:]]], np.int64)
    assert d.share(n, whole).tolist() == [1 + 10**9 * (int(a) + 1) // int(b) for a, b in zip(n, whole, strict=True)]
    assert d.distance(np.array([10**9 + 1]), np.array([1])).tolist() == [10**18]


def test_a_block_equals_the_dense_sum():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 4, (6, 30)) * (rng.random((6, 30)) < 0.3)
    counts[2] = 0
    row, term = np.nonzero(counts)
    term = np.unique(term, return_inverse=True)[1].reshape(-1)
    dense = np.zeros((6, term.max() + 1), np.int64)
    dense[row, term] = counts[np.nonzero(counts)]
    whole = dense.sum(1) + 30
    got = d.block_divergence(row, term, dense[row, term], whole)
    p = d.share(dense, whole[:, None])
    assert got.tolist() == [[int(d.distance(p[g], p[h]).sum()) for h in range(6)] for g in range(6)]


def test_a_text_longer_than_a_run_counts_as_one_document(spark):
    data = [(1, "lang " * 3000 + "wort", "en", "a", *[None] * 4), (2, "wort lang", "en", "b", *[None] * 4), (3, "Lang wort", "en", "b", *[None] * 4)]
    got = sorted(tuple(r) for r in d.digest(spark.createDataFrame(data, SCHEMA), run_bytes=100).collect())
    assert got == by_sql(data)


def test_empty_table(spark):
    assert d.digest(spark.createDataFrame([], SCHEMA)).count() == 0
