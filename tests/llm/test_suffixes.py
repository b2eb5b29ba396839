import random

import numpy as np
import pytest

from pulsegrid.llm import suffixes


def test_sliding_min():
    values = np.random.default_rng(0).integers(0, 50, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 64, 101):
        assert suffixes.sliding_min(values, width).tolist() == [values[i : i + width].min() for i in range(200 - width + 1)]


def _corpus(seed):
    rng = random.Random(seed)
    letters = rng.choice(["ab", "abcdefgh ", "éa "])
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [text(rng.randint(20, 90)) for _ in range(6)]
    docs = [None, "", "a" * 300, "a" * 41, "ab" * 60, shared[0], shared[0], text(39), text(40)]
    for _ in range(60):
        body = text(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(body))
            part = rng.choice(shared)
            body = body[:at] + part[rng.randint(0, 10) : len(part) - rng.randint(0, 10)] + body[at:]
        docs.append(body)
    for _ in range(20):  # near copies
        body = list(docs[20] + docs[21] + shared[1])
        body[rng.randrange(len(body))] = "Z"
        docs.append("".join(body))
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(spark, seed):
    docs = _corpus(seed)
    frame = spark.createDataFrame([(i if i != 12 else None, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, low string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digest(frame, length=40, gram=10, slice_width=8).collect()}
    want = {i if i != 12 else None: w for i, w in enumerate(suffixes.brute_force(docs, 40))}
    assert got == want
    assert sum(w[1] > 0 for w in want.values()) > 10


def test_repeated_rows_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "q" * 10 + "w" * 500), (1, "q" * 10 + "w" * 500), (2, "short")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in suffixes.digest(frame).collect()) == [(1, 510), (1, 510), (2, 0)]
    assert suffixes.digest(frame.limit(0)).count() == 0


def test_refinement_doubles_depth_and_settles_suffixes_alone(spark):
    rows = [(1, 0, 0, True, [1, 2, 3, 4]), (2, 0, 0, False, [1, 2, 3, 4]), (3, 0, 0, True, [1, 2, 3, 9]), (4, 0, 0, True, [3, 4, 1, 2]), (5, 0, 0, True, [3, 4, 1, 2]), (6, 0, 0, True, [7, 7, 7, 7])]
    frame = spark.createDataFrame(rows, "row_key long, row_id long, start int, open boolean, buckets array<long>")
    assert sorted(r.row_key for r in suffixes.refined(frame, 4).collect()) == [1, 4, 5]
    assert suffixes.pointer_offsets(400, 100) == [0, 100, 200, 300] and suffixes.pointer_offsets(40, 10) == [0, 10, 20, 30]
    assert suffixes.pointer_offsets(50, 20) == [0, 20, 30, 30] and suffixes.pointer_offsets(7, 7) == [0]


def test_texts_and_clashing_columns(spark):
    long = "é" * 30 + "".join(chr(97 + i % 26) + str(i) for i in range(300))
    names = "doc_id long, text string, row_id string, row_key int, starts string, anchor long, low int"
    frame = spark.createDataFrame([(1, "A" + long, "r", 1, "s", 2, 3), (2, long + "B", None, None, None, None, None), (None, None, "n", 0, "", 0, 0), (3, "plain", "p", 1, "", 1, 1)], names)
    got = {r.doc_id: r for r in suffixes.deduplicated(frame).collect()}
    assert [got[k].text for k in (1, 2, 3, None)] == ["A", "B", "plain", None]
    assert got[1].row_id == "r" and got[None].starts == ""
    assert {r.doc_id: [(s.start, s.stop) for s in r.spans] for r in suffixes.digest(frame).collect()}[1] == [(1, 1 + len(long.encode()))]
