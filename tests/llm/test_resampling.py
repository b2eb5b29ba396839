import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import resampling as r

SCHEMA = "doc_id long, text string, row long, score long, weight string, place long, n long"


def documents(rng, n):
    words = ["Alpha", "beta", "Gamma's", "ünder", "9", "x" * 70, "delta-epsilon", "東京", "y" * 300]
    return [(k, rng.choice([" ", "\n", " .. "]).join(rng.choices(words, k=rng.randint(0, 60))), k, 1, "w", 2, 3) for k in range(n)] + [(n, None, *[None] * 5), (n + 1, "", *[None] * 5), (n + 2, "?!", *[None] * 5)]


TARGET = ["alpha beta beta gamma", "Alpha beta", None, "", "delta epsilon 東京 " + "y" * 300]


@pytest.mark.parametrize("options", [{}, {"chunk_words": 7}, {"chunk_words": 1}, {"percent": 30}, {"least_words": 1}])
def test_equals_the_contract_read_feature_by_feature(spark, options):
    data = documents(random.Random(8), 120)
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = {x.doc_id: [x.n_features, x.weight, x.score, x["rank"]] for x in r.digest(docs, spark.createDataFrame([(t, 5) for t in TARGET], "text string, doc_id int"), **options).collect()}
    want = r.brute_force([(x[0], x[1]) for x in data], TARGET, **{k: v for k, v in options.items() if k != "chunk_words"})
    assert got == want


def test_checksums_of_slices_and_concatenations():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 4000, dtype=np.uint8)
    starts = np.sort(rng.integers(0, 3500, 200))
    stops = starts + rng.integers(0, 400, 200)
    stops[:3] = starts[:3] + [0, 64, 65]
    crc = r.Crc()
    raw = data.tobytes()
    one = crc.of(data, starts, stops)
    assert one.tolist() == [zlib.crc32(raw[a:b]) for a, b in zip(starts, stops, strict=True)]
    left = rng.integers(0, 1 << 32, 200, dtype=np.uint32)
    both = crc.shifted(np.array([zlib.crc32(b"%d" % x) for x in left], np.uint32), stops - starts) ^ one
    assert both.tolist() == [zlib.crc32(b"%d" % x + raw[a:b]) for x, a, b in zip(left.tolist(), starts, stops, strict=True)]


def test_repeated_rows_null_ids_and_ties(spark):
    text = " ".join(f"w{k}" for k in range(30))
    data = [(7, text, *[None] * 5)] * 40 + [(None, text, *[None] * 5)] * 3 + [(8, "short", *[None] * 5)]
    got = r.digest(spark.createDataFrame(data, SCHEMA), spark.createDataFrame([("w1 w2",)], "text string"), percent=10).collect()
    assert len(got) == 44
    drawn = sorted(x["rank"] for x in got if x["rank"] is not None)
    assert drawn == [1, 2, 3, 4]
    assert len({(x.weight, x.score) for x in got if x.doc_id == 7}) == 1
    best = max(x.score for x in got if x.n_features > 20)
    assert all(x.score == best for x in got if x["rank"] == 1)


def test_drawn_documents_keep_their_columns(spark):
    data = documents(random.Random(9), 80)
    docs = spark.createDataFrame(data, SCHEMA)
    target = spark.createDataFrame([("alpha beta",)], "text string")
    want = {x.doc_id for x in r.digest(docs, target, percent=20).where("rank is not null").collect()}
    got = r.sample(docs, target, percent=20)
    assert got.schema == docs.schema
    assert {x.doc_id: tuple(x) for x in got.collect()} == {x[0]: x for x in data if x[0] in want}


def test_empty_tables(spark):
    empty, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame(documents(random.Random(1), 9), SCHEMA)
    nothing = spark.createDataFrame([], "text string")
    assert r.digest(empty, nothing).count() == 0
    assert r.digest(some, nothing).where(F.col("n_features") > 0).count() > 0
    with pytest.raises(ValueError, match="16 bits"):
        r.resampled(some, nothing, buckets=70_000)
