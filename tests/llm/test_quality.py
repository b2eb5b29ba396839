import numpy as np

from pulsegrid.llm import quality


def _offsets(texts):
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    return np.concatenate(raw), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def test_scores_do_not_depend_on_neighbours():
    net = quality.Network.fresh(np.random.default_rng(3))
    texts = ["", "a", "hello " * 50, "x" * 127, "y" * 128, "z" * 1000]
    together = quality.probabilities(net, *_offsets(texts))
    alone = [quality.probabilities(net, *_offsets([t]))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5)


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    net = quality.Network.fresh(rng)
    net.parts = {k: v.astype(np.float64) for k, v in net.parts.items()}
    data, offsets = _offsets(["some text " * 20, "other!! " * 9, "q"])
    y, w = np.array([1.0, 0.0, 1.0]), np.array([0.4, 0.3, 0.3])

    def loss():
        p = quality.probabilities(net, data, offsets)
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    got = quality._gradients(net, data, offsets, y, w)
    for name, g in got.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        base = net.parts[name][at]
        net.parts[name][at] = base + 1e-5
        up = loss()
        net.parts[name][at] = base - 1e-5
        down = loss()
        net.parts[name][at] = base
        assert abs((up - down) / 2e-5 - g[at]) < 1e-3 * max(1, abs(g[at])), name


def test_held_out_accuracy_and_edges(spark, sf_dir):
    where = sf_dir.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{where}/{t}.parquet") for t in ("documents", "labels"))
    extra = spark.createDataFrame([(-1, None, None, None, None), (-2, "", None, None, None)], docs.schema)
    got = quality.digest(docs.union(extra), labels).join(labels, "doc_id", "left").collect()
    ends = {r.doc_id: r.score for r in got if r.doc_id < 0}
    assert ends[-1] == ends[-2]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    out = [r for r in got if r.held_out and r.quality is not None]
    good = [r.predicted for r in out if r.quality == 1]
    bad = [r.predicted for r in out if r.quality == 0]
    print(sum(good) / len(good), 1 - sum(bad) / len(bad))
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.25 * len(bad)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc"), (1, "abc")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.digest(docs, labels).collect()] == [0.5, 0.5]
    assert quality.accepted(docs, labels).count() == 2
    assert quality.digest(docs.limit(0), labels).count() == 0


def test_scores_equal_a_plain_forward_pass():
    net = quality.Network.fresh(np.random.default_rng(5))
    texts = ["", "b", "hello world " * 40, "é" * 130, "x" * 120, "long text, " * 900]
    got = quality.probabilities(net, *_offsets(texts))
    want = [quality.plain_probability(net, t.encode()) for t in texts]
    assert np.allclose(got, want, atol=1e-5)


def test_samples_are_not_crowded_and_hold_long_texts(spark):
    rows = [(1, f"row {i} of one id") for i in range(20_000)]
    rows += [(i, f"good text {i} " * 3) for i in range(2, 300)]
    rows += [(1000 + i, f"long bad text {i} " * 1000) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 300)] + [(1000 + i, 0) for i in range(60)], "doc_id long, quality int")
    texts, marks, weights = quality.sample(docs, labels)
    assert marks.count(1) == 299 and marks.count(0) == 60
    assert max(map(len, texts)) <= quality.SAMPLE_CHARS
    assert abs(sum(weights) - 359) < 1e-6
