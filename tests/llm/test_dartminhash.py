import random
from collections import Counter

import numpy as np
import pyarrow as pa

from pulsegrid.llm import components, dartminhash as d
from pulsegrid.llm.text import raw_strings


def _shingles(text):
    import re

    w = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def similarity(a, b):
    x, y = _shingles(a), _shingles(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_collisions_follow_weighted_jaccard():
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocab) for _ in range(400)] + ["again"] * 60
    other = base[:]
    for _ in range(12):
        other[rng.randrange(400)] = "new"
    texts = [" ".join(base), " ".join(other), "", "one two", " ".join(base)]
    data, offsets = raw_strings(pa.array(texts))
    doc, element, weight = d.shingle_sets(data, offsets)
    for t, i in zip(texts, range(5)):
        assert sorted(weight[doc == i].tolist()) == sorted(_shingles(t).values())
    k = 2000
    rows = d.signatures(doc, element, weight, 5, k)
    assert (rows[0] == rows[4]).all() and not rows[2].any() and rows[3].all()
    assert abs((rows[0] == rows[1]).mean() - similarity(texts[0], texts[1])) < 0.04
    # fractional and very heavy weights stay consistent
    heavy = d.signatures(np.array([0, 0, 1, 1]), np.array([5, 9, 5, 9], np.uint64), np.array([1000.5, 3.0, 500.25, 3.0]), 2, k)
    assert abs((heavy[0] == heavy[1]).mean() - 503.25 / 1003.5) < 0.05


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(20, 60)] + [(1, 1), (3, 2), (2, 3)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: min(y for y in want if want[y] == want[x]) for x in want}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _corpus():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    docs = [None, "", "?!", "", "one two", "one two", "One, two.", "short text of four"]
    for _ in range(25):
        base = text(rng.choice([30, 120, 400]))
        docs.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = base[:]
            for _ in range(max(1, len(copy) // rng.choice([40, 70, 110]))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            docs.append(" ".join(copy))
    base = text(150)  # a hot group around one text
    for _ in range(80):
        copy = base[:]
        copy[rng.randrange(150)] = copy[rng.randrange(150)] = "edit"
        docs.append(" ".join(copy))
    docs += [docs[8]] * 30
    rng.shuffle(docs)
    return docs


def test_classes_match_brute_force(spark):
    docs = _corpus()
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, bands string").repartition(3)
    got = {r.doc_id: r for r in d.digest(frame).collect()}
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if docs[i] and docs[j] and _shingles(docs[i]) and label[i] != label[j] and similarity(docs[i], docs[j]) >= 0.8:
                label = [label[j] if x == label[i] else x for x in label] if label[j] < label[i] else [label[i] if x == label[j] else x for x in label]
    least = {}
    for i, x in enumerate(label):
        least.setdefault(x, i)
    assert {i: r.class_id for i, r in got.items()} == {i: least[x] for i, x in enumerate(label)}
    kept = sorted(i for i, r in got.items() if r.kept)
    assert kept == sorted(set(least.values()))
    assert sorted(r.doc_id for r in d.deduplicated(frame).collect()) == kept


def test_large_group_without_its_base_is_whole(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    docs = []
    for k in range(900):
        copy = base[:]
        for at in rng.sample(range(200), 3):
            copy[at] = f"x{k}y{at}"
        docs.append(" ".join(copy))
    sets = [set(_shingles(t)) for t in docs]
    index = {s: i for i, s in enumerate(sorted(set().union(*sets)))}
    rows = np.zeros((len(docs), len(index)), np.float32)
    for i, s in enumerate(sets):
        rows[i, [index[x] for x in s]] = 1
    same, size = rows @ rows.T, rows.sum(1)
    near = same / (size[:, None] + size[None, :] - same) >= 0.8
    label = np.arange(len(docs))
    while True:
        least = np.where(near, label[None, :], len(docs)).min(1)
        if (least == label).all():
            break
        label = least
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in d.digest(frame).collect()}
    assert got == dict(enumerate(label.tolist()))


def test_repeats_nulls_and_empty_tables(spark):
    frame = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (5, "q r"), (5, "q r"), (6, "q r")], "doc_id long, text string")
    rows = d.deduplicated(frame).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["5", "None"]
    assert d.digest(frame.limit(0)).count() == 0 and d.deduplicated(frame.limit(0)).count() == 0
