import os
import random

import numpy as np
import pyarrow as pa

from pulsegrid.llm import fmindex, storage, text


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(1)
    text = np.concatenate([np.append(rng.integers(1, 4, rng.integers(1, 40)), 0) for _ in range(30)])
    index = fmindex.FMIndex(text, 5)
    for k in (1, 2, 3, 5):
        patterns = rng.integers(1, 5, (20, k))
        low, high = index.search(patterns.reshape(-1), np.arange(1, 21) * k, np.full(20, k))
        for p, a, b in zip(patterns, low, high):
            want = [i for i in range(len(text) - k + 1) if (text[i : i + k] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def _corpus():
    rng = random.Random(5)
    vocab = ["alpha", "beta", "Gamma", "dél", "x1", "über", "it"]
    items = {i: " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 12, 13, 14, 30]))) for i in range(12)}
    items[40] = ""
    items[41] = items[3]
    docs = [None, "", "...", items[3].upper(), items[5] + " zebra " + items[5]]
    for _ in range(60):
        words = [rng.choice([*vocab, "other", "more"]) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.7:
            at = rng.randint(0, len(words))
            words[at:at] = items[rng.randrange(12)].split()[: rng.randint(1, 30)]
        docs.append(rng.choice([" ", ", ", "\n"]).join(words))
    docs.append(" ".join(["beta"] * 5000))
    return items, docs


def test_matches_brute_force_in_one_or_many_blocks(spark):
    items, docs = _corpus()
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, found string")
    bench = spark.createDataFrame([*items.items(), (None, None)], "item_id long, text string")
    for size in (1 << 20, 300):
        got = {r.doc_id: r for r in fmindex.digest(frame, bench, block_bytes=size).collect()}
        for i, t in enumerate(docs):
            n, hit, found, sha = fmindex.brute_force(t, items)
            assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256) == (n, hit, len(found), sha), (size, i)
            assert got[i].contaminated == (hit > 0 and 20 * hit >= n)


def test_empty_tables_and_excision(spark):
    docs = spark.createDataFrame([(1, "keep one two three four end"), (1, "keep one two three four end"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(not r.contaminated for r in fmindex.digest(docs, none).collect())
    assert fmindex.digest(docs.limit(0), none).count() == 0
    bench = spark.createDataFrame([(7, "One two three four")], "item_id long, text string")
    assert sorted(r.text or "" for r in fmindex.excise(docs, bench).collect()) == ["", "keep  end", "keep  end"]
    assert [r.doc_id for r in fmindex.drop_contaminated(docs, bench).collect()] == [2]


def test_large_benchmark_block_stays_thin():
    rng = np.random.default_rng(2)
    vocab = np.array([f"w{i}" for i in range(5000)])
    texts = [" ".join(vocab[rng.integers(0, 5000, 200)]) for _ in range(2000)]  # about 2 MB
    windows = fmindex.Windows(list(range(2000)), texts)
    held = sum(x.nbytes for x in vars(windows).values() if isinstance(x, np.ndarray))
    assert len(windows.stops) == 2000 * 188
    assert held < 12 * sum(map(len, texts))
    found = fmindex.search_shard(__import__("pyarrow").array([texts[7], "w1 w2 w3", None]), windows)
    assert found["n_hit"].tolist() == [200, 0, 0] and found["items"] == [[7], [], []]


def test_equal_windows_of_items_are_listed_for_both():
    item = "a b c d e f g h i j k l m"
    windows = fmindex.Windows([5, 4, None], [item, item + " n", "x y"])
    assert len(windows.stops) == 3
    found = fmindex.search_shard(__import__("pyarrow").array(["x y " + item]), windows)
    assert found["items"] == [[4, 5]] and found["n_hit"].tolist() == [15]


def test_blocks_leave_little_behind_and_callers_keep_their_columns(spark):
    items, docs = _corpus()
    frame = spark.createDataFrame([(i, t, f"f{i}", i) for i, t in enumerate(docs * 3)], "doc_id long, text string, found string, items int")
    bench = spark.createDataFrame([*items.items()], "item_id long, text string")
    shared = storage.shared_dir(spark).removeprefix("file://")

    def held():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(shared) if "/hits-" in d for f in files)

    before = held()
    some = {size: [tuple(r) for r in fmindex.drop_contaminated(frame, bench, block_bytes=size).collect()] for size in (1 << 20, 200)}
    assert held() - before < sum(len(t or "") for t in docs * 3)
    assert sorted(some[200], key=repr) == sorted(some[1 << 20], key=repr)
    want = {(i, t, f"f{i}", i) for i, t in enumerate(docs * 3)}
    assert 0 < len(some[200]) < len(want) and set(some[200]) <= want
    cut = fmindex.excise(frame, bench, block_bytes=200)
    assert cut.schema == frame.schema and {(r.doc_id, r.found, r["items"]) for r in cut.collect()} == {(i, f"f{i}", i) for i in range(len(docs) * 3)}


def test_shards_and_stretches_of_any_size_find_the_same():
    items, docs = _corpus()
    windows = fmindex.Windows(list(items), list(items.values()))
    whole = fmindex.search(pa.array(docs, pa.string()), windows)
    small = fmindex.search(pa.array(docs, pa.string()), windows, shard_bytes=100)
    assert {k: [str(x) for x in v] for k, v in whole.items()} == {k: [str(x) for x in v] for k, v in small.items()}
    data, offsets = text.raw_strings(pa.array(docs, pa.string()))
    for stretch in (1, 7, 1000):
        assert all((a == b).all() for a, b in zip(text.words(data, offsets), text.words(data, offsets, stretch), strict=True))


def test_a_text_of_several_megabytes(spark):
    items, docs = _corpus()
    long = ("filler words that no item has " * 200_000) + items[5]
    frame = spark.createDataFrame([(1, long), (2, items[5])], "doc_id long, text string")
    got = {r.doc_id: r for r in fmindex.digest(frame, spark.createDataFrame([(5, items[5])], "item_id long, text string")).collect()}
    n = len(items[5].split())
    assert (got[1].n_hit, got[1].n_words, got[1].contaminated) == (n, 1_200_000 + n, False) and got[2].contaminated
