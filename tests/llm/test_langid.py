import numpy as np
import pyarrow as pa

from pulsegrid.llm import langid
from pulsegrid.llm.text import raw_strings


def test_gram_sets_do_not_cross_documents():
    texts = ["aB!", "", "x", "éa"]
    data, offsets = raw_strings(pa.array(texts))
    grams = np.arange(1, 1 << 24)
    model = langid.Model(["x"], np.zeros(0, int), np.zeros((1, 1)))
    held = {}
    for k, codes in enumerate(langid.gram_codes(data, offsets)):
        for d, (a, b) in enumerate(zip(offsets, offsets[1:])):
            held.setdefault(d, set()).update(int(c) for c in codes[a:b] if c)
    fold = lambda t: [c if c > 127 else (c if chr(c).isalpha() else 32) for c in t.lower().encode()]
    for d, t in enumerate(texts):
        b = fold(t)
        want = {int.from_bytes(bytes(b[i : i + n]), "big") for n in (1, 2, 3) for i in range(len(b) - n + 1)}
        assert held.get(d, set()) == want
    assert len(grams) and not model.grams.size


def test_folded_scores_equal_the_kernel_expansion():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abc def" if k % 2 else "xyz abf"), 60)) for k in range(30)]
    labels = ["one" if k % 2 else "two" for k in range(30)]
    model = langid.fit(texts, labels, 5)
    best, _ = langid.score(model, pa.array(texts), model.lookup())
    assert [model.languages[b] for b in best] == labels


def test_held_out_accuracy_and_edges(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    extra = spark.createDataFrame([(-1, None, None, "s", 0), (-2, "", "en", "s", 0), (-3, "123 !?", "en", "s", 0), (None, "the and of", None, None, 0)], docs.schema)
    got = langid.digest(docs.union(extra)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == docs.count() + 4
    assert [by_id[i].lang_pred for i in (-1, -2, -3)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in got)
    truth = {r.doc_id: r.lang for r in docs.where("text rlike '\\\\p{L}'").collect()}
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.95 * len(out)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.digest(docs).collect()] == ["und"]
    assert langid.digest(docs.limit(0)).count() == 0


def test_samples_hold_copies_once_and_long_texts(spark):
    rows = [(i, "same english words " * 3, "en") for i in range(40_000)]
    rows += [(50_000 + i, f"other english words number {i}", "en") for i in range(400)]
    rows += [(60_000 + i, f"ein langer deutscher satz {i} " * 2000, "de") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, labels = langid.bounded_sample(docs, docs["lang"], 400)
    assert labels.count("en") == 400 and labels.count("de") == 50
    assert max(map(len, texts)) <= langid.SAMPLE_CHARS
    got = {r.doc_id: r.lang_pred for r in langid.digest(docs).where("doc_id >= 50000").collect()}
    assert all(v == ("de" if k >= 60_000 else "en") for k, v in got.items())


def test_long_texts_are_spread_over(spark):
    from pulsegrid.llm.text import spread_over
    from pyspark.sql import functions as F

    text = "".join(chr(97 + i // 100) for i in range(2600))
    frame = spark.createDataFrame([(text,), ("short",), (None,)], "text string")
    long, short, none = (r.t for r in frame.select(spread_over(F.col("text"), 80).alias("t")).collect())
    assert len(long) == 80 and long.startswith("a" * 10) and long.endswith("z" * 10)
    assert (short, none) == ("short", None)
