import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pulsegrid.llm import paragraphs as p

rng = random.Random(3)
VOCAB = [f"{a}{b}{c}" for a in "bdgklmnprst" for b in "aeiou" for c in "bdgklmn"]


def prose(n):
    return [rng.choice(VOCAB) for _ in range(n)]


def test_parts_of_a_run_equal_parts_of_each_text():
    texts = ["", "a b c", " ".join(prose(300)), "\n\n".join(" ".join(prose(30)) for _ in range(5)), "x " * 200]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    together = p.Parts(np.frombuffer(b"".join(raw), np.uint8), offsets)
    doc, first, last = together.lines()
    gram, at = together.anchors(9)
    for k, r in enumerate(raw):
        alone = p.Parts(np.frombuffer(r, np.uint8), np.array([0, len(r)]))
        _, f, z = alone.lines()
        base = together.word_at[k]
        assert (first[doc == k] - base).tolist() == f.tolist() and (last[doc == k] - base).tolist() == z.tolist()
        own = together.owner[at] == k
        g, a = alone.anchors(9)
        assert gram[own].tolist() == g.tolist() and (at[own] - base).tolist() == a.tolist()


@pytest.fixture(scope="module")
def planted():
    passage = [prose(rng.randint(51, 90)) for _ in range(12)]
    stock = " ".join(prose(12))
    docs, holds = {}, {}
    for k in range(90):
        lines = [prose(rng.randint(5, 70)) for _ in range(rng.randint(2, 8))]
        if k % 3 == 0:
            which = rng.randrange(12)
            line = rng.choice(lines)
            at = rng.randint(0, len(line))
            line[at:at] = passage[which]
            holds.setdefault(which, []).append(k)
        text = "\n".join(" ".join(x) + "." for x in lines)
        docs[k] = text + "\n" + stock if k % 2 else text
    return docs, holds, passage


def test_planted_passages_go_and_clean_documents_stay(spark, planted):
    docs, holds, passage = planted
    frame = spark.createDataFrame([(k, t, "z") for k, t in docs.items()], "doc_id long, text string, place string").repartition(3)
    got = {r.doc_id: r for r in p.digest(frame).collect()}
    new = {r.doc_id: r.text for r in p.deduplicated(frame).collect()}
    within = {k for ks in holds.values() for k in ks}
    for which, ks in holds.items():
        if len(ks) > 1:
            lost = [k for k in ks if got[k].n_removed]
            assert len(lost) == len(ks) - 1
            middle = " ".join(passage[which][22:29])
            assert sum(middle in new[k] for k in ks) == 1
    for k, t in docs.items():
        assert got[k].n_bytes == len(t.encode()) and got[k].kept_sha256 == hashlib.sha256(new[k].encode()).hexdigest()
        assert got[k].n_bytes - got[k].n_removed == len(new[k].encode())
        if k not in within:
            assert got[k].n_removed == 0 and new[k] == t


def test_whole_passages_stay_once(spark, planted):
    docs, holds, passage = planted
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    new = {r.doc_id: " " + " ".join(r.text.split()) + " " for r in p.deduplicated(frame).collect()}
    for which, ks in holds.items():
        words = passage[which]
        assert sum(" ".join(words) in new[k] for k in ks) == 1
        parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
        assert sum(any(x in new[k] for x in parts) for k in ks) == 1


def test_edited_passages_inside_lines_go(spark):
    docs = []
    for k in range(12):
        passage = prose(60)
        edited = {0: passage[:30] + ["changed"] + passage[31:], 1: passage[:30] + passage[31:], 2: passage[:30] + ["added"] + passage[30:]}[k % 3]
        docs += [" ".join(prose(80) + x + prose(80)) for x in (passage, edited)]
        docs.append(" ".join(prose(80) + [w if i % 9 else "other" for i, w in enumerate(passage)] + prose(80)))
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: len(r.text.split()) for r in p.deduplicated(frame).collect()}
    lost = [[len(docs[i].split()) - got[i] for i in range(k, k + 3)] for k in range(0, len(docs), 3)]
    whole = [sorted(x[:2])[0] == 0 and 59 <= sorted(x[:2])[1] <= 61 and x[2] == 0 for x in lost]
    assert sum(whole) >= 11, lost


def test_near_lines_by_exact_similarity(spark):
    base = [prose(90) for _ in range(8)]
    docs = []
    for b in base:
        near, far = b[:], b[:]
        near[40] = "changed"
        for at in (5, 15, 25, 35, 45, 55, 65, 75):
            far[at] = "other"
        docs += ["\n".join([" ".join(prose(25)), " ".join(x), "end"]) for x in (b, near)] + [" ".join(far)]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in p.deduplicated(frame).collect()}
    for k in range(0, len(docs), 3):
        gone = [len(docs[i]) - len(got[i]) for i in (k, k + 1)]
        assert sorted(g > 300 for g in gone) == [False, True]


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "..."), (5, "The " * 5000), (None, "né " * 400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = p.digest(frame).collect()
    assert len(got) == 7 and {r.doc_id: r.n_bytes for r in got}[1] == 0
    assert p.digest(frame.limit(0)).count() == 0
    assert [r.text for r in p.deduplicated(frame).where("doc_id = 1").collect()] == [None]


def test_extra_columns_ties_and_periodic_texts(spark):
    passage = " ".join(prose(60))
    names = "doc_id long, text string, row_id string, row_key int, repeats string, bands int, found string, band int, key string"
    rows = [(1, passage, "r", 1, "x", 1, "f", 0, "k"), (1, passage, "r", 1, "x", 1, "f", 0, "k"), (2, "an intro line\n" + passage, None, None, None, None, None, None, None)]
    rows += [(3, "The " * 3000, "", 0, "", 0, "", 0, ""), (4, " ".join(prose(40) * 50), "", 0, "", 0, "", 0, "")]
    got = p.deduplicated(spark.createDataFrame(rows, names)).collect()
    assert sorted((r.doc_id, len(r.text.split())) for r in got) == [(1, 60), (1, 60), (2, 3), (3, 1), (4, 40)]
    assert [r.row_id for r in got if r.doc_id == 1] == ["r", "r"]


def test_recall_of_edited_passages_against_brute_force(spark):
    docs, truth = [], []
    for k in range(150):
        passage = prose(rng.randint(51, 80))
        edited = passage[:]
        for at in rng.sample(range(6, len(passage) - 6), 1 + (len(passage) > 70 and k % 2)):
            edited[at] = "edit"
        one, two = (Counter(tuple(x[i : i + 5]) for i in range(len(x) - 4)) for x in (passage, edited))
        truth.append((one & two).total() >= 0.8 * (one | two).total())
        docs += [" ".join(prose(50) + x + prose(50)) for x in (passage, edited)]
    got = {r.doc_id: r.n_removed for r in p.digest(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    near = [k for k in range(150) if truth[k]]
    found = [k for k in near if got[2 * k + 1] >= 0.9 * len(" ".join(docs[2 * k].split()[50:-50]))]
    assert len(near) > 60 and len(found) >= 0.95 * len(near), (len(found), len(near))
    assert all(got[2 * k] == 0 for k in range(150))


def test_pieces_of_a_passage_in_earlier_texts_do_not_hide_its_copies(spark):
    """Two texts hold 17-word pieces of a passage between other words; two exact copies follow."""
    docs = []
    for k in range(40):
        passage = prose(60)
        pieces = [passage[i : i + 17] for i in range(0, 60, 17)]
        between = [f"between{k}"] * 6  # never by chance a word of the passage
        docs += [" ".join(sum((between + x for x in some), [])) for some in (pieces[::2], pieces[1::2])]
        docs += [" ".join(prose(30) + passage + prose(30)) for _ in range(2)]
    got = {r.doc_id: r.n_removed for r in p.digest(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert sum(got[k + 3] >= len(" ".join(docs[k + 3].split()[30:-30])) for k in range(0, 160, 4)) == 40
    assert sum(bool(got[k + i]) for k in range(0, 160, 4) for i in range(3)) == 0


def test_longer_pieces_in_earlier_texts_do_not_hide_copies_either(spark):
    docs = []
    for _ in range(20):
        passage = prose(100)
        docs += [" ".join(prose(9) + passage[a : a + 40] + prose(9)) for a in (0, 30, 60)]
        docs += [" ".join(prose(30) + passage + prose(30)) for _ in range(2)]
    new = {r.doc_id: r.text.split() for r in p.deduplicated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    # both copies are made of the pieces
    assert all(len(new[k + i]) == 60 for k in range(0, 100, 5) for i in (3, 4))


def test_no_window_repeats_after_all(spark):
    """Exact repeats in texts that share phrases: none of 18 words is left twice."""
    stock = [prose(rng.randint(18, 70)) for _ in range(30)]
    docs = [" ".join(sum((prose(rng.randint(3, 40)) + rng.choice(stock) for _ in range(rng.randint(1, 4))), [])) for _ in range(120)]
    new = [r.text.split() for r in p.deduplicated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)).collect()]
    size = p.LEAST_WORDS
    seen = Counter(tuple(w[i : i + size]) for w in new for i in range(len(w) - size + 1))
    assert max(seen.values()) == 1


@pytest.mark.parametrize("low, high", [(51, 138), (139, 300)])
def test_recall_of_edits_anywhere_against_brute_force(spark, low, high):
    docs, truth = [], []
    for k in range(100):
        passage = prose(rng.randint(low, high))
        edited = passage[:]
        for _ in range(rng.randint(1, max(1, len(passage) // 45))):
            at = rng.randrange(len(edited))
            edited[at : at + rng.choice([0, 1, 1, 2])] = rng.choice([["edit"], ["edit"], ["two", "more"], []])
        one, two = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (passage, edited))
        truth.append(len(one & two) >= 0.8 * len(one | two))
        docs += [" ".join(prose(50) + passage + prose(50)), " ".join(prose(50) + edited + prose(50))]
    got = {r.doc_id: r.n_removed for r in p.digest(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    near = [k for k in range(100) if truth[k]]
    found = [k for k in near if got[2 * k + 1] >= 0.9 * len(" ".join(docs[2 * k + 1].split()[50:-50]))]
    assert len(near) > 50 and len(found) >= 0.9 * len(near), (len(found), len(near))
    assert all(got[2 * k] == 0 for k in range(100))


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_places_meet_the_first_and_the_one_before(spark, parts):
    """Whatever the ranges: one anchor over many of them, and repeated rows."""
    r = random.Random(parts)
    rows = sorted({(r.choice([5, 5, 5, *range(-9, 9)]), r.randrange(40), 1, r.randrange(9), 50) for _ in range(300)})
    rows = list({x[:3]: x for x in rows}.values())
    want: Counter = Counter()
    for key in {x[0] for x in rows}:
        own = sorted(x[1:4] for x in rows if x[0] == key)
        want.update({(*x, *own[0]) for x in own[1:]} | {(*x, *y) for x, y in zip(own[1:], own, strict=False)})
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        frame = spark.createDataFrame(rows + rows[:50], "key long, row_key long, row_id long, place long, n_words long")
        got = Counter((x.row_key, x.row_id, x.place, x.to_key, x.to_id, x.to_place) for x in p.met_places(frame).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == want
