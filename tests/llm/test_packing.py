import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pulsegrid.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def test_cached_ids_equal_the_tokenizers(plain, spark, sf_dir):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += ["", " ", "it's  a\ttest\n\n'S 12ab", "a\xa0b c", "x<|endoftext|>y", "ΣΑΣ ΟΔΟΣ.", "éa ́x", "日本 語。 \x01 q", "a\x1cb", "İstanbul", "😀!! 😀"]
    own = packing.ChunkTokenizer(PATH)
    assert own.by_chunk
    for _ in range(2):
        ids, at = own.encode(texts)
        for t, a, b in zip(texts, at, at[1:]):
            assert ids[a:b].tolist() == plain.encode(t, add_special_tokens=False).ids, t


def check(rows, texts, plain, window):
    ids = {i: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length])
        assert r.doc_tokens == len(ids[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, all_ids in ids.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(all_ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and {r.sequence_length for r in pieces} == {at}
        assert pieces[0].padded_length == (at if at & (at - 1) == 0 else window)
    return sum(len(x) for x in ids.values()), len(by_sequence)


@pytest.mark.parametrize(("window", "most"), [(2048, 64), (100, 3), (7, 1)])
def test_every_id_lies_in_one_piece(spark, sf_dir, plain, window, most):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3, "doc_id")
    extra = spark.createDataFrame([(10**9, None, None, None, None), (10**9 + 1, "", None, None, None)], docs.schema)
    texts = {r.doc_id: r.text for r in docs.union(extra).collect()}
    rows = packing.pack(docs.union(extra), PATH, window=window, open_windows=most).collect()
    tokens, sequences = check(rows, texts, plain, window)
    if window == 2048:
        assert sequences <= 1.05 * tokens / window + 2


def test_empty_table_and_repeats(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert packing.pack(docs.limit(0), PATH).count() == 0
    rows = packing.pack(docs, PATH).collect()
    assert [r.doc_id for r in rows] == [None, None] and sorted(r.offset for r in rows) == [0, 3]
