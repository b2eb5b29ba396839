"""What the stages' row functions take and keep in a Python worker."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from pulsegrid.llm import dartminhash, packing, paragraphs, suffixes, text


class _Rows:
    """Stands in for a DataFrame and hands out the function that would run over its rows."""

    def __getattr__(self, name):
        return lambda *_, **__: self

    def mapInArrow(self, function, _):
        return function


def _texts(n_bytes):
    rng = random.Random(4)
    known = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    out = []
    while n_bytes > 0:
        out.append(" ".join(rng.choice(known) for _ in range(600)))
        n_bytes -= len(out[-1])
    return out


def _batch(texts):
    keys = pa.array(np.arange(len(texts)))
    return pa.RecordBatch.from_arrays([keys, keys, pa.array(texts)], names=["row_key", "row_id", "text"])


@pytest.mark.parametrize("step", [lambda d: paragraphs._units(d, paragraphs.BANDS, paragraphs.ROWS, paragraphs.LEAST_WORDS), lambda d: dartminhash._sign(d, dartminhash.BANDS, dartminhash.ROWS)])
def test_work_arrays_stay_small(step):
    batch, function = _batch(_texts(3 << 20)), step(_Rows())
    text._powers(text.RUN_BYTES)
    tracemalloc.start()
    rows = sum(b.num_rows for b in function(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows >= batch.num_rows and peak < 32 << 20


def test_slices_hold_runs_of_texts():
    texts = [None, "", "é" * 200_000, *_texts(1 << 20), ""]
    batch = _batch(texts)
    parts = list(text.in_runs(iter([batch.slice(0, 0), batch]), 2))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist() and len(parts) > 4
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(2).to_pylist()) <= text.RUN_BYTES for p in parts)


def test_suffix_steps_take_a_batch_in_slices(monkeypatch):
    texts = [*_texts(8 << 20), "", None, "short"]
    keys = pa.array(np.arange(len(texts)))
    held = [[{"anchor": k, "stretch": j, "n": 1, "low": 300 * j, "high": 300 * j + 60, "at": 300 * j + 200} for j in range(8)] if len(t or "") > 3000 else [] for k, t in enumerate(texts)]
    starts = [[{"low": h["low"], "high": h["high"]} for h in x] or None for x in held]
    cut = suffixes._cut_contexts(_Rows(), suffixes.LENGTH)
    monkeypatch.setattr(suffixes, "with_removals", lambda *_: _Rows())
    kept = suffixes.digest(_Rows())
    for function, columns in ((cut, [keys, keys, pa.array(texts), pa.array(held)]), (kept, [keys, pa.array(texts), pa.array(starts)])):
        batch = pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))])
        whole = list(function(iter([batch])))
        alone = [row for k in range(len(texts)) for out in function(iter([batch.slice(k, 1)])) for row in out.to_pylist()]
        assert [row for out in whole for row in out.to_pylist()] == alone and len(alone) >= len(texts)
        assert max(out.nbytes for out in whole) < 8 * text.RUN_BYTES
        del whole, alone
        tracemalloc.start()
        rows = sum(out.num_rows for out in function(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows >= len(texts) and peak < 6 << 20


def test_tokenizer_keeps_early_chunks_within_bounds(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_CHUNKS", 400)
    monkeypatch.setattr(packing, "KEPT_CHUNKS", 200)
    path = public_tokenizers.path("word_bpe_49k.json")
    own, rng = packing.ChunkTokenizer(path), random.Random(9)
    own.encode(["often met words"])
    for _ in range(12):
        texts = [" ".join(["often", str(rng.randrange(10**9)), f"Zq{rng.randrange(10**6)}'re", "words"]) for _ in range(40)]
        ids, at = own.encode(texts)
        want = [own.inner.encode(t, add_special_tokens=False).ids for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == want
        assert len(own.number) <= 400 + 80 and {"often", "met", "words"} <= own.number.keys()
    assert len(own.number) == own.chunks.n and len(own.piece) == own.pieces.n
