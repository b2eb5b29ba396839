import hashlib
import os
import random
import zlib

import pytest

from pulsegrid.llm import matroska as m


@pytest.mark.parametrize("kind", [m.NO_LACING, m.XIPH, m.FIXED, m.EBML_LACING])
def test_lacing_round_trip(kind):
    rng = random.Random(kind)
    for _ in range(50):
        n = 1 if kind == m.NO_LACING else rng.randint(1, 9)
        size = rng.randint(0, 700)
        frames = [os.urandom(size if kind == m.FIXED else rng.randint(0, 700)) for _ in range(n)]
        body = m.lace(frames, kind)
        assert [body[a : a + s] for a, s in m.unlace(body, 0, len(body), kind)] == frames


@pytest.mark.parametrize("n", [1, 8, 9, 799, 800, 801, 2500])
@pytest.mark.parametrize("kind", [m.FIXED, m.XIPH, m.EBML_LACING])
def test_file_round_trip(n, kind):
    payload = os.urandom(n * m.FRAME)
    data = m.mux(payload, kind)
    media = m.parse(data)
    assert m.read_back(data, media) == payload
    assert media.doc_type == "matroska" and media.tracks[1]["codec"] == "A_PCM/INT/LIT" and media.tracks[1]["bits"] == 8
    assert [p[1] for p in media.packets] == [k * 24_000_000 for k in range(n)]
    assert [c[2] for c in media.cues] == media.clusters and len(media.clusters) == -(-n // 800)


def test_unknown_sizes_groups_and_breakage():
    block = m.vint(1) + b"\x00\x05\x00" + b"abc"
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, block) + m.number(m.REFERENCE_BLOCK, 1))
    cluster = m.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + m.number(m.TIMESTAMP, 7) + group
    segment = m.SEGMENT.to_bytes(4, "big") + b"\xff" + m._TRACKS + cluster + cluster
    data = m._HEADER + segment
    media = m.parse(data)
    assert [(p[1], data[p[2] : p[2] + p[3]], p[6]) for p in media.packets] == [(12_000_000, b"abc", False)] * 2
    whole = m.mux(b"x" * 1920)
    for cut in (0, 3, 60, len(whole) - 5):
        with pytest.raises(ValueError):
            m.parse(whole[:cut])


def test_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    extra = spark.createDataFrame([(-1, None, None, None, None), (-2, "", None, None, None), (None, "né" * 70000, None, None, None), (-4, "né" * 70000, "x", None, None)], docs.schema)
    docs = docs.union(extra).cache()
    got = {r.doc_id: r for r in m.digest(docs).collect()}
    for r in docs.collect():
        raw = (r.text or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 or (192 if not raw else 0))
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes) == (len(raw), len(payload))
        assert g.payload_sha256 == hashlib.sha256(payload).hexdigest() and g.tail_crc32 == zlib.crc32(payload[-16:])
    assert got[None][1:] == got[-4][1:] and got[-1][1:] == got[-2][1:]
    table = m.packets(m.store(docs), "media", "doc_id")
    assert table.where("error is not null").count() == 0
    assert table.selectExpr("sum(size)").first()[0] == sum(g.payload_bytes for g in got.values())
    broken = spark.createDataFrame([(1, bytearray(b"junk")), (2, None)], "doc_id long, media binary")
    assert [(r.doc_id, r.track) for r in m.packets(broken, "media", "doc_id").collect()] == [(1, None)]
    assert m.digest(docs.limit(0)).count() == 0
