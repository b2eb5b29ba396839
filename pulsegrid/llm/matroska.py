"""Media columns: Matroska files in binary columns and their packet tables.

``parse`` reads variable-length EBML elements, clusters, simple and grouped blocks
with no, Xiph, fixed-size or EBML lacing, and cues.  ``packets`` turns a column of
files into one row per packet.  ``store`` writes bytes as 8-bit PCM audio, and the
payload is read back through the packet table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, DEFAULT_DURATION, CODEC_ID = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x23E383, 0x86
AUDIO, SAMPLING_RATE, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

FRAME = 192
RATE = 8000
FRAMES_PER_BLOCK = 8
BLOCKS_PER_CLUSTER = 100
SCALE_NS = 1_000_000


def vint(value: int, width: int = 0) -> bytes:
    """A size; the all-ones pattern of each width is kept for 'unknown'."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def read_vint(data: bytes, at: int) -> tuple[int | None, int]:
    """Value (None: unknown size) and the place after it."""
    first = data[at]
    if not first:
        raise ValueError("a size is longer than 8 bytes")
    width = 9 - first.bit_length()
    if at + width > len(data):
        raise ValueError("the data end inside a size")
    value = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def read_head(data: bytes, at: int, end: int) -> tuple[int, int, int, bool]:
    """Element id, where its body starts and stops, and whether its size is known."""
    width = 9 - data[at].bit_length()
    if width > 4 or at + width >= end:
        raise ValueError("bad element id")
    ident = int.from_bytes(data[at : at + width], "big")
    size, start = read_vint(data, at + width)
    stop = end if size is None else start + size
    if stop > end:
        raise ValueError("an element reaches beyond its parent")
    return ident, start, stop, size is not None


def lace(frames: list[bytes], kind: int) -> bytes:
    """Body of a block after its flags."""
    sizes = [len(f) for f in frames]
    head = b"" if kind == NO_LACING else bytes([len(frames) - 1])
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACING and len(sizes) > 1:
        head += vint(sizes[0])
        for before, now in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(now - before) < (1 << 7 * w - 1) - 1)
            head += vint(now - before + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def unlace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Start and size of every frame of a block."""
    if kind == NO_LACING:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == FIXED:
        if (end - at) % n:
            raise ValueError("fixed lacing of unequal frames")
        sizes = [(end - at) // n] * n
    elif kind == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif n > 1:
        size, at = read_vint(data, at)
        sizes.append(size)
        for _ in range(n - 2):
            width = 9 - data[at].bit_length()
            step, at = read_vint(data, at)
            sizes.append(sizes[-1] + (((1 << 7 * width) - 1) if step is None else step) - ((1 << 7 * width - 1) - 1))
    if kind != FIXED:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) > end:
        raise ValueError("laced frames reach beyond their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


@dataclass
class Media:
    """Tracks by number, packets and cues of a file.

    A packet is (track, timestamp in ns, start, size, cluster start, block number, key)."""

    scale: int = SCALE_NS
    doc_type: str = ""
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, int, int, bool]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    blocks: int = 0


def _children(data: bytes, at: int, end: int):
    while at < end:
        ident, start, stop, _ = read_head(data, at, end)
        yield ident, start, stop
        at = stop


def _unsigned(data: bytes, start: int, stop: int) -> int:
    return int.from_bytes(data[start:stop], "big")


def _block(media: Media, data: bytes, start: int, stop: int, cluster: int, base: int, key: bool | None) -> None:
    track, at = read_vint(data, start)
    relative, flags = struct.unpack_from(">hB", data, at)
    step = media.tracks.get(track, {}).get("default_duration", 0)
    first = (base + relative) * media.scale
    key = bool(flags & 0x80) if key is None else key
    for k, (begin, size) in enumerate(unlace(data, at + 3, stop, flags >> 1 & 3)):
        media.packets.append((track, first + k * step, begin, size, cluster, media.blocks, key))
    media.blocks += 1


def _cluster(media: Media, data: bytes, head: int, at: int, end: int, known: bool) -> int:
    """Reads a cluster; one of unknown size ends where a segment's next child starts."""
    media.clusters.append(head)
    base = 0
    while at < end:
        ident, start, stop, _ = read_head(data, at, end)
        if not known and ident in (CLUSTER, CUES, INFO, TRACKS, SEGMENT):
            return at
        if ident == TIMESTAMP:
            base = _unsigned(data, start, stop)
        elif ident == SIMPLE_BLOCK:
            _block(media, data, start, stop, head, base, None)
        elif ident == BLOCK_GROUP:
            inner = list(_children(data, start, stop))
            key = all(i != REFERENCE_BLOCK for i, _, _ in inner)
            for i, a, b in inner:
                if i == BLOCK:
                    _block(media, data, a, b, head, base, key)
        at = stop
    return at


def _track(data: bytes, start: int, stop: int) -> tuple[int, dict]:
    found: dict = {}
    for ident, a, b in _children(data, start, stop):
        if ident in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION):
            found[{TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "default_duration"}[ident]] = _unsigned(data, a, b)
        elif ident == CODEC_ID:
            found["codec"] = data[a:b].decode()
        elif ident == AUDIO:
            for i, x, y in _children(data, a, b):
                if i == SAMPLING_RATE:
                    found["rate"] = struct.unpack(">f" if y - x == 4 else ">d", data[x:y])[0]
                elif i in (CHANNELS, BIT_DEPTH):
                    found["channels" if i == CHANNELS else "bits"] = _unsigned(data, x, y)
    return found.get("number", 0), found


def parse(data: bytes) -> Media:
    """Packet table, tracks and cues; ValueError for data that aren't whole."""
    media, at = Media(), 0
    try:
        ident, start, stop, _ = read_head(data, 0, len(data))
        if ident != EBML:
            raise ValueError("no EBML header")
        for i, a, b in _children(data, start, stop):
            if i == DOC_TYPE:
                media.doc_type = data[a:b].decode()
        ident, at, end, _ = read_head(data, stop, len(data))
        if ident != SEGMENT:
            raise ValueError("no segment")
        origin = at
        while at < end:
            head = at
            ident, start, stop, known = read_head(data, at, end)
            at = stop
            if ident == INFO:
                for i, a, b in _children(data, start, stop):
                    if i == TIMESTAMP_SCALE:
                        media.scale = _unsigned(data, a, b)
            elif ident == TRACKS:
                media.tracks |= dict(_track(data, a, b) for i, a, b in _children(data, start, stop) if i == TRACK_ENTRY)
            elif ident == CLUSTER:
                at = _cluster(media, data, head - origin, start, stop, known)
            elif ident == CUES:
                for i, a, b in _children(data, start, stop):
                    if i == CUE_POINT:
                        inner = {k: (x, y) for k, x, y in _children(data, a, b)}
                        place = {k: _unsigned(data, x, y) for k, x, y in _children(data, *inner[CUE_POSITIONS])}
                        media.cues.append((_unsigned(data, *inner[CUE_TIME]) * media.scale, place[CUE_TRACK], place[CUE_CLUSTER]))
    except (IndexError, KeyError, struct.error, UnicodeDecodeError) as e:
        raise ValueError(f"broken Matroska data: {e!r}") from e
    return media


_HEADER = element(EBML, b"".join([number(EBML_VERSION, 1), number(EBML_READ_VERSION, 1), number(EBML_MAX_ID, 4), number(EBML_MAX_SIZE, 8), element(DOC_TYPE, b"matroska"), number(DOC_VERSION, 4), number(DOC_READ_VERSION, 2)]))
_TRACKS = element(
    TRACKS,
    element(
        TRACK_ENTRY,
        b"".join([number(TRACK_NUMBER, 1), number(TRACK_UID, 1), number(TRACK_TYPE, 2), number(FLAG_LACING, 1), number(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE), element(CODEC_ID, b"A_PCM/INT/LIT")])
        + element(AUDIO, element(SAMPLING_RATE, struct.pack(">f", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8)),
    ),
)


def mux(payload: bytes, lacing: int = FIXED) -> bytes:
    """A file of one 8-bit mono PCM track; the payload is a multiple of FRAME bytes."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    tick = FRAME * 1000 // RATE  # milliseconds
    per_cluster = BLOCKS_PER_CLUSTER * FRAMES_PER_BLOCK
    info = element(INFO, number(TIMESTAMP_SCALE, SCALE_NS) + element(DURATION, struct.pack(">d", len(frames) * tick)) + element(MUXING_APP, b"pulsegrid") + element(WRITING_APP, b"pulsegrid"))
    parts, cues = [info, _TRACKS], []
    at = sum(map(len, parts))
    for first in range(0, len(frames), per_cluster):
        body = [number(TIMESTAMP, first * tick)]
        for k in range(first, min(first + per_cluster, len(frames)), FRAMES_PER_BLOCK):
            held = frames[k : min(k + FRAMES_PER_BLOCK, first + per_cluster)]
            kind = lacing if len(held) > 1 else NO_LACING
            body.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", (k - first) * tick, 0x80 | kind << 1) + lace(held, kind)))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, number(CUE_TIME, first * tick) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    return _HEADER + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


def padded_payload(text: bytes) -> bytes:
    """Spaces fill a text up to a positive multiple of FRAME bytes."""
    return text.ljust(max(1, -(-len(text) // FRAME)) * FRAME)


PACKET_FIELDS = "track long, timestamp_ns long, start long, size long, cluster_start long, block long, keyframe boolean, error string"


def packets(df: DataFrame, media_col: str, id_col: str) -> DataFrame:
    """One row per packet of every file in a binary column.

    Null files give no row; files that can't be read give one row that tells why.
    Repeated rows give their packets again."""
    names = [f.split()[0] for f in PACKET_FIELDS.split(", ")]
    frame = df.select(F.col(id_col).alias("__id"), F.col(media_col).alias("__media")).where(F.col("__media").isNotNull())

    def one(batches):
        for batch in batches:
            rows = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(key, *p, None) for p in parse(data).packets]
                except ValueError as e:
                    rows.append((key, None, None, None, None, None, None, None, str(e)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * (len(names) + 1)
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 6, pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[id_col, *names])

    return frame.mapInArrow(one, f"`{id_col}` {frame.schema['__id'].dataType.simpleString()}, {PACKET_FIELDS}")


def store(docs: DataFrame, text_col: str = "text", into: str = "media", lacing: int = FIXED) -> DataFrame:
    """``docs`` with the Matroska form of each text instead of the text."""
    rest = [c for c in docs.columns if c not in (text_col, into)]
    frame = docs.select(*rest, F.col(text_col).alias("__text"))
    kinds = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest] + [f"`{into}` binary"])

    def one(batches):
        for batch in batches:
            files = [mux(padded_payload((t or "").encode()), lacing) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(files, pa.binary())], names=[*rest, into])

    return frame.mapInArrow(one, kinds)


def read_back(data: bytes, media: Media) -> bytes:
    """Payload of the only track, through the byte ranges of its packets."""
    return b"".join([data[start : start + size] for _, _, start, size, _, _, _ in media.packets])


def feature(media: Media, payload: bytes) -> str:
    """Packet, block, cluster and cue counts, length, level and sign changes of the samples."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    last = media.packets[-1][1] + media.tracks[1]["default_duration"]
    turns = int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0)))
    return f"packets={len(media.packets)};blocks={media.blocks};clusters={len(media.clusters)};cues={len(media.cues)};ms={last // 1_000_000};sum={int(samples.sum())};energy={int((samples * samples).sum())};turns={turns}"


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: sizes, hashes and features of the stored and reread media.

    Null is the empty text, which is stored as one block of blanks; equal texts give equal
    values; repeated rows are stored one by one, and other columns are not looked at."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def one(batches):
        for batch in batches:
            rows = []
            for text, data in zip(batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist(), strict=True):
                media = parse(data)
                payload = read_back(data, media)
                rows.append((text, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(media, payload)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", *names])

    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return store(sized).mapInArrow(one, schema)
