"""Importance resampling towards a target distribution, by hashed n-gram features.

Every document becomes a stream of packed 16-bit bucket numbers, one for each run of one
to three words.  The streams are written with the documents' offsets in them, a table that
is read twice: to be sorted and run-length encoded, which counts the buckets, and to
gather the buckets' gains, which ``np.add.reduceat`` sums by document.  Gumbel noise from
a hash of the id turns weights into a draw without replacement: the highest scores.

A document longer than ``CHUNK_WORDS`` words goes in several pieces, so that no array
grows with a text; pieces share the words at which they meet.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.llm.ranks import placed
from pulsegrid.llm.storage import dropped, written
from pulsegrid.llm.text import LOWER, WORD_BYTE, bounds, ragged, raw_strings, runs

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
CHUNK_WORDS = 1 << 18
LONG_WORD = 64  # bytes; longer words are hashed one by one

_POLYNOMIAL = 0xEDB88320  # of the CRC-32 in use everywhere, bits reversed


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1)
    return table.astype(np.uint32)


class Crc:
    """CRC-32 of many byte strings at once, and of their concatenations."""

    def __init__(self):
        self.table = _byte_table()
        one = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
        tables = [one]
        for _ in range(LONG_WORD + 1):
            tables.append(self._one_zero(tables[-1]))
        #: tables[n, b, v] is what n zero bytes make of byte b of a checksum
        self.tables = np.stack(tables)

    def _one_zero(self, crc: np.ndarray) -> np.ndarray:
        return self.table[crc & np.uint32(0xFF)] ^ (crc >> np.uint32(8))

    def shifted(self, crc: np.ndarray, by: np.ndarray) -> np.ndarray:
        """Checksums after ``by`` zero bytes each: what they add to a concatenation."""
        short = by <= LONG_WORD + 1
        n, out = np.where(short, by, 0), np.zeros(len(crc), np.uint32)
        for b in range(4):
            out ^= self.tables[n, b, (crc >> np.uint32(8 * b)) & np.uint32(0xFF)]
        for k in np.flatnonzero(~short):
            out[k] = self._far(crc[k : k + 1], int(by[k]))[0]
        return out

    def _far(self, crc: np.ndarray, by: int) -> np.ndarray:
        """The same for any number of bytes, by doubling the tables."""
        tables = self.tables[1]
        while by:
            if by & 1:
                crc = np.bitwise_xor.reduce([tables[b, (crc >> np.uint32(8 * b)) & np.uint32(0xFF)] for b in range(4)])
            by >>= 1
            if by:
                tables = np.bitwise_xor.reduce([tables[b, (tables >> np.uint32(8 * b)) & np.uint32(0xFF)] for b in range(4)])
        return crc

    def of(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Checksums of the slices of ``data``; a byte of every slice a step, the longest
        first, so that slices that have ended fall away."""
        size = stops - starts
        order = np.argsort(-size, kind="stable")
        long = int(np.searchsorted(-size[order], -LONG_WORD, "left"))
        at, left = starts[order], size[order]
        crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
        live = np.searchsorted(-left, -np.arange(1, LONG_WORD + 1), "right")
        for k in range(LONG_WORD):
            stop = int(live[k])
            if stop <= long:
                break
            now = crc[long:stop]
            crc[long:stop] = self.table[(now ^ data[at[long:stop] + k]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
        crc ^= np.uint32(0xFFFFFFFF)
        for k in range(long):
            crc[k] = zlib.crc32(data[at[k] : at[k] + left[k]])
        out = np.empty(len(crc), np.uint32)
        out[order] = crc
        return out


_CRC: list[Crc] = []


def _crc() -> Crc:
    if not _CRC:
        _CRC.append(Crc())
    return _CRC[0]


def buckets_of(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, doc_at: np.ndarray, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Packed buckets of all features, document by document, and where each begins.

    Words lie at ``starts`` to ``stops`` of the lower-cased ``data``; those of document k
    are numbers ``doc_at[k]`` to ``doc_at[k + 1]``."""
    crc, n = _crc(), len(starts)
    one = crc.of(data, starts, stops)
    size = stops - starts
    joined = crc.shifted(np.full(n, zlib.crc32(b" "), np.uint32), size) ^ one  # a blank and the word
    left = np.repeat(doc_at[1:], np.diff(doc_at)) - np.arange(n)  # words of the document from here on
    per_word = np.minimum(left, longest)
    place = np.cumsum(per_word) - per_word
    out = np.empty(int(per_word.sum()), np.uint16)
    now, live = one, np.arange(n)
    for k in range(longest):
        if k:
            keep = left[live] > k
            live, now = live[keep], now[keep]
            now = crc.shifted(now, size[live + k] + 1) ^ joined[live + k]
        out[place[live] + k] = now % np.uint32(buckets)
    ends = np.append(place, len(out))
    return out, ends[doc_at]


def _schema(docs: DataFrame, rest: str) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row long, pieces int, n_words long, n_features long, {rest}"


def streams(docs: DataFrame, chunk_words: int = CHUNK_WORDS, **options) -> DataFrame:
    """``doc_id``, ``row`` (a number of its own), ``pieces``, ``n_words``, ``n_features``
    and ``stream``, the packed buckets, of every document; a text over ``chunk_words``
    words has a row for each of its pieces.

    Null and empty texts have one piece without features."""
    longest = options.get("longest", LONGEST)
    names = ["doc_id", "row", "pieces", "n_words", "n_features", "stream"]

    def record(ids, row, pieces, n_words, cut):
        n = np.array([len(c) // 2 for c in cut], np.int64)
        return pa.RecordBatch.from_arrays([ids, row, pa.array(np.full(len(cut), pieces, np.int32)), pa.array(n_words.astype(np.int64)), pa.array(n), pa.array(cut, pa.binary())], names=names)

    def one(batches):
        for batch in batches:
            data, offsets = raw_strings(batch.column(2))
            for i, j in runs(offsets):
                ids, row = batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i)
                low = LOWER[data[offsets[i] : offsets[j]]]
                at = offsets[i : j + 1] - offsets[i]
                starts, stops = bounds(WORD_BYTE[low], at)
                if j - i > 1 or len(starts) <= chunk_words:
                    word_at = np.searchsorted(starts, at, "left")
                    packed, ends = buckets_of(low, starts, stops, word_at, **options)
                    raw = packed.tobytes()
                    yield record(ids, row, 1, np.diff(word_at), [raw[2 * a : 2 * b] for a, b in zip(ends, ends[1:], strict=False)])
                    continue
                firsts = range(0, len(starts), chunk_words)
                for a in firsts:
                    # with the first words of the next piece, whose features are its own
                    b = min(a + chunk_words, len(starts))
                    more = min(b + longest - 1, len(starts))
                    packed, _ = buckets_of(low, starts[a:more], stops[a:more], np.array([0, more - a]), **options)
                    own = int(np.minimum(np.arange(more - a, more - b, -1), longest).sum())
                    yield record(ids, row, len(firsts), np.array([b - a]), [packed[:own].tobytes()])

    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(one, _schema(docs, "stream binary"))


def counted(table: DataFrame) -> DataFrame:
    """``bucket`` and ``n`` of a table of streams: streams of a batch laid end to end are
    sorted and run-length encoded; the runs are summed."""

    def one(batches):
        for batch in batches:
            data, offsets = raw_strings(batch.column(0))
            for i, j in runs(offsets):
                packed = np.sort(np.frombuffer(data[offsets[i] : offsets[j]].tobytes(), np.uint16), kind="stable")
                begin = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])) if len(packed) else np.zeros(0, np.int64)
                n = np.diff(np.append(begin, len(packed)))
                yield pa.RecordBatch.from_arrays([pa.array(packed[begin].astype(np.int32)), pa.array(n.astype(np.int64))], names=["bucket", "n"])

    return table.select("stream").mapInArrow(one, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and ``gain``: a thousand times the logarithm of how much likelier a bucket
    is in the target than in the corpus, each count raised by one; one row a bucket."""
    spark = corpus.sparkSession
    all_s, all_t = (x.agg(F.sum("n")).first()[0] or 0 for x in (corpus, target))
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    odds = (F.col("t") + 1).cast("double") * F.lit(float(all_s + buckets)) / ((F.col("s") + 1).cast("double") * F.lit(float(all_t + buckets)))
    return both.select("bucket", F.floor(1000 * F.log(odds)).cast("long").alias("gain"))


def weighed(table: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id``, ``row``, ``pieces``, ``n_words``, ``n_features`` and ``weight`` of every stream."""
    shared = table.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def one(batches):
        for batch in batches:
            data, offsets = raw_strings(batch.column(5))
            total = np.zeros(len(batch), np.int64)
            for i, j in runs(offsets):
                got = shared.value[np.frombuffer(data[offsets[i] : offsets[j]].tobytes(), np.uint16)]
                at = (offsets[i : j + 1] - offsets[i]) // 2
                held = np.flatnonzero(np.diff(at) > 0)
                if len(held):
                    total[i + held] = np.add.reduceat(got, at[held])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(total)], names=["doc_id", "row", "pieces", "n_words", "n_features", "weight"])

    return table.mapInArrow(one, _schema(table, "weight long"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A thousandth-unit Gumbel value from a hash of the id; null counts as no digits."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Every document's ``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and
    ``rank``: 1, 2, ... for the ``percent`` of the documents of ``least_words`` words or
    more with the highest scores, equal scores by id (null first), null for all others.

    Null and empty texts have no features and weigh 0.  Rows with one id and one score
    take ranks next to each other.  An empty target, or no documents, do no harm.  Other
    columns are not looked at."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("bucket numbers have 16 bits")
    options = {"buckets": buckets, "longest": longest}
    table = written(streams(docs, chunk_words, **options), "streams")
    aim = counted(streams(target.select(F.lit(0).alias("doc_id"), "text"), chunk_words, **options))
    gain = gains(written(counted(table), "counts"), written(aim, "counts"), buckets).orderBy("bucket").toArrow()
    pieces = written(weighed(table, gain.column("gain").to_numpy().astype(np.int64)), "weights")
    dropped(table)
    sums = [F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")]
    whole = pieces.where("pieces = 1").drop("pieces").unionByName(pieces.where("pieces > 1").groupBy("doc_id", "row").agg(*sums))
    scored = whole.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    enough = scored.where(F.col("n_words") >= least_words)
    drawn = percent * enough.count() // 100
    # the row number parts equal scores of equal ids, so that no range is larger than others
    ranked = placed(enough, [F.col("score").desc(), F.col("doc_id").asc(), F.col("row").asc()])
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    rest = scored.where(F.col("n_words") < least_words).select(*names, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*names, rank.cast("long").alias("rank")).unionByName(rest)


def sample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The documents that are drawn, with all their columns, by their ids."""
    ids = resampled(docs, target, **options).where("rank is not null").select("doc_id").distinct()
    return docs.join(ids.withColumnRenamed("doc_id", "__drawn"), F.col("doc_id").eqNullSafe(F.col("__drawn")), "left_semi")


def digest(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """One row per document: features, weight, score and rank in the draw.

    Null and empty texts have no features; repeated rows are judged one by one."""
    return resampled(docs, target, **options).select("doc_id", "n_features", "weight", "score", "rank")


def brute_force(docs: list[tuple], target: list, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS) -> dict:
    """The contract read feature by feature, for tests: rows by id."""
    import hashlib
    import math
    import re
    from collections import Counter

    def split(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)

    def features(own):
        return [zlib.crc32(" ".join(own[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(own) - k + 1)]

    split_docs = {i: split(text) for i, text in docs}
    s, t = Counter(), Counter()
    for own in split_docs.values():
        s.update(features(own))
    for text in target:
        t.update(features(split(text)))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = {}
    for i, own in split_docs.items():
        held = features(own)
        weight = sum(gain[b] for b in held)
        h = int(hashlib.sha256(f"{SEED}:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(held), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((i for i, own in split_docs.items() if len(own) >= least_words), key=lambda i: (-out[i][2], i))
    for rank, i in enumerate(able[: percent * len(able) // 100], 1):
        out[i][3] = rank
    return out
