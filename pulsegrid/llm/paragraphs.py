"""Substring dedup: repeated paragraphs by MinHash banding.

Two kinds of paragraph are looked at, both of ``LEAST_WORDS`` words or more.

*Lines* are newline paragraphs.  Their MinHash bands are tuned for high recall at the
similarity asked for, colliding lines are joined through a central one, verified by
exact Jaccard similarity of their word shingles, and clustered by components.

*Passages* are stretches of words anywhere in a text.  In every ``LEAST_WORDS`` words that
follow each other start ``WINDOW`` grams of words; the one with the smallest hash is an
anchor: a MinHash band of one row, the same wherever these words stand.  A place meets the
first place of its anchor and the one before it, where the words around are compared: what
is equal for ``LEAST_WORDS`` words goes, and what goes on past edits while the exact Jaccard
similarity of the shingles holds.  An anchor is half of ``LEAST_WORDS`` long, so that
scattered pieces of a passage, too short to go themselves, hold only some of its anchors:
by the others its copies meet.  Inside a text a place meets the one before.  As everything
points to an earlier place, one occurrence stays of every component of similar passages.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.dartminhash import linked
from pulsegrid.llm.skew import met
from pulsegrid.llm.storage import dropped, written
from pulsegrid.llm.suffixes import KEYS, keyed, sliding_min
from pulsegrid.llm.text import Rolling, fold, in_runs, mix, ragged, raw_strings, runs, words

SHINGLE = 5
SIMILARITY = 0.8
#: Repeats of fewer words stay: headings, stock phrases, licence lines.
LEAST_WORDS = 18
BANDS, ROWS = 6, 2  # recall at a similarity of 0.8: 1 - (1 - 0.8**2)**6 = 0.998
WINDOW = 10  # grams among which an anchor is chosen: 9 words each, for LEAST_WORDS
TILE = 48  # words that are looked up together


class Parts:
    """Lines and blocks of a run of documents, as ranges of word numbers."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.starts, self.stops, self.hashes, self.word_at = words(data, offsets)
        self.rolling = Rolling(self.hashes)
        n_docs = len(offsets) - 1
        self.owner = np.repeat(np.arange(n_docs), np.diff(self.word_at))
        self.first_word = self.word_at[:-1]

    def _ranges(self, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, first and one past the last word of the parts that start where ``cut`` is set."""
        if not len(self.starts):
            return (np.zeros(0, np.int64),) * 3
        cut[self.first_word[np.diff(self.word_at) > 0]] = True
        first = np.flatnonzero(cut)
        return self.owner[first], first, np.append(first[1:], len(cut))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        breaks = np.concatenate([[0], np.cumsum(self.data == 0x0A)])[self.starts]
        return self._ranges(np.concatenate([[True], breaks[1:] != breaks[:-1]])[: len(breaks)])

    def anchors(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the ``size``-word grams that are smallest in some window of starts
        inside one text, and the words at which they start.

        Of texts that hold fewer grams than a window the smallest of all is taken."""
        if len(self.starts) < size:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        grams = self.rolling.grams(size)
        own = self.owner[: len(grams)] == self.owner[size - 1 :]
        half = np.uint64(32)
        placed = (grams >> half << half) | np.arange(len(grams), dtype=np.uint64)
        at = np.zeros(0, np.int64)
        if len(grams) >= WINDOW:
            least = (sliding_min(placed, WINDOW) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            last = np.arange(WINDOW - 1, len(grams))
            at = least[own[last] & (self.owner[: len(least)] == self.owner[last])]
        held = np.maximum(np.diff(self.word_at) - size + 1, 0)
        few = np.flatnonzero((held > 0) & (held < WINDOW))
        if len(few):
            inside = ragged(self.first_word[few], held[few])
            begin = np.cumsum(held[few]) - held[few]
            at = np.concatenate([at, (np.minimum.reduceat(placed[inside], begin) & np.uint64(0xFFFFFFFF)).astype(np.int64)])
        at = np.unique(at)
        return grams[at], at

    def content(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return fold(self.rolling.spans(first, last), 101)

    def shingles(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Part and hash of every shingle."""
        n = np.maximum(last - first - SHINGLE + 1, 1)
        start = ragged(first, n)
        part = np.repeat(np.arange(len(n)), n)
        return part, self.rolling.spans(start, np.minimum(start + SHINGLE, last[part]))


def gram_of(least_words: int) -> int:
    """Words of an anchor."""
    return max(SHINGLE, least_words - WINDOW + 1)


def within_texts(owner: np.ndarray, gram: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Which anchors are the first of their kind in a text, and for the others owner,
    shift to the one before, first and last word, an entry for each shift of a text."""
    order = np.lexsort((at, gram, owner))
    again = np.zeros(len(at), bool)
    again[1:] = (owner[order[1:]] == owner[order[:-1]]) & (gram[order[1:]] == gram[order[:-1]])
    first = np.ones(len(at), bool)
    first[order[again]] = False
    places = np.flatnonzero(again)
    of, place = owner[order[places]], at[order[places]]
    shift = place - at[order[places - 1]]
    by = np.lexsort((place, shift, of))
    of, shift, place = of[by], shift[by], place[by]
    opens = np.ones(len(of), bool)
    opens[1:] = (of[1:] != of[:-1]) | (shift[1:] != shift[:-1])
    closes = np.append(opens[1:], True)[: len(of)]
    return first, (of[opens], shift[opens], place[opens], place[closes])


def _units(docs: DataFrame, bands: int, rows: int, least_words: int) -> DataFrame:
    """Anchors (``band`` -1), repeats inside a text (-2) and line bands of every text,
    which is cut into words once.

    ``place`` is a word's number for anchors, with ``node`` the number of words of the
    text; for lines it is the line's number, with ``node`` the hash of its words; for
    repeats it is the first word, with the shift as ``key`` and the last as ``node``."""
    schema = pa.schema([("band", pa.int32()), ("key", pa.int64()), ("node", pa.int64()), ("row_key", pa.int64()), ("row_id", pa.int64()), ("place", pa.int32())])

    def one(batches):
        for batch in batches:
            row_key, row_id = (batch.column(k).to_numpy() for k in (0, 1))
            data, offsets = raw_strings(batch.column(2))
            for i, j in runs(offsets):
                parts = Parts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                gram, at = parts.anchors(gram_of(least_words))
                first, inner = within_texts(parts.owner[at], gram, at)
                gram, at = gram[first], at[first]
                size = np.diff(parts.word_at)[parts.owner[at]].astype(np.uint64)
                doc, first_word, last = parts.lines()
                number = np.arange(len(doc)) - np.searchsorted(doc, doc)
                keep = last - first_word >= least_words
                doc, first_word, last, number = doc[keep], first_word[keep], last[keep], number[keep]
                part, shingle = parts.shingles(first_word, last)
                begin = np.searchsorted(part, np.arange(len(doc)))
                keys = [gram, inner[1].astype(np.uint64)]
                for b in range(bands):
                    key = np.full(len(doc), b, np.uint64)
                    for r in range(rows):
                        if len(doc):
                            key = fold(key, 7) + np.minimum.reduceat(fold(shingle, 1000 + b * rows + r), begin)
                    keys.append(fold(key, 13))
                of = np.concatenate([parts.owner[at], inner[0], np.tile(doc, bands)]) + i
                start = parts.first_word
                place = np.concatenate([at - start[parts.owner[at]], inner[2] - start[inner[0]], np.tile(number, bands)])
                band = np.concatenate([np.full(len(at), -1), np.full(len(inner[0]), -2), np.repeat(np.arange(bands), len(doc))])
                node = np.concatenate([size, (inner[3] - start[inner[0]]).astype(np.uint64), np.tile(parts.content(first_word, last), bands)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(band.astype(np.int32)), pa.array(np.concatenate(keys).view(np.int64)), pa.array(node.view(np.int64)), pa.array(row_key[of]), pa.array(row_id[of]), pa.array(place.astype(np.int32))], schema=schema
                )

    return docs.select("row_key", "row_id", "text").mapInArrow(one, "band int, key long, node long, row_key long, row_id long, place int")


def _line_sets(joined: DataFrame) -> DataFrame:
    """Sorted 32-bit hashes of the different shingles of the lines that are asked for."""

    def one(batches):
        for batch in in_runs(batches, 0):
            data, offsets = raw_strings(batch.column(0))
            asked = batch.column(1).to_pylist()
            nodes, sets = [], []
            for i, j in runs(offsets):
                parts = Parts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                doc, first, last = parts.lines()
                at = np.searchsorted(doc, np.arange(j - i))
                for k in range(i, j):
                    for want in asked[k]:
                        line = at[k - i] + want["place"]
                        _, shingle = parts.shingles(first[line : line + 1], last[line : line + 1])
                        nodes.append(want["node"])
                        sets.append(np.unique((fold(np.unique(shingle), 41) >> np.uint64(32)).astype(np.uint32)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return joined.select("text", "asked").mapInArrow(one, "node long, shingles binary")


def _tiles(joined: DataFrame) -> DataFrame:
    """Word hashes of the tiles that are asked for."""
    schema = pa.schema([("to_key", pa.int64()), ("to_id", pa.int64()), ("tile", pa.int32()), ("n", pa.int64()), ("words", pa.binary())])

    def one(batches):
        for batch in in_runs(batches, 2):
            data, offsets = raw_strings(batch.column(2))
            row_key, row_id, asked = (batch.column(k).to_pylist() for k in (0, 1, 3))
            rows = []
            for i, j in runs(offsets):
                parts = Parts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                short = short_words(parts)
                for k in range(i, j):
                    own = short[parts.word_at[k - i] : parts.word_at[k - i + 1]]
                    rows += [(row_key[k], row_id[k], w["tile"], w["n"], own[w["tile"] * TILE : (w["tile"] + 1) * TILE].tobytes()) for w in asked[k]]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return joined.select("row_key", "row_id", "text", "asked").mapInArrow(one, "to_key long, to_id long, tile int, n long, words binary")


def short_words(parts: Parts, low: int = 0, high: int | None = None) -> np.ndarray:
    """32-bit hashes of words low to high."""
    return (parts.hashes[low:high] >> np.uint64(32)).astype(np.uint32)


def _counted(rows: DataFrame) -> int:
    return rows.agg(F.sum("n")).first()[0] or 0


def repeated_lines(docs: DataFrame, units: DataFrame, least: float) -> DataFrame:
    """``row_key``, ``row_id``, ``place`` of every line that repeats an earlier one."""
    here = F.struct("row_key", "row_id", "place")
    pairs = units.where("band >= 0").select("key", "node").distinct()
    hits = written(pairs.join(pairs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "buckets")
    lines = units.where("band = 0").select("node", "row_key", "row_id", "place")
    kinds = written(lines.groupBy("node").agg(F.count("*").alias("n"), F.min(here).alias("kept")), "lines")
    asked = kinds.join(hits.select("node").distinct(), "node", "left_semi").select("node", "kept.*")
    by_row = asked.groupBy("row_key", "row_id").agg(F.collect_list(F.struct("node", "place")).alias("asked"))
    sets = written(_line_sets(docs.join(by_row, ["row_key", "row_id"])).dropDuplicates(["node"]), "sets")
    labels = linked(hits, sets, least)
    # of equal lines and of those in one component the first stays
    found = kinds.join(labels, "node", "left").withColumn("cluster", F.coalesce("component", "node"))
    first = found.groupBy("cluster").agg(F.min("kept").alias("first"), F.sum("n").alias("all")).where("all > 1")
    clusters = written(found.select("node", "cluster", "n").join(first, "cluster").select("node", "n", F.col("first").alias("kept")), "clusters")
    gone = met(lines, clusters, ["node"], _counted(clusters)).where(here != F.col("kept"))
    gone = written(gone.select("row_key", "row_id", "place"), "repeats")
    dropped(hits, sets, kinds, clusters)
    return gone


def _met_places(batches):
    """Places of anchors in order of anchor and text, with an earlier place of the anchor
    each (``kind`` 0): its first one, and the one before it.

    Only what a partition's first anchor has in earlier partitions isn't known: its places
    have no first one (``kind`` 1, and the very first none before).  The first place of a
    partition (2) and its last one, with the first of the same anchor (3), tell it later."""
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), *[(c, pa.int64()) for c in PLACE], *[("to_" + c, pa.int64()) for c in PLACE]])
    part, before, first, open_ = TaskContext.get().partitionId(), None, None, True

    def rows(kind, own, other, known=None):
        columns = [pa.array(np.full(len(own), kind, np.int32)), pa.array(np.full(len(own), part, np.int32)), *[pa.array(own[:, k]) for k in range(5)], *[pa.array(other[:, k], mask=None if known is None else ~known) for k in range(5)]]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for batch in batches:
        own = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(5)], axis=1)
        if not len(own):
            continue
        head = before is None
        own = own if head else np.concatenate([before[None], own])
        # the same anchor of the same text: a repeated row
        own = own[np.append(True, (own[1:, :3] != own[:-1, :3]).any(axis=1))]
        fresh = np.append(False, own[1:, 0] != own[:-1, 0])
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(own)), 0))
        first = own[0] if head else first
        firsts = np.where((run > 0)[:, None], own[run], first[None])
        still = (run == 0) & open_
        if head:
            yield rows(2, own[:1], own[:1])
        later = ~fresh
        later[0] = head
        known = np.ones(len(own), bool)
        known[0] = not head
        previous = np.concatenate([own[:1], own[:-1]])
        settled = later & ~still
        yield rows(0, own[settled], firsts[settled])
        other = settled & (previous != firsts).any(axis=1)
        yield rows(0, own[other], previous[other])
        yield rows(1, own[later & still], previous[later & still], known[later & still])
        before, first, open_ = own[-1], firsts[-1], bool(still[-1])
    if before is not None:
        yield rows(3, before[None], first[None], np.array([not open_]))


PLACE = ["key", "row_key", "row_id", "place", "n_words"]


def _carried(ends: list) -> list[tuple]:
    """What the first anchor of each partition has before: partition, first place, last one."""
    out, carry = [], None
    heads = {r.part: r for r in ends if r.kind == 2}
    for tail in sorted((r for r in ends if r.kind == 3), key=lambda r: r.part):
        head = heads[tail.part]
        own = (head.row_key, head.row_id, head.place)
        goes_on = carry is not None and carry[0] == head.key
        first, last = carry[1:] if goes_on else (own, None)
        out.append((tail.part, *first, *(last or (None,) * 3)))
        carry = (tail.key, (tail.to_row_key, tail.to_row_id, tail.to_place) if tail.to_key is not None else first, (tail.row_key, tail.row_id, tail.place))
    return out


def met_places(anchors: DataFrame) -> DataFrame:
    """Pairs of a place and an earlier place of its anchor: its first one, and the one before.

    Anchors are dealt to ranges and read in order, so that an anchor of any number of places
    spreads over as many ranges as it fills; one row a range tells what it goes on from."""
    order = PLACE[:3]
    kinds = "kind int, part int, " + ", ".join(f"{c} long" for c in [*PLACE, *["to_" + c for c in PLACE]])
    held = written(anchors.select(*PLACE).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_met_places, kinds), "places")
    here = ["row_key", "row_id", "place", "n_words"]
    there = [F.col(c).alias(n) for c, n in (("to_row_key", "to_key"), ("to_row_id", "to_id"), ("to_place", "to_place"))]
    names = ["first_key", "first_id", "first_place", "last_key", "last_id", "last_place"]
    carried = anchors.sparkSession.createDataFrame(_carried(held.where("kind > 1").collect()), "part int, " + ", ".join(f"{c} long" for c in names))
    open_ = held.where("kind = 1").join(F.broadcast(carried), "part")  # a row a partition
    # the first place of a partition may have one before it in another
    to_first = open_.select(*here, F.col("first_key").alias("to_key"), F.col("first_id").alias("to_id"), F.col("first_place").alias("to_place"))
    to_last = open_.select(*here, F.coalesce("to_row_key", "last_key").alias("to_key"), F.coalesce("to_row_id", "last_id").alias("to_id"), F.coalesce("to_place", "last_place").alias("to_place")).where("to_key is not null")
    pairs = held.where("kind = 0").select(*here, *there).unionByName(to_first.unionByName(to_last).distinct())
    pairs = pairs.where("row_key <> to_key or row_id <> to_id")
    pairs.stored_at = held.stored_at
    return pairs


def reach_of(n, least_words: int = LEAST_WORDS, least: float = SIMILARITY):
    """Words that may belong to a similar passage before or after ``n`` anchored words, a
    number or a column's name.

    A passage of N words bears N / 45 edits at a similarity of 0.8, as each costs five
    shingles of it, and without an anchor fewer than 18 words stand between edits.  So x
    words past the anchored ones hold x / 18 edits, which makes x at most 18 n / 27."""
    between = max(2 * SHINGLE, least_words)
    words_an_edit = round(SHINGLE * (1 + least) / (1 - least)) if least < 1 else 1 << 30
    share = max(1, words_an_edit - between)
    return between * (max(1, n // share) if isinstance(n, int) else F.expr(f"greatest(1, ({n}) div {share})"))


def repeated_passages(docs: DataFrame, units: DataFrame, least_words: int, least: float) -> DataFrame:
    """What each text shares with earlier texts, by row: ``shared`` holds the row and the
    offset of an earlier place, the first and last anchor word, and the words there."""
    gram = gram_of(least_words)
    pairs = met_places(units.where("band = -1").select("key", "row_key", "row_id", "place", F.col("node").alias("n_words")))
    shift = (F.col("place") - F.col("to_place")).cast("int").alias("shift")
    matches = pairs.groupBy("row_key", "row_id", "to_key", "to_id", shift).agg(F.min("place").cast("int").alias("low"), F.max("place").cast("int").alias("high"), F.max("n_words").cast("int").alias("n_words"))
    reach = reach_of(f"high - low + {gram}", least_words, least)
    # of what is left of the text on each side, and no more than is similar to it
    before = F.least(reach, F.expr("low + low div 4 + 5"))
    after = F.least(reach, F.expr(f"(n_words - high - {gram}) * 5 div 4 + 5"))
    matches = written(matches.withColumns({"before": before.cast("int"), "after": after.cast("int")}), "matches")
    dropped(pairs)
    low = F.greatest(F.lit(0), F.col("low") - F.col("shift") - F.col("before"))
    high = F.col("high") - F.col("shift") + gram + F.col("after")
    wanted = matches.withColumn("tile", F.explode(F.sequence((low / TILE).cast("int"), (high / TILE).cast("int"))))
    needed = wanted.groupBy("to_key", "to_id", "tile").agg(F.count("*").alias("n"))
    by_row = needed.groupBy(F.col("to_key").alias("row_key"), F.col("to_id").alias("row_id")).agg(F.collect_list(F.struct("tile", "n")).alias("asked"))
    # equal rows give equal tiles
    tiles = written(_tiles(docs.join(by_row, ["row_key", "row_id"])).where(F.octet_length("words") > 0).dropDuplicates(["to_key", "to_id", "tile"]), "tiles")
    held = met(wanted, tiles, ["to_key", "to_id", "tile"], _counted(tiles))
    shared = held.groupBy("row_key", "row_id").agg(F.collect_list(F.struct("to_key", "to_id", "shift", "low", "high", "tile", "words")).alias("shared"))
    shared = written(shared, "shared")
    dropped(matches, tiles)
    return shared


def repeated(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, least_words: int = LEAST_WORDS) -> DataFrame:
    """Repeated lines (``places``) and passages (``shared`` with other texts, ``inner``
    with themselves) of keyed ``docs``, by row."""
    docs = docs.select(F.col("__row_key").alias("row_key"), F.col("__row_id").alias("row_id"), "text")
    units = written(_units(docs.where(F.length("text") > 0), bands, rows, least_words), "units")
    gone = repeated_lines(docs, units, least)
    shared = repeated_passages(docs, units, least_words, least)
    keys = ["row_key", "row_id"]
    by_line = gone.distinct().groupBy(*keys).agg(F.collect_list("place").alias("places"))
    inner = units.where("band = -2").select(*keys, F.col("key").alias("shift"), F.col("place").alias("low"), F.col("node").alias("high"))
    by_shift = inner.distinct().groupBy(*keys).agg(F.collect_list(F.struct("shift", "low", "high")).alias("inner"))
    held = written(shared.join(by_line, keys, "full").join(by_shift, keys, "full"), "repeats")
    dropped(units, gone, shared)
    return held.select(F.col("row_key").alias("__row_key"), F.col("row_id").alias("__row_id"), F.struct("places", "shared", "inner").alias("__repeats"))


def grams_of(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of the shingles of a text's 32-bit words."""
    n = max(0, len(words) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n].astype(np.uint64)
    return mix(out)


def _steps(own: list[int], other: list[int]) -> list[tuple[int, int]]:
    """Ways to go on past edits, from the first shingles on: how many words are taken here
    and there, ends of equal words only.

    Each way leads to the nearest shingle that both sides have; edits may change, add or
    drop any number of words."""
    out, i, j = [(0, 0)], 0, 0
    if not own or not other:
        return out
    where: dict[int, list[int]] = {}
    for y, gram in enumerate(other):
        where.setdefault(gram, []).append(y)
    while True:
        best = None
        for p in range(i, len(own)):
            if best and p - i >= best[0]:
                break
            held = where.get(own[p])
            at = bisect.bisect_left(held, j) if held else 0
            if held and at < len(held) and (best is None or p - i + held[at] - j < best[0]):
                best = (p - i + held[at] - j, p, held[at])
        if best is None:
            return out
        _, p, q = best
        k, most = 1, min(len(own) - p, len(other) - q)
        while k < most and own[p + k] == other[q + k]:
            k += 1
        i, j = p + k + SHINGLE - 1, q + k + SHINGLE - 1
        out.append((i, j))


def alike(own: np.ndarray, other: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sets of shingles reaches ``least``."""
    a, b = set(own.tolist()), set(other.tolist())
    same = len(a & b)
    return same >= least * (len(a) + len(b) - same)


def near_stretch(own: np.ndarray, a: int, b: int, other: np.ndarray, shift: int, least_words: int = LEAST_WORDS, least: float = SIMILARITY) -> tuple[int, int] | None:
    """The longest stretch around words a to b, equal to those at ``shift`` words before
    in the other text, that goes on past an edit and is similar to what stands there.

    Texts are given by their shingles."""
    reach, back = reach_of(b - a, least_words, least), SHINGLE - 1
    x, y = a - shift, b - shift
    before = lambda grams, at: grams[max(0, at - reach) : max(0, at - back)][::-1].tolist()
    after = lambda grams, at: grams[at : max(at, at + reach - back)].tolist()
    left, right = _steps(before(own, a), before(other, x)), _steps(after(own, b), after(other, y))
    ways = sorted(((i + j, i, p, j, q) for i, p in left for j, q in right), reverse=True)
    for more, i, p, j, q in ways:
        if more and alike(own[a - i : b + j - back], other[x - p : y + q - back], least):
            return a - i, b + j
    return None


def passages(own: np.ndarray, low: int, high: int, other: np.ndarray, base: int, least_words: int = LEAST_WORDS, least: float = SIMILARITY, grams: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Stretches of words that repeat ``other``, the words of an earlier place whose first
    one lies at word ``base`` of this text.  Anchors start from ``low`` to ``high``.

    Every stretch of equal words with an anchor's length is taken to its true ends, and
    past edits where it stays similar.  ``grams`` are the shingles of ``own``, if known."""
    gram = gram_of(least_words)
    reach = max(least_words, reach_of(high - low + gram, least_words, least))
    a, b = max(0, base, low - reach), min(len(own), base + len(other), high + gram + reach)
    if a >= b:
        return []
    same = np.concatenate([[False], own[a:b] == other[a - base : b - base], [False]])
    edge = np.flatnonzero(same[1:] != same[:-1])
    grams, there = grams_of(own) if grams is None else grams, None
    out: list[tuple[int, int]] = []
    for p, q in zip((edge[::2] + a).tolist(), (edge[1::2] + a).tolist(), strict=True):
        if q - p < least_words or q <= low or p > high:
            continue
        out.append((p, q))
        if p == 0 and q == len(own):
            continue
        there = (grams if other is own else grams_of(other)) if there is None else there
        if reached := near_stretch(grams, p, q, there, base, least_words, least):
            out.append(reached)
    return out


def _others(shared: list[dict]) -> list[tuple[int, int, int, np.ndarray, int]]:
    """Matches with the words of their tiles put together: first and last anchor, shift,
    words, and the word number of the first one there."""
    tiles: dict[tuple, list[tuple[int, bytes]]] = {}
    for s in shared:
        tiles.setdefault((s["to_key"], s["to_id"], s["shift"], s["low"], s["high"]), []).append((s["tile"], s["words"]))
    return [(low, high, shift, np.frombuffer(b"".join(w for _, w in sorted(held)), np.uint32), min(held)[0] * TILE) for (_, _, shift, low, high), held in sorted(tiles.items())]


def spans_to_remove(text: bytes, parts: Parts, k: int, repeats: dict, lines: tuple[np.ndarray, np.ndarray, np.ndarray], least: float = SIMILARITY, least_words: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """Merged byte ranges of text ``k`` of a run that go, from its repeated lines and
    passages."""
    low, high = parts.word_at[k], parts.word_at[k + 1]
    starts, own = parts.starts[low:high] - parts.offsets[k], short_words(parts, low, high)
    spans: list[tuple[int, int]] = []
    for line in repeats["places"] or []:
        at = np.searchsorted(lines[0], k) + line
        begin = text.rfind(b"\n", 0, starts[lines[1][at] - low]) + 1
        end = text.find(b"\n", parts.stops[lines[2][at] - 1] - parts.offsets[k])
        spans.append((begin, len(text) if end < 0 else end + 1))
    found: list[tuple[int, int]] = []
    grams = grams_of(own)
    for first, last, shift, other, begin in _others(repeats["shared"] or []):
        found += passages(own, first, last, other, begin + shift, least_words, least, grams)
    for r in repeats["inner"] or []:
        found += passages(own, r["low"], r["high"], own, r["shift"], least_words, least, grams)
    spans += [(int(starts[a]), len(text) if b >= len(starts) else int(starts[b])) for a, b in found]
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _with_repeats(docs: DataFrame, **options) -> DataFrame:
    base = keyed(docs)
    return base.join(repeated(base, **options), KEYS, "left")


def _cut(texts: pa.Array, repeats: pa.Array, least: float = SIMILARITY, least_words: int = LEAST_WORDS, **_) -> tuple[list[bytes], list[list[tuple[int, int]]], list[int]]:
    data, offsets = raw_strings(texts)
    raw = data.tobytes()
    kept = [raw[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
    spans: list[list[tuple[int, int]]] = [[] for _ in kept]
    sizes = [len(t) for t in kept]
    known = repeats.is_valid().to_numpy(zero_copy_only=False)
    for i, j in runs(offsets):
        if not known[i:j].any():
            continue
        parts = Parts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        lines = parts.lines()
        for k in np.flatnonzero(known[i:j]).tolist():
            text, pieces, at = kept[i + k], [], 0
            spans[i + k] = spans_to_remove(text, parts, k, repeats[i + k].as_py(), lines, least, least_words)
            for a, b in spans[i + k]:
                pieces.append(text[at:a])
                at = b
            kept[i + k] = b"".join([*pieces, text[at:]])
    return kept, spans, sizes


def digest(docs: DataFrame, **options) -> DataFrame:
    """One row per document: how much of it repeats earlier occurrences and is removed,
    and a hash of what stays.

    Null is the empty text.  Rows with the same id and text are one text and agree; where
    they repeat no other row, they stay.  Texts under LEAST_WORDS words lose nothing."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def one(batches):
        for batch in in_runs(batches, 1):
            kept, spans, sizes = _cut(batch.column(1), batch.column(2), **options)
            columns = [pa.array(sizes, pa.int64()), pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_repeats(docs.select("doc_id", "text"), **options).select("doc_id", "text", "__repeats").mapInArrow(one, schema)


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """Documents without their repeated paragraphs; other columns as they came.

    Texts that lose nothing stay as they are, null included; a text that loses
    everything becomes empty."""
    names = docs.columns
    held = docs.withColumn("__null", F.col("text").isNull())
    frame = _with_repeats(held, **options).select(*names, "__null", "__repeats")
    at = names.index("text")

    def one(batches):
        for batch in in_runs(batches, at):
            kept, _, _ = _cut(batch.column(at), batch.column(len(names) + 1), **options)
            void = batch.column(len(names)).to_pylist()
            text = pa.array([None if v else t.decode() for t, v in zip(kept, void, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([text if k == at else batch.column(k) for k in range(len(names))], names=names)

    return frame.mapInArrow(one, docs.schema)
