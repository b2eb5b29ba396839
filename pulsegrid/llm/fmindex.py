"""Benchmark decontamination with one FM-index per training shard.

A shard is a stretch of an Arrow batch, ``SHARD_BYTES`` of text.  Benchmark windows are found in it by
backward search through wavelet-matrix ranks, located through sampled suffix
positions, and merged into removal spans.  Only stretches of benchmark vocabulary
long enough for a window enter the index: no window can occur anywhere else, so
nothing is lost and the index stays far smaller than the shard.

The benchmark is cut into blocks of about ``block_bytes`` of text; each block is broadcast
to a pass of its own over the documents, so neither a broadcast nor a worker grows with
the benchmark.  With one block the pass adds its result to the documents, which are not
shuffled.  With more, a pass writes what it finds, by text, and no documents; the finds
meet the documents once, after the last block.  A block keeps its words once, as 32-bit
symbols, and its windows as places in them; a shard looks up only windows whose last words
occur in it.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pulsegrid.llm.storage import dropped, written
from pulsegrid.llm.text import Rolling, owners, ragged, raw_strings, runs, words

WINDOW = 13
BLOCK_BYTES = 2 << 20
SHARD_BYTES = 8 << 20
SAMPLE_EVERY = 16
#: Words at the end of a window by which a shard chooses the windows that it looks up.
TAIL = 3

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("items", T.ArrayType(T.LongType())),
        T.StructField("span_start", T.ArrayType(T.LongType())),
        T.StructField("span_stop", T.ArrayType(T.LongType())),
        T.StructField("n_hit", T.LongType()),
    ]
)


class WaveletMatrix:
    """Ranks of any symbol in a prefix of a sequence, for many queries at once."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        # where the run of each symbol starts once all bits are sorted
        self.base = np.searchsorted(self._order(symbols), np.arange(1 << self.levels))

    def _order(self, symbols: np.ndarray) -> np.ndarray:
        key = np.zeros(len(symbols), np.int64)
        for level in range(self.levels):
            key |= ((symbols.astype(np.int64) >> level) & 1) << (self.levels - 1 - level)
        return key

    def rank(self, symbol: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position ``stop``."""
        at, key = stop.astype(np.int64), np.zeros(len(symbol), np.int64)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            bit = (symbol >> level) & 1
            one = self.ones[k][at]
            at = np.where(bit == 1, self.zeros[k] + one, at - one)
            key |= bit.astype(np.int64) << k
        return at - self.base[key]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at each position and how often it stands before it."""
        at, key = at.astype(np.int64), np.zeros(len(at), np.int64)
        symbol = np.zeros(len(at), np.int64)
        for k in range(self.levels):
            bit = (self.ones[k][at + 1] - self.ones[k][at]).astype(np.int64)
            one = self.ones[k][at]
            at = np.where(bit == 1, self.zeros[k] + one, at - one)
            symbol = (symbol << 1) | bit
            key |= bit << k
        return symbol, at - self.base[key]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; each separator (0) is a symbol of its own."""
    n = len(text)
    ends = text == 0
    rank = text.astype(np.int64) + int(ends.sum())
    rank[ends] = np.arange(int(ends.sum()))
    reach = 1
    while True:
        later = np.zeros(n, np.int64)
        later[: n - reach if reach < n else 0] = rank[reach:] + 1
        key = rank * (int(rank.max()) + 2) + later
        order = np.argsort(key, kind="stable")
        fresh = np.zeros(n, np.int64)
        fresh[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        rank, reach = fresh, reach * 2
        if n == 0 or rank[order[-1]] == n - 1:
            return order


class FMIndex:
    """Self-index of a symbol sequence that ends in 0; 0 separates stretches."""

    def __init__(self, text: np.ndarray, sigma: int):
        order = suffix_order(text)
        self.n = len(text)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.bwt = WaveletMatrix(text[order - 1], sigma)
        self.sampled = (order % SAMPLE_EVERY == 0) | (text[order - 1] == 0)
        self.place = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def search(self, symbols: np.ndarray, stops: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of patterns, given as stretches of ``symbols`` that end at ``stops``."""
        low, high = np.zeros(len(stops), np.int64), np.full(len(stops), self.n, np.int64)
        for back in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > back) & (low < high))
            if not len(live):
                break
            symbol = symbols[stops[live] - 1 - back]
            low[live] = self.before[symbol] + self.bwt.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.bwt.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by walking back to a sampled one.

        The first position of every stretch is sampled too, so that no walk has to
        step over a separator."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.sampled[rows[open_]]
            hit = open_[done]
            out[hit] = self.samples[self.place[rows[hit]]] + steps[hit]
            open_ = open_[~done]
            if len(open_):
                symbol, rank = self.bwt.access(rows[open_])
                rows[open_] = self.before[symbol] + rank
                steps[open_] += 1
        return out


class Windows:
    """Distinct windows of benchmark items, as stretches of the items' symbols."""

    def __init__(self, item_ids: list, texts: list, window: int = WINDOW):
        data, offsets = raw_strings(pa.array(texts, pa.string()))
        _, _, hashes, word_at = words(data, offsets)
        self.vocabulary, symbols = np.unique(hashes, return_inverse=True)
        self.symbols = (symbols.reshape(-1) + 1).astype(np.int32)
        counts = np.diff(word_at)
        size = np.minimum(counts, window)
        n_windows = np.where(counts > 0, counts - size + 1, 0)
        item = np.repeat(np.arange(len(counts)), n_windows)
        stop = ragged(word_at[:-1], n_windows) + size[item]
        length = size[item]
        rolling = Rolling(hashes)
        whole = rolling.spans(stop - length, stop) if len(stop) else np.zeros(0, np.uint64)
        order = np.lexsort((item, whole))
        stop, length, item, whole = stop[order], length[order], item[order], whole[order]
        first = np.ones(len(stop), bool)
        first[1:] = whole[1:] != whole[:-1]
        # equal hashes are windows of one kind only if their words agree
        again = np.flatnonzero(~first)
        for back in range(window):
            deep = again[length[again] > back]
            first[deep] |= self.symbols[stop[deep] - 1 - back] != self.symbols[stop[deep - 1] - 1 - back]
        first[again] |= length[again] != length[again - 1]
        self.item_at = np.append(np.flatnonzero(first), len(stop))
        self.item_of = np.array([np.iinfo(np.int64).min if i is None else i for i in item_ids], np.int64)[item]
        self.stops, self.lengths = stop[first].astype(np.int32), length[first].astype(np.int32)
        self.shortest = int(self.lengths.min(initial=window)) if len(self.lengths) else 0
        tails = rolling.spans(np.maximum(self.stops - TAIL, 0).astype(np.int64), self.stops.astype(np.int64)) if len(self.stops) else np.zeros(0, np.uint64)
        self.by_tail = np.argsort(tails, kind="stable").astype(np.int32)
        self.by_tail = self.by_tail[self.lengths[self.by_tail] >= TAIL]
        self.tails = tails[self.by_tail]
        self.always = np.flatnonzero(self.lengths < TAIL)

    def ending_in(self, tails: np.ndarray) -> np.ndarray:
        """Windows whose last words are among ``tails``, and all those of fewer words."""
        tails = np.unique(tails)
        low, high = np.searchsorted(self.tails, tails, "left"), np.searchsorted(self.tails, tails, "right")
        return np.concatenate([self.always, self.by_tail[ragged(low, high - low)]]).astype(np.int64)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Symbol of each word, 0 for words outside the benchmark."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def _stretches(symbol: np.ndarray, word_at: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of known words inside single documents."""
    known = symbol > 0
    first = np.zeros(len(symbol) + 1, bool)
    first[word_at] = True
    before = np.concatenate([[False], known[:-1]]) if len(known) else known
    after = np.concatenate([known[1:], [False]]) if len(known) else known
    start = np.flatnonzero(known & (~before | first[:-1]))
    stop = np.flatnonzero(known & (~after | first[1:])) + 1
    long = stop - start >= max(1, shortest)
    return start[long], (stop - start)[long]


def search_shard(texts: pa.Array, windows: Windows) -> dict[str, list]:
    """Word counts, items found and merged byte spans of every text of a shard."""
    data, offsets = raw_strings(texts)
    n = len(texts)
    counts = np.zeros(n, np.int64)
    symbols, docs, starts, stops, ordinal, tails = [], [], [], [], [], []
    for i, j in runs(offsets):
        base = offsets[i]
        begin, end, hashes, word_at = words(data[base : offsets[j]], offsets[i : j + 1] - base)
        counts[i:j] = np.diff(word_at)
        symbol = windows.known(hashes)
        first, length = _stretches(symbol, word_at, windows.shortest)
        if not len(first):
            continue
        at = ragged(first, length)
        ends = np.maximum(length - TAIL + 1, 0)
        tail = ragged(first, ends)
        tails.append(np.unique(Rolling(hashes).spans(tail, tail + TAIL)) if len(tail) else np.zeros(0, np.uint64))
        gap = np.cumsum(length)  # a separator follows every stretch
        doc = owners(word_at)
        symbols.append(np.insert(symbol[at], gap, 0))
        docs.append(np.insert(doc[at] + i, gap, -1))
        in_doc = np.concatenate([[0], offsets])[np.minimum(doc[at] + i + 1, n)]
        starts.append(np.insert(begin[at] + base - in_doc, gap, 0))
        stops.append(np.insert(end[at] + base - in_doc, gap, 0))
        ordinal.append(np.insert(at, gap, -1))
    found = {"n_words": counts, "items": [[] for _ in range(n)], "span_start": [[] for _ in range(n)], "span_stop": [[] for _ in range(n)], "n_hit": np.zeros(n, np.int64)}
    if not symbols:
        return found
    text, doc, start, stop, ordinal = (np.concatenate(x) for x in (symbols, docs, starts, stops, ordinal))
    index = FMIndex(text, len(windows.vocabulary) + 1)
    asked = windows.ending_in(np.concatenate(tails))
    low, high = index.search(windows.symbols, windows.stops[asked], windows.lengths[asked])
    pattern = np.repeat(asked, high - low)
    at = index.locate(ragged(low, high - low))
    if not len(at):
        return found
    cover = np.zeros(len(text) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + windows.lengths[pattern], -1)
    hit = np.cumsum(cover[:-1]) > 0
    np.add.at(found["n_hit"], doc[hit], 1)
    # neighbouring hit words of one stretch merge into one span
    place = np.flatnonzero(hit)
    opens = np.concatenate([[True], (place[1:] != place[:-1] + 1) | (doc[place[1:]] != doc[place[:-1]]) | (ordinal[place[1:]] != ordinal[place[:-1]] + 1)])
    closes = np.concatenate([opens[1:], [True]])
    for d, a, b in zip(doc[place[opens]].tolist(), start[place[opens]].tolist(), stop[place[closes]].tolist(), strict=True):
        found["span_start"][d].append(a)
        found["span_stop"][d].append(b)
    pairs = np.unique(np.stack([doc[at], pattern]), axis=1)
    many = windows.item_at[pairs[1] + 1] - windows.item_at[pairs[1]]
    of = windows.item_of[ragged(windows.item_at[pairs[1]], many)]
    both = np.unique(np.stack([np.repeat(pairs[0], many), of]), axis=1)
    for d, item in both.T.tolist():
        if item != np.iinfo(np.int64).min:
            found["items"][d].append(item)
    return found


def search(texts: pa.Array, windows: Windows, shard_bytes: int = SHARD_BYTES) -> dict[str, list]:
    """What ``search_shard`` finds, shard by shard."""
    _, offsets = raw_strings(texts)
    parts = [search_shard(texts.slice(i, j - i), windows) for i, j in runs(offsets, shard_bytes)]
    return {name: [x for part in parts for x in part[name]] for name in (f.name for f in FOUND)}


def _merged(starts: list[int], stops: list[int]) -> tuple[list[int], list[int]]:
    out: list[list[int]] = []
    for x, y in sorted(zip(starts, stops, strict=True)):
        if out and x <= out[-1][1]:
            out[-1][1] = max(y, out[-1][1])
        else:
            out.append([x, y])
    return [x for x, _ in out], [y for _, y in out]


def _n_words(data: np.ndarray) -> int:
    return len(words(data, np.array([0, len(data)]))[0])


def _block(benchmark: DataFrame, k: int, n: int, window: int) -> Windows:
    """Windows of block ``k`` of ``n``; each is gathered and broadcast by itself."""
    held = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    table = (held if n == 1 else held.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)).toArrow()
    return Windows(table.column("item_id").to_pylist(), table.column("text").to_pylist(), window)


_ARROW = pa.struct([("n_words", pa.int64()), ("items", pa.list_(pa.int64())), ("span_start", pa.list_(pa.int64())), ("span_stop", pa.list_(pa.int64())), ("n_hit", pa.int64())])


def _struct(found: dict[str, list]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(found[f.name], f.type) for f in _ARROW], fields=list(_ARROW))


def _block_hits(docs: DataFrame, windows, text_col: str) -> DataFrame:
    """``__text_key``, items and spans of the texts that a block has something in."""

    def one(batches):
        for batch in batches:
            found = search(batch.column(1), windows.value)
            hit = pa.array([bool(x) for x in found["span_start"]], pa.bool_())
            columns = [pa.array(found[c], pa.list_(pa.int64())) for c in ("items", "span_start", "span_stop")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["__text_key", "items", "span_start", "span_stop"]).filter(hit)

    return docs.select("__text_key", text_col).mapInArrow(one, "__text_key binary, items array<long>, span_start array<long>, span_stop array<long>")


def _in_blocks(docs: DataFrame, benchmark: DataFrame, window: int, n: int, text_col: str, into: str) -> DataFrame:
    spark, names = docs.sparkSession, docs.columns
    keyed = docs.withColumn("__text_key", F.unhex(F.md5(F.encode(F.coalesce(text_col, F.lit("")), "UTF-8"))))
    hits = []
    for k in range(n):
        shared = spark.sparkContext.broadcast(_block(benchmark, k, n, window))
        hits.append(written(_block_hits(keyed, shared, text_col).dropDuplicates(["__text_key"]), "hits"))
        shared.unpersist()
    every = hits[0]
    for more in hits[1:]:
        every = every.unionByName(more)
    gathered = [F.flatten(F.collect_list(F.struct(*columns)[c])).alias(c) for columns in [("items", "span_start", "span_stop")] for c in columns]
    by_text = written(every.groupBy("__text_key").agg(*gathered).select("__text_key", F.struct("items", "span_start", "span_stop").alias("__hits")), "hits")
    dropped(*hits)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, FOUND)])

    def one(batches):
        for batch in batches:
            data, offsets = raw_strings(batch.column(names.index(text_col)))
            found = {f.name: [] for f in FOUND}
            for k, hit in enumerate(batch.column(len(names)).to_pylist()):
                own = data[offsets[k] : offsets[k + 1]]
                starts, stops = _merged(hit["span_start"], hit["span_stop"]) if hit else ([], [])
                n_hit = sum(_n_words(own[a:b]) for a, b in zip(starts, stops, strict=True))
                for name, x in zip(found, (_n_words(own), sorted(set(hit["items"])) if hit else [], starts, stops, n_hit), strict=True):
                    found[name].append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], _struct(found)], names=[*names, into])

    return keyed.join(by_text, "__text_key", "left").select(*names, "__hits").mapInArrow(one, schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, text_col: str = "text", into: str = "found") -> DataFrame:
    """``docs`` with one more column ``into``: a struct of ``n_words``, ``n_hit``,
    ``items`` (ids of items with an occurring window, ascending) and the merged byte
    spans ``span_start``/``span_stop`` of hit words.

    Null and empty texts have no words and no hits.  Repeated rows are judged one by
    one.  An empty benchmark hits nothing.  Benchmark rows without an id still mark
    words but are not listed.  A column of docs already called ``into`` is replaced.
    """
    docs = docs.drop(into)
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    if n > 1:
        return _in_blocks(docs, benchmark, window, n, text_col, into)
    shared = docs.sparkSession.sparkContext.broadcast(_block(benchmark, 0, 1, window))
    at = docs.columns.index(text_col)

    def one(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _struct(search(batch.column(at), shared.value))], names=[*batch.schema.names, into])

    return docs.mapInArrow(one, T.StructType([*docs.schema.fields, T.StructField(into, FOUND)]))


def contaminated(found="found"):
    """The rule: at least a twentieth of a document's words lie in benchmark windows."""
    return (F.col(f"{found}.n_hit") > 0) & (F.lit(20) * F.col(f"{found}.n_hit") >= F.col(f"{found}.n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents that the rule leaves, with all their columns as they came.

    Null and empty texts stay; repeated rows are judged one by one."""
    return find_contamination(docs, benchmark, into="__found", **options).where(~contaminated("__found")).select(*docs.columns)


def excise(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Documents with the hit spans cut out of contaminated texts.

    Null texts stay null; repeated rows are cut one by one; other columns are kept."""
    found = find_contamination(docs, benchmark, text_col=text_col, into="__found", **options)
    raw = F.encode(F.col(text_col), "UTF-8")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.col("__found.span_stop"))
    stops = F.concat(F.col("__found.span_start"), F.array(F.octet_length(F.col(text_col)).cast("long")))
    kept = F.array_join(F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda s: F.decode(F.substring(raw, (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int")), "UTF-8")), "")
    return found.withColumn(text_col, F.when(contaminated("__found"), kept).otherwise(F.col(text_col))).select(*docs.columns)


def digest(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: the counts, a hash of the items found and the verdict.

    Null and empty texts have no words, no hits and are clean; repeated rows, and rows
    without an id, are judged one by one; an empty benchmark hits nothing."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark, **options).drop("text")
    names = F.array_join(F.array_sort(F.transform(F.col("found.items"), lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        F.col("found.n_hit").alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def brute_force(text: str | None, items: dict, window: int = WINDOW) -> tuple[int, int, list, str]:
    """The contract read word by word, for tests."""
    import re

    def split(x):
        return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in x or ""))

    own, hit, found = split(text), set(), []
    for item, other in items.items():
        w = split(other)
        k = min(window, len(w))
        seen = False
        for i in range(len(w) - k + 1 if w else 0):
            for j in range(len(own) - k + 1):
                if own[j : j + k] == w[i : i + k]:
                    hit.update(range(j, j + k))
                    seen = True
        if seen:
            found.append(item)
    names = ",".join(sorted(map(str, found)))
    return len(own), len(hit), found, hashlib.sha256(names.encode()).hexdigest()
