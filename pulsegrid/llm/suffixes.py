"""Removal of long repeated byte strings by bucket-pointer refinement.

Suffixes (places where a string of ``length`` bytes starts) lie in buckets of equal
leading q-grams.  A bucket is refined by the identifiers of the buckets that hold its
suffixes' later offsets; a suffix alone in its bucket is settled and leaves.  A round
numbers the pairs of neighbouring identifiers, so what it finds for the offsets 2q, 3q
serves the next round at offset 0 as well: depth doubles from q to ``length``.

A corpus has too many suffixes for a row each, so those that need no refinement are
settled in bulk first, which loses nothing:

* Two copies of a string hold the same smallest q-gram at the same place.  Suffixes
  whose anchor (this q-gram) occurs once are alone.
* The suffixes of one anchor form a stretch.  Equal stretches have all their suffixes
  in common buckets; one member of each kind stands for all.
* Slices of a stretch, by the bytes that all their starts have in common and by those
  that any has, are settled in the same way: alone, or all repeated.
* The suffixes that are left are refined one by one in :func:`refined`.

All steps are Spark groupings and joins over at least 128 bits of hashes, or over
exact bucket numbers; no bucket is ever gathered.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pulsegrid.llm.storage import dropped, written
from pulsegrid.llm.text import Rolling, in_runs, owners, ragged, raw_strings, runs

LENGTH = 400
GRAM = 100
SLICE = 32

_STRETCH = pa.schema([("row_key", pa.int64()), ("row_id", pa.int64()), ("anchor", pa.int64()), ("stretch", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("at", pa.int32()), ("copies", pa.int32())])


def _spark_schema(schema: pa.Schema) -> T.StructType:
    kinds = {pa.int64(): T.LongType(), pa.int32(): T.IntegerType(), pa.binary(): T.BinaryType(), pa.bool_(): T.BooleanType()}
    return T.StructType([T.StructField(f.name, kinds[f.type]) for f in schema])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every window of ``width``."""
    out, reach = values, 1
    while reach * 2 <= width:
        out, reach = np.minimum(out[:-reach], out[reach:]), reach * 2
    return np.minimum(out[: len(out) - (width - reach)], out[width - reach :]) if width > reach else out


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Stretches of string starts with one anchor: document, first and last start,
    anchor, hash of its gram and hash of the stretch's bytes (starts from the run's origin)."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    rolling = Rolling.of_bytes(data)
    grams = rolling.grams(gram)
    width = length - gram + 1
    # the place in the low half makes the leftmost of equal grams the smallest, and tells where it is
    half = np.uint64(32)
    keyed = (grams >> half << half) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(keyed, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    own = owners(offsets)
    valid = own[:n] == own[length - 1 :]
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    low = np.flatnonzero(begins)
    closes = valid.copy()
    closes[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
    high = np.flatnonzero(closes)
    at = anchor[low]
    return own[low], low, high, at, grams[at], rolling.spans(low, high + length)


def within_documents(of: np.ndarray, low: np.ndarray, high: np.ndarray, grams: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal stretches of one document, taken together before anything is shuffled.

    Returns the first of each kind, how many there are, and merged ranges of those that
    occur more than once: first and last stretch number of each range."""
    order = np.lexsort((spans, grams, of))
    new = np.ones(len(order), bool)
    for x in (of, grams, spans):
        y = x[order]
        new[1:] &= y[1:] == y[:-1]
    new[1:] = ~new[1:]
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(order)))
    again = np.zeros(len(order), bool)
    again[order] = np.repeat(counts > 1, counts)
    many = np.flatnonzero(again)
    opens = np.ones(len(many), bool)
    opens[1:] = (of[many[1:]] != of[many[:-1]]) | (low[many[1:]] > high[many[:-1]] + 1)
    closes = np.append(opens[1:], True)[: len(many)]
    return order[first], counts, many[opens], many[closes], again


def _find_stretches(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """A row per kind of stretch and document, and rows with 0 copies for ranges that
    repeat inside a document."""

    def one(batches):
        for batch in batches:
            key, ident = (batch.column(k).to_numpy() for k in (0, 1))
            data, offsets = raw_strings(batch.column(2))
            for i, j in runs(offsets):
                of, low, high, at, grams, spans = stretches(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length, gram)
                kept, counts, begin, end, _ = within_documents(of, low, high, grams, spans)
                pick, last = np.concatenate([kept, begin]), np.concatenate([kept, end])
                copies = np.concatenate([counts, np.zeros(len(begin), np.int64)]).astype(np.int32)
                origin = offsets[i + of[pick]] - offsets[i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[i + of[pick]]), pa.array(ident[i + of[pick]]), pa.array(grams[pick].view(np.int64)), pa.array(spans[pick].view(np.int64))]
                    + [pa.array((x - origin).astype(np.int32)) for x in (low[pick], high[last], at[pick])]
                    + [pa.array(copies)],
                    schema=_STRETCH,
                )

    return docs.select("row_key", "row_id", "text").mapInArrow(one, _spark_schema(_STRETCH))


def _cut_contexts(joined: DataFrame, length: int) -> DataFrame:
    """Bytes of the open stretches of each text."""
    schema = pa.schema([("anchor", pa.int64()), ("stretch", pa.int64()), ("n", pa.int64()), ("row_key", pa.int64()), ("row_id", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("at", pa.int32()), ("context", pa.binary())])

    def one(batches):
        for batch in in_runs(batches, 2):
            data, offsets = raw_strings(batch.column(2))
            raw = data.tobytes()
            rows = []
            for k, (key, ident, held) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True)):
                base = int(offsets[k])
                rows += [(s["anchor"], s["stretch"], s["n"], key, ident, s["low"], s["high"], s["at"], raw[base + s["low"] : base + s["high"] + length]) for s in held]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return joined.select("row_key", "row_id", "text", "held").mapInArrow(one, _spark_schema(schema))


def _slices(contexts: DataFrame, length: int, width: int) -> DataFrame:
    """Level 2 keys.  A slice holds the starts of one stretch that lie ``first`` to
    ``last`` bytes before the anchor, all in one cell of a fixed grid.  ``inner`` covers
    the bytes that any start of the cell has in common, ``outer`` those of all starts."""
    schema = pa.schema([("anchor", pa.int64()), ("stretch", pa.int64()), ("n", pa.int64()), ("cell", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("inner", pa.int64()), ("outer", pa.int64())])

    def one(batches):
        for batch in batches:
            anchor, stretch, n = (batch.column(k).to_numpy() for k in (0, 1, 2))
            low, high, at = (batch.column(k).to_numpy().astype(np.int64) for k in (3, 4, 5))
            data, offsets = raw_strings(batch.column(6))
            for i, j in runs(offsets):
                rolling = Rolling.of_bytes(data[offsets[i] : offsets[j]])
                near, far = (at - high)[i:j], (at - low)[i:j]
                cells = far // width - near // width + 1
                of = np.repeat(np.arange(j - i), cells)
                cell = ragged(near // width, cells)
                first, last = np.maximum(near[of], cell * width), np.minimum(far[of], cell * width + width - 1)
                anchor_at = offsets[i:j][of] - offsets[i] + far[of]
                inner = rolling.spans(anchor_at - cell * width, anchor_at - cell * width - width + 1 + length)
                outer = rolling.spans(anchor_at - last, anchor_at - first + length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[i:j][of]) for x in (anchor, stretch, n)] + [pa.array(x.astype(np.int32)) for x in (cell, first, last)] + [pa.array(x.view(np.int64)) for x in (inner, outer)],
                    schema=schema,
                )

    return contexts.select("anchor", "stretch", "n", "low", "high", "at", "context").mapInArrow(one, _spark_schema(schema))


def pointer_offsets(length: int, gram: int) -> list[int]:
    """Offsets of the q-grams that make up a string: a power of two of them, the last
    ones moved back so that none reaches beyond the string."""
    slots = 1 << max(0, math.ceil(math.log2(math.ceil(length / gram))))
    return [min(k * gram, length - gram) for k in range(slots)]


def _suffixes(joined: DataFrame, length: int, gram: int) -> DataFrame:
    """Single suffixes with the first bucket identifiers at their pointer offsets."""
    schema = pa.schema([("row_key", pa.int64()), ("row_id", pa.int64()), ("start", pa.int32()), ("open", pa.bool_()), ("buckets", pa.list_(pa.int64()))])
    offsets_of = pointer_offsets(length, gram)

    def one(batches):
        for batch in batches:
            key, ident = (batch.column(k).to_numpy() for k in (0, 1))
            low, at, first, last = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3, 4, 5))
            still = batch.column(6).to_numpy(zero_copy_only=False)
            data, offsets = raw_strings(batch.column(7))
            for i, j in runs(offsets):
                grams = Rolling.of_bytes(data[offsets[i] : offsets[j]]).grams(gram)
                size = (last - first)[i:j] + 1
                of = np.repeat(np.arange(j - i), size)
                start = (at - low)[i:j][of] - ragged(first[i:j], size)
                place = offsets[i:j][of] - offsets[i] + start
                buckets = np.stack([grams[place + step] for step in offsets_of], 1).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(of) + 1, dtype=np.int32) * len(offsets_of)), pa.array(buckets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(key[i:j][of]), pa.array(ident[i:j][of]), pa.array((low[i:j][of] + start).astype(np.int32)), pa.array(still[i:j][of]), lists], schema=schema)

    kinds = T.StructType([*(T.StructField(n, T.LongType()) for n in ("row_key", "row_id")), T.StructField("start", T.IntegerType()), T.StructField("open", T.BooleanType()), T.StructField("buckets", T.ArrayType(T.LongType()))])
    return joined.select("row_key", "row_id", "low", "at", "first", "last", "open", "context").mapInArrow(one, kinds)


def refined(suffixes: DataFrame, slots: int) -> DataFrame:
    """Suffixes that share their bucket with another one at full depth.

    ``buckets`` holds the identifiers at ``slots`` (a power of two) pointer offsets.  A
    round numbers the different pairs of neighbouring identifiers, whatever offset they
    stand at, and puts the numbers in their place.  A suffix with a pair that no other
    place has is alone."""
    now = suffixes
    while slots > 1:
        slots //= 2
        pair = lambda k: F.struct(F.element_at("buckets", 2 * k + 1).alias("a"), F.element_at("buckets", 2 * k + 2).alias("b"))
        pairs = now.select(F.explode(F.array(*(pair(k) for k in range(slots)))).alias("pair")).select("pair.*")
        numbers = written(pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b", F.monotonically_increasing_id().alias("number")), "buckets")
        moved = now
        for k in range(slots):
            named = numbers.select(F.col("a").alias("a_"), F.col("b").alias("b_"), F.col("number").alias(f"number_{k}"))
            moved = moved.withColumns({"a": pair(k)["a"], "b": pair(k)["b"]}).join(named, (F.col("a") == F.col("a_")) & (F.col("b") == F.col("b_"))).drop("a", "b", "a_", "b_")
        earlier, now = now, written(moved.withColumn("buckets", F.array(*(f"number_{k}" for k in range(slots)))).select(*suffixes.columns), "suffixes")
        dropped(numbers, earlier)
    bucket = F.element_at("buckets", 1)
    many = now.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    return now.where("open").withColumn("bucket", bucket).join(many, "bucket").drop("bucket")


KEYS = ["__row_key", "__row_id"]


def keyed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows told apart by id and text; equal rows share their keys, and agree in every result."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"__row_key": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")), "__row_id": F.xxhash64("doc_id", text), text_col: text})


def repeated_starts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, slice_width: int = SLICE) -> DataFrame:
    """Ranges low..high of starts whose ``length`` bytes start elsewhere too, by row key.

    ``docs`` is keyed.  Ranges may overlap."""
    docs = docs.select(F.col("__row_key").alias("row_key"), F.col("__row_id").alias("row_id"), "text")
    found = written(_find_stretches(docs.where(F.octet_length("text") >= length), length, gram), "anchors")
    # anchors that are not alone
    shared = found.groupBy("anchor").agg(F.sum("copies").alias("rows"), F.min("stretch").alias("a"), F.max("stretch").alias("b")).where("rows > 1")
    held = written(found.join(shared.select("anchor", (F.col("a") != F.col("b")).alias("mixed")), "anchor"), "stretches")
    dropped(found)
    # stretches with a twin
    mixed = held.where("mixed and copies > 0")
    classes = mixed.groupBy("anchor", "stretch").agg(F.sum("copies").alias("n"), F.min_by(F.struct("row_key", "row_id", "low", "high", "at"), F.struct("row_key", "row_id", "low")).alias("one"))
    classes = written(classes.select("anchor", "stretch", "n", "one.*"), "classes")
    whole = held.where("not mixed or copies = 0").select("row_key", "row_id", "low", "high").unionByName(mixed.join(classes.where("n > 1").select("anchor", "stretch"), ["anchor", "stretch"]).select("row_key", "row_id", "low", "high"))
    wanted = classes.groupBy("row_key", "row_id").agg(F.collect_list(F.struct("anchor", "stretch", "n", "low", "high", "at")).alias("held"))
    contexts = written(_cut_contexts(docs.join(wanted, ["row_key", "row_id"]), length), "contexts")
    # slices of the stretches without one
    slices = written(_slices(contexts, length, slice_width), "slices")
    outer = slices.groupBy("anchor", "cell", "inner", "first", "last", "outer").agg(F.count("*").alias("same"), F.min("stretch").alias("stretch"), F.max("n").alias("n"))
    inner = outer.groupBy("anchor", "cell", "inner").agg(F.count("*").alias("kinds"), F.max((F.col("same") == 1) & (F.col("n") == 1)).alias("unsettled")).where("kinds > 1 and unsettled")
    ids = contexts.select("anchor", "stretch", "row_key", "row_id", "low", "at")
    by_slice = (
        slices.where("n = 1")
        .join(outer.where("same > 1").select("anchor", "cell", "inner", "first", "last", "outer"), ["anchor", "cell", "inner", "first", "last", "outer"])
        .join(ids, ["anchor", "stretch"])
        .select("row_key", "row_id", (F.col("at") - F.col("last")).alias("low"), (F.col("at") - F.col("first")).alias("high"))
    )
    # single suffixes of slices that share their inner bytes
    open_slices = outer.join(inner.select("anchor", "cell", "inner"), ["anchor", "cell", "inner"]).select("anchor", "stretch", "first", "last", ((F.col("same") == 1) & (F.col("n") == 1)).alias("open"))
    suffixes = written(_suffixes(open_slices.join(contexts.select("anchor", "stretch", "row_key", "row_id", "low", "at", "context"), ["anchor", "stretch"]), length, gram), "suffixes")
    by_start = refined(suffixes, len(pointer_offsets(length, gram))).select("row_key", "row_id", F.col("start").alias("low"), F.col("start").alias("high"))
    ranges = written(whole.unionByName(by_slice).unionByName(by_start).distinct(), "ranges")
    dropped(held, classes, contexts, slices)
    return ranges.select(F.col("row_key").alias("__row_key"), F.col("row_id").alias("__row_id"), "low", "high")


def merged(lows: list[int], highs: list[int], length: int) -> list[tuple[int, int]]:
    """Byte ranges covered by the strings that start in the given ranges."""
    low, high = np.array(lows, np.int64), np.array(highs, np.int64) + length
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.concatenate([[True], low[1:] > high[:-1]])
    return list(zip(low[new].tolist(), high[np.concatenate([new[1:], [True]])].tolist(), strict=True))


def with_removals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, slice_width: int = SLICE) -> DataFrame:
    """Keyed ``docs`` with an array ``__starts`` of the ranges found in each, or null."""
    base = keyed(docs)
    per_row = repeated_starts(base, length, gram, slice_width).groupBy(*KEYS).agg(F.collect_list(F.struct("low", "high")).alias("__starts"))
    return base.join(per_row, KEYS, "left")


def _kept(texts: pa.Array, starts: pa.Array, length: int) -> tuple[list[bytes], list[bytes], list[list[tuple[int, int]]]]:
    """Texts, what stays of them, and the byte spans that go."""
    data, offsets = raw_strings(texts)
    raw, before, after, gone = data.tobytes(), [], [], []
    for k, held in enumerate(starts.to_pylist()):
        text = raw[offsets[k] : offsets[k + 1]]
        spans = merged([s["low"] for s in held], [s["high"] for s in held], length) if held else []
        pieces, at = [], 0
        for a, b in spans:
            pieces.append(text[at:a])
            at = b
        before.append(text)
        after.append(b"".join([*pieces, text[at:]]) if spans else text)
        gone.append(spans)
    return before, after, gone


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, slice_width: int = SLICE) -> DataFrame:
    """Documents without their repeated strings; other columns as they came.

    Null stays null.  Where a cut parts the bytes of a character, what is left of it
    becomes U+FFFD.  Repeated rows count as copies of each other."""
    names = docs.columns
    at = names.index("text")
    frame = with_removals(docs.withColumn("__null", F.col("text").isNull()), length, gram, slice_width).select(*names, "__null", "__starts")

    def one(batches):
        for batch in in_runs(batches, at):
            _, after, _ = _kept(batch.column(at), batch.column(len(names) + 1), length)
            void = batch.column(len(names)).to_pylist()
            text = pa.array([None if v else t.decode(errors="replace") for t, v in zip(after, void, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([text if k == at else batch.column(k) for k in range(len(names))], names=names)

    return frame.mapInArrow(one, docs.schema)


def digest(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, slice_width: int = SLICE) -> DataFrame:
    """One row per document: what is removed (``spans``, in bytes), a hash of the bytes
    that stay, and those as ``text``, where parts of cut characters read U+FFFD.

    Null is the empty text; texts under ``length`` bytes lose nothing.  Repeated rows
    (same id, same text) count as copies of each other."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>, text string"
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def one(batches):
        for batch in in_runs(batches, 1):
            before, after, gone = _kept(batch.column(1), batch.column(2), length)
            columns = [
                pa.array([len(t) for t in before], pa.int64()),
                pa.array([sum(b - a for a, b in s) for s in gone], pa.int64()),
                pa.array([len(s) for s in gone], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in after], pa.string()),
                pa.array([[{"start": a, "stop": b} for a, b in s] for s in gone], span),
                pa.array([t.decode(errors="replace") for t in after], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "text"])

    return with_removals(docs.select("doc_id", "text"), length, gram, slice_width).select("doc_id", "text", "__starts").mapInArrow(one, schema)


def brute_force(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    """The contract start by start, for tests."""
    raw, count, out = [(t or "").encode() for t in texts], {}, []
    for r in raw:
        for i in range(len(r) - length + 1):
            count[r[i : i + length]] = count.get(r[i : i + length], 0) + 1
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return out
