"""Near-duplicate documents by DartMinHash over weighted word shingles.

A document is its five-word shingles, each weighing as often as it occurs.  Darts are
thrown by hashing: every shingle has a fixed Poisson process of darts over weight and
rank, cut into dyadic regions of the weight axis.  A document catches the darts below
its shingles' weights and below a rank bound, and keeps the earliest dart of each
coordinate; equal coordinates have the probability of the weighted Jaccard similarity.
Bands of coordinates give candidate pairs, the exact similarity decides, and components
of the verified pairs are the classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from pulsegrid.llm.components import components
from pulsegrid.llm.storage import dropped, written
from pulsegrid.llm.text import Rolling, fold, in_runs, mix, ragged, raw_strings, runs, words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
CHUNK = 256
#: Buckets of up to PAIRED nodes are finished pair by pair, larger ones in cells of CELL by CELL nodes.
PAIRED = 16
CELL = 512
#: A character that belongs to a word.
WORDED = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and count of every distinct shingle, ordered by both.

    A text of fewer words, but not none, has one shingle of all its words."""
    _, _, hashes, at = words(data, offsets)
    counts = np.diff(at)
    size = np.minimum(counts, shingle)
    n = np.where(counts > 0, counts - size + 1, 0)
    start = ragged(at[:-1], n)
    doc = np.repeat(np.arange(len(n)), n)
    values = Rolling(hashes).spans(start, start + size[doc]) if len(start) else np.zeros(0, np.uint64)
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    first = np.flatnonzero(new)
    return doc[first], values[first], np.diff(np.append(first, len(doc)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _throw(element: np.ndarray, low: np.ndarray, width: np.ndarray, weight: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts of regions [low, low + width) with rank up to ``bound`` and place below
    ``weight``: region, identity and rank.  Gaps between ranks are exponential."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    mean = bound * width
    level = np.where(mean < 1, 0, np.log2(np.maximum(mean, 1)).astype(np.int64) + 1)
    seed = fold(element, 3) + low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for q in np.unique(level):
        live = np.flatnonzero(level == q)
        block = 1 if q == 0 else 1 << int(q)
        rank, turn = np.zeros(len(live)), 0
        while len(live):
            turns = np.arange(turn, turn + block, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            ident = mix(seed[live][:, None] + turns[None, :])
            ranks = rank[:, None] + np.cumsum(-np.log(_uniform(ident)) / width[live][:, None], axis=1)
            place = low[live][:, None] + _uniform(mix(ident + np.uint64(1))) * width[live][:, None]
            row, column = np.nonzero((ranks <= bound[live][:, None]) & (place < weight[live][:, None]))
            found.append((live[row], ident[row, column], ranks[row, column]))
            on = ranks[:, -1] <= bound[live]
            live, rank, turn = live[on], ranks[on, -1], turn + block
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """A row of ``k`` dart identities for every document; rows without elements stay 0."""
    out = np.zeros((n_docs, k), np.uint64)
    total = np.bincount(doc, weight, n_docs)
    weight = weight.astype(np.float64)
    n_regions = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1, 1)
    of = np.repeat(np.arange(len(doc)), n_regions)
    step = ragged(np.zeros(len(doc), np.int64), n_regions)
    low = np.where(step == 0, 0.0, 2.0 ** (step - 1))
    width = np.where(step == 0, 1.0, 2.0 ** (step - 1))
    bound = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-9)
    left = total > 0
    while left.any():
        use = np.flatnonzero(left[doc[of]])
        region, ident, rank = _throw(element[of[use]], low[use], width[use], weight[of[use]], bound[doc[of[use]]])
        owner = doc[of[use[region]]]
        coordinate = (fold(ident, 17) % np.uint64(k)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")  # the last to be set is the earliest dart
        row = np.zeros((n_docs, k), np.uint64)
        row[owner[order], coordinate[order]] = ident[order]
        whole = left & (row != 0).all(axis=1)
        out[whole] = row[whole]
        left &= ~whole
        bound *= 2
    return out


def band_keys(rows: np.ndarray, bands: int, per_band: int) -> np.ndarray:
    """Hash of each band of each signature."""
    keys = np.zeros((len(rows), bands), np.uint64)
    for r in range(per_band):
        keys = fold(keys, 29) + rows[:, r::per_band][:, :bands]
    return mix(keys + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sign(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """Band keys of every row; none for texts without words."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def one(batches):
        for batch in batches:
            data, offsets = raw_strings(batch.column(2))
            for i, j in runs(offsets):
                doc, element, weight = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                keys = band_keys(signatures(doc, element, weight, j - i, bands * rows), bands, rows)
                some = np.bincount(doc, minlength=j - i) > 0
                flat = pa.array(keys[some].reshape(-1).view(np.int64))
                column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), column], names=["doc_id", "text_key", "bands"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(one, schema)


def _sets(texts: DataFrame) -> DataFrame:
    """Sorted 32-bit hashes of each text's shingles, the n-th repeat told from the first."""

    def one(batches):
        for batch in in_runs(batches, 1):
            data, offsets = raw_strings(batch.column(1))
            out = []
            for i, j in runs(offsets):
                doc, element, weight = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                of = np.repeat(np.arange(len(doc)), weight)
                nth = ragged(np.zeros(len(doc), np.int64), weight)
                short = (fold(element[of] + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 41) >> np.uint64(32)).astype(np.uint32)
                order = np.lexsort((short, doc[of]))
                cuts = np.searchsorted(doc[of], np.arange(j - i + 1))
                short = short[order]
                out += [short[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "shingles"])

    return texts.select("node", "text").mapInArrow(one, "node long, shingles binary")


def jaccard(a: bytes, b: bytes) -> float:
    """Similarity of two sorted sets of 32-bit values."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return same / max(1, len(both) - same)


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose similarity reaches ``least``.

    A centre b of many pairs is met in chunks of its members, so that no join key
    holds more than CHUNK of them."""
    salted = pairs.withColumn("chunk", F.pmod(F.xxhash64("a"), F.greatest(F.lit(1), F.ceil(F.col("degree") / CHUNK))))
    members = salted.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    centres = salted.select("b", "chunk").distinct().join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")

    def one(batches):
        for batch in batches:
            a, b, x, y = (batch.column(k) for k in range(4))
            sizes = [(min(p, q), max(p, q)) for p, q in zip(pc.binary_length(x).to_pylist(), pc.binary_length(y).to_pylist(), strict=True)]
            keep = [low >= least * high and jaccard(p.as_py(), q.as_py()) >= least for p, q, (low, high) in zip(x, y, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return members.join(centres, ["b", "chunk"]).select("a", "b", "x", "y").mapInArrow(one, "a long, b long")


def _with_degree(pairs: DataFrame) -> DataFrame:
    return pairs.join(pairs.groupBy("b").agg(F.count("*").alias("degree")), "b")


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select("doc_id", F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("text_key"), text.alias("text"))


def linked(hits: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``node`` and ``component`` of nodes with verified partners.

    ``hits`` has node, key and ``n``, the number of nodes under that key.  First every
    node is compared with the centre of each of its buckets, the node that meets most
    others: a group of copies becomes a star.  Then every pair of nodes that share a
    bucket, and that no star has joined, is compared, so no link between components is
    lost."""
    weight = hits.groupBy("node").agg(F.sum("n").alias("weight"))
    centre = hits.join(weight, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("b"))
    stars = written(hits.join(centre, "key").select(F.col("node").alias("a"), "b").where("a <> b").distinct(), "stars")
    links = written(verified(_with_degree(stars), sets, least), "links")
    labels = written(components(links), "labels")
    held = _labelled(hits, labels)
    parts = held.groupBy("key", "component").agg(F.count("*").alias("c"))
    bulk = parts.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("c").alias("n"), F.max("c").alias("most"), F.max_by("component", F.struct("c", "component")).alias("main")).where("kinds > 1")
    held = written(held.join(bulk, "key"), "open")
    small = held.where(F.col("n") <= PAIRED).select("key", "node", "component")
    other = small.select("key", F.col("node").alias("b"), F.col("component").alias("cb"))
    pairs = small.join(other, "key").where("node < b and component <> cb").select(F.col("node").alias("a"), "b").distinct()
    met = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = written(pairs.join(met, ["a", "b"], "left_anti"), "pairs")
    more = written(verified(_with_degree(pairs), sets, least).unionByName(_in_cells(held.where(F.col("n") > PAIRED), sets, least)), "links")
    dropped(stars, links, held, pairs)
    if more.isEmpty():
        return labels
    # only the components that the new links join are looked at again
    of = labels.select("node", "component")
    ends = more.join(of.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(of.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    joined = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    joined = written(joined.select(F.col("node").alias("part"), F.col("component").alias("whole")), "joined")
    known = labels.join(joined, F.col("component") == F.col("part"), "left").select("node", F.coalesce("whole", "component").alias("component"))
    fresh = joined.join(labels, F.col("part") == F.col("node"), "left_anti").select(F.col("part").alias("node"), F.col("whole").alias("component"))
    return written(known.unionByName(fresh), "labels")


def _in_cells(held: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that join components of large buckets.

    The nodes outside a bucket's main component meet all its nodes in cells of about
    CELL by CELL, so that neither a task nor a row grows with the bucket."""
    rows = F.ceil((F.col("n") - F.col("most")) / CELL).cast("int")
    columns = F.ceil(F.col("n") / CELL).cast("int")
    at = F.xxhash64("node", "key")
    base = held.select("key", "node", "component", "main", F.pmod(at, rows).cast("int").alias("row"), F.pmod(at, columns).cast("int").alias("column"), rows.alias("rows"), columns.alias("columns"))
    left = base.where("component <> main").withColumn("column", F.explode(F.sequence(F.lit(0), F.col("columns") - 1))).withColumn("left", F.lit(True))
    right = base.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("left", F.lit(False))
    names = ["key", "row", "column", "left", "node", "component"]
    filled = left.select(*names).unionByName(right.select(*names)).join(sets, "node")

    def one(table: pa.Table) -> pa.Table:
        return pa.table(dict(zip("ab", (pa.array(x, pa.int64()) for x in cell_links(table, least)), strict=True)))

    return filled.groupBy("key", "row", "column").applyInArrow(one, "a long, b long")


def overlaps(x: list[np.ndarray], y: list[np.ndarray], step: int = 1024) -> np.ndarray:
    """How many values each set of ``x`` shares with each of ``y``."""
    rows = [np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (x, y)]
    values = [np.concatenate(s) for s in (x, y)]
    shared = np.intersect1d(*values)
    for k in range(2):
        at = np.searchsorted(shared, values[k])
        known = at < len(shared)
        known[known] = shared[at[known]] == values[k][known]
        order = np.argsort(at[known], kind="stable")
        rows[k], values[k] = rows[k][known][order], at[known][order]
    out = np.zeros((len(x), len(y)), np.float32)
    for low in range(0, len(shared), step):
        dense = []
        for k, s in enumerate((x, y)):
            i, j = np.searchsorted(values[k], (low, low + step))
            block = np.zeros((len(s), min(step, len(shared) - low)), np.float32)
            block[rows[k][i:j], values[k][i:j] - low] = 1
            dense.append(block)
        out += dense[0] @ dense[1].T
    return out


def cell_links(table: pa.Table, least: float) -> tuple[list[int], list[int]]:
    """Links between different components of a cell, as many as it takes to join them."""
    node, component, side = (table.column(c).to_numpy() for c in ("node", "component", "left"))
    side = side.astype(bool)
    raw = table.column("shingles").to_pylist()
    left, right = np.flatnonzero(side), np.flatnonzero(~side)
    found: tuple[list[int], list[int]] = ([], [])
    if not len(left) or not len(right):
        return found
    size = np.array([len(r) // 4 for r in raw])
    both = size[left][:, None] + size[right][None, :]
    common = overlaps(*([np.frombuffer(raw[k], np.uint32) for k in ks] for ks in (left, right)))
    # a repeated 32-bit value inside a set counts once here: exact similarity decides below
    near = (common + 2 >= least / (1 + least) * both) & (component[left][:, None] != component[right][None, :])
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            parent[c] = parent.get(parent[c], parent[c])
            c = parent[c]
        return c

    for i, j in np.argwhere(near).tolist():
        i, j = left[i], right[j]
        a, b = root(int(component[i])), root(int(component[j]))
        if a != b and jaccard(raw[i], raw[j]) >= least:
            parent[a] = b
            found[0].append(int(node[i]))
            found[1].append(int(node[j]))
    return found


def classes(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text_key`` of every distinct pair, with the node of its text and
    ``class_id``, the smallest doc_id of its class.

    Equal texts that are not null or without words share a node.  Candidates are
    compared with the most central node of each bucket (the one met by most others),
    then pair by pair where that left them apart.  The hot case is a star; all pairs
    are met only between components that no star has joined."""
    keyed = _keyed(docs, text_col)
    signed = _sign(keyed, bands, rows)
    nodes = written(
        signed.groupBy("text_key").agg(F.first("bands").alias("bands"), F.min("doc_id").alias("least_id"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    hits = nodes.select("node", F.posexplode("bands").alias("band", "key")).select("node", "key")
    crowded = hits.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    hits = written(hits.join(crowded, "key"), "buckets")
    wanted = hits.select("node").distinct().join(nodes.select("node", "text_key", "least_id"), "node")
    ones = keyed.join(wanted, (keyed["text_key"] == wanted["text_key"]) & keyed["doc_id"].eqNullSafe(wanted["least_id"]))
    # repeated rows come once: a set row each, or else a pair would be compared many times
    sets = written(_sets(ones.select("node", "text").dropDuplicates(["node"])), "sets")
    labels = linked(hits, sets, least)
    grouped = nodes.select("node", "text_key", "least_id", "copies", F.size("bands").alias("n_bands")).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_ids = grouped.groupBy("component").agg(F.min("least_id").alias("class_id"), F.min_by("node", F.struct(F.col("least_id").isNull(), "least_id", "node")).alias("kept_node"))
    return grouped.join(least_ids, "component").select("text_key", "node", "class_id", "kept_node", "least_id", "n_bands", "component")


def _labelled(hits: DataFrame, labels: DataFrame) -> DataFrame:
    return hits.select("key", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def digest(docs: DataFrame, **options) -> DataFrame:
    """One row per document: class_id (smallest doc_id of the class) and whether its
    text is the one to keep.

    Texts that are null or hold no words are classes of their own, each with its own
    doc_id.  Of a class the smallest doc_id is kept; where that id repeats, or where
    all ids are null, every row with it is marked."""
    found = classes(docs, **options)
    rows = _keyed(docs, "text").select("doc_id", "text_key")
    held = _salted(rows, found.select("text_key", "class_id", "n_bands", (F.col("node") == F.col("kept_node")).alias("first")))
    own = F.col("n_bands") == 0
    return held.select(
        "doc_id",
        F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (own | (F.col("first") & F.col("doc_id").eqNullSafe(F.col("class_id")))).alias("kept"),
    )


def _salted(rows: DataFrame, found: DataFrame, salts: int = 16) -> DataFrame:
    """A text that a third of all rows share meets its class once per salt."""
    left = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    right = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, ["text_key", "salt"]).drop("salt")


def deduplicated(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """One document of each class, with its columns as they came.

    It is the one with the smallest doc_id; of repeated rows one stays.  Documents
    without words all stay.  Rows are met by text and id, so copies spread."""
    kept = classes(docs, text_col=text_col, **options).where("n_bands > 0 and node = kept_node").select(F.col("text_key").alias("__kept_key"), F.col("class_id").alias("__kept_id"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    worded = text.rlike(WORDED)
    rows = docs.where(worded).withColumn("__key", F.unhex(F.md5(F.encode(text, "UTF-8"))))
    chosen = rows.join(kept, (F.col("__key") == F.col("__kept_key")) & F.col("doc_id").eqNullSafe(F.col("__kept_id"))).dropDuplicates(["__key", "doc_id"])
    return chosen.select(*docs.columns).unionByName(docs.where(~worded))
