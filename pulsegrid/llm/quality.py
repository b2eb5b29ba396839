"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are embedded and run through learned filters of ``WIDTH`` bytes every
``STRIDE`` bytes.  Filter outputs are max-pooled in overlapping chunks that cover the
whole text; every chunk gives a logit and their mean gives the probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pulsegrid.llm.langid import held_out
from pulsegrid.llm.text import raw_strings, runs, spread_over

WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 8, 4, 8, 24, 16
BLOCK = 128  # a chunk is two neighbouring blocks, so chunks overlap by half
SAMPLE_PER_CLASS = 1500
SAMPLE_CHARS = 6000  # of a training text; longer ones are represented by pieces from all over
EPOCHS = 6
_PER_BLOCK = BLOCK // STRIDE


@dataclass
class Network:
    """Weights; ``prior`` is the probability given when there was nothing to learn from."""

    parts: dict[str, np.ndarray]
    prior: float | None = None

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        return cls(
            {
                "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
                "filters": rng.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH * EMBED, FILTERS)).astype(np.float32),
                "shift": np.zeros(FILTERS, np.float32),
                "hidden": rng.normal(0, 1 / np.sqrt(FILTERS), (FILTERS, HIDDEN)).astype(np.float32),
                "hidden_shift": np.zeros(HIDDEN, np.float32),
                "out": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN).astype(np.float32),
                "out_shift": np.zeros(1, np.float32),
            }
        )


def laid_out(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with each document zero-filled to whole blocks, and blocks by document.

    At least WIDTH zeros end a document, so no filter output that counts mixes two."""
    size = np.diff(offsets)
    blocks = (size + WIDTH + BLOCK - 1) // BLOCK
    at = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros(int(at[-1]) * BLOCK + WIDTH, np.uint8)
    shift = np.repeat(at[:-1] * BLOCK - offsets[:-1], size)
    out[np.arange(len(data)) + shift] = data
    return out, at


def _windows(net: Network, laid: np.ndarray) -> np.ndarray:
    embedded = net.parts["embed"][laid]
    n = (len(laid) - WIDTH) // STRIDE
    view = np.lib.stride_tricks.sliding_window_view(embedded.reshape(-1), WIDTH * EMBED)[:: STRIDE * EMBED]
    return view[:n]


def _pooled(net: Network, laid: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest filter outputs by block, where they stand, and the windows."""
    windows = _windows(net, laid)
    raw = (windows @ net.parts["filters"]).reshape(-1, _PER_BLOCK, FILTERS)
    raw[at[1:] - 1, -1] = -np.inf  # this window reaches into the next document
    where = raw.argmax(1)
    return np.take_along_axis(raw, where[:, None], 1)[:, 0], where, windows


def _chunks(block: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each block joined with the next one of its document, and which of the two won."""
    after = np.minimum(np.arange(1, len(block) + 1), len(block) - 1)
    after[at[1:] - 1] = at[1:] - 1
    return np.maximum(block, block[after]), np.where(block >= block[after], np.arange(len(block))[:, None], after[:, None])


def _head(net: Network, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = net.parts
    first = np.maximum(chunk + p["shift"], 0)
    second = np.maximum(first @ p["hidden"] + p["hidden_shift"], 0)
    return second @ p["out"] + p["out_shift"], first, second


def plain_probability(net: Network, text: bytes) -> float:
    """One text chunk by chunk and window by window, for tests."""
    p = net.parts
    n = max(1, -(-(len(text) + WIDTH) // BLOCK))
    laid = text + bytes(n * BLOCK - len(text))
    blocks = [
        np.max([p["embed"][list(laid[k : k + WIDTH])].reshape(-1) @ p["filters"] for k in range(b * BLOCK, (b + 1) * BLOCK, STRIDE) if k + WIDTH <= len(laid)], axis=0)
        for b in range(n)
    ]
    logits = []
    for b in range(n):
        chunk = np.maximum(blocks[b], blocks[min(b + 1, n - 1)])
        first = np.maximum(chunk + p["shift"], 0)
        second = np.maximum(first @ p["hidden"] + p["hidden_shift"], 0)
        logits.append(float(second @ p["out"] + p["out_shift"][0]))
    return float(1 / (1 + np.exp(-np.mean(logits))))


def probabilities(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    laid, at = laid_out(data, offsets)
    block, _, _ = _pooled(net, laid, at)
    logit, _, _ = _head(net, _chunks(block, at)[0])
    mean = np.add.reduceat(logit, at[:-1]) / np.diff(at)
    return 1 / (1 + np.exp(-np.clip(mean.astype(np.float64), -30, 30)))


def _gradients(net: Network, data: np.ndarray, offsets: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    p = net.parts
    laid, at = laid_out(data, offsets)
    block, where, windows = _pooled(net, laid, at)
    chunk, winner = _chunks(block, at)
    logit, first, second = _head(net, chunk)
    n_chunks = np.diff(at)
    chance = 1 / (1 + np.exp(-np.clip(np.add.reduceat(logit, at[:-1]) / n_chunks, -30, 30)))
    d_logit = np.repeat(((chance - target) * weight / n_chunks).astype(np.float32), n_chunks)
    d_second = d_logit[:, None] * p["out"] * (second > 0)
    d_first = d_second @ p["hidden"].T * (first > 0)
    d_block = np.zeros_like(block)
    np.add.at(d_block, (winner, np.arange(FILTERS)[None, :]), d_first)
    place = np.arange(len(block))[:, None] * _PER_BLOCK + where
    d_filters = np.stack([windows[place[:, f]].T @ d_block[:, f] for f in range(FILTERS)], 1)
    d_window = d_block[:, :, None] * p["filters"].T[None]
    bytes_at = laid[place[:, :, None] * STRIDE + np.arange(WIDTH)]
    d_embed = np.zeros_like(p["embed"])
    np.add.at(d_embed, bytes_at.reshape(-1), d_window.reshape(-1, EMBED))
    return {"embed": d_embed, "filters": d_filters, "shift": d_first.sum(0), "hidden": first.T @ d_second, "hidden_shift": d_second.sum(0), "out": second.T @ d_logit, "out_shift": d_logit.sum(keepdims=True)}


def fit(texts: list[str], labels: list[int], weights: list[float], epochs: int = EPOCHS, seed: int = 7, batch: int = 32, rate: float = 4e-3) -> Network:
    """Adam on the weighted log loss, in a fixed order for a given seed."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    if len(set(labels)) < 2:
        net.prior = float(labels[0]) if labels else 0.5
        return net
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    y, w = np.array(labels, np.float64), np.array(weights) / np.mean(weights)
    mean = {k: np.zeros_like(v) for k, v in net.parts.items()}
    var = {k: np.zeros_like(v) for k, v in net.parts.items()}
    steps = epochs * -(-len(raw) // batch)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(raw))
        for k in range(0, len(raw), batch):
            step += 1
            pick = order[k : k + batch]
            offsets = np.concatenate([[0], np.cumsum([len(raw[i]) for i in pick])])
            got = _gradients(net, np.concatenate([raw[i] for i in pick]), offsets, y[pick], w[pick] / len(pick))
            pace = rate * (1 - 0.9 * step / steps)
            for name, g in got.items():
                mean[name] += 0.1 * (g - mean[name])
                var[name] += 0.01 * (g * g - var[name])
                scale = np.sqrt(var[name] / (1 - 0.99**step)) + 1e-8
                net.parts[name] -= (pace * mean[name] / (1 - 0.9**step) / scale).astype(np.float32)
    return net


def sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, most_chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int], list[float]]:
    """At most ``per_class`` labelled texts of either class, chosen by hash of the id,
    with weights that restore the classes' shares.

    Of several labels of one document the lower counts, and of several rows of one id
    the text with the smallest hash, so no id crowds out others.  Long texts take part
    with pieces spread over the whole text, ``most_chars`` characters together."""
    held = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["n"] for r in held.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    spread = 1 << 30
    place = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(spread))
    bound = F.lit(0)
    for name, n in counts.items():
        bound = F.when(F.col("quality") == name, F.lit(min(spread, int(spread * (1.5 * per_class + 40) / n) + 1))).otherwise(bound)
    chosen = held.withColumn("place", place).where(F.col("place") < bound)  # a few thousand ids, whatever the input
    text = F.coalesce("text", F.lit(""))
    near = docs.select("doc_id", F.xxhash64(text).alias("hash"), spread_over(text, most_chars).alias("text")).join(F.broadcast(chosen), "doc_id")
    found = near.groupBy("place", "doc_id", "quality").agg(F.min_by("text", F.struct("hash", "text")).alias("text")).collect()
    texts, marks, taken = [], [], dict.fromkeys(counts, 0)
    for r in sorted(found, key=lambda r: (r["place"], r["doc_id"])):
        if taken[r["quality"]] < per_class:
            taken[r["quality"]] += 1
            texts.append(r["text"])
            marks.append(r["quality"])
    return texts, marks, [counts[m] / taken[m] for m in marks]


def train(docs: DataFrame, labels: DataFrame, **bounds) -> Network:
    return fit(*sample(docs, labels, **bounds))


def rate(docs: DataFrame, net: Network, text_col: str = "text", into: str = "quality_score", keep_text: bool = True) -> DataFrame:
    """``docs`` plus the probability that a text is of good quality.

    Whole texts are read.  Null counts as the empty text, which is scored like any
    other.  A column of docs already called ``into`` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # about 20 KB
    frame = docs.drop(into)
    kept = [c for c in frame.columns if keep_text or c != text_col]
    schema = T.StructType([*(frame.schema[c] for c in kept), T.StructField(into, T.DoubleType())])

    def one(batches):
        own = shared.value
        for batch in batches:
            data, offsets = raw_strings(batch.column(batch.schema.get_field_index(text_col)))
            out = np.zeros(batch.num_rows)
            for i, j in runs(offsets, 1 << 18):
                if own.prior is not None:
                    out[i:j] = own.prior
                else:
                    out[i:j] = probabilities(own, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.round(out, 5))], names=[*kept, into])

    return frame.mapInArrow(one, schema)


def unseen(id_col: str = "doc_id") -> Column:
    """Rows that are kept from training: a checksum of the id modulo 3 that is 1."""
    return held_out(3, 1, id_col)


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents whose probability reaches ``least``; columns as they came."""
    net = train(docs.where(~unseen()), labels.where(~unseen()))
    return rate(docs, net, into="__quality").where(F.col("__quality") >= least).select(*docs.columns)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: held_out, score, predicted.

    Null and empty texts are scored as the empty text; a null id is never held out;
    repeated rows agree; without labels of both kinds every score is the same."""
    net = train(docs.where(~unseen()), labels.where(~unseen()))
    rated = rate(docs.select("doc_id", "text"), net, into="score", keep_text=False)
    return rated.select("doc_id", unseen().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
