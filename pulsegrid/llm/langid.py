"""Language identification with a blended-spectrum string kernel.

A text is the set of its byte 1-, 2- and 3-grams, after ASCII letters are lowered and
other ASCII turned to spaces.  The kernel counts shared grams over the geometric mean
of both set sizes, within the grams that the landmark texts hold.  Nystrom features
over the landmarks carry a one-versus-rest kernel ridge regression; landmarks, the
inverse root of their kernel and the weights multiply out to one gram-by-language
matrix, so scoring is a product of presence rows with it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pulsegrid.llm.text import owners, raw_strings, runs, spread_over

SAMPLE_PER_LANGUAGE = 400
LANDMARKS_PER_LANGUAGE = 40
SAMPLE_CHARS = 8192  # of a training text; longer ones are represented by pieces from all over
RIDGE = 1e-2
NO_LANGUAGE = "und"

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 0x20
_FOLD[0x41:0x5B] = _FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray
    weights: np.ndarray

    def lookup(self) -> np.ndarray:
        """Column of each possible gram code; 0 for grams of no landmark."""
        table = np.zeros(1 << 24, np.uint16 if len(self.grams) < 1 << 16 else np.uint32)
        table[self.grams] = np.arange(1, len(self.grams) + 1)
        return table


def gram_codes(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Codes of the grams of length 1, 2 and 3 that end at each byte; 0 where a
    gram would reach into the document before."""
    byte = _FOLD[data]
    two, three = np.zeros_like(byte), np.zeros_like(byte)
    two[1:] = byte[:-1] << 8 | byte[1:]
    three[2:] = byte[:-2] << 16 | two[2:]
    first = offsets[:-1][np.diff(offsets) > 0]
    two[first] = three[first] = 0
    three[first[first + 1 < len(byte)] + 1] = 0
    return [byte, two, three]


def presence(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """One row per document, 1 where it holds the column's gram; column 0 is void."""
    seen = np.zeros((len(offsets) - 1, width), np.uint8)
    row = owners(offsets) * width
    for codes in gram_codes(data, offsets):
        seen.reshape(-1)[row + table[codes]] = 1
    seen[:, 0] = 0
    return seen


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.maximum(a.sum(1), 1))[:, None] * np.sqrt(np.maximum(b.sum(1), 1))[None, :]
    return (a @ b.T) / size


def fit(texts: list[str], labels: list[str], landmarks_per_language: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> Model:
    """Trains on texts at hand; the first texts of each language become landmarks."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros(0, np.int64), np.zeros((1, 0), np.float32))
    data, offsets = raw_strings(pa.array(texts, pa.string()))
    chosen = [i for name in languages for i in [k for k, x in enumerate(labels) if x == name][:landmarks_per_language]]
    held = np.zeros(1 << 24, bool)
    of = owners(offsets)
    wanted = np.isin(np.arange(len(texts)), chosen)
    for codes in gram_codes(data, offsets):
        held[codes[wanted[of]]] = True
    held[0] = False
    grams = np.flatnonzero(held)
    model = Model(languages, grams, np.zeros((len(grams) + 1, len(languages)), np.float32))
    rows = presence(data, offsets, model.lookup(), len(grams) + 1).astype(np.float32)
    marks = rows[chosen]
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel(rows, marks) @ root
    target = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    share = np.array([1.0 / labels.count(x) for x in labels])[:, None]  # every language weighs the same
    solved = np.linalg.solve(features.T @ (features * share) + ridge * np.eye(features.shape[1]), features.T @ (target * share))
    by_mark = (root @ solved) / np.sqrt(np.maximum(marks.sum(1), 1))[:, None]
    model.weights = (marks.T @ by_mark).astype(np.float32)
    return model


def score(model: Model, texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best language and a confidence between 0 and 1 for every text."""
    data, offsets = raw_strings(texts)
    best, value = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    for i, j in runs(offsets, 1 << 19):
        seen = presence(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], table, len(model.grams) + 1)
        # rows of one text must not depend on their neighbours, so sums are rounded
        out = (seen.astype(np.float32) @ model.weights) / np.sqrt(np.maximum(seen.sum(1, dtype=np.int64), 1))[:, None]
        out = np.round(out, 4)
        best[i:j] = out.argmax(1)
        value[i:j] = np.clip((out.max(1) + 1) / 2, 0, 1)
    return best, np.round(value, 4)


def bounded_sample(docs: DataFrame, label: Column, per_class: int, most_chars: int = SAMPLE_CHARS) -> tuple[list[str], list]:
    """At most ``per_class`` different texts of each label, chosen by hash.

    Copies of a text count once, so they cannot crowd out others.  Long texts take part
    with pieces spread over the whole text, ``most_chars`` characters together."""
    rows = docs.select(F.col("text"), label.alias("label"), F.xxhash64("text").alias("hash")).where("label is not null and text is not null")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.approx_count_distinct("hash").alias("n")).collect()}
    spread = 1 << 30
    place = F.pmod(F.col("hash"), F.lit(spread))
    bound = F.lit(0)
    for name, n in counts.items():
        bound = F.when(F.col("label") == F.lit(name), F.lit(min(spread, int(spread * (2 * per_class + 40) / max(1, n)) + 1))).otherwise(bound)
    near = rows.where(place < bound).select(place.alias("place"), "hash", "label", spread_over(F.col("text"), most_chars).alias("text"))
    found = near.groupBy("hash", "label").agg(F.min("place").alias("place"), F.min("text").alias("text")).collect()
    texts, labels, taken = [], [], dict.fromkeys(counts, 0)
    for r in sorted(found, key=lambda r: (r["place"], r["text"], str(r["label"]))):
        if taken[r["label"]] < per_class:
            taken[r["label"]] += 1
            texts.append(r["text"])
            labels.append(r["label"])
    return texts, labels


def identify(docs: DataFrame, model: Model, text_col: str = "text", into: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` without its text, plus the predicted language and its score.

    Texts that are null or without a letter are ``und`` with score 0, as are all texts
    under a model without languages.  Whole texts are read; repeated rows agree.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most SAMPLE_CHARS x 3 grams a landmark
    rest = [c for c in docs.columns if c not in (text_col, into, score_col)]
    lettered = F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False))
    frame = docs.select(*rest, F.when(lettered, F.col(text_col)).alias(text_col))
    fields = [f for f in frame.schema.fields if f.name != text_col]
    schema = T.StructType([*fields, T.StructField(into, T.StringType()), T.StructField(score_col, T.DoubleType())])

    def one(batches):
        own = shared.value
        table = own.lookup() if own.languages else None
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            keep = [c for c in batch.schema.names if c != text_col]
            if table is None:
                names, value = [NO_LANGUAGE] * len(texts), np.zeros(len(texts))
            else:
                best, value = score(own, texts, table)
                void = texts.is_null().to_numpy(zero_copy_only=False)
                value[void] = 0
                names = [NO_LANGUAGE if v else own.languages[b] for b, v in zip(best, void, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(value, pa.float64())], names=[*keep, into, score_col])

    return frame.mapInArrow(one, schema)


def train(docs: DataFrame, label_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, landmarks: int = LANDMARKS_PER_LANGUAGE) -> Model:
    """Fits on a bounded sample: at most ``per_language`` labelled texts of each."""
    texts, labels = bounded_sample(docs, F.col(label_col), per_language)
    return fit(texts, labels, landmarks)


def held_out(parts: int, part: int, id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training by the checksum of its id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(parts)) == part, F.lit(False))


def digest(docs: DataFrame) -> DataFrame:
    """Fits on rows whose id checksum modulo 4 is not 2 and labels all rows.

    Null texts and texts without a letter are ``und`` with score 0; a null id is never
    held out; repeated rows agree; without labelled texts every row is ``und``."""
    out = held_out(4, 2)
    model = train(docs.where(~out))
    return identify(docs.select("doc_id", out.alias("held_out"), "text"), model)
