"""Points of routes as packed columns: 32-bit little-endian floats, column after column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

#: The name of the layout, its columns in order, and the most points of a route.
LAYOUT = "f32le-columns-v1"
FIELDS = ("t_offset_s", "altitude_m", "vertical_accuracy_m", "horizontal_accuracy_m")
MOST_POINTS = 20_000


def packed(routes: DataFrame) -> DataFrame:
    """Routes with arrays of FIELDS as ``n_points`` and ``points``, one binary each.

    Arrays of unequal length, and more than MOST_POINTS of them, are an error; a null array
    counts as empty."""
    rest = [c for c in routes.columns if c not in FIELDS]
    kept = T.StructType([routes.schema[c] for c in rest] + [T.StructField("n_points", T.IntegerType()), T.StructField("points", T.BinaryType())])

    def one(batches):
        for batch in batches:
            columns = [batch.column(len(rest) + k).cast(pa.list_(pa.float32())) for k in range(len(FIELDS))]
            sizes = np.stack([c.value_lengths().fill_null(0).to_numpy() for c in columns]) if len(batch) else np.zeros((4, 0), int)
            if (sizes != sizes[0]).any():
                raise ValueError("columns of a route differ in length")
            if (sizes > MOST_POINTS).any():
                raise ValueError(f"a route has more than {MOST_POINTS} points")
            flat = [c.flatten().to_numpy(zero_copy_only=False).astype("<f4") for c in columns]
            ends = np.concatenate([[0], np.cumsum(sizes[0])])
            blobs = [b"".join(f[a:b].tobytes() for f in flat) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(sizes[0].astype(np.int32)), pa.array(blobs, pa.binary())], names=[*rest, "n_points", "points"])

    return routes.select(*rest, *FIELDS).mapInArrow(one, kept)


def unpacked(routes: DataFrame, refuse: bool = False) -> DataFrame:
    """Routes with the arrays of FIELDS again, read from their buffers, and ``reason``.

    A blob whose length isn't that of its points, and a number of points below 0 or above
    MOST_POINTS, is an error, or with ``refuse`` a row with a reason and null arrays."""
    rest = [c for c in routes.columns if c != "points"]
    fields = [T.StructField(f, T.ArrayType(T.FloatType())) for f in FIELDS]
    schema = T.StructType([routes.schema[c] for c in rest] + fields + [T.StructField("reason", T.StringType())])

    def one(batches):
        for batch in batches:
            n = batch.column(rest.index("n_points")).to_numpy(zero_copy_only=False)
            reasons, cut = [], [[] for _ in FIELDS]
            for count, blob in zip(n, batch.column(len(rest)), strict=True):
                raw = blob.as_buffer() if blob.is_valid else pa.py_buffer(b"")
                reason = "bad_count" if not 0 <= count <= MOST_POINTS else "bad_length" if raw.size != 4 * len(FIELDS) * count else None
                if reason and not refuse:
                    raise ValueError(f"packed points: {reason}")
                reasons.append(reason)
                table = None if reason else np.frombuffer(raw, "<f4").reshape(len(FIELDS), int(count))
                for k, c in enumerate(cut):
                    c.append(None if reason else table[k])
            columns = [pa.array(c, pa.list_(pa.float32())) for c in cut]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *columns, pa.array(reasons, pa.string())], names=[*rest, *FIELDS, "reason"])

    return routes.select(*rest, "points").mapInArrow(one, schema)


