"""Vectors as whole numbers in few bytes, shared by the operators on `embeddings`.

A component x becomes floor(scale * x), computed on doubles, which is exact; what lies
beyond 2^62 on either side counts as 2^62. A vector is packed with one, two or eight
bytes a component, the least that holds all of them. Vectors that are null or hold null
or non-finite components are left out.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import map_arrow

#: Components beyond this count as this.
LARGEST = float(1 << 62)
#: Bytes of a component to its type.
KINDS = {1: np.int8, 2: np.int16, 8: np.float64}


def usable(column="embedding"):
    """Not null, and no component null, NaN or infinite."""
    def finite(x):
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.col(column).isNotNull() & F.coalesce(F.forall(column, finite), F.lit(False))


def pack(rows):
    """A matrix of whole doubles as one bytes object a row."""
    out = np.empty(len(rows), object)
    largest = np.abs(rows).max(axis=1) if rows.shape[1] else np.zeros(len(rows))
    for kind, low, high in ((np.int8, -1, 127), (np.int16, 127, 32_767), (np.float64, 32_767, np.inf)):
        at = np.flatnonzero((largest > low) & (largest <= high))
        out[at] = [r.tobytes() for r in rows[at].astype(kind)]
    return out


def unpack(packed, dim):
    """The matrix of doubles that `pack` was given."""
    if not dim:
        return np.zeros((len(packed), 0))
    width = np.array([len(p) for p in packed], np.int64) // dim
    out = np.empty((len(packed), dim))
    for size, kind in KINDS.items():
        at = np.flatnonzero(width == size)
        if len(at):
            joined = b"".join(packed if len(at) == len(packed) else [packed[i] for i in at])
            out[at] = np.frombuffer(joined, kind).reshape(-1, dim)
    return out


def quantised(embeddings: DataFrame, scale: int, *columns: str) -> DataFrame:
    """`columns`, dim (components), norm (length of the whole numbers) and packed of every usable vector."""
    rows = embeddings.filter(usable()).select(*columns, F.col("embedding").cast("array<double>").alias("__vector"))
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in columns] + ["dim int", "norm double", "packed binary"])

    def run(batch):
        vectors = batch.column(len(columns))
        length = np.diff(vectors.offsets.to_numpy())
        flat = np.clip(np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * scale), -LARGEST, LARGEST)
        start = np.cumsum(length) - length
        norm, packed = np.zeros(len(length)), np.empty(len(length), object)
        for dim in np.unique(length):
            at = np.flatnonzero(length == dim)
            matrix = flat[start[at][:, None] + np.arange(dim)]
            norm[at], packed[at] = np.sqrt(np.square(matrix).sum(axis=1)), pack(matrix)
        return [*batch.columns[:len(columns)], length, norm, packed.tolist()]
    return map_arrow(rows, run, schema)
