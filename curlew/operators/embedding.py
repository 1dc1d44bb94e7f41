"""Text embedders as plug-ins.

Defined cases: a null text is an empty one; a vector of length 0 stays as it is when
normalised; an empty table gives no row; further columns are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Encoder = Callable[[list[str]], np.ndarray]


def hashed_words(dimensions: int = 64) -> Encoder:
    """An embedder without a model: signed counts of hashed words."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dimensions] += 1 if h >> 31 else -1
        return out

    return encode


def embed(df: DataFrame, text: str, make: Callable[[], Encoder], out: str = "embedding", batch: int = 256, normalise: bool = True) -> DataFrame:
    """Adds the vector of each text. ``make`` is called once in each task and loads the
    embedder there, which then gets ``batch`` texts at a time."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make()
        for b in batches:
            for low in range(0, b.num_rows, batch):
                rows = b.slice(low, batch)
                v = np.asarray(encode([t or "" for t in rows.column(at).to_pylist()]), np.float32)
                if normalise:
                    size = np.linalg.norm(v, axis=1, keepdims=True)
                    v = v / np.where(size > 0, size, 1)
                yield pa.record_batch([*rows.columns, pa.array(list(v), pa.list_(pa.float32()))], names=[*rows.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))
