"""Vectors as arrays: norms by built-in higher-order functions, similarities by matrix products over Arrow batches, and a hashing encoder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Sum of products in the order of the elements, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(v: Column) -> Column:
    """The vector by its norm; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def rows_of(vectors: pa.Array) -> np.ndarray | None:
    """A column of vectors as a matrix in double precision, without a copy for each row; None if one is absent, has an absent number or another length."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    n, flat = len(vectors), vectors.flatten()
    if not n or vectors.null_count or flat.null_count or len(flat) % n or pc.min_max(pc.list_value_length(vectors)).as_py() != dict.fromkeys(("min", "max"), len(flat) // n):
        return None
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


@F.arrow_udf(T.DoubleType())
def _cosines(a: pa.Array, b: pa.Array) -> pa.Array:
    x, y = rows_of(a), rows_of(b)
    if x is not None and y is not None and x.shape == y.shape:
        return pa.array(np.round(np.einsum("ij,ij->i", x, y), 6) + 0.0)
    each = [None if u is None or v is None or len(u) != len(v) or None in u or None in v else round(float(np.dot(np.asarray(u, float), np.asarray(v, float))), 6) + 0.0 for u, v in zip(a.to_pylist(), b.to_pylist(), strict=True)]
    return pa.array(each, pa.float64())


def similarity(a: Column, b: Column) -> Column:
    """Cosine of unit vectors to six decimals: both engines and all plans then rank alike. A product of matrices for each
    Arrow batch; vectors of different lengths, or with absent numbers, have none."""
    return _cosines(a, b)


def hash_encoder(dimensions: int = 64, model: str = "hash-64"):
    """An offline encoder with the interface of a real one: texts in, unit vectors out. Words are hashed with a sign.

    A model is loaded once for each task, before its first batch."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def vector(text: str | None) -> np.ndarray:
            v = np.zeros(dimensions, np.float32)
            for word in (text or "").lower().replace("_", " ").split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), key=model.encode(), digest_size=8).digest(), "little")
                v[h % dimensions] += 1 if h >> 32 & 1 else -1
            norm = float(np.linalg.norm(v))
            return v / norm if norm else v

        for batch in texts:
            yield batch.map(vector)

    return encode
