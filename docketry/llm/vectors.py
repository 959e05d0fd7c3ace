"""Helpers of the vector operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def valid_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Add ``vec``: the vector in double precision, or null if it takes no part, that
    is if it is null, empty, zero, or holds a null or non-finite component. Zeros at
    the end do not change a cosine, so shorter vectors count as filled up with zeros."""
    values = F.transform(vector, lambda x: x.cast("double"))
    good = F.forall(vector, lambda x: F.coalesce((x == x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists(vector, lambda x: x != 0)
    return df.withColumn("vec", F.when(good & ~F.exists(values, lambda x: F.isnan(x)), values))


def width(df: DataFrame) -> int:
    """Components of the longest vector that takes part."""
    return df.agg(F.max(F.size("vec")).alias("n")).first().n or 0


def matrix(column, columns: int):
    """An Arrow list column as a matrix of doubles with ``columns`` columns."""
    import numpy as np

    out = np.zeros((len(column), columns))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(np.asarray(column.offsets))
    if len(sizes) and (sizes == columns).all():
        return flat.reshape(-1, columns)
    at = 0
    for n, k in enumerate(sizes.tolist()):
        out[n, :k] = flat[at:at + k]
        at += k
    return out


def unit(rows):
    """Rows scaled to length 1; the largest component goes first, so that squares neither overflow nor vanish."""
    import numpy as np

    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
