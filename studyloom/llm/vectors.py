"""Integer component matrices from Arrow batches of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components converted at a time, which bounds the memory of long vectors.
VALUES = 1 << 20


def integer_rows(column: pa.Array, dims: int, scale: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable rows and their components floor(scale * x), held within +-limit.

    Usable rows have ``dims`` components, none of them null, NaN or infinite.
    """
    starts, values = column.offsets.to_numpy(), column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    keep = np.flatnonzero((np.diff(starts) == dims) & (odd[starts[1:]] == odd[starts[:-1]]) & np.asarray(column.is_valid()))
    found = values[starts[:-1][keep][:, None] + np.arange(dims)] if dims else np.empty((len(keep), 0))
    return keep, np.clip(np.floor(scale * found), -limit, limit).astype(np.int64)


def slices(batch: pa.RecordBatch, dims: int):
    """The batch in pieces of at most about ``VALUES`` components."""
    step = max(1, VALUES // max(1, dims))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def usable(v: Column) -> Column:
    """True for an array without null, NaN or infinite values."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def first_rows(vectors: DataFrame, vec_id: str, embedding: str, count: int) -> tuple[int, list[list[float]]]:
    """Dimension of the first usable vector by id (nulls last, ties by components), and the first ``count`` usable vectors of it; (0, []) if there is none."""
    fine = vectors.select(F.col(vec_id).cast("long").alias("i"), F.col(embedding).cast("array<double>").alias("v")).where(usable(F.col("v")) & (F.size("v") > 0))
    order = [F.asc_nulls_last("i"), "v"]
    dims = [len(r["v"]) for r in fine.orderBy(*order).limit(1).collect()]
    return (dims[0], [r["v"] for r in fine.where(F.size("v") == dims[0]).orderBy(*order).limit(count).collect()]) if dims else (0, [])
