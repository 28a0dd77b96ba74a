"""Compressed vector codes: one small codebook per part of the vectors, nearest entries found by equal-average search.

By Cauchy's inequality the squared difference of two component sums, divided by the dimension, is at most the squared distance. So
the entries of a codebook are sorted by their sums; a part starts at its own sum and goes outwards, always to the nearer
sum, until the squared gap over the dimension strictly exceeds the best distance. Entries that are as near as the best one are
all seen, so ties go to the lower index.

Each round is one map pass: a task reads vectors, finds entries and returns only sums and counts per part, entry and component, at most
``parts * entries * (width + 1)`` rows whatever it has read. The driver holds the codebooks alone (entries x dimension integers).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import null_safe_join
from .common import HEAVY_SHARE, batch, written
from .vectors import first_rows, integer_rows, slices

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
CODES = pa.schema([("code", pa.string()), ("error", pa.int64())])


def edges(dims: int, parts: int) -> list[int]:
    """Where the parts begin and end; if they can't be equal, they differ by one component at most."""
    return [i * dims // parts for i in range(parts + 1)]


def limit(dims: int, parts: int) -> int:
    """Largest component for which squared gaps, distances and errors all stay within 64 bits."""
    return (1 << 30) // max(4, -(-dims // parts), parts)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of each row's nearest entry, the squared distance, and how many distances were taken."""
    n, width = x.shape
    sums, at = entries.sum(1), x.sum(1)
    order = np.argsort(sums, kind="stable")
    sums = sums[order]
    right = np.searchsorted(sums, at)
    left = right - 1
    best, index, todo, looked = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.arange(n), 0
    far = np.iinfo(np.int64).max
    while len(todo):
        lo, hi, a = left[todo], right[todo], at[todo]
        down = np.where(lo >= 0, a - sums[np.maximum(lo, 0)], far)
        up = np.where(hi < len(sums), sums[np.minimum(hi, len(sums) - 1)] - a, far)
        gap = np.minimum(down, up)
        open_ = gap < far
        open_[open_] &= (best[todo[open_]] < 0) | (gap[open_] ** 2 <= width * best[todo[open_]])
        todo, lower = todo[open_], (down <= up)[open_]
        entry = order[np.where(lower, lo[open_], hi[open_])]
        distance = ((x[todo] - entries[entry]) ** 2).sum(1)
        looked += len(todo)
        better = (best[todo] < 0) | (distance < best[todo]) | ((distance == best[todo]) & (entry < index[todo]))
        best[todo[better]], index[todo[better]] = distance[better], entry[better]
        left[todo[lower]] -= 1
        right[todo[~lower]] += 1
    return index, best, looked


def fit(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """One codebook per part: the first vectors by id, moved ``rounds`` times to the floored means of what is nearest to them. Without a usable row: an empty list."""
    dims, first = first_rows(vectors, vec_id, embedding, entries)
    if not first:
        return []
    cut, most = edges(dims, parts), limit(dims, parts)
    start = np.clip(np.floor(scale * np.array(first)), -most, most).astype(np.int64)
    books = [start[:, a:b] for a, b in zip(cut, cut[1:])]
    for _ in range(rounds):
        def sums(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
            total = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
            for some in (s for whole in batches for s in slices(whole, dims)):
                q = integer_rows(some.column(0), dims, scale, most)[1]
                for p, book in enumerate(books):
                    x = q[:, cut[p]:cut[p + 1]]
                    index = nearest(x, book)[0]
                    for e in np.unique(index):
                        own = x[index == e]
                        total[p][e] += [*own.sum(0), len(own)]
            out = [(p, e, j, int(t[e, j])) for p, t in enumerate(total) for e in np.flatnonzero(t[:, -1]) for j in range(t.shape[1])]
            yield batch(pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("at", pa.int32()), ("total", pa.int64())]), [list(c) for c in zip(*out)] or [[]] * 4)

        found = vectors.select(F.col(embedding).cast("array<double>")).mapInArrow(sums, "part int, entry int, at int, total long")
        new = [np.column_stack([b, np.zeros(len(b), np.int64)]) for b in books]
        for r in found.groupBy("part", "entry", "at").agg(F.sum("total").alias("total")).collect():
            new[r["part"]][r["entry"], r["at"]] = r["total"]
        books = [np.where(t[:, -1:] > 0, t[:, :-1] // np.maximum(1, t[:, -1:]), b) for t, b in zip(new, books)]
    return books


def encode(vectors: DataFrame, books: list[np.ndarray], vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of every usable row."""
    dims = sum(b.shape[1] for b in books)
    cut, most = np.cumsum([0, *(b.shape[1] for b in books)]), limit(dims, max(1, len(books)))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (s for whole in batches for s in slices(whole, dims)):
            keep, q = integer_rows(some.column(2), dims, scale, most)
            found = [nearest(q[:, cut[p]:cut[p + 1]], b)[:2] for p, b in enumerate(books)]
            digits = np.column_stack([i for i, _ in found]).astype(np.uint8)
            ids, labels = (some.column(c).take(pa.array(keep)) for c in (0, 1))
            codes = [row.tobytes().hex() for row in digits]
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes, pa.string()), pa.array(sum(d for _, d in found))], names=["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    shape = f"vec_id long, label {kind}, code string, error long"
    return rows.mapInArrow(run, shape) if books else rows.sparkSession.createDataFrame([], shape)


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES,
                 rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every usable row.

    Rows whose vector is null, empty, of another length than the first one by vec_id, or holds null or non-finite components are left out.
    Components are held within the bound of :func:`limit` (2^27 for 64 dimensions), beyond which sums would leave 64 bits. Rows
    without an id come last in the order of ids; rows with equal ids are ordered by their vectors, and each has its code.
    Null labels are one label. Other columns are not read. At most 256 ``entries``. A table without usable rows gives no rows.

    Labels with at least ``HEAVY_SHARE`` of the rows, a bounded number, have their totals sent to every task; the others meet theirs by a shuffle.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits a part: at most 256 entries")
    books = fit(vectors, vec_id, embedding, scale, parts, entries, rounds)
    codes = written(encode(vectors, books, vec_id, embedding, label, scale), "vector-codes")
    totals = codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    least = max(1, int(codes.count() * HEAVY_SHARE))
    heavy, light = (totals.where(c).drop("n") for c in (F.col("n") >= least, F.col("n") < least))
    heavy = heavy.withColumn("heavy", F.lit(True))
    split = null_safe_join(codes, F.broadcast(heavy), ["label"], "left")
    of_heavy = split.where("heavy").drop("heavy")
    of_light = null_safe_join(split.where("heavy is null").drop("heavy", "label_error"), light, ["label"])
    return of_heavy.unionByName(of_light).withColumn("codebooks_sha256", F.lit(digest(books)))
