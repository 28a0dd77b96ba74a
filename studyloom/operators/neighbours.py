"""Exact nearest rows by a pivot index (inventory M12).

Reference rows go to the nearest of about twice the square root of their number of pivots; the pivots themselves lie round some super pivots. A cell is known by
its pivot and the least and largest distance of its rows to it. By the triangle inequality a row at distance d from a pivot can have a neighbour
within r in its cell only where that cell's rows are from d - r to d + r away from the pivot; the distances of pivots to super pivots rule out
most pivots in the same way. A first pass looks at a row's own cell alone, which gives r; a second one visits the other cells for which the bound is open.

Equal rows are one row of the index, with the first ids only, which are all that ties can need. Blocks of a cell
and bundles of searches are bounded, so a cell with most of all rows is many tasks. No pair of rows leaves a task but the best ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Super pivots whose distances bound those to all pivots.
LANDMARKS = 8
#: Numbers of a task's matrix at a time.
VALUES = 1 << 20
#: More pivots are not sent to the tasks; a larger table has larger cells.
PIVOTS = 16_384


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances along the last axis, summed column by column, so that equal rows have equal distances wherever they are taken."""
    out = 0.0
    for c in range(a.shape[-1]):
        out = out + (a[..., c] - b[..., c]) ** 2
    return np.sqrt(out)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return gaps(a[:, None], b[None])


class PivotIndex:
    """Pivots, their groups and, once told, what their cells hold."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.supers = pivots[:int(np.ceil(np.sqrt(len(pivots))))]
        near = distances(pivots, self.supers)
        self.group = near.argmin(1)
        self.reach = near[np.arange(len(pivots)), self.group]
        self.marks = near[:, :LANDMARKS].T
        self.count, self.low, self.high = np.zeros(len(pivots), int), np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)

    def at_least(self, to: np.ndarray) -> np.ndarray:
        """[row, pivot] lower bounds of distances, from those to the pivot's own super pivot and to a few others."""
        out = np.abs(to[:, self.group] - self.reach)
        for i, mark in enumerate(self.marks):
            np.maximum(out, np.abs(to[:, i, None] - mark), out=out)
        return out

    def sure_radius(self, k: int) -> np.ndarray:
        """A distance from each pivot within which there are k indexed rows for certain, taken from the cells as balls; infinite if there are fewer."""
        out = np.where(self.count >= k, self.high, np.inf)
        filled = np.flatnonzero(self.count)
        for c in np.flatnonzero(self.count < k):
            balls = gaps(self.pivots[filled], self.pivots[c]) + self.high[filled]
            order = np.argsort(balls)
            enough = np.flatnonzero(np.cumsum(self.count[filled][order]) >= k)
            if len(enough):
                out[c] = balls[order[enough[0]]]
        return out

    def pairs(self, v: np.ndarray, rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        return gaps(v[rows], self.pivots[pivots])

    def assign(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Nearest pivot of each row, the distance to it, those to all super pivots, and how many distances were taken."""
        to = distances(v, self.supers)
        cell, at_least = to.argmin(1), self.at_least(to)  # a super pivot is a pivot too
        best, looked = to.min(1), to.size
        guess = at_least.argmin(1)  # probably near: brings the bound down before the others are looked at
        for round_ in (0, 1):
            rows, pivots = (np.arange(len(v)), guess) if round_ == 0 else np.nonzero((at_least <= best[:, None]) & (np.arange(len(self.pivots)) >= len(self.supers)))
            d = self.pairs(v, rows, pivots)
            looked += len(d)
            order = np.lexsort((pivots, d, rows))
            first = order[np.unique(rows[order], return_index=True)[1]]
            r, d, p = rows[first], d[first], pivots[first]
            better = (d < best[r]) | ((d == best[r]) & (p < cell[r]))
            best[r[better]], cell[r[better]] = d[better], p[better]
        return cell, best, to, looked

    def open_cells(self, v: np.ndarray, own: np.ndarray, to: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(row, cell, distance to its pivot) of the other cells that may hold rows within r, and how many distances were taken."""
        rr = (r + 1e-9 * (1 + r))[:, None]
        at_least = self.at_least(to)
        rows, cells = np.nonzero((at_least - rr <= self.high) & (self.count > 0) & (np.arange(len(self.pivots)) != own[:, None]))
        d = self.pairs(v, rows, cells)
        rr = rr[rows, 0]
        keep = (d - rr <= self.high[cells]) & (d + rr >= self.low[cells])
        return rows[keep], cells[keep], d[keep], len(d)


class Cell:
    """Rows of a block of a cell in the order of their distance to the pivot; ``ids`` are the rows' smallest."""

    def __init__(self, v: np.ndarray, ids: np.ndarray, to_pivot: np.ndarray):
        self.order = np.lexsort((ids, to_pivot))
        self.v, self.ids, self.to_pivot = v[self.order], ids[self.order], to_pivot[self.order]

    def nearest(self, x: np.ndarray, d: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(search, position, distance) of up to k nearest rows within r of each x, by (distance, id), and how many distances were taken.

        ``d`` are the distances of the searches to the pivot.
        """
        n, looked, r = len(self.ids), 0, r.copy()
        free = np.flatnonzero(~np.isfinite(r))
        if len(free) and n > 8 * k:  # rows about as far from the pivot give a first bound
            start = np.clip(np.searchsorted(self.to_pivot, d[free]) - 2 * k, 0, n - 4 * k)
            for i in range(0, len(free), VALUES // (4 * k)):
                at = free[i:i + VALUES // (4 * k)]
                some = gaps(x[at, None], self.v[start[i:i + len(at), None] + np.arange(4 * k)])
                looked += some.size
                r[at] = np.partition(some, k - 1, 1)[:, k - 1]
        slack = 1e-9 * (1 + d)
        lo, hi = np.searchsorted(self.to_pivot, d - r - slack), np.searchsorted(self.to_pivot, d + r + slack, "right")
        wide = np.maximum(0, hi - lo)
        found = []
        dense = wide.sum() > n * len(x) / 4
        step = max(1, VALUES // max(1, n))
        for i in range(0, len(x), step):
            part = slice(i, i + step)
            if dense:
                dist = distances(x[part], self.v)
                q, p = np.nonzero(dist <= r[part, None])
                dist, looked = dist[q, p], looked + (len(x[part]) * n)
            else:
                w = wide[part]
                q = np.repeat(np.arange(len(w)), w)
                p = np.arange(len(q)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(lo[part], w)
                dist, looked = gaps(x[part][q], self.v[p]), looked + len(q)
                keep = dist <= r[part][q]
                q, p, dist = q[keep], p[keep], dist[keep]
            order = np.lexsort((self.ids[p], dist, q))
            q, p, dist = q[order], p[order], dist[order]
            best = np.arange(len(q)) - np.searchsorted(q, q) < k
            found.append((q[best] + i, self.order[p[best]], dist[best]))
        return *(np.concatenate(c) for c in zip(*found)), looked


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


FOUND = pa.schema([("q", pa.int64()), ("d", pa.float64()), ("ids", pa.list_(pa.int64())), ("looked", pa.int64())])
PLACED = "q long, v array<double>, ids array<long>, cell int, d double, to array<double>, looked long"
STEP = 512


def nearest_rows(df: DataFrame, ident: str, columns: list[str], reference: Column, k: int, block_rows: int = 4096, bundle_rows: int = 4096, counted: bool = False) -> DataFrame:
    """The k nearest other reference rows of every row as an array ``near`` of (d, o), exact; equal distances go by id.

    Ids are whole numbers. Rows with a missing or non-finite value take no part. With ``counted``, instead one row with the number of ``rows``
    and of all distances ``looked`` at, those to pivots included.
    """
    width = len(columns)
    checkpoint_dir(df.sparkSession)
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.array(*[F.col(c).cast("double") + 0.0 for c in columns])  # adds to one zero
    x = df.select(F.col(ident).cast("long").alias("id"), v.alias("v"), F.coalesce(reference, F.lit(False)).alias("ref")).where(fine)
    first = F.row_number().over(Window.partitionBy("v", "ref").orderBy("id"))
    some = x.withColumn("place", first).where(F.col("place") <= k + 1)
    distinct = some.groupBy("v").agg(F.sort_array(F.collect_list(F.when(F.col("ref"), F.col("id")))).alias("ids"))
    distinct = distinct.select(F.monotonically_increasing_id().alias("q"), "v", "ids").checkpoint()
    there = distinct.where(F.size("ids") > 0)
    m = there.count()
    if not m:
        empty = x.select(F.col("id").alias(ident), F.array().cast("array<struct<d:double,o:bigint>>").alias("near"))
        return x.agg(F.count(F.lit(1)).alias("rows"), F.lit(0).cast("long").alias("looked")) if counted else empty
    spots = there.orderBy(F.xxhash64("v"), "v").limit(min(PIVOTS, int(np.ceil(2 * np.sqrt(m))))).select("v").collect()
    index = PivotIndex(np.array([r["v"] for r in spots], float))

    def once(n: int, looked: int) -> pa.Array:
        """A batch's count in its first row."""
        return pa.array(np.where(np.arange(n) == 0, looked, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in (b.slice(i, STEP) for b in batches for i in range(0, b.num_rows, STEP)):
            cell, d, to, looked = index.assign(matrix(s.column("v"), width))
            columns = [*s.columns, pa.array(cell.astype(np.int32)), pa.array(d), pa.array(list(to)), once(len(cell), looked)]
            yield pa.RecordBatch.from_arrays(columns, names=[*s.schema.names, "cell", "d", "to", "looked"])

    placed = distinct.mapInArrow(assign, PLACED).checkpoint()
    indexed = placed.where(F.size("ids") > 0)
    for r in indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).collect():
        index.count[r["cell"]], index.low[r["cell"]], index.high[r["cell"]] = r["n"], r["low"], r["high"]

    def parts(sizes: dict[int, int], most: int) -> Column:
        """Into how many parts a cell's rows are cut, from its size; most cells are whole."""
        cut = [F.lit(x) for c, n in sizes.items() if n > most for x in (c, -(-n // most))]
        return F.coalesce(F.element_at(F.create_map(*cut), F.col("cell")), F.lit(1)).cast("long") if cut else F.lit(1).cast("long")

    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    blocks = parts({c: int(n) for c, n in enumerate(index.count)}, block_rows)

    def search(rows: pa.Table, some: pa.Table) -> pa.Table:
        if not rows.num_rows or not some.num_rows:
            return FOUND.empty_table()
        ids = rows["ids"].combine_chunks()
        cell = Cell(matrix(rows["v"], width), pc.list_element(ids, 0).to_numpy(), rows["d"].to_numpy())
        at, p, near, looked = cell.nearest(matrix(some["v"], width), some["d"].to_numpy(), some["r"].to_numpy(), k + 1)
        count = pa.table([pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.nulls(1, FOUND.field("ids").type), pa.array([looked])], schema=FOUND)
        return pa.concat_tables([count, pa.table([some["q"].take(pa.array(at)), pa.array(near), ids.take(pa.array(p)), pa.array(np.zeros(len(at), np.int64))], schema=FOUND)])

    def visit(searches: DataFrame) -> DataFrame:
        """Best k + 1 rows of each search (q, v, cell, d, r) in each block of its cell."""
        large = searches.groupBy("cell").count().where(F.col("count") > bundle_rows).collect()
        bundles = parts({r["cell"]: r["count"] for r in large}, bundle_rows)
        keys = ["cell", "block", "bundle"]
        s = searches.select("q", "v", "cell", "d", "r", F.pmod(F.xxhash64("q"), bundles).alias("bundle"), each(blocks).alias("block"))
        r = indexed.select("ids", "v", "cell", "d", F.pmod(F.xxhash64(F.lit(5), "q"), blocks).alias("block"), each(bundles).alias("bundle"))
        return r.groupBy(*keys).cogroup(s.groupBy(*keys)).applyInArrow(search, "q long, d double, ids array<long>, looked long")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("q").orderBy("d", F.get("ids", F.lit(0)))
        return found.where("ids is not null").select("q", "d", "ids", F.row_number().over(order).alias("place")).where(F.col("place") <= k + 1)

    home = visit(placed.select("q", "v", "cell", "d", F.lit(float("inf")).alias("r"))).checkpoint()
    bound = best(home).where(F.col("place") == k + 1).select("q", F.col("d").alias("r"))
    rest = placed.select("q", "v", "cell", "d", "to").join(bound, "q", "left").withColumn("r", F.coalesce("r", F.lit(float("inf"))))
    sure = index.sure_radius(k + 1)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in (b.slice(i, STEP) for b in batches for i in range(0, b.num_rows, STEP)):
            own = s.column("cell").to_numpy()
            r = np.minimum(s.column("r").to_numpy(), s.column("d").to_numpy() + sure[own])
            rows, cell, d, looked = index.open_cells(matrix(s.column("v"), width), own, matrix(s.column("to"), len(index.supers)), r)
            t = s.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([t.column("q"), t.column("v"), pa.array(cell.astype(np.int32)), pa.array(d), pa.array(r[rows]), once(len(rows), looked)], names=["q", "v", "cell", "d", "r", "looked"])

    routed = rest.mapInArrow(spread, "q long, v array<double>, cell int, d double, r double, looked long").checkpoint()
    away = visit(routed)
    if counted:
        total = placed.select("looked").unionByName(home.select("looked")).unionByName(routed.select("looked")).unionByName(away.select("looked"))
        return total.agg(F.lit(x.count()).alias("rows"), F.sum("looked").alias("looked"))
    # the ids of a row's best vectors, nearest first; its own is among them at most once
    near = best(home.unionByName(away)).groupBy("q").agg(F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda o: F.struct(F.col("d").alias("d"), o.alias("o")))))).alias("near"))
    found = distinct.join(near, "q").select("v", "near")
    mine = F.slice(F.filter("near", lambda e: ~e["o"].eqNullSafe(F.col("id"))), 1, k)
    return x.select("id", "v").join(found, "v").select(F.col("id").alias(ident), mine.alias("near"))
