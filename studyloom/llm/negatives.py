"""Hard negatives by a multiway hyperplane tree with distance ranges to sibling subtrees.

**Metric.** A row x becomes a point of one norm by a further component sqrt(M^2 - |x|^2), where M is the largest norm; an anchor a gets 0
there. Then the squared distance of a and x is |a|^2 + M^2 - 2 <a, x>: a window of scores is an annulus of distances around the anchor.

**Tree.** Every node has some split points, chosen far apart; a row goes to the nearest one (so hyperplanes lie between the
subtrees). Each split point stores the least and the largest distance to the rows of each sibling subtree. For an anchor at distance d
from a split point and an annulus from r to R, a row in it is between max(d - R, r - d, 0) and d + R away from the split point; a subtree
whose range misses that interval for any split point is eliminated. R shrinks as results come in. Leaves are scored exactly, in integers.

**Spark.** The root's split points come from a bounded sample; its ranges are a small table. Its cells are cut into blocks of bounded rows,
each one task's subtree, kept as one row of a table. Anchors go in bounded bundles to the blocks that are left after elimination: the own
cell first, then, with the bound found there, the others. Per block and search only the best k rows come back.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, written
from .vectors import first_rows, integer_rows, slices

SCALE = 256
#: Stands for a null id in the order of ties, so such rows come last.
NO_ID = np.iinfo(np.int64).max
NONE = -float("inf")


class Space:
    """Distances of the padded points. ``most`` is the largest squared norm."""

    def __init__(self, most: float):
        self.most, self.slack = float(most), 1e-6 * (float(most) ** 0.5 + 1)

    def extra(self, norms: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, self.most - norms))

    def between(self, x: np.ndarray, x_norms: np.ndarray, p: np.ndarray, p_norms: np.ndarray) -> np.ndarray:
        """Of rows and split points."""
        inner = x @ p.T + np.outer(self.extra(x_norms), self.extra(p_norms))
        return np.sqrt(np.maximum(0, 2 * (self.most - inner)))

    def radius(self, norms: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Of anchors of these squared norms and rows with these scores."""
        return np.sqrt(np.maximum(0, norms + self.most - 2 * scores))

    def meets(self, d: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Anchors for which a cell may hold a row of any window. d: [anchor, split point]; near, far: the cell's range for each split point."""
        out = np.zeros(len(d), bool)
        for w in range(low.shape[1]):
            inner, outer = self.radius(norms, high[:, w])[:, None], self.radius(norms, low[:, w])[:, None]
            at_least = np.maximum(d - outer, inner - d) - self.slack
            out |= (low[:, w] <= high[:, w]) & ((far >= at_least) & (near <= d + outer + self.slack)).all(1)
        return out


def far_apart(x: np.ndarray, norms: np.ndarray, count: int, space: Space) -> np.ndarray:
    """Positions of up to ``count`` distinct split points: each next one is as far as can be from those before."""
    chosen = [0]
    least = space.between(x, norms, x[:1], norms[:1])[:, 0]
    differs = (x != x[0]).any(1)
    while len(chosen) < count and differs.any():
        nxt = int(np.argmax(np.where(differs, least, -1)))
        chosen.append(nxt)
        least = np.minimum(least, space.between(x, norms, x[nxt:nxt + 1], norms[nxt:nxt + 1])[:, 0])
        differs &= (x != x[nxt]).any(1)
    return np.array(chosen)


def ranges(distances: np.ndarray, cell: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """[split point, cell] least and largest distance; an empty cell has an empty range."""
    low, high = np.full((count, count), np.inf), np.full((count, count), -np.inf)
    for j in np.unique(cell):
        own = distances[cell == j]
        low[:, j], high[:, j] = own.min(0), own.max(0)
    return low, high


class Tree:
    """A subtree over one block: rows, and nodes that are (split points, their norms, low, high, children) or (start, end) of a leaf."""

    def __init__(self, x: np.ndarray, norms: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, space: Space, fanout: int = 8, leaf: int = 128):
        self.space, order = space, []

        def grow(at: np.ndarray):
            if len(at) > leaf:
                some = at[np.linspace(0, len(at) - 1, min(len(at), 3 * fanout)).astype(int)]
                split = some[far_apart(x[some], norms[some], fanout, space)]
                if len(split) == 1 and (other := at[(x[at] != x[split[0]]).any(1)]).size:
                    split = np.append(split, other[0])  # the sample was of one vector
                if len(split) > 1:
                    distances = space.between(x[at], norms[at], x[split], norms[split])
                    cell = np.argmin(distances, 1)
                    if (cell != cell[0]).any():
                        low, high = ranges(distances, cell, len(split))
                        return x[split], norms[split], low, high, [grow(at[cell == j]) if (cell == j).any() else None for j in range(len(split))]
            at = at[np.argsort(ids[at], kind="stable")]
            start = sum(map(len, order))
            order.append(at)
            return start, start + len(at)

        self.root = grow(np.arange(len(x)))
        at = np.concatenate(order) if order else np.arange(0)
        self.x, self.ids, self.rows, self.labels = x[at], ids[at], rows[at], labels[at]

    def search(self, a: np.ndarray, norms: np.ndarray, own: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, dict]:
        """The k best rows (positions, scores) of each anchor and window: scores from ``low`` to ``high``, equal or other labels, not the anchor's ``own`` row.

        ``low`` and ``high`` are [anchor, window]. Ties go to the smaller id. Missing places are -1. Also counts the pairs scored.
        """
        n, wide = low.shape
        score, at = np.full((n, wide, k), NONE), np.full((n, wide, k), -1)
        low, seen, step = low.astype(float).copy(), {"scored": 0, "eliminated": 0}, 512

        def visit(node, todo: np.ndarray) -> None:
            if node is None or not len(todo):
                return
            if len(node) == 2:
                return leaf(*node, todo)
            points, p_norms, near, far, children = node
            d = self.space.radius(norms[todo][:, None], a[todo] @ points.T)
            first = np.argmin(d, 1)
            for j, child in enumerate(children):  # everybody's nearest subtree first, which brings the bound down
                visit(child, todo[first == j])
            for j, child in enumerate(children):
                rest, dj = todo[first != j], d[first != j]
                left = self.space.meets(dj, norms[rest], low[rest], high[rest], near[:, j], far[:, j])
                seen["eliminated"] += int((~left).sum())
                visit(child, rest[left])

        def leaf(start: int, end: int, todo: np.ndarray) -> None:
            if end - start > step:  # many equal vectors
                for i in range(start, end, step):
                    leaf(i, min(end, i + step), todo)
                return
            seen["scored"] += len(todo) * (end - start)
            s = a[todo] @ self.x[start:end].T
            fits = ((self.labels[start:end] == labels[todo][:, None]) == same) & (self.rows[start:end] != own[todo][:, None])
            for w in range(wide):
                s_w = np.where(fits & (s >= low[todo, w][:, None]) & (s <= high[todo, w][:, None]), s, NONE)
                hit = np.flatnonzero(s_w.max(1, initial=NONE) > NONE)
                if not len(hit):
                    continue
                who = todo[hit]
                if end - start > 4 * k:  # the k best and all that tie with the last of them
                    edge = -np.partition(-s_w[hit], k - 1, 1)[:, k - 1:k]
                    s_hit = np.where(s_w[hit] >= edge, s_w[hit], NONE)
                    keep = np.flatnonzero((s_hit > NONE).any(0))
                else:
                    s_hit, keep = s_w[hit], np.arange(end - start)
                places = np.broadcast_to(start + keep, (len(hit), len(keep)))
                all_s, all_at = np.concatenate([score[who, w], s_hit[:, keep]], 1), np.concatenate([at[who, w], places], 1)
                best = np.lexsort((self.ids[all_at], -all_s), axis=1)[:, :k]
                new = np.take_along_axis(all_s, best, 1)
                score[who, w], at[who, w] = new, np.where(new > NONE, np.take_along_axis(all_at, best, 1), -1)
                low[who, w] = np.maximum(low[who, w], score[who, w, k - 1])

        visit(self.root, np.flatnonzero((low <= high).any(1)))
        return at, score, seen


    def dump(self) -> bytes:
        return pickle.dumps((self.space, self.root, self.x.astype(np.int32), self.ids, self.rows, self.labels), 5)

    @classmethod
    def load(cls, blob: bytes) -> Tree:
        tree = cls.__new__(cls)
        tree.space, tree.root, x, tree.ids, tree.rows, tree.labels = pickle.loads(blob)
        tree.x = x.astype(float)
        return tree


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a column of little-endian 32-bit integers."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dims).astype(float)


def nested(column: pa.Array) -> np.ndarray:
    """A matrix from a column of lists of equal length."""
    return np.array(column.to_pylist(), float).reshape(len(column), -1)


class Root:
    """The top node: split points from a sample, block counts and ranges of their cells."""

    def __init__(self, space: Space, points: np.ndarray):
        self.space, self.points, self.norms = space, points, (points ** 2).sum(1)
        self.blocks = np.zeros(len(points), int)
        self.low, self.high = ranges(np.empty((0, len(points))), np.empty(0), len(points))

    def distances(self, x: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return self.space.between(x, norms, self.points, self.norms)


ROW = "row long, vec_id long, label long, q binary, norm double"
BLOCK = pa.schema([("cell", pa.int32()), ("block", pa.int32()), ("tree", pa.binary()), ("near", pa.list_(pa.float64())), ("far", pa.list_(pa.float64()))])
FOUND = pa.schema([("anchor", pa.int64()), ("window", pa.int32()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND_DDL = "anchor long, window int, row long, vec_id long, score long"


def prepared(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """Rows that take part, numbered, with integer components and squared norms; columns vec_id, label, v."""
    limit = int((2 ** 52 // max(1, dims)) ** 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (s for whole in batches for s in slices(whole, dims)):
            keep, q = integer_rows(some.column(2), dims, scale, limit)
            own = [some.column(c).take(pa.array(keep)) for c in (0, 1)]
            packed = [r.tobytes() for r in q.astype("<i4")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(packed, pa.binary()), pa.array((q ** 2).sum(1).astype(float))], names=["vec_id", "label", "q", "norm"])

    found = vectors.mapInArrow(run, "vec_id long, label long, q binary, norm double")
    return written(found.select(F.monotonically_increasing_id().alias("row"), "*"), "negatives-rows")


def plant(rows: DataFrame, dims: int, cells: int, block_rows: int, fanout: int, leaf: int) -> tuple[Root, DataFrame, DataFrame]:
    """The root, the table of blocks with their subtrees, and the rows with their cells."""
    most = rows.agg(F.max("norm")).first()[0]
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(3 * cells).select("q", "norm").toPandas()
    x = np.frombuffer(b"".join(map(bytes, sample["q"])), "<i4").reshape(-1, dims).astype(float)
    space = Space(most)
    root = Root(space, x[far_apart(x, sample["norm"].to_numpy(), cells, space)])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = np.argmin(root.distances(matrix(b.column("q"), dims), b.column("norm").to_numpy()), 1).astype(np.int32)
            block = b.column("row").to_numpy() % np.maximum(1, root.blocks[cell])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(block.astype(np.int32))], names=[*b.schema.names, "cell", "block"])

    def placed() -> DataFrame:
        return rows.mapInArrow(assign, ROW + ", cell int, block int")

    def build(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        x, norms = matrix(t["q"], dims), t["norm"].to_numpy()
        ids = t["vec_id"].fill_null(int(NO_ID)).to_numpy()
        tree = Tree(x, norms, ids, t["row"].to_numpy(), t["label"].to_numpy(), space, fanout, leaf)
        d = root.distances(x, norms)
        return pa.Table.from_batches([batch(BLOCK, [[t["cell"][0].as_py()], [t["block"][0].as_py()], [tree.dump()], [d.min(0).tolist()], [d.max(0).tolist()]])])

    for r in placed().groupBy("cell").count().collect():
        root.blocks[r["cell"]] = -(-r["count"] // block_rows)
    blocks = written(placed().groupBy("cell", "block").applyInArrow(build, "cell int, block int, tree binary, near array<double>, far array<double>"), "negatives-blocks")
    per_point = blocks.select("cell", F.posexplode(F.arrays_zip("near", "far")).alias("point", "r"))
    for r in per_point.groupBy("point", "cell").agg(F.min("r.near").alias("near"), F.max("r.far").alias("far")).collect():
        root.low[r["point"], r["cell"]], root.high[r["point"], r["cell"]] = r["near"], r["far"]
    return root, blocks, placed().drop("block")


SEARCH = "anchor long, label long, q binary, norm double, home int, low array<double>, high array<double>"


def _visit(root: Root, blocks: DataFrame, searches: DataFrame, dims: int, k: int, same: bool, home: bool, bundles: int) -> DataFrame:
    """Send searches to the blocks of their own cell, or to those of all other cells that elimination leaves, and get each block's best k."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in slices(whole, dims)):
            own = b.column("home").to_numpy()
            a, norms, low, high = matrix(b.column("q"), dims), b.column("norm").to_numpy(), nested(b.column("low")), nested(b.column("high"))
            if not low.size:
                continue
            d = root.space.radius(norms[:, None], a @ root.points.T)
            for cell in np.flatnonzero(root.blocks):
                if home:
                    left = (own == cell) & (low <= high).any(1)
                else:
                    left = (own != cell) & root.space.meets(d, norms, low, high, root.low[:, cell], root.high[:, cell])
                some = b.take(pa.array(np.flatnonzero(left)))
                for block in range(root.blocks[cell]):
                    n = some.num_rows
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array([cell] * n, pa.int32()), pa.array([block] * n, pa.int32())], names=[*some.schema.names, "cell", "block"])

    def search(block: pa.Table, some: pa.Table) -> pa.Table:
        if not block.num_rows or not some.num_rows:
            return FOUND.empty_table()
        tree, some = Tree.load(block["tree"][0].as_py()), some.combine_chunks()
        rows = some["anchor"].to_numpy()
        at, score, _ = tree.search(matrix(some["q"], dims), some["norm"].to_numpy(), rows, some["label"].to_numpy(), nested(some["low"]), nested(some["high"]), k, same)
        i, w, place = np.nonzero(at >= 0)
        p = at[i, w, place]
        ids = tree.ids[p]
        return pa.table([rows[i], w.astype(np.int32), tree.rows[p], pa.array(ids, mask=ids == NO_ID), score[i, w, place].astype(np.int64)], schema=FOUND)

    sent = searches.mapInArrow(route, SEARCH + ", cell int, block int").withColumn("bundle", F.pmod(F.xxhash64("anchor"), F.lit(bundles)))
    there = blocks.select("cell", "block", "tree", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bundles - 1).cast("long"))).alias("bundle"))
    keys = ["cell", "block", "bundle"]
    return there.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(search, FOUND_DDL)


def best(found: DataFrame, k: int) -> DataFrame:
    """The best k rows of each anchor and window, by score, then id (nulls last), then row, with their ``place``."""
    w = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def nearest(root: Root, blocks: DataFrame, searches: DataFrame, dims: int, k: int, same: bool, bundles: int) -> DataFrame:
    """The best k rows of each anchor and window, from the own cell first and then, below that bound, from all cells that are left."""
    first = written(best(_visit(root, blocks, searches, dims, k, same, True, bundles), k), "negatives-home")
    bound = first.where(F.col("place") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", F.col("score").cast("double")))).alias("bound"))
    low = F.transform("low", lambda x, i: F.when(F.col("bound").isNull(), x).otherwise(F.greatest(x, F.coalesce(F.col("bound")[i.cast("int")], x))))
    narrowed = searches.join(bound, "anchor", "left").withColumn("low", low).select(searches.columns)
    rest = _visit(root, blocks, narrowed, dims, k, same, False, bundles)
    return best(first.drop("place").unionByName(rest), k)


def hard_negatives(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = SCALE, anchors_every: int = 100, positives: int = 5,
                   negatives: int = 10, lower: int = 30, upper: int = 90, cells: int = 32, block_rows: int = 8192, bundle_rows: int = 2048, fanout: int = 8, leaf: int = 128) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``anchors_every``; scores are inner products of floor(scale * component). An
    anchor's positives are the best rows of its label, its negatives the best ones of other labels whose score is between ``lower`` and ``upper`` percent of the positive's.

    Rows with a null label, a null or empty vector, a null or non-finite component or another dimension than the first row by id take no part.
    A null id is no anchor; in ties it comes last (as would the id 2^63 - 1, returned as null). Repeated rows are rows of their own: equal ids are each
    an anchor, and none is its own positive. Components are held within +-sqrt(2^52 / dimension), so that scores are exact.
    Other columns are not read. A table without usable rows or anchors gives no rows.
    """
    label_col = F.col(label).cast("long")
    some = vectors.where(label_col.isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), label_col.alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    dims, _ = first_rows(some, "vec_id", "v", 1)
    spark = vectors.sparkSession
    if not dims:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = prepared(some, dims, scale)
    root, blocks, placed = plant(rows, dims, cells, block_rows, fanout, leaf)
    anchors = placed.where(F.col("vec_id") % anchors_every == 0).withColumnRenamed("cell", "home").withColumnRenamed("row", "anchor")
    bundles = max(1, -(-anchors.count() // bundle_rows))
    whole = [F.array(F.lit(x)).alias(n) for n, x in (("low", NONE), ("high", -NONE))]
    columns = ["anchor", "label", "q", "norm", "home"]
    found = written(nearest(root, blocks, anchors.select(*columns, *whole), dims, positives, True, bundles), "negatives-positives")
    each = F.array_sort(F.collect_list(F.struct("place", "score")))
    percent = lambda x, p: F.floor(x * p / F.lit(100).cast("decimal(38,0)"))
    bounds = found.groupBy("anchor").agg(each.alias("p")).select(
        "anchor", F.transform("p", lambda x: (-percent(-x["score"].cast("decimal(20,0)"), lower)).cast("double")).alias("low"),
        F.transform("p", lambda x: percent(x["score"].cast("decimal(20,0)"), upper).cast("double")).alias("high"))
    hard = nearest(root, blocks, anchors.select(*columns).join(bounds, "anchor").select(*columns, "low", "high"), dims, negatives, False, bundles)
    of = found.select("anchor", (F.col("place") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = anchors.select("anchor", F.col("vec_id").alias("anchor_id"))
    return (hard.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score", "place": "rank"}).join(of, ["anchor", "window"]).join(named, "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
