"""k-means and Gaussian mixtures from many starts (inventory M02-M05).

All starts, of all numbers of clusters, move in the same passes over the data: a task scores its rows against every set of centres as one
matrix and returns sums only, as many numbers as the sets have, whatever it has read. Sets that have converged leave the passes. The driver holds the centres.
Rows draw from hashes of their ids, so a rerun of a lost task draws the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .audit import draw_hashes

#: Numbers that a task holds at a time in one of its matrices.
VALUES = 1 << 21


def points(df: DataFrame, ident: str | None, columns: list[str]) -> DataFrame:
    """Hash of the id (of the row itself without one) and the columns as one array, pinned; rows with a missing or non-finite value take no part."""
    checkpoint_dir(df.sparkSession)
    v = F.array(*[F.col(c).cast("double") for c in columns])
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.xxhash64(*([ident] if ident else columns)).alias("h"), v.alias("v")).where(fine).checkpoint()


def _parts(batches: Iterator[pa.RecordBatch], width: int, a_row: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = max(1, VALUES // max(1, a_row))
    for b in batches:
        h, x = b.column("h").to_numpy(), b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        for i in range(0, len(h), step):
            yield h[i:i + step], x[i:i + step]


def summed(x: DataFrame, width: int, a_row: int, shape: tuple, work: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """Totals over all rows: ``work(total, hashes, rows)`` adds a task's rows to its own array of this shape. ``a_row``: numbers that work holds for a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for h, rows in _parts(batches, width, a_row):
            work(total, h, rows)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["i", "s"])

    out = np.zeros(math.prod(shape))
    found = x.mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).toPandas()
    out[found["i"].to_numpy(np.int64)] = found["s"].to_numpy()
    return out.reshape(shape)


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """[row, set, centre] squared distances; infinite to a centre that isn't there."""
    s, k, d = centres.shape
    flat = centres.reshape(-1, d)
    there = ~np.isnan(flat[:, 0])
    flat = np.where(there[:, None], flat, 0.0)
    out = np.maximum((x ** 2).sum(1)[:, None] - 2 * x @ flat.T + (flat ** 2).sum(1), 0)
    out[:, ~there] = np.inf
    return out.reshape(len(x), s, k)


class Subsamples:
    """Rows that take part in each set: set i has subsample ``of[i]``, an independent share of the rows drawn by hash; -1 is all rows."""

    def __init__(self, of: np.ndarray, share: float, seed: int):
        self.of, self.share, self.seed = of, share, seed

    def taken(self, h: np.ndarray) -> np.ndarray:
        """[row, subsample]"""
        u = (draw_hashes(h, int(self.of.max()) + 1, self.seed) >> np.uint64(11)) / 2.0**53
        return u < self.share

    def mask(self, h: np.ndarray, sets: np.ndarray) -> np.ndarray | None:
        of = self.of[sets]
        if (of < 0).all():
            return None
        return np.where(of >= 0, self.taken(h)[:, np.maximum(of, 0)], True)


def seeds(x: DataFrame, width: int, ks: np.ndarray, seed: int, subsamples: Subsamples) -> np.ndarray:
    """First centres [set, centre, column] by k-means++: each next one is drawn in proportion to the squared distance to those before, over all rows.

    A Gumbel number per row and set turns the weighted draw into a maximum, so one pass draws a centre for every set. Sets that run out of different rows have fewer.
    """
    n, sets = len(ks), np.arange(len(ks))
    centres = np.full((n, int(ks.max()), width), np.nan)
    for place in range(int(ks.max())):
        def draw(batches: Iterator[pa.RecordBatch], place=place, centres=centres.copy()) -> Iterator[pa.RecordBatch]:
            best, row = np.full(n, -np.inf), np.zeros((n, width))
            for h, v in _parts(batches, width, n * (place + 3)):
                u = ((draw_hashes(h, n, seed * 1009 + place) >> np.uint64(11)) + 0.5) / 2.0**53
                key = -np.log(-np.log(u))
                if place:
                    with np.errstate(divide="ignore"):
                        key += np.log(squared(v, centres[:, :place]).min(2))
                if (mask := subsamples.mask(h, sets)) is not None:
                    key = np.where(mask, key, -np.inf)
                at = key.argmax(0)
                better = key[at, sets] > best
                best[better], row[better] = key[at, sets][better], v[at[better]]
            hit = np.flatnonzero(best > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(best[hit]), pa.array(list(row[hit]), pa.list_(pa.float64()))], names=["i", "key", "v"])

        found = x.mapInArrow(draw, "i long, key double, v array<double>").groupBy("i").agg(F.max(F.struct("key", "v"))["v"].alias("v")).collect()
        for r in found:
            if place < ks[r["i"]]:
                centres[r["i"], place] = r["v"]
    return centres


def lloyd(x: DataFrame, width: int, centres: np.ndarray, subsamples: Subsamples, tolerance: float, most: int = 300) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Move all sets until their centres' summed squared shift is at most the tolerance. Returns centres, inertia and sizes [set, cluster], which belong together."""
    n, k, _ = centres.shape
    centres, inertia, sizes, active = centres.copy(), np.full(n, np.nan), np.zeros((n, k)), np.arange(n)
    for round_ in range(most + 1):
        now, here = centres[active], active

        def work(total: np.ndarray, h: np.ndarray, v: np.ndarray, now=now, here=here) -> None:
            d = squared(v, now)
            label, near = d.argmin(2), d.min(2)
            weight = np.isfinite(near).astype(float)
            if (mask := subsamples.mask(h, here)) is not None:
                weight *= mask
            code = (label + k * np.arange(len(here))).ravel()
            flat = total.reshape(-1, width + 2)
            add = lambda w: np.bincount(code, w, minlength=len(flat))
            flat[:, 0] += add(weight.ravel())
            flat[:, 1] += add((np.where(weight > 0, near, 0.0)).ravel())
            for c in range(width):
                flat[:, 2 + c] += add((weight * v[:, c:c + 1]).ravel())

        total = summed(x, width, 4 * k * len(active), (len(active), k, width + 2), work)
        sizes[active], inertia[active] = total[:, :, 0], total[:, :, 1].sum(1)
        if round_ == most:
            break
        with np.errstate(invalid="ignore", divide="ignore"):
            new = np.where(total[:, :, :1] > 0, total[:, :, 2:] / total[:, :, :1], now)
        moved = np.nansum((new - now) ** 2, (1, 2)) > tolerance
        centres[active[moved]] = new[moved]
        active = active[moved]
        if not len(active):
            break
    return centres, inertia, sizes


def spread(x: DataFrame, width: int) -> tuple[float, int]:
    """Mean variance of the columns, and the number of rows."""
    def work(total, h, v):
        total[0, 0] += len(v)
        total[1] += v.sum(0)
        total[2] += (v ** 2).sum(0)

    t = summed(x, width, width, (3, width), work)
    n = t[0, 0]
    return (float(np.mean(np.maximum(0, t[2] / n - (t[1] / n) ** 2))) if n else 0.0), int(n)


class Fit:
    """One set of centres with its inertia and cluster sizes."""

    def __init__(self, centres: np.ndarray, inertia: float, sizes: np.ndarray):
        there = ~np.isnan(centres[:, 0])
        self.centres, self.inertia, self.sizes = centres[there], float(inertia), sizes[there].astype(int)


def kmeans_table(x: DataFrame, width: int, ks: tuple[int, ...], starts: int, seed: int = 7) -> dict[int, Fit]:
    """The best of ``starts`` fits for each number of clusters; the winner is moved on until nothing changes."""
    of = np.repeat(ks, starts)
    everybody = Subsamples(np.full(len(of), -1), 1.0, seed)
    variance, n = spread(x, width)
    if not n:
        return {}
    moved, inertia, _ = lloyd(x, width, seeds(x, width, of, seed, everybody), everybody, 1e-4 * variance)
    best = np.array([i + np.argmin(inertia[i:i + starts]) for i in range(0, len(of), starts)])
    centres, inertia, sizes = lloyd(x, width, moved[best], everybody, 1e-14 * variance)
    return {k: Fit(centres[i], inertia[i], sizes[i]) for i, k in enumerate(ks)}


def labelled(df: DataFrame, columns: list[str], fit: Fit, name: str) -> DataFrame:
    """Add each row's nearest centre (the lower number in ties), null where a value is missing."""
    v = [F.col(c).cast("double") for c in columns]
    d = F.array(*[sum(((a - F.lit(float(b))) ** 2 for a, b in zip(v, c)), F.lit(0.0)) for c in fit.centres])
    whole = ~F.coalesce(*[F.when(a.isNull() | F.isnan(a), F.lit(True)) for a in v], F.lit(False))
    return df.withColumn("_d", d).withColumn(name, F.when(whole, F.array_position("_d", F.array_min("_d")) - 1).cast("int")).drop("_d")


def subsample_agreement(x: DataFrame, width: int, full: Fit, repeats: int, share: float, starts: int, seed: int = 7) -> np.ndarray:
    """[repeat, full label, refit label] counts: refits of as many clusters on independent subsamples, each the best of ``starts``, against the full fit's labels.

    All starts of all repeats move together.
    """
    k = len(full.centres)
    variance, _ = spread(x, width)
    subsamples = Subsamples(np.repeat(np.arange(repeats), starts), share, seed)
    moved, inertia, _ = lloyd(x, width, seeds(x, width, np.full(repeats * starts, k), seed, subsamples), subsamples, 1e-4 * variance)
    best = moved[[b * starts + int(np.argmin(inertia[b * starts:(b + 1) * starts])) for b in range(repeats)]]

    def work(total: np.ndarray, h: np.ndarray, v: np.ndarray) -> None:
        whole, part = squared(v, full.centres[None]).argmin(2), squared(v, best).argmin(2)
        code = (np.arange(repeats) * k + whole) * k + part
        total += np.bincount(code.ravel(), subsamples.taken(h).ravel().astype(float), minlength=total.size).reshape(total.shape)

    return summed(x, width, 3 * repeats * k, (repeats, k, k), work).astype(int)


class Mixture:
    """Sets of Gaussian mixtures: weights [set, part], means [set, part, column], covariances [set, part, column, column]; absent parts weigh 0."""

    def __init__(self, weights: np.ndarray, means: np.ndarray, covs: np.ndarray):
        self.weights, self.means, self.covs = weights, means, covs
        self.roots = np.linalg.inv(np.linalg.cholesky(covs))
        self.bias = np.log(np.maximum(weights, 1e-300)) + np.log(np.diagonal(self.roots, axis1=2, axis2=3)).sum(2) - means.shape[2] / 2 * math.log(2 * math.pi)

    def only(self, sets) -> Mixture:
        return Mixture(self.weights[sets], self.means[sets], self.covs[sets])

    def log_joint(self, v: np.ndarray) -> np.ndarray:
        """[row, set, part]"""
        s, k, d = self.means.shape
        roots = self.roots.reshape(-1, d, d)
        y = np.einsum("nd,qed->nqe", v, roots) - np.einsum("qd,qed->qe", self.means.reshape(-1, d), roots)
        out = self.bias - 0.5 * (y ** 2).sum(2).reshape(len(v), s, k)
        return np.where(self.weights > 0, out, -np.inf)

    @classmethod
    def of_sums(cls, total: np.ndarray, diagonal: np.ndarray, ridge: float) -> Mixture:
        """From [set, part, 1 + d + d * d] sums of responsibilities, rows and products."""
        d = int((math.sqrt(4 * total.shape[2] - 3) - 1) / 2)
        n = total[:, :, 0]
        safe = np.maximum(n, 1e-12)[:, :, None]
        means = total[:, :, 1:1 + d] / safe
        covs = (total[:, :, 1 + d:] / safe).reshape(*n.shape, d, d) - means[..., :, None] * means[..., None, :]
        covs = np.where(diagonal[:, None, None, None], covs * np.eye(d), covs)
        covs = np.where((n > 1e-9)[..., None, None], covs, np.eye(d)) + ridge * np.eye(d)
        return cls(n / np.maximum(n.sum(1, keepdims=True), 1e-12), means, covs)


def _responsible(joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Responsibilities and the rows' log likelihoods."""
    top = joint.max(2, keepdims=True)
    r = np.exp(joint - top)
    total = r.sum(2, keepdims=True)
    return r / total, (top + np.log(total))[:, :, 0]


def _moments(total: np.ndarray, r: np.ndarray, v: np.ndarray) -> None:
    s, k, width = total.shape
    flat, r = total.reshape(s * k, width), r.reshape(len(v), -1)
    flat += np.concatenate([r.sum(0)[:, None], r.T @ v, r.T @ (v[:, :, None] * v[:, None, :]).reshape(len(v), -1)], 1)


def mixture_table(x: DataFrame, width: int, ks: tuple[int, ...], kinds: tuple[str, ...] = ("full", "diagonal"), starts: int = 20, seed: int = 7, tolerance: float = 1e-3, most: int = 1000,
                  ridge: float = 1e-6) -> list[dict]:
    """The likeliest of ``starts`` mixtures per number of parts and kind of covariance, with log likelihood, relative entropy and mean top posterior.

    Starts are k-means fits from k-means++ centres, one for each mixture. Mixtures move until the mean log likelihood gains less than the tolerance.
    """
    cases = [(k, kind) for k in ks for kind in kinds]
    per = [1 if k == 1 else starts for k, _ in cases]  # one part has one solution
    of, diagonal = np.repeat([k for k, _ in cases], per), np.repeat([kind == "diagonal" for _, kind in cases], per)
    everybody = Subsamples(np.full(len(of), -1), 1.0, seed)
    variance, n = spread(x, width)
    if not n:
        return []
    centres, _, _ = lloyd(x, width, seeds(x, width, of, seed, everybody), everybody, 1e-4 * variance)
    k_max, size = int(of.max()), 1 + width + width * width

    def hard(total, h, v):
        d = squared(v, centres)
        _moments(total, (np.arange(k_max) == d.argmin(2)[:, :, None]).astype(float), v)

    model = Mixture.of_sums(summed(x, width, len(of) * k_max * (width + 2), (len(of), k_max, size), hard), diagonal, ridge)
    likely, before, converged, active = np.full(len(of), -np.inf), np.full(len(of), -np.inf), np.zeros(len(of), bool), np.arange(len(of))
    for round_ in range(most):
        now = model.only(active)

        def step(total, h, v, now=now):
            r, ll = _responsible(now.log_joint(v))
            _moments(total[:, :, :-1], r, v)
            total[:, 0, -1] += ll.sum(0)

        total = summed(x, width, len(active) * k_max * (2 * width + 2), (len(active), k_max, size + 1), step)
        likely[active] = total[:, 0, -1]
        done = np.abs(likely[active] - before[active]) < tolerance * n if round_ else np.zeros(len(active), bool)
        before[active] = likely[active]
        converged[active[done]] = True
        go = ~done
        if not go.any():
            break
        new = Mixture.of_sums(total[go][:, :, :-1], diagonal[active[go]], ridge)
        active = active[go]
        for mine, its in ((model.weights, new.weights), (model.means, new.means), (model.covs, new.covs)):
            mine[active] = its
    edges = np.concatenate([[0], np.cumsum(per)])
    best = np.array([a + int(np.argmax(likely[a:b])) for a, b in zip(edges, edges[1:])])
    chosen = model.only(best)

    def quality(total, h, v):
        r, ll = _responsible(chosen.log_joint(v))
        total[:, 0] += ll.sum(0)
        total[:, 1] -= (r * np.log(np.maximum(r, 1e-300))).sum((0, 2))
        total[:, 2] += r.max(2).sum(0)

    q = summed(x, width, len(best) * k_max * (2 * width + 2), (len(best), 3), quality)
    out = []
    for i, (k, kind) in enumerate(cases):
        free = k - 1 + k * width + (k * width if kind == "diagonal" else k * width * (width + 1) // 2)
        ll = float(q[i, 0])
        out.append({"k": k, "covariance": kind, "log_likelihood": ll, "aic": 2 * free - 2 * ll, "bic": free * math.log(n) - 2 * ll, "entropy": 1.0 if k == 1 else 1 - float(q[i, 1]) / (n * math.log(k)),
                    "top_posterior": float(q[i, 2]) / n, "converged": bool(converged[best[i]])})
    return out
