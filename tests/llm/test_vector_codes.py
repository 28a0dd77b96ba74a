"""Equal-average search, rounds and codes against plain search."""

import hashlib
import math
import random

import numpy as np

from studyloom.llm import vector_codes as V

INF, NAN = float("inf"), float("nan")


def test_nearest_is_exact_and_skips_entries():
    rng = np.random.default_rng(2)
    for width, entries, spread in ((8, 16, 40), (1, 5, 3), (3, 16, 2), (8, 1, 9), (16, 200, 500)):
        e, x = rng.integers(-spread, spread + 1, (entries, width)), rng.integers(-spread, spread + 1, (400, width))
        e[entries // 2] = e[0]  # equal entries: the lower index
        index, distance, looked = V.nearest(x, e)
        d = ((x[:, None] - e[None]) ** 2).sum(2)
        assert (index == d.argmin(1)).all() and (distance == d.min(1)).all()
    assert looked < 400 * 200
    clustered = np.repeat(np.arange(16)[:, None] * 100, 8, 1)
    assert V.nearest(clustered[rng.integers(0, 16, 500)] + rng.integers(-3, 4, (500, 8)), clustered)[2] == 500  # every other sum is too far
    # a gap that only equals the bound must be looked at: both entries are at distance 2, the second by its sum
    assert V.nearest(np.array([[0, 0]]), np.array([[1, 1], [1, -1]]))[0][0] == 0


def plain(rows, parts=8, k=16, rounds=6):
    """(vec_id, code, error, label) and the books, by Python integers alone."""
    kept = sorted((i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v))
    dims = len(kept[0][1])
    cut = V.edges(dims, parts)
    books = [[q[a:b] for _, q, _ in kept[:k]] for a, b in zip(cut, cut[1:])]

    def assign():
        out = []
        for _, q, _ in kept:
            best = []
            for p, book in enumerate(books):
                x = q[cut[p]:cut[p + 1]]
                best.append(min((sum((u - w) ** 2 for u, w in zip(x, e)), j) for j, e in enumerate(book)))
            out.append(best)
        return out

    for _ in range(rounds):
        found = assign()
        for p, book in enumerate(books):
            for j in range(len(book)):
                own = [q[cut[p]:cut[p + 1]] for (_, q, _), b in zip(kept, found) if b[p][1] == j]
                if own:
                    book[j] = [sum(c) // len(own) for c in zip(*own)]
    return [(i, "".join(f"{j:02x}" for _, j in b), sum(d for d, _ in b), lab) for (i, _, lab), b in zip(kept, assign())], books


def test_rows_against_plain(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)], rng.choice([None, 1, 2])) for i in range(120)]
    rows += [(200 + i, rows[3][1], 3) for i in range(60)]  # copies
    odd = [(300, None, 1), (301, [None] * 16, 1), (302, [NAN] * 16, 1), (303, [INF] + [0.0] * 15, 1), (-5, [], 1)]
    df = spark.createDataFrame([(*r, 9, "x") for r in rows + odd], "vec_id long, embedding array<float>, label int, code int, label_error string").repartition(5)
    want, books = plain([(i, np.float32(v).tolist(), lab) for i, v, lab in rows])
    got = V.vector_codes(df).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in got) == sorted(w[:3] for w in want)
    totals = {}
    for w in want:
        totals[w[3]] = totals.get(w[3], 0) + w[2]
    assert all(r.label_error == totals[r.label] for r in got)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()}


def test_edge_tables(spark):
    shape = "vec_id long, embedding array<double>, label string"
    assert V.vector_codes(spark.createDataFrame([], shape)).collect() == []
    assert V.vector_codes(spark.createDataFrame([(1, None, "a"), (2, [NAN], "a"), (3, [], None)], shape)).collect() == []
    # fewer rows than entries, another dimension, a null id, repeated rows and ids, components beyond the bound, parts of unequal width
    rows = [(7, [1.0] * 11, "a"), (7, [1.0] * 11, "a"), (7, [2.0] * 11, None), (None, [3.0] * 11, "b"), (8, [1.0] * 12, "a"), (9, [1e30] * 11, "b")]
    got = sorted(V.vector_codes(spark.createDataFrame(rows, shape)).collect(), key=lambda r: (str(r.vec_id), r.code))
    assert [r.vec_id for r in got] == [7, 7, 7, 9, None] and all(r.error == 0 == r.label_error for r in got)
    assert len({r.code for r in got if r.vec_id == 7}) == 2


def test_labels_beyond_the_heavy_ones(spark):
    rows = [(i, [float(i % 3)] * 8, 0 if i % 3 == 0 else i) for i in range(4000)]
    got = V.vector_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), entries=1)
    want = {}
    for r in got.collect():
        want.setdefault(r.label, []).append((r.error, r.label_error))
    assert len(want) > 2000 and all({t for _, t in v} == {sum(e for e, _ in v)} for v in want.values())
