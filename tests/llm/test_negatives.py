"""The hyperplane tree and the mined negatives against all pairs."""

import random

import numpy as np

from studyloom.llm import negatives as N

NAN = float("nan")


def space_of(x):
    return N.Space(float((x ** 2).sum(1).max()))


def test_tree_search_is_exact_and_eliminates():
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 201, (20, 16))
    x = (centres[rng.integers(0, 20, 3000)] + rng.integers(-8, 9, (3000, 16))).astype(float)
    x[500:900] = x[0]  # copies
    labels, ids, rows, norms = rng.integers(0, 4, 3000), rng.permutation(3000), np.arange(3000), (x ** 2).sum(1)
    tree = N.Tree.load(N.Tree(x, norms, ids, rows, labels, space_of(x), fanout=6, leaf=32).dump())
    a = np.arange(0, 3000, 60)
    s = x[a] @ x.T
    low = np.column_stack([np.full(len(a), N.NONE), np.ceil(.2 * norms[a]), np.ceil(.9 * norms[a])])
    high = np.column_stack([np.full(len(a), -N.NONE), np.floor(.7 * norms[a]), np.floor(.8 * norms[a])])
    for same in (True, False):
        at, score, seen = tree.search(x[a], norms[a], rows[a], labels[a], low, high, 7, same)
        for i, r in enumerate(a):
            for w in range(3):
                fits = [(-s[i, j], ids[j]) for j in range(3000) if j != r and (labels[j] == labels[r]) == same and low[i, w] <= s[i, j] <= high[i, w]]
                assert [(-v, tree.ids[p]) for v, p in zip(score[i, w], at[i, w]) if p >= 0] == sorted(fits)[:7]
        assert seen["scored"] < .8 * len(a) * 3000 and seen["eliminated"] > 0
    near = tree.search(x[a], norms[a], rows[a], labels[a], np.ceil(.9 * norms[a])[:, None], norms[a][:, None] * 2, 7, True)[2]
    assert near["scored"] < .4 * len(a) * 3000


def plain(rows, every=100, k=5, n=10):
    kept = [(r, i, lab, [int(np.floor(256 * x)) for x in v]) for r, (i, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for r, i, lab, q in kept:
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(q, o[3])), o[1], o[2] == lab) for o in kept if o[0] != r]
        for ps, pid, _ in sorted((s for s in scored if s[2]), key=key)[:k]:
            hard = sorted((s for s in scored if not s[2] and 30 * ps <= 100 * s[0] <= 90 * ps), key=key)[:n]
            out += [(i, pid, rank, nid, ps, ns) for rank, (ns, nid, _) in enumerate(hard, 1)]
    return out


def made(seed, n, dims=12, labels=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    return [(i * 10, [float(np.float32(c + rng.gauss(0, .4))) for c in rng.choice(centres)], rng.randrange(labels)) for i in range(n)]


def sort(rows):
    return sorted(map(tuple, rows), key=str)


def test_negatives_against_all_pairs(spark):
    rows = made(3, 400)
    rows += [(5000 + i, rows[10][1], i % 3) for i in range(150)]  # copies with ties, anchors among them
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, row string, score int").repartition(4)
    want = plain(rows)
    assert len(want) > 1000
    # one cell and block, and many small ones with several bundles
    assert sort(N.hard_negatives(df).collect()) == sort(want)
    assert sort(N.hard_negatives(df, cells=5, block_rows=40, bundle_rows=7, fanout=3, leaf=8).collect()) == sort(want)


def test_rows(spark):
    shape = "vec_id long, embedding array<double>, label int"
    assert N.hard_negatives(spark.createDataFrame([], shape)).collect() == []
    odd = [(100, None, 1), (200, [NAN, 1.0], 1), (300, [1.0, None], 1), (400, [1.0, 2.0], None), (500, [], 1), (600, [1.0] * 3, 1)]
    assert N.hard_negatives(spark.createDataFrame(odd, shape)).collect() == []
    # null ids, repeated rows and ids, another dimension, a zero and a negative score, an anchor without positives
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (None, [1.0, 0.1], 1), (3, [0.5, 0.1], 2), (None, [0.6, 0.0], 2), (4, [0.5, 0.1], 2), (5, [-1.0, 0.0], 1), (6, [0.0, 1.0], 1), (7, [0.0, -1.0], 3), (100, [2.0, 0.0], 9), (8, [0.0], 1)]
    df = spark.createDataFrame(rows, shape)
    want = plain([r for r in rows if len(r[1]) == 2])
    assert want and sort(N.hard_negatives(df).collect()) == sort(want)
    assert N.hard_negatives(df.where("vec_id = 3")).collect() == []
