"""Order changes under moved weights against plain ranks."""

from itertools import combinations

import numpy as np
import pytest

from studyloom.functions import scoring as S
from studyloom.operators import audit as A

SHAPE = "run_id long, cand string, phi double, omega double, psi double, p double"


def plain(rows):
    out = {}
    for i, c in enumerate(A.CRITERIA):
        for d in (0.05, -0.05):
            w, flips, taus = A.perturbed(S.DEFAULT.weights, c, d), [], []
            for run in {r[0] for r in rows}:
                mine = [r for r in rows if r[0] == run]
                if run is None or len(mine) < 2:
                    continue

                def order(weights, clip):
                    def key(r):
                        s = sum((x * y for x, y in zip(r[2:], weights)), 0.0)
                        return (-round(min(1.0, max(0.0, s)) if clip else s, 9), r[1])
                    return [r[1] for r in sorted(mine, key=key)]

                base, new = order([S.DEFAULT.weights[k] for k in A.CRITERIA], True), order(w, False)
                at = {k: n for n, k in enumerate(new)}
                swapped = sum(at[a] > at[b] for a, b in combinations(base, 2))
                flips.append(new[0] != base[0])
                taus.append(1 - 4 * swapped / (len(mine) * (len(mine) - 1)))
            out[c, d] = (sum(flips) / len(flips), sum(taus) / len(taus), len(flips))
    return out


def made():
    rng = np.random.default_rng(4)
    # components on a coarse grid tie; one run has most rows, one a single row, one none
    rows = [(int(rng.choice([5, *range(30)], p=[.4, *[.02] * 30])), f"c{i:04d}", *(float(x) / 4 for x in rng.integers(0, 5, 4))) for i in range(300)]
    return [*rows, (99, "x", .5, .5, .5, .5), (None, "y", .5, .5, .5, .5), (None, "z", .1, .5, .5, .5)]


@pytest.mark.parametrize("pool", [256, 8, 1])
def test_small_and_large_runs_equal_plain_ranks(many_blocks, pool):
    rows, want = made(), None
    before = many_blocks.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    many_blocks.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # runs are cut by batches
    try:
        found = A.weight_sensitivity(many_blocks.createDataFrame(rows, SHAPE).repartition(5), pool=pool).collect()
    finally:
        many_blocks.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = {(r.criterion, r.delta): (r.reversal_rate, r.mean_tau, r.runs) for r in found}
    want = plain(rows)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


def test_small_runs_are_dealt_once(spark, monkeypatch):
    """No run is large, so no candidate is laid out per variant and bit."""
    def never(*_):
        raise AssertionError("candidates are copied per variant")

    monkeypatch.setattr(A, "_variants", never)
    df = spark.createDataFrame(made(), SHAPE)
    assert len(A.weight_sensitivity(df).collect()) == 8 and A.weight_sensitivity(df.where("false")).collect() == []


def test_missing_scores_go_last(spark):
    """Nulls stand behind numbers, and among themselves by id, in both ways of counting."""
    rows = [(1, "a", None, .5, .5, .5), (1, "b", .1, .1, .1, 0.), (1, "c", None, .9, .9, 1.), (1, "d", float("nan"), .2, .2, .2), (2, "a", 1., 1., 1., 1.), (2, "b", None, 0., 0., 0.)]
    df = spark.createDataFrame(rows, SHAPE)
    small, large = ({(r.criterion, r.delta): (r.reversal_rate, r.mean_tau, r.runs) for r in A.weight_sensitivity(df, pool=n).collect()} for n in (256, 1))
    assert len(small) == 8 and set(small) == set(large) and all(small[k] == pytest.approx(large[k]) for k in small)
