"""Selection stability and the review band against plain draws."""

import inspect

import numpy as np
import pytest

from studyloom.functions import scoring as S
from studyloom.operators import audit as A

SHAPE = "run_id {}, staff_id {}, phi double, omega double, psi double, p double"


def plain(rows, samples):
    """Wins by scoring every row under every draw, in the order of ids."""
    wins = {}
    for w in A.weight_draws(S.DEFAULT, samples):
        best = {}
        for run, staff, *x in sorted(rows, key=lambda r: (r[0], r[1])):
            s = 0.0
            for a, b in zip(x, w):
                s += a * b
            if run not in best or s > best[run][0]:
                best[run] = (s, staff)
        for run, (_, staff) in best.items():
            wins[run, staff] = wins.get((run, staff), 0) + 1
    return {k: v / samples for k, v in wins.items()}


@pytest.mark.parametrize("kinds", [("long", "long"), ("string", "string")])
def test_shares_equal_plain_draws(many_blocks, kinds):
    rng = np.random.default_rng(8)
    # half of all rows are one run, which crosses partitions; components on a coarse grid tie
    rows = [(7 if i % 2 else int(rng.integers(0, 60)), i, *(float(x) / 4 for x in rng.integers(0, 5, 4))) for i in range(900)]
    rows += [(3, 5000, .5, .5, .5, .5)] * 2 + [(100, 1, 0., 0., 0., 0.)]
    if kinds[0] == "string":
        rows = [(f"r{r[0]:03d}", f"s{r[1]:05d}", *r[2:]) for r in rows]
    df = many_blocks.createDataFrame(rows, SHAPE.format(*kinds)).repartition(6)
    for values in (1 << 21, 40 * 30):  # whole partitions at once, and runs cut by small blocks
        got = {(r.run_id, r.staff_id): r.stability for r in A.selection_stability(df, 40, values=values).collect()}
        assert got == plain(rows, 40)


def test_reference_case_and_edges(spark):
    rows = [(1, 1, .8, .5, .2, 1.), (1, 2, .5, .5, .9, 0.), (1, 3, .1, .5, .4, 0.)]
    got = {r.staff_id: r.stability for r in A.selection_stability(spark.createDataFrame(rows, SHAPE.format("long", "long")), 500).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and got.get(3, 0) < got[1]
    odd = [(1, 1, None, .5, .2, 1.), (1, 2, 0., 0., 0., 0.), (2, 9, None, None, None, None), (None, 1, 1., 1., 1., 1.), (3, None, 1., 1., 1., 1.)]
    df = spark.createDataFrame(odd, SHAPE.format("long", "long"))
    assert {(r.run_id, r.staff_id): r.stability for r in A.selection_stability(df, 10).collect()} == {(1, 2): 1.0, (2, 9): 1.0}
    assert A.selection_stability(df.where("false"), 10).collect() == []


def test_counts_and_band(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    assert inspect.signature(A.selection_stability).parameters["samples"].default == 2000
    shares = entry.queries()["h05_selection_stability"](spark, sf)
    assert shares.selectExpr("min(stability)").first()[0] < 1 / 400  # finer than 400 draws can be
    assert abs(shares.groupBy("run_id").sum("stability").selectExpr("max(abs(`sum(stability)` - 1))").first()[0]) < 1e-3
    band = entry.queries()["h06_band_calibration"](spark, sf).collect()
    assert len(band) == 8 and 0 < band[0].chosen <= .2
