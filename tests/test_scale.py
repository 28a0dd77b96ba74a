import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from studyloom import scale as S


def _frame(n=400, seed=3):
    rng = np.random.default_rng(seed)
    # one key holds most rows
    key = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c", "d"], n))
    return pd.DataFrame({"k": key, "o": rng.permutation(n), "v": rng.integers(0, 50, n), "m": np.where(rng.random(n) < 0.3, np.nan, rng.integers(0, 9, n))})


def test_running_matches_pandas_across_blocks(many_blocks):
    pdf = _frame()
    df = many_blocks.createDataFrame(pdf).withColumn("m", F.when(~F.isnan("m"), F.col("m")))
    order = [F.col("o")]
    blocks = S.ordered_blocks(df, ["k"], order)
    assert blocks.where("k = 'hot'").select(S.BLOCK).distinct().count() > 2
    got = S.running(blocks, ["k"], order, rn=("rows",), total=("sum", F.col("v")), top=("max", F.col("v")), reach=("max_before", F.col("v")),
                    seen=("last", F.col("m")), prev=("lag", F.col("v")), nxt=("lead", F.col("v"))).toPandas().sort_values(["k", "o"]).reset_index(drop=True)
    want = pdf.sort_values(["k", "o"]).reset_index(drop=True)
    g = want.groupby("k")
    want["rn"], want["total"], want["top"] = g.cumcount() + 1, g["v"].cumsum(), g["v"].cummax()
    want["reach"] = g["top"].shift(1) if "top" in want else None
    want["reach"] = want.groupby("k")["top"].shift(1)
    want["seen"] = want.groupby("k")["m"].ffill()
    want["prev"], want["nxt"] = g["v"].shift(1), g["v"].shift(-1)
    for c in ("rn", "total", "top", "reach", "seen", "prev", "nxt"):
        np.testing.assert_array_equal(got[c].astype(float).to_numpy(), want[c].astype(float).to_numpy(), err_msg=c)


def test_running_without_keys(many_blocks):
    pdf = _frame(120, 5)
    got = S.running_over(many_blocks.createDataFrame(pdf[["o", "v"]]), [], [F.col("o").desc()], rn=("rows",), total=("sum", F.col("v"))).toPandas().sort_values("o", ascending=False)
    want = pdf.sort_values("o", ascending=False)
    assert got["rn"].tolist() == list(range(1, 121))
    assert got["total"].tolist() == want["v"].cumsum().tolist()


def test_average_ranks_and_quantiles(many_blocks):
    pdf = _frame(300, 9)
    df = many_blocks.createDataFrame(pdf[["k", "v"]])
    r = S.average_ranks(df, ["k"], "v").toPandas()
    pdf["r"] = pdf.groupby("k")["v"].rank()
    want = pdf.groupby(["k", "v"])["r"].first()
    for row in r.itertuples():
        assert want[(row.k, row.v)] == row.avg_rank
    q = S.exact_quantiles(df, ["k"], "v", {"p01": 0.01, "p50": 0.5, "p90": 0.9}).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        np.testing.assert_allclose(q.loc[k, ["p01", "p50", "p90"]].astype(float), g["v"].quantile([0.01, 0.5, 0.9]))


def test_halo_gives_every_bucket_its_neighbours(spark):
    pdf = pd.DataFrame({"t": np.arange(0, 100, 1.0)})
    out = S.with_halo(spark.createDataFrame(pdf), "t", 10, 3, 2).toPandas()
    assert out[out.is_core].shape[0] == 100
    for b, g in out.groupby("bucket"):
        lo, hi = b * 10, (b + 1) * 10
        need = {t for t in pdf.t if lo - 3 <= t <= hi + 2}
        assert need <= set(g.t)


def test_bounded_and_gate(spark):
    assert S.bounded(spark.range(5), 5) and not S.bounded(spark.range(6), 5)
    try:
        S.require_empty(spark.range(1), "found")
    except ValueError as e:
        assert "found" in str(e)
    else:
        raise AssertionError


def test_null_keys_are_a_group_at_every_size(many_blocks):
    """One block and many give the same running values, ranks and quantiles, a null key included."""
    spark = many_blocks
    rows = [(None if i % 3 else f"k{i % 4}", i, float(i % 7)) for i in range(400)]
    got = []
    for parts in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        df = spark.createDataFrame(rows, "k string, i long, v double")
        run = S.running_over(df, ["k"], [F.col("i")], n=("rows",), total=("sum", F.col("v")), before=("lag", F.col("i")), after=("lead", F.col("i")))
        got.append((sorted(map(str, run.collect())), sorted(map(str, S.average_ranks(df, ["k"], "v").collect())), sorted(map(str, S.exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got[0] == got[1]
    assert run.where("k is null").agg(F.max("n")).first()[0] == sum(r[0] is None for r in rows)


def test_null_keys_repeat_and_keep_their_months(spark):
    import datetime as dt

    from studyloom.operators import series

    df = spark.createDataFrame([(None, dt.date(2024, 1, 5)), (None, dt.date(2024, 3, 1)), ("a", dt.date(2024, 2, 1))], "k string, d date")
    assert sorted(r.is_repeated for r in series.repeated(df, ["k"]).collect()) == [False, True, True]
    assert {(r.k, r.month.month): r.n for r in series.monthly(df, "d", ["k"]).collect()} == {(None, 1): 1, (None, 2): 0, (None, 3): 1, ("a", 2): 1}
