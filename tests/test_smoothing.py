"""Estimated smoothing against plain recursions, fixed constants and series with a known answer."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from studyloom.operators import series as S, smoothing as M


def plain(y, alpha, gamma, level, seas):
    """Squared errors and last state of one series, month by month."""
    seas, total = list(seas), 0.0
    for i, v in enumerate(y):
        k = i % len(seas)
        e = v - level - seas[k]
        total += e * e
        level, seas[k] = level + alpha * e, seas[k] + gamma * e
    return total, level, seas


def month(i):
    return dt.date(2000 + i // 12, i % 12 + 1, 1)


def test_linear_part_equals_the_recursion():
    rng = np.random.default_rng(1)
    y = rng.normal(10, 3, (4, 40))
    alpha, gamma = rng.random(4) * .6, rng.random(4) * .4
    e, level, seas = M.errors(y, np.ones_like(y), alpha, gamma, 12)
    start, first = 7.0, rng.normal(size=12)
    x = np.array([1, start, *first])
    for i in range(4):
        total, l, s = plain(y[i], alpha[i], gamma[i], start, first)
        assert abs(((e[i] @ x) ** 2).sum() - total) < 1e-8 and abs(level[i] @ x - l) < 1e-9 and np.allclose(x @ seas[i], s)


def test_initial_state_is_the_best_one():
    rng = np.random.default_rng(2)
    y = rng.poisson(8, (3, 36)).astype(float)
    alpha, gamma = np.array([.2, .5, 0.]), np.array([.1, .4, 0.])
    sse, level, seas = M.best_state(y, np.ones_like(y), alpha, gamma, 12)
    for i in range(3):
        for _ in range(50):  # no other start is better
            assert plain(y[i], alpha[i], gamma[i], rng.normal(8, 2), rng.normal(0, 2, 12))[0] > sse[i]
    # without movement the season is the month's mean
    assert np.allclose(level[2] + seas[2], y[2].reshape(3, 12).mean(0), atol=1e-4)


def test_series_with_known_answers():
    season = np.array([3., 1, -2, 0, 5, -4, 2, -1, 0, 1, -3, -2])
    exact = 20 + np.tile(season, 4)
    step = np.concatenate([np.full(24, 5.), np.full(24, 15.)])
    got = M.estimate(np.stack([exact, exact * 0 + 7, step + np.tile(season, 4)]), np.ones((3, 48)), 12)
    assert got["sse"][0] < 1e-6 and np.allclose(got["level"][0] + got["seasons"][0], 20 + season, atol=1e-4)
    assert got["sse"][1] < 1e-6 and (got["alpha"][:2] == 0).all() and (got["gamma"][:2] == 0).all()  # nothing moves
    # the level follows a jump at once; the true seasons would leave the jump's square as the only error, the best ones share it out
    assert got["alpha"][2] > .8 and got["sse"][2] <= plain(step + np.tile(season, 4), 1, 0, 5, season)[0] == 100
    # a level alone: a random walk keeps the last value, noise the mean
    rng = np.random.default_rng(3)
    walk, noise = np.cumsum(rng.normal(size=400)), rng.normal(50, 1, 400)
    alone = M.estimate(np.stack([walk, noise]), np.ones((2, 400)), 0)
    assert alone["alpha"][0] > .85 and alone["alpha"][1] < .1 and abs(alone["level"][1] - 50) < .4


def test_never_worse_than_fixed_constants_or_random_search():
    rng = np.random.default_rng(4)
    y = rng.poisson(12 + 4 * np.sin(np.arange(60) / 12 * 2 * np.pi), (20, 60)).astype(float)
    got = M.estimate(y, np.ones_like(y), 12)
    assert (got["alpha"] + got["gamma"] <= 1 + 1e-9).all() and (got["gamma"] >= 0).all()
    for i in range(20):
        assert got["sse"][i] <= plain(y[i], .3, .2 * .7, y[i].mean(), [0.0] * 12)[0]
    for _ in range(60):
        a = rng.random(20)
        c = rng.random(20) * (1 - a)
        assert (got["sse"] <= M.best_state(y, np.ones_like(y), a, c, 12)[0] * (1 + 1e-6)).all()


def test_forecast_rows(spark):
    season = [3, 1, -2, 0, 5, -4, 2, -1, 0, 1, -3, -2]
    rows = [("long", month(i), 20 + season[i % 12]) for i in range(3, 43)] + [("short", month(i), 4) for i in range(7)] + [("one", month(5), 9), (None, month(1), 2)]
    rows += [("falls", month(i), max(0, 30 - i)) for i in range(60)]
    train = spark.createDataFrame(rows, "k string, month date, n long").repartition(3)
    future = S.future_months(train, ["k"], 14)
    got = {(r.k, r.month): r.yhat for r in M.smoothed_forecast(train, future.where("k is not null"), ["k"]).collect()}
    assert len(got) == 4 * 14
    for i in range(43, 57):
        assert abs(got["long", month(i)] - (20 + season[i % 12])) < 1e-3
    assert all(abs(v - {"short": 4, "one": 9}[k]) < 1e-6 for (k, _), v in got.items() if k in ("short", "one")) and min(got.values()) >= 0
    fit = {r.k: r for r in M.smoothing_fit(train, ["k"]).collect()}
    assert len(fit) == 5 and len(fit["short"].seasons) == 1 and len(fit["long"].seasons) == 12 and fit["long"].sse < 1e-6
    # blocks and padding don't matter
    alone = M.smoothing_fit(train.where("k = 'falls'"), ["k"]).first()
    assert abs(alone.sse - fit["falls"].sse) < 1e-6 and abs(alone.alpha - fit["falls"].alpha) < 1e-9
    assert M.smoothed_forecast(train.where("false"), future, ["k"]).collect() == []


def test_query_beats_the_fixed_constants(spark):
    from studyloom.plans.series_q import series
    from studyloom.session import Tables

    s = series(Tables(spark, "/root/testdata/sf0.001")).cache()
    fit = {r.priority: r for r in M.smoothing_fit(s, ["priority"]).collect()}
    ordered = {r.priority: [x.n for x in r.a] for r in s.groupBy("priority").agg(F.sort_array(F.collect_list(F.struct("month", "n"))).alias("a")).collect()}
    assert len(fit) == len(ordered) > 1
    for k, y in ordered.items():
        assert fit[k].sse <= plain(y, .3, .14, np.mean(y), [0.0] * 12)[0]
