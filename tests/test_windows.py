"""Moments, order statistics and blocked scans against plain computations."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.functions.moments import Moment, moments
from barline.operators import clean, features, order_statistics, passes, rolling, scan
from barline.operators.order_statistics import SortedBlocks, Statistic

START = dt.date(2020, 1, 1)


def series(spark, *columns, symbol="x"):
    rows = [(symbol, START + dt.timedelta(days=i), *[None if v is None or v != v else float(v) for v in vs]) for i, vs in enumerate(zip(*columns, strict=True))]
    names = [f"c{k} double" for k in range(len(columns))]
    return spark.createDataFrame(rows, ", ".join(["symbol string", "d date", *names]))


def column(df, name):
    return np.array([np.nan if r[0] is None else r[0] for r in df.orderBy("symbol", "d").select(name).collect()], float)


@pytest.fixture(scope="module")
def gappy():
    draw = np.random.default_rng(7)
    x = 100 * np.exp(np.cumsum(draw.normal(0, 0.02, 400)))
    x[draw.random(400) < 0.1] = np.nan
    x[50:90] = x[49] if x[49] == x[49] else 77.7
    x[200:230] = np.nan
    return x


@pytest.mark.parametrize("kind", ["mean", "std", "sum"])
def test_moments_against_pandas(spark, gappy, kind):
    steep = 1e-3 * np.exp(np.arange(400) / 15)  # grows by eleven orders of magnitude
    df = moments(series(spark, gappy, steep), {f"m{k}_{n}": Moment(f"c{k}", n, least, kind) for k in (0, 1) for n, least in ((2, 2), (20, 10), (63, 31))})
    for k, x in enumerate((gappy, steep)):
        for n, least in ((2, 2), (20, 10), (63, 31)):
            rolled = pd.Series(x).rolling(n, min_periods=least)
            whole = np.array([np.nan if np.sum(~np.isnan(w)) < least else {"mean": np.nanmean, "sum": np.nansum, "std": lambda w: np.nanstd(w, ddof=1)}[kind](w) for w in (x[max(0, t - n + 1) : t + 1] for t in range(len(x)))])
            assert len(rolled.sum()) == len(whole)
            np.testing.assert_allclose(column(df, f"m{k}_{n}"), whole, rtol=1e-9)


def test_equal_values_have_no_deviation(spark):
    x = [0.1, 0.2, 0.3] + [0.7] * 30 + [None, None] + [0.7] * 5 + [0.9]
    got = column(moments(series(spark, x), {"s": Moment("c0", 5, 2, "std")}), "s")
    assert (got[7:33] == 0).all() and (got[36:40] == 0).all() and got[-1] > 0
    assert set(moments(series(spark, x), {"s": Moment("c0", 5, 2)}).columns) == {"symbol", "d", "c0", "s"}
    assert moments(series(spark, x).limit(0), {"s": Moment("c0", 5, 2)}).count() == 0


@pytest.mark.parametrize("most", [1, 3, 512])
def test_sorted_blocks_against_a_list(most):
    draw, held, plain = random.Random(most), SortedBlocks(most), []
    for _ in range(600):
        v = draw.randrange(30)
        if plain and draw.random() < 0.45:
            gone = draw.choice(plain)
            held.remove(gone)
            plain.remove(gone)
        else:
            held.add(v)
            plain.append(v)
        plain.sort()
        assert [held.at(k) for k in range(len(held))] == plain
        assert held.below(v) == sum(x < v for x in plain) and held.up_to(v) == sum(x <= v for x in plain)
        if plain:
            assert held.quantile(0.3) == pytest.approx(float(np.quantile(plain, 0.3)))


def test_order_statistics_equal_their_windows(spark, gappy):
    rounded = np.round(gappy)  # ties
    wanted = [Statistic("c0", 40, 10, "quantile", 0.25), Statistic("c0", 40, 10, "quantile", 0.5), Statistic("c0", 40, 10, "rank"), Statistic("c0", 40, 5, "share"), Statistic("c0", 40, 3, "quantile", 0.9, absolute=True)]
    df = series(spark, rounded - 100)
    fast = order_statistics.with_statistics(df, wanted)
    for s in wanted:
        slow = df.withColumn("y", s.value(df))
        np.testing.assert_allclose(column(fast, s.name), column(slow, "y"), rtol=1e-12)
    assert order_statistics.with_statistics(fast, wanted) is fast


def test_blocked_averages_equal_the_kernel_over_fifty_blocks(spark, gappy):
    draw = np.random.default_rng(3)
    close = np.concatenate([gappy, gappy[::-1]])
    close[:12] = np.nan
    close[300:345] = np.nan  # longer than a block
    df = series(spark, close, close + draw.random(800), close - draw.random(800)).withColumnsRenamed({"c0": "close", "c1": "high", "c2": "low"})
    df = df.unionByName(df.withColumn("symbol", F.lit("y")).withColumn("close", F.col("close") * 2).filter(F.col("d") > "2020-03-01"))
    names = ["tr", "rsi_14", "atr_14", "ema_12", "ema_26", "macd_line", "macd_signal", "macd_histogram"]
    one, many = features.averages(features.true_range(df)), scan.averages(df, 16)
    assert set(one.columns) == set(many.columns) and many.count() == df.count()
    assert scan.blocked(df, 16).select("symbol", scan.BLOCK).distinct().filter("symbol = 'x'").count() >= 50
    for n in names:
        np.testing.assert_allclose(column(many, n), column(one, n), rtol=1e-9, atol=1e-9)


def test_moments_of_a_pass_equal_their_windows(spark, gappy):
    flat_after_a_move = np.where(np.arange(400) % 90 == 0, 5e4, 100 + 1e-4 * (np.arange(400) % 7))
    df = series(spark, gappy, flat_after_a_move, np.full(400, np.nan))
    df = df.unionByName(series(spark, gappy[::-1][:15], gappy[:15], gappy[:15], symbol="y"))
    wanted = {f"{kind}{k}_{n}": Moment(f"c{k}", n, least, kind) for k in (0, 2) for n, least in ((2, 1), (20, 10), (63, 31)) for kind in ("mean", "std", "sum")}
    got, want = passes.by_group(df, [rolling.step(wanted)]), moments(df, wanted)
    for name in wanted:
        np.testing.assert_allclose(column(got, name), column(want, name), rtol=1e-9, err_msg=name)
    std = column(passes.by_group(df.filter("symbol = 'x'"), [rolling.step({"s": Moment("c1", 20, 20, "std")})]), "s")
    exact = pd.Series([np.std(flat_after_a_move[max(0, t - 19) : t + 1], ddof=1) if t >= 19 else np.nan for t in range(400)])
    np.testing.assert_allclose(std, exact, rtol=1e-9)


def test_days_between_bars_equal_a_joined_grid(spark):
    bars = [("a", 0, 1.0), ("a", 3, 2.0), ("a", 3, 4.0), ("a", 4, None), ("b", 9, 5.0), (None, 1, 6.0), (None, 3, 7.0), ("b", None, 8.0)]
    df = spark.createDataFrame([(s, None if d is None else START + dt.timedelta(days=d), x) for s, d, x in bars], "symbol string, d date, close double")
    spans = df.groupBy("symbol").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    want = spans.select("symbol", F.explode(F.sequence("lo", "hi")).alias("d")).join(df, ["symbol", "d"], "left")
    assert sorted(map(str, clean.align(df).collect())) == sorted(map(str, want.collect()))


def test_bars_of_many_symbols_become_features_in_one_pass(spark):
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 3 + F.col("id") % 2).cast("int"))
    price = F.round(100 + F.rand(5), 4)
    bars = spark.range(120).select(F.explode(F.array(F.lit("A"), F.lit("B"))).alias("symbol"), day.alias("d"), price.alias("open"), (price + 1).alias("high"), (price - 1).alias("low"), price.alias("close"), F.lit(10.0).alias("volume")).localCheckpoint()
    one, apart = features.of_bars(bars), features.all_features(clean.clean(bars))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FlatMapGroupsInArrow") == 1 and plan.count("windowspecdefinition") < 20
    assert set(one.columns) == set(apart.columns) and one.count() == apart.count() == 2 * 359
    for c in [c for c in one.columns if c not in ("symbol", "d")]:
        np.testing.assert_allclose(column(one, c), column(apart, c), rtol=1e-8, atol=1e-10, err_msg=c)
