"""Many small models at once, against a plain loop of trees over rows."""

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from barline.operators import learning, trees


def plain(learn, target, ask, t):
    """Boosted trees, or one averaged, that try every split of every column one by one."""
    base, told, asked = target.mean(), np.zeros(len(learn)), np.zeros(len(ask))
    shrunk = lambda s: np.sign(s) * max(abs(s) - t.l1, 0)
    score = lambda g: shrunk(g.sum()) ** 2 / (len(g) + t.l2)

    def grow(rows, depth, g):
        best = (trees.EPS, None)
        for c in range(learn.shape[1]) if depth else ():
            values = np.unique(learn[:, c])
            for cut in (values[1:] + values[:-1]) / 2:
                left, right = rows[learn[rows, c] <= cut], rows[learn[rows, c] > cut]
                if min(len(left), len(right)) >= t.least:
                    gain = score(g[left]) + score(g[right]) - score(g[rows])
                    best = max(best, (gain, (c, cut, left, right)), key=lambda b: b[0])
        if best[1] is None:
            return shrunk(g[rows].sum()) / (len(rows) + t.l2)
        c, cut, left, right = best[1]
        return c, cut, grow(left, depth - 1, g), grow(right, depth - 1, g)

    def leaf(tree, x):
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(t.n):
        tree = grow(np.arange(len(learn)), t.depth, target - base - told)
        told += t.rate * np.array([leaf(tree, x) for x in learn])
        asked += t.rate * np.array([leaf(tree, x) for x in ask])
    return base + asked


def bars(spark, n=130):
    """Three symbols, of which one is too short for a fold, with nulls and a tail without target."""
    rows = spark.range(n).select("id", F.explode(F.array(F.lit("A"), F.lit("B"), F.lit("C"), F.lit("short"))).alias("symbol")).filter(f"symbol <> 'short' or id < 30")
    draw = lambda k: (F.pmod(F.xxhash64("symbol", "id", F.lit(k)), F.lit(10_007)) / 10_007)
    rows = rows.withColumn("d", F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")))
    rows = rows.withColumns({"a": draw(1), "b": F.when(draw(2) > 0.1, draw(3)), "empty": F.lit(None).cast("double")})
    return rows.withColumn("returns_fwd_5", F.when(F.col("id") < n - 5, F.sin(F.col("a") * 6) + F.coalesce("b", F.lit(0.5)) ** 2 + draw(4) / 10)).drop("id")


def test_every_symbol_and_fold_equals_the_plain_loop(spark):
    t, folds = trees.Trees(n=4, depth=3, rows=1.0, columns=1.0, rate=0.3, least=3), learning.Folds(n_folds=2, min_train=70, test=30)
    df = bars(spark)
    made = learning.models(df, folds=folds, kind=t, least=30).cache()
    got = {(r.symbol, r.fold_id, r.d): (r.target, r.prediction) for r in learning.predictions(made).collect()}
    assert {k[:2] for k in got} == {(s, f) for s in "ABC" for f in (0, 1)} and len(got) == 6 * 30
    for symbol, rows in df.filter("symbol <> 'short'").toPandas().groupby("symbol"):
        rows = rows.sort_values("d").reset_index(drop=True)
        for fold, lo, hi, a, b in folds.rows(len(rows)):
            learn = rows.iloc[lo:hi].dropna(subset=["returns_fwd_5"])
            fills = learn[["a", "b", "empty"]].astype(float).median().fillna(0)
            x = rows[["a", "b", "empty"]].astype(float).fillna(fills)
            want = plain(x.loc[learn.index].to_numpy(), learn["returns_fwd_5"].to_numpy(), x.iloc[a:b].to_numpy(), t)
            assert [got[symbol, fold, d][1] for d in rows["d"].iloc[a:b]] == pytest.approx(list(want), abs=1e-9)
            assert [got[symbol, fold, d][0] is None for d in rows["d"].iloc[a:b]] == rows["returns_fwd_5"].iloc[a:b].isna().tolist()
    weights = learning.importances(made).groupBy("symbol", "fold_id").agg(F.sum("importance").alias("all"), F.sum(F.when(F.col("feature") == "empty", F.col("importance"))).alias("none")).collect()
    assert len(weights) == 6 and all(w["all"] == pytest.approx(1) and w["none"] == 0 for w in weights)
    top = learning.importance_report(learning.importances(made), n=2).collect()
    assert sorted((r.symbol, r.feature) for r in top) == [(s, c) for s in "ABC" for c in "ab"]


def test_a_watched_model_that_fails_tells_why(spark):
    folds, broken = learning.Folds(n_folds=1, min_train=70, test=30), trees.Trees(n=1, depth=-1)
    made = learning.models(bars(spark), folds=folds, kind=broken, watched=True).collect()
    assert {r.symbol for r in made} == set("ABC") and all(r.error and r.told is None for r in made)
    with pytest.raises(PythonException):
        learning.models(bars(spark), folds=folds, kind=broken).collect()


@pytest.mark.parametrize("kind", ["xgboost", "random_forest"])
def test_models_learn_what_there_is_and_repeat_themselves(kind):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(600, 5))
    y = np.sin(x[:, 1]) + 0.5 * (x[:, 3] > 0) + draw.normal(size=600) / 20
    t = trees.MODELS[kind]
    told, weights = trees.fitted(x[:500], y[:500], x[500:], t)
    assert np.corrcoef(told, y[500:])[0, 1] > 0.95 and set(np.argsort(weights)[-2:]) == {1, 3}
    assert np.array_equal(told, trees.fitted(x[:500], y[:500], x[500:], t)[0])
    flat, none = trees.fitted(x[:500], np.full(500, 2.0), x[500:], t)
    assert np.allclose(flat, 2) and none.sum() == 0


def test_columns_beyond_the_bins_are_cut_at_quantiles():
    x = np.arange(1000.0)
    codes = trees.binned(x, x, 10)
    assert codes.min() == 0 and codes.max() == 9 and (np.diff(codes) >= 0).all() and np.bincount(codes).max() <= 101


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "symbol string, d date, a double, returns_fwd_5 double")
    assert learning.models(empty).count() == 0
    with pytest.raises(ValueError):
        learning.models(empty.drop("a"))
    with pytest.raises(ValueError):
        learning.models(empty, kind="other")
