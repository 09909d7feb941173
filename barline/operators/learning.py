"""Walk-forward tree models on features, with folds that never look ahead.

Every (symbol, fold) has a model of its own. All models of a frame are one job: a fold of a
symbol is a group of as many rows as ``Folds`` lets it have (499 to learn from and 63 to
test at most by its defaults), so groups stay small however many bars or symbols there are, and the job
count does not depend on symbols, folds, trees or levels.
"""

from __future__ import annotations

import sys
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.util import inheritable_thread_target

from ..functions.moments import correlation
from ..functions.windows import ordered
from .passes import floats
from .trees import MODELS, Trees, fitted

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCKED = {"open", "high", "low", "close", "volume", "returns", "returns_norm", "returns_fwd_1", "returns_fwd_5", "tr", "target", "fold_id", "rn"}
#: Training rows of a task at least, where a fold has as many.
TASK_ROWS = 20_000
PREFIXES = ("signal_", "position_", "regime_", "gate_")


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are neither bars, targets nor derived decisions."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in BLOCKED and not f.name.startswith(PREFIXES)]


@dataclass(frozen=True)
class Folds:
    n_folds: int = 5
    min_train: int = 252
    test: int = 63
    expanding: bool = True
    train_window: int = 504
    embargo: int = 5

    def rows(self, n: int) -> list[tuple[int, int, int, int, int]]:
        """(fold_id, train_lo, train_hi, test_lo, test_hi) for n bars, in row
        positions from 0, ends exclusive."""
        if n < self.min_train + self.test:
            raise ValueError(f"{n} bars are too few: {self.min_train + self.test} are needed")
        out = []
        for k in range(min(self.n_folds, (n - self.min_train) // self.test)):
            at = self.min_train + k * self.test
            lo = 0 if self.expanding else max(0, at - self.train_window)
            hi = max(lo, at - self.embargo)
            if hi - lo >= self.min_train // 2:
                out.append((k, lo, hi, at, min(at + self.test, n)))
        if not out:
            raise ValueError("no fold has enough bars")
        return out


def _bounds(n: Column, k: Column, folds: Folds) -> tuple[dict[str, Column], Column]:
    """(bounds of fold k of n bars, whether there is such a fold)."""
    at = F.lit(folds.min_train) + k * folds.test
    lo = F.lit(0) if folds.expanding else F.greatest(F.lit(0), at - folds.train_window)
    hi = F.greatest(lo, at - folds.embargo)
    return {"train_lo": lo, "train_hi": hi, "test_lo": at, "test_hi": at + folds.test}, (at + folds.test <= n) & (hi - lo >= folds.min_train // 2)


def _numbers(folds: Folds) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(folds.n_folds - 1)))


def fold_table(df: DataFrame, folds: Folds = Folds()) -> DataFrame:
    """(symbol, fold_id, train_lo, train_hi, test_lo, test_hi) per symbol, by
    expressions: symbols with too few bars have no folds."""
    each = df.groupBy("symbol").agg(F.count("*").alias("n")).select("symbol", "n", _numbers(folds).alias("fold_id"))
    bounds, there = _bounds(F.col("n"), F.col("fold_id"), folds)
    return each.filter(there).select("symbol", "fold_id", *[c.cast("int").alias(name) for name, c in bounds.items()])


def with_folds(df: DataFrame, folds: Folds = Folds()) -> DataFrame:
    """Bars of every fold (a bar may be in several), with ``part`` train or test. The
    symbol's rows are numbered and counted in one exchange; a bar then knows its folds."""
    numbered = df.withColumns({"rn": F.row_number().over(ordered()) - 1, "_n": F.count("*").over(Window.partitionBy("symbol"))})
    each = numbered.select("*", _numbers(folds).alias("fold_id"))
    b, there = _bounds(F.col("_n"), F.col("fold_id"), folds)
    rn = F.col("rn")
    learns, tests = (rn >= b["train_lo"]) & (rn < b["train_hi"]), (rn >= b["test_lo"]) & (rn < b["test_hi"])
    return each.filter(there & (learns | tests)).withColumn("part", F.when(learns, "train").otherwise("test")).drop("_n")


def medians(train: DataFrame, columns: list[str]) -> dict[str, float]:
    row = train.agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in columns]).first()
    return {c: row[c] if row[c] is not None else 0.0 for c in columns}


def model(kind: str, seed: int = 42):
    if kind == "xgboost":
        return GBTRegressor(maxIter=200, maxDepth=4, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed, labelCol="target")
    if kind == "random_forest":
        return RandomForestRegressor(numTrees=200, maxDepth=6, minInstancesPerNode=20, seed=seed, labelCol="target")
    raise ValueError(f"unknown model {kind!r}")


#: A model: what it tells of its test bars and what it is made of.
MODEL = "symbol string, fold_id int, n_train int, told array<struct<d: date, target: double, prediction: double>>, importances array<struct<feature: string, importance: double>>, error string"


def models(df: DataFrame, target: str = "returns_fwd_5", folds: Folds = Folds(), kind: str | Trees = "xgboost", least: int = 30, watched: bool = False) -> DataFrame:
    """A row per (symbol, fold): what its model tells of the test bars, and the model's
    importances. A model that fails ends the job, or, where ``watched``, tells its ``error`` alone. A fold with fewer than ``least`` rows that have a target has no row. Nulls
    are filled with the medians of the training rows, or 0 where a column has none."""
    columns = feature_columns(df)
    if not columns:
        raise ValueError("no numeric column to learn from")
    if isinstance(kind, str) and kind not in MODELS:
        raise ValueError(f"unknown model {kind!r}; there are {', '.join(MODELS)}")
    trees = kind if isinstance(kind, Trees) else MODELS[kind]
    staged = with_folds(df, folds).select("symbol", "d", "fold_id", "part", F.col(target).cast("double").alias("target"), *[F.col(c).cast("double").alias(f"x_{c}") for c in columns])

    def fit(bars: pa.Table) -> pa.Table:
        key = {"symbol": bars.column("symbol")[0].as_py(), "fold_id": bars.column("fold_id")[0].as_py()}
        try:
            return pa.Table.from_pylist([key | model for model in one(bars.sort_by("d"))], schema)
        except Exception as e:
            if not watched:
                raise
            return pa.Table.from_pylist([key | {"error": f"{type(e).__name__}: {e}"}], schema)

    def one(bars: pa.Table) -> list[dict]:
        x, y = np.stack([floats(bars, f"x_{c}") for c in columns], 1), floats(bars, "target")
        tests = np.array(bars.column("part").to_pylist()) == "test"
        learns = ~tests & np.isfinite(y)
        if learns.sum() < least:
            return []
        fills = [np.median(v[~np.isnan(v)]) if (~np.isnan(v)).any() else 0.0 for v in x[learns].T]
        x = np.where(np.isnan(x), fills, x)
        told, weights = fitted(x[learns], y[learns], x[tests], trees)
        days = bars.column("d").filter(pa.array(tests)).to_pylist()
        return [{
            "n_train": int(learns.sum()),
            "told": [{"d": d, "target": None if np.isnan(t) else float(t), "prediction": float(p)} for d, t, p in zip(days, y[tests], told, strict=True)],
            "importances": [{"feature": c, "importance": float(v)} for c, v in zip(columns, weights, strict=True)]}]

    schema = to_arrow_schema(T.StructType.fromDDL(MODEL))
    # few bytes a model, but much work: partitions are not to be joined by their size
    spread = staged.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "symbol", "fold_id")
    return spread.groupBy("symbol", "fold_id").applyInArrow(fit, MODEL)


def predictions(made: DataFrame) -> DataFrame:
    """(symbol, d, fold_id, target, prediction) of all test bars."""
    return made.select("symbol", "fold_id", F.inline("told")).select("symbol", "d", "fold_id", "target", "prediction")


def importances(made: DataFrame) -> DataFrame:
    """(symbol, fold_id, feature, importance)."""
    return made.select("symbol", "fold_id", F.inline("importances"))


def pooled_walk_forward(df: DataFrame, target: str = "returns_fwd_5", folds: Folds = Folds(), estimator=None, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """(predictions, importances): one MLlib model per fold for all symbols of the
    frame, where symbols have too few bars for models of their own; test rows are imputed with the medians of the fold's training rows. The
    folds are fitted side by side: boosting is many short jobs, each of which leaves
    most of a cluster idle."""
    spark, columns = df.sparkSession, feature_columns(df)
    staged = with_folds(df, folds).withColumn("target", F.col(target))
    ready = VectorAssembler(inputCols=columns, outputCol="features")

    def fold(k: int) -> tuple[DataFrame, list[tuple[int, str, float]]] | None:
        part = staged.filter(F.col("fold_id") == k)
        train = part.filter("part = 'train' and target is not null").persist()  # read by the medians and by the fit
        try:
            n = train.count()
            if n < least:
                return None
            fills = medians(train, columns)
            # each tree is a job a level: few rows in many partitions are mostly overhead
            rows = train.coalesce(1 + n // TASK_ROWS).fillna(fills, columns)
            fitted = (estimator or model("xgboost")).fit(ready.transform(rows))
        finally:
            train.unpersist()
        told = fitted.transform(ready.transform(part.filter("part = 'test'").fillna(fills, columns))).select("symbol", "d", "fold_id", "target", "prediction")
        return told, [(k, c, float(v)) for c, v in zip(columns, fitted.featureImportances.toArray(), strict=True)]

    numbers = sorted(r["fold_id"] for r in fold_table(df, folds).select("fold_id").distinct().collect())  # at most n_folds rows
    with ThreadPoolExecutor(max(1, len(numbers))) as pool:
        done = [d for d in pool.map(inheritable_thread_target(spark)(fold), numbers) if d]
    if done:
        predictions = reduce(DataFrame.unionByName, (told for told, _ in done))
    else:
        predictions = spark.createDataFrame([], "symbol string, d date, fold_id int, target double, prediction double")
    importances = [row for _, rows in done for row in rows]
    return predictions, spark.createDataFrame(importances, "fold_id int, feature string, importance double")


def fold_report(predictions: DataFrame, by: tuple[str, ...] = (), flat: float = 0.0) -> DataFrame:
    """A row per fold, or per fold of each group of ``by``. ``flat`` is the ic of a fold whose
    predictions or targets are all equal, as of a model without a split."""
    known = predictions.filter("target is not null")
    right = (F.signum("prediction") == F.signum("target")).cast("double")
    return known.groupBy(*by, "fold_id").agg(
        F.count("*").alias("n"), F.avg(F.pow(F.col("prediction") - F.col("target"), 2.0)).alias("mse"), F.avg(F.abs(F.col("prediction") - F.col("target"))).alias("mae"),
        correlation("prediction", "target", flat).alias("ic"), F.avg(right).alias("direction_acc"))


def importance_report(importances: DataFrame, n: int = 30, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The ``n`` features of each group that weigh most over its folds."""
    each = importances.groupBy(*by, "feature").agg(F.avg("importance").alias("mean"), F.stddev_pop("importance").alias("std"), F.count_if(F.col("importance") > 0).alias("n_nonzero"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("mean"), "feature"))
    return each.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def thresholded(x: Column, band: float = 0.005) -> Column:
    return F.when(x > band, 1).when(x < -band, -1).otherwise(0)


def threshold_sweep(predictions: DataFrame, thresholds: tuple[float, ...] = (0.0, 0.0025, 0.005, 0.0075, 0.01, 0.015, 0.02), by: tuple[str, ...] = ()) -> DataFrame:
    """(by, threshold, active_pct, direction_acc, mean_abs_active_pred): every row is
    measured against each of the few thresholds in one pass."""
    p, t = F.col("prediction"), F.col("target")
    each = predictions.filter("prediction is not null and target is not null").select(*by, "prediction", "target", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold"))
    active = F.abs(p) > F.col("threshold")
    return each.groupBy(*by, "threshold").agg(
        (F.avg(active.cast("double")) * 100).alias("active_pct"), F.avg(F.when(active, (F.signum(p) == F.signum(t)).cast("double"))).alias("direction_acc"), F.avg(F.when(active, F.abs(p))).alias("mean_abs_active_pred"))


def with_signal(df: DataFrame, predictions: DataFrame, band: float = 0.005) -> DataFrame:
    """Bars with ``signal_ml``: the thresholded prediction of the fold that tests the bar,
    0 where none does. Test windows do not overlap, so a bar has one prediction at most."""
    told = predictions.select("symbol", "d", thresholded(F.col("prediction"), band).alias("signal_ml"))
    return df.join(told, ["symbol", "d"], "left").withColumn("signal_ml", F.coalesce("signal_ml", F.lit(0)))


def folds_of(spark: SparkSession, n: int, folds: Folds = Folds()) -> DataFrame:
    return spark.createDataFrame(folds.rows(n), "fold_id int, train_lo int, train_hi int, test_lo int, test_hi int")
