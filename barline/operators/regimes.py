"""Regime detection (rules or a hidden Markov model) and signal blending."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.windows import changed, clip, ordered, require, rolling, sign
from .kernels import GaussianHMM, state_names
from .order_statistics import Statistic, with_statistics

NAMES = ("range_bound", "trending_up", "trending_down", "crisis")
#: The regimes in which each signal is trusted.
TRUST = {"signal_rsi": ("range_bound",), "signal_zscore": ("range_bound",), "signal_macd": ("trending_up", "trending_down"), "signal_bb": ("trending_up", "trending_down")}


def volatility_rank(lookback: int = 252) -> Statistic:
    """Rank of the last volatility among the last ``lookback`` rows, in percent."""
    return Statistic("vol_21d", lookback, lookback // 4, "rank")


def classify(df: DataFrame, lookback: int = 252, crisis: float = 90.0, window: int = 63, flat: float = 0.05) -> DataFrame:
    """regime_label and one-hot regime_prob_* by rules; null while warming up."""
    require(df, "vol_21d", "returns", "macd_line")
    place = volatility_rank(lookback)
    ranked = with_statistics(df, [place])
    ready = ranked.withColumns({"_rank": place.value(ranked), "_trend": rolling(F.avg, F.col("returns"), window, window // 2) * 252})
    rank, trend, macd = F.col("_rank"), F.col("_trend"), F.col("macd_line")
    label = (
        F.when(rank.isNull() | trend.isNull(), F.lit(None).cast("string")).when(rank > crisis, "crisis").when(F.abs(trend) < flat, "range_bound")
        .when((trend > 0) & (macd > 0), "trending_up").when((trend < 0) & (macd < 0), "trending_down").otherwise("range_bound"))
    out = ready.withColumn("regime_label", label).drop("_rank", "_trend", place.name)
    return out.withColumns({f"regime_prob_{n}": (F.col("regime_label") == n).cast("double") for n in NAMES})


def durations(df: DataFrame, label: str = "regime_label") -> DataFrame:
    """(symbol, regime, mean_bars): mean length of the runs of each label."""
    known = df.filter(F.col(label).isNotNull())
    flagged = known.select("symbol", "d", F.col(label).alias("regime"), changed(F.col(label)).cast("int").alias("flip"))
    runs = flagged.withColumn("run", F.sum("flip").over(ordered()))
    return runs.groupBy("symbol", "regime", "run").agg(F.count("*").alias("n")).groupBy("symbol", "regime").agg(F.avg("n").alias("mean_bars"))


def frequency(df: DataFrame, label: str = "regime_label") -> DataFrame:
    """(symbol, regime, share) over the labelled bars."""
    counts = df.filter(F.col(label).isNotNull()).groupBy("symbol", F.col(label).alias("regime")).agg(F.count("*").alias("n"))
    total = counts.groupBy("symbol").agg(F.sum("n").alias("total"))
    return counts.join(total, "symbol").select("symbol", "regime", (F.col("n") / F.col("total")).alias("share"))


def transitions(df: DataFrame, label: str = "regime_label") -> DataFrame:
    """(symbol, from_state, to_state, prob) of successive labels."""
    pairs = df.filter(F.col(label).isNotNull()).select("symbol", F.lag(label).over(ordered()).alias("from_state"), F.col(label).alias("to_state")).filter("from_state is not null")
    n = pairs.groupBy("symbol", "from_state", "to_state").agg(F.count("*").alias("n"))
    total = n.groupBy("symbol", "from_state").agg(F.sum("n").alias("total"))
    return n.join(total, ["symbol", "from_state"]).select("symbol", "from_state", "to_state", (F.col("n") / F.col("total")).alias("prob"))


def hmm(df: DataFrame, states: int = 4, columns: tuple[str, ...] = ("returns", "vol_21d"), train_end: str | None = None, online: bool = True, steps: int = 100, full: bool = False) -> DataFrame:
    """regime_label and regime_prob_* by a Gaussian HMM per symbol, fitted on bars
    up to ``train_end``. Online, probabilities use no later bar and start after
    max(30, 10 states) complete bars; symbols with too few bars stay null."""
    require(df, *columns)
    probs = [f"regime_prob_{n}" for n in NAMES]
    schema = T.StructType([*[f for f in df.schema.fields if f.name not in {"regime_label", *probs}], T.StructField("regime_label", T.StringType()), *[T.StructField(p, T.DoubleType()) for p in probs]])
    names, keep = NAMES, [f.name for f in schema.fields if f.name not in {"regime_label", *probs}]

    def run(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("d")[keep]
        values = bars[list(columns)].to_numpy(float, na_value=np.nan)
        known = ~np.isnan(values).any(1)
        x = values[known]
        trained = x if train_end is None else x[(pd.to_datetime(bars["d"][known]) <= pd.Timestamp(train_end)).to_numpy()]
        labels, table = np.full(len(bars), None, object), np.full((len(bars), len(names)), np.nan)
        if len(trained) >= 30 * states:
            model = GaussianHMM(states, steps, full=full).fit(trained)
            called = state_names(model.path(trained), trained[:, 0], trained[:, 1] if trained.shape[1] > 1 else np.abs(trained[:, 0]), states)
            p = model.filtered(x) if online else model.smoothed(x)
            merged = np.zeros((len(x), len(names)))
            for j, name in called.items():
                if name in names:
                    merged[:, names.index(name)] += p[:, j]
            if online:
                merged[: max(30, 10 * states)] = np.nan
            table[known] = merged
            shown = known.copy()
            shown[known] = ~np.isnan(merged[:, 0])
            labels[shown] = np.array(names, object)[table[shown].argmax(1)]
        return bars.assign(regime_label=labels, **{c: table[:, k] for k, c in enumerate(probs)})

    return df.groupBy("symbol").applyInPandas(run, schema)


def blend(columns: list[str], trust: dict[str, tuple[str, ...]] = TRUST, normalise: bool = True) -> Column:
    """Signals weighted by the probability of the regimes that favour them."""
    if not trust:
        raise ValueError("no signals are registered")
    total, weights = F.lit(0.0), F.lit(0.0)
    for signal, regimes in trust.items():
        there = [f"regime_prob_{r}" for r in regimes if f"regime_prob_{r}" in columns]
        if signal in columns and there:
            w = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in there[1:]), F.coalesce(F.col(there[0]), F.lit(0.0)))
            total, weights = total + w * F.coalesce(F.col(signal), F.lit(0)), weights + w
    return F.coalesce(total / F.nullif(weights, F.lit(0.0)), F.lit(0.0)) if normalise else total


def discrete(x: Column, threshold: float) -> Column:
    return F.when(x > threshold, 1).when(x < -threshold, -1).otherwise(0)


def adaptive(df: DataFrame, trust: dict[str, tuple[str, ...]] = TRUST) -> DataFrame:
    """signal_adaptive, the sign of the blend, and its size as position_scale_adaptive."""
    out = df.withColumn("_blend", blend(df.columns, trust))
    return out.withColumns({"signal_adaptive": sign(F.col("_blend")), "position_scale_adaptive": clip(F.abs("_blend"), 0.0, 1.0)}).drop("_blend")


def coverage(trust: dict[str, tuple[str, ...]] = TRUST) -> dict[str, list[str]]:
    """The signals registered for each regime."""
    return {n: [s for s, rs in trust.items() if n in rs] for n in NAMES}
