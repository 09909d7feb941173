"""Position signals: state machines in one kernel, strengths and blends natively."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.moments import correlation
from ..functions.windows import changed, clip, past, require, rolling, sign
from . import order_statistics
from .kernels import band_machine, macd_machine, rsi_machine, zscore_machine
from .order_statistics import Statistic
from .passes import Step, by_group, floats

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Rules:
    oversold: float = 30.0
    overbought: float = 70.0
    rsi_exit: float = 50.0
    smoothing: int = 1
    z_entry: float = 2.0
    z_exit: float = 0.0
    z_window: int = 60
    zero_cross: bool = False
    bb_mode: str = "breakout"
    squeeze_percentile: float = 20.0
    min_holding: int = 2
    max_holding: int = 20
    bb_max_holding: int = 10


INPUTS = ("close", "rsi_14", "macd_histogram", "macd_line", "bb_upper", "bb_lower", "bb_middle", "bb_width")


def squeeze(rules: Rules) -> Statistic:
    return Statistic("bb_width", 252, 60, "quantile", rules.squeeze_percentile / 100)


def positions(df: DataFrame, rules: Rules = Rules(), also: tuple[Statistic, ...] = ()) -> DataFrame:
    """signal_rsi, signal_macd, signal_zscore and signal_bb, in one pass over the
    bars of a symbol, which makes the statistics of ``also`` on its way."""
    score = f"z_price_{rules.z_window}d"
    require(df, *INPUTS, score)
    if rules.bb_mode not in ("breakout", "reversion"):
        raise ValueError(f"unknown mode {rules.bb_mode!r}")
    least = rolling(F.min, F.col("rsi_14"), rules.smoothing, 1)
    most = rolling(F.max, F.col("rsi_14"), rules.smoothing, 1)
    ready = df.withColumns({"_rsi_min": least, "_rsi_max": most})
    names = ["signal_rsi", "signal_macd", "signal_zscore", "signal_bb"]
    bound = squeeze(rules)
    ranked, bound_name = order_statistics.step([bound, *order_statistics.missing(df, list(also))]), bound.name

    def run(bars: pa.Table) -> dict[str, np.ndarray]:
        v = {c: floats(bars, c) for c in (*INPUTS, score, "_rsi_min", "_rsi_max")}
        told = ranked.run(bars)
        at = told.pop(bound_name)
        inside = np.isnan(at) | (v["bb_width"] <= at)
        lo, hi = rules.min_holding, rules.max_holding
        found = [
            rsi_machine(v["close"], v["_rsi_min"], v["_rsi_max"], v["rsi_14"], rules.oversold, rules.overbought, rules.rsi_exit, lo, hi),
            macd_machine(v["macd_histogram"], v["macd_line"], rules.zero_cross, lo, hi),
            zscore_machine(v[score], rules.z_entry, rules.z_exit, lo, hi),
            band_machine(v["close"], v["bb_upper"], v["bb_lower"], v["bb_middle"], inside, rules.bb_mode, lo, rules.bb_max_holding)]
        return told | dict(zip(names, found, strict=True))

    made = {n: k for n, k in ranked.made.items() if n != bound_name} | dict.fromkeys(names, "int")
    return by_group(ready, [Step(made, run)], drop=("_rsi_min", "_rsi_max"))


def strengths(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The companions in [0, 1]."""
    r, z, h, p, mid = F.col("rsi_14"), F.col(f"z_price_{rules.z_window}d"), F.col("macd_histogram"), F.col("close"), F.col("bb_middle")
    top = rolling(F.max, F.abs(h), 63, 10)
    spread = F.col("bb_upper") - F.col("bb_lower")
    by_side = lambda s, long, short: F.when(s == 1, clip(long, 0.0, 1.0)).when(s == -1, clip(short, 0.0, 1.0)).otherwise(0.0)
    zero = F.lit(0.0)
    # a forced exit is the only way from a position to 0, and its row has no strength
    s, before = F.col("signal_macd"), past(F.col("signal_macd"))
    seen = past(h).isNotNull() & ~((s == 0) & (F.coalesce(before, F.lit(0)) != 0))
    return df.withColumns({
        "signal_rsi_strength": by_side(F.col("signal_rsi"), (rules.oversold - r) / rules.oversold, (r - rules.overbought) / (100 - rules.overbought)),
        "signal_macd_strength": F.when(seen, F.coalesce(clip(F.abs(h) / F.nullif(top, zero), 0.0, 1.0), zero)).otherwise(zero),
        "signal_zscore_strength": F.when(F.col("signal_zscore") != 0, clip(F.greatest(F.abs(z) - rules.z_entry, zero) / rules.z_entry, 0.0, 1.0)).otherwise(0.0),
        "signal_bb_strength": by_side(F.col("signal_bb"), F.greatest(mid - p, zero) / F.nullif(spread, zero), F.greatest(p - mid, zero) / F.nullif(spread, zero)),
    })


def scale_share(column: str = "vol_21d", lookback: int = 252) -> Statistic:
    return Statistic(column, lookback, 10, "share")


def position_scale(df: DataFrame, column: str = "vol_21d", lookback: int = 252, floor: float = 0.0, ceiling: float = 2.0) -> DataFrame:
    """High against the last ``lookback`` rows' volatility gives a small scale."""
    require(df, column)
    share = scale_share(column, lookback)
    rank = share.value(df)
    scale = F.greatest(F.lit(floor), F.least(F.lit(ceiling), ceiling - (ceiling - floor) * rank))
    return df.withColumn("position_scale", F.when(rank.isNotNull(), scale).otherwise(1.0)).drop(share.name)


def ensemble(method: str = "majority_vote", weights: dict[str, float] | None = None) -> Column:
    """A blend of the rsi, macd and z-score signals."""
    names = ("signal_rsi", "signal_macd", "signal_zscore")
    if method == "majority_vote":
        return sign(sum((F.col(n) for n in names[1:]), F.col(names[0])))
    if method == "weighted":
        weights = weights or dict.fromkeys(names, 1 / 3)
        total = sum(weights.values())
        return sign(sum((F.col(n) * w for n, w in weights.items()), F.lit(0.0)) / total)
    if method == "regime_switch":
        return F.when(F.col("vol_21d") > rolling(F.avg, F.col("vol_21d"), 63, 20), F.col("signal_macd")).otherwise(F.col("signal_rsi"))
    raise ValueError(f"unknown method {method!r}")


def all_signals(df: DataFrame, rules: Rules = Rules(), method: str = "majority_vote", also: tuple[Statistic, ...] = (), scale: tuple[float, float] = (0.0, 2.0)) -> DataFrame:
    """All signals; statistics of ``also`` that the gates or regimes need later are made in
    the same pass, and stay."""
    return position_scale(strengths(positions(df, rules, (scale_share(), *also)), rules), floor=scale[0], ceiling=scale[1]).withColumn("signal_ensemble", ensemble(method))


def report(df: DataFrame) -> DataFrame:
    """(symbol, signal, turnover, long_pct, short_pct, flat_pct)."""
    names = [c for c in df.columns if c.startswith("signal_") and not c.endswith("_strength")]
    flagged = df.select("symbol", "d", *names).unpivot(["symbol", "d"], names, "signal", "value")
    keys = ("symbol", "signal")
    flagged = flagged.withColumn("change", changed(F.col("value"), keys))
    pct = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0)) * 100
    return flagged.groupBy(*keys).agg(F.avg(F.col("change").cast("double")).alias("turnover"), pct(F.col("value") == 1).alias("long_pct"), pct(F.col("value") == -1).alias("short_pct"), pct(F.col("value") == 0).alias("flat_pct"))


def correlations(df: DataFrame) -> DataFrame:
    """(a, b, corr) of all pairs of signal and strength columns, over the rows where
    all of them are known."""
    names = [c for c in df.columns if c.startswith("signal_")]
    whole = df.dropna(subset=names).select(*[F.col(c).cast("double").alias(c) for c in names])
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), correlation(a, b).alias("corr")) for i, a in enumerate(names) for b in names[i:]]
    return whole.agg(F.array(*pairs).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def values(df: DataFrame) -> DataFrame:
    """(symbol, signal, unique_values, mean_strength): the values that a signal takes, in
    order, and the mean of its strength where it has one."""
    names = [c for c in df.columns if c.startswith("signal_") and not c.endswith("_strength")]
    strength = lambda c: F.col(f"{c}_strength") if f"{c}_strength" in df.columns else F.lit(None)
    each = F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).cast("int").alias("x"), strength(c).cast("double").alias("y")) for c in names])
    long = df.select("symbol", F.explode(each).alias("s")).select("symbol", "s.*")
    shown = F.array_join(F.transform(F.sort_array(F.collect_set("x")), lambda x: x.cast("string")), ",")
    return long.groupBy("symbol", "signal").agg(shown.alias("unique_values"), F.avg("y").alias("mean_strength"))
