"""Regime gates: conditions on features that let a signal through or not.

A condition turns a frame into a boolean column; missing values close the gate.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import changed, require, rolling, sign, whole
from . import order_statistics
from .kernels import breaker
from .order_statistics import Statistic
from .passes import Step, by_group, floats

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Condition(Protocol):
    """The extension point: anything with this method is a condition. One that compares
    with quantiles may also tell them as ``statistics``, a tuple: they then are made
    together with those of all other conditions, in one pass."""

    def column(self, df: DataFrame) -> Column: ...


def _known(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _bound(df: DataFrame, at: Statistic, point_in_time: bool) -> Column:
    """The rolling quantile; where it is missing, the median of the whole series
    (which looks ahead), unless ``point_in_time``."""
    x = F.abs(at.column) if at.absolute else F.col(at.column)
    return at.value(df) if point_in_time else F.coalesce(at.value(df), F.percentile(x, F.lit(0.5)).over(whole()))


def statistics_of(conditions: list) -> list[Statistic]:
    return [s for c in conditions for s in getattr(c, "statistics", ())]


@dataclass(frozen=True)
class VolPercentile:
    name: str = "vol_21d"
    lookback: int = 252
    percentile: float = 30.0
    mode: str = "below"

    @property
    def statistics(self) -> tuple[Statistic, ...]:
        return (Statistic(self.name, self.lookback, self.lookback // 2, p=self.percentile / 100),)

    def column(self, df: DataFrame) -> Column:
        if self.name not in df.columns:
            return F.lit(False)
        x, at = F.col(self.name), self.statistics[0].value(df)
        return _known(x < at if self.mode == "below" else x > at)


@dataclass(frozen=True)
class Trend:
    name: str = "returns"
    window: int = 63
    most: float = 0.10
    directional: str | None = None

    def column(self, df: DataFrame) -> Column:
        if self.name not in df.columns:
            return F.lit(False)
        mean, bound = rolling(F.avg, F.col(self.name), self.window, self.window // 2), self.most / 252
        return _known({None: F.abs(mean) < bound, "up": mean > bound, "down": mean < -bound}[self.directional])


@dataclass(frozen=True)
class Macd:
    direction: str = "positive"
    threshold: float | None = None
    name: str = "macd_line"
    point_in_time: bool = False

    @property
    def statistics(self) -> tuple[Statistic, ...]:
        weak = self.direction not in ("positive", "negative") and self.threshold is None
        return (Statistic(self.name, 252, 60, p=0.25, absolute=True),) if weak else ()

    def column(self, df: DataFrame) -> Column:
        if self.name not in df.columns:
            return F.lit(False)
        m = F.col(self.name)
        if self.direction in ("positive", "negative"):
            return _known(m > 0 if self.direction == "positive" else m < 0)
        bound = F.lit(self.threshold) if self.threshold is not None else _bound(df, self.statistics[0], self.point_in_time)
        return _known(F.abs(m) < bound)


@dataclass(frozen=True)
class BandWidth:
    lookback: int = 252
    percentile: float = 40.0
    name: str = "bb_width"

    @property
    def statistics(self) -> tuple[Statistic, ...]:
        return (Statistic(self.name, self.lookback, self.lookback // 4, p=self.percentile / 100),)

    def column(self, df: DataFrame) -> Column:
        if self.name not in df.columns:
            return F.lit(False)
        return _known(F.col(self.name) < self.statistics[0].value(df))


@dataclass(frozen=True)
class RsiRange:
    low: float = 35.0
    high: float = 65.0
    name: str = "rsi_14"

    def column(self, df: DataFrame) -> Column:
        return _known(F.col(self.name).between(self.low, self.high)) if self.name in df.columns else F.lit(False)


@dataclass(frozen=True)
class Composite:
    conditions: tuple
    logic: str = "AND"

    @property
    def statistics(self) -> tuple[Statistic, ...]:
        return tuple(statistics_of(list(self.conditions)))

    def column(self, df: DataFrame) -> Column:
        if not self.conditions:
            raise ValueError("a composite needs conditions")
        if self.logic not in ("AND", "OR"):
            raise ValueError(f"unknown logic {self.logic!r}")
        return reduce((lambda a, b: a & b) if self.logic == "AND" else (lambda a, b: a | b), [_known(c.column(df)) for c in self.conditions])


@dataclass(frozen=True)
class TrendConfirmation:
    signal: str
    percentile: float = 25.0
    lookback: int = 252
    name: str = "macd_line"
    point_in_time: bool = False

    @property
    def statistics(self) -> tuple[Statistic, ...]:
        return (Statistic(self.name, self.lookback, self.lookback // 4, p=self.percentile / 100, absolute=True),)

    def column(self, df: DataFrame) -> Column:
        if self.name not in df.columns or self.signal not in df.columns:
            return F.lit(False)
        m = F.col(self.name)
        strong = F.abs(m) >= _bound(df, self.statistics[0], self.point_in_time)
        return _known((F.signum(F.col(self.signal).cast("double")) == F.signum(m)) & strong)


@dataclass(frozen=True)
class Drawdown:
    """The resettable breaker of a signal's simulated equity. Its column is made
    by ``with_breakers`` beforehand; without the needed columns it stays open."""

    signal: str
    most: float = 0.15
    recovery: float = 0.95
    returns: str = "returns"

    @property
    def name(self) -> str:
        return f"gate_dd_{self.signal}_{round(self.most * 1000)}"

    def column(self, df: DataFrame) -> Column:
        return F.col(self.name) if self.name in df.columns else F.lit(True)


def with_inputs(df: DataFrame, gates: list[Drawdown], statistics: list[Statistic] = ()) -> DataFrame:
    """df with a column for every drawdown gate and statistic, in one pass by symbol."""
    told = [(g.name, g.signal, g.returns, g.most, g.recovery) for g in gates if {g.signal, g.returns} <= set(df.columns)]
    wanted = order_statistics.missing(df, list(statistics))

    def run(bars: pa.Table) -> dict[str, np.ndarray]:
        return {n: breaker(floats(bars, s), floats(bars, r), m, c) for n, s, r, m, c in told}

    steps = [Step({t[0]: "boolean" for t in told}, run)] * bool(told) + [order_statistics.step(wanted)] * bool(wanted)
    return by_group(df, steps) if steps else df


def with_breakers(df: DataFrame, gates: list[Drawdown]) -> DataFrame:
    return with_inputs(df, gates)


def gated(df: DataFrame, signal: str, conditions: list, output: str | None = None, logic: str = "AND", invert: bool = False) -> DataFrame:
    """The signal where the gate is open, 0 elsewhere."""
    require(df, signal)
    wanted = order_statistics.missing(df, statistics_of(conditions))
    ready = with_inputs(df, [], wanted)
    gate = Composite(tuple(conditions), logic).column(ready)
    return ready.withColumn(output or f"{signal}_filtered", F.when(~gate if invert else gate, F.col(signal)).otherwise(0)).drop(*[s.name for s in wanted])


def stats(df: DataFrame, signal: str, output: str) -> DataFrame:
    """(symbol, n_bars, active_pct, trades before and after, reduction_pct). A
    change of the signal counts as a trade, so does the first bar."""
    marked = df.select("symbol", (F.col(output) != 0).alias("active"), changed(F.col(signal)).alias("a"), changed(F.col(output)).alias("b"))
    n = marked.groupBy("symbol").agg(
        F.count("*").alias("n_bars"), (F.avg(F.col("active").cast("double")) * 100).alias("active_pct"),
        F.count_if("a").alias("base_trades"), F.count_if("b").alias("gated_trades"))
    return n.withColumn("reduction_pct", (1 - F.col("gated_trades") / F.greatest(F.col("base_trades"), F.lit(1))) * 100)


def gate_set(rsi: float, zscore: float, macd: float, bb: float, trend: float = 0.06, width: float = 25.0) -> dict[str, tuple[str, tuple]]:
    """signal -> (gated column, its conditions), by the volatility percentiles of the four,
    the greatest annual trend and the percentile of the bands' width."""
    return {
        "signal_rsi": ("signal_rsi_vol_trend_gated", (VolPercentile(percentile=rsi), Trend(most=trend), Drawdown("signal_rsi", 0.15))),
        "signal_zscore": ("signal_zscore_vol_bb_gated", (VolPercentile(percentile=zscore), BandWidth(percentile=width), Drawdown("signal_zscore", 0.15))),
        "signal_macd": ("signal_macd_trend_gated", (VolPercentile(percentile=macd, mode="above"), TrendConfirmation("signal_macd"), Drawdown("signal_macd", 0.20))),
        "signal_bb": ("signal_bb_breakout_gated", (VolPercentile(percentile=bb, mode="above"), TrendConfirmation("signal_bb"), Drawdown("signal_bb", 0.20))),
    }


# A preset alone gates at its own percentiles, the ensemble at those of its pools.
PRESETS = gate_set(rsi=20, zscore=25, macd=50, bb=40)
ENSEMBLE = gate_set(rsi=20, zscore=20, macd=50, bb=50)


def statistics_for(gates: dict[str, tuple[str, tuple]]) -> list[Statistic]:
    return statistics_of([c for _, conditions in gates.values() for c in conditions])


def presets(df: DataFrame, gates: dict[str, tuple[str, tuple]] = PRESETS, also: tuple[Statistic, ...] = ()) -> DataFrame:
    """The gated columns of the signals that are there. Breakers and quantiles are made in
    one pass, with the statistics of ``also``, which stay."""
    present = {s: p for s, p in gates.items() if s in df.columns}
    own = order_statistics.missing(df, statistics_for(present))
    out = with_inputs(df, [c for _, cs in present.values() for c in cs if isinstance(c, Drawdown)], [*own, *also])
    for signal, (name, conditions) in present.items():
        out = gated(out, signal, list(conditions), name)
    return out.drop(*[s.name for s in own if s not in also])


def base_of(column: str, columns: list[str]) -> str | None:
    """The signal that a gated column comes from: its name up to the first condition."""
    base = re.split("_vol|_trend|_bb|_breakout", column, maxsplit=1)[0]
    return base if base in columns else None


def filter_stats(df: DataFrame) -> DataFrame:
    """(symbol, filtered_signal, original_signal, active_pct, n_trades, turnover,
    trade_reduction_pct) of every gated column and pool; turnover is changes a year, the
    first bar counts as one."""
    pools = ("signal_mr_pool", "signal_trend_pool", "signal_regime_adaptive")
    names = [c for c in df.columns if c.endswith(("_filtered", "_gated")) or c in pools]
    if not names:
        raise ValueError("no gated columns")
    each = [F.struct(F.lit(c).alias("filtered_signal"), F.lit(base_of(c, df.columns)).cast("string").alias("original_signal"), F.col(c).cast("int").alias("x"), (F.col(b) if (b := base_of(c, df.columns)) else F.lit(None)).cast("int").alias("y")) for c in names]
    long = df.select("symbol", "d", F.explode(F.array(*each)).alias("s")).select("symbol", "d", "s.filtered_signal", "s.original_signal", F.coalesce("s.x", F.lit(0)).alias("x"), F.coalesce("s.y", F.lit(0)).alias("y"))
    keys = ("symbol", "filtered_signal")
    told = long.withColumns({"a": changed(F.col("x"), keys).cast("double"), "b": changed(F.col("y"), keys).cast("double")})
    out = told.groupBy(*keys, "original_signal").agg((F.avg((F.col("x") != 0).cast("double")) * 100).alias("active_pct"), F.sum("a").cast("long").alias("n_trades"), (F.avg("a") * 252).alias("turnover"), F.sum("b").alias("before"))
    less = (1 - F.col("n_trades") / F.greatest(F.col("before"), F.lit(1.0))) * 100
    return out.withColumn("trade_reduction_pct", F.when(F.col("original_signal").isNotNull(), less)).drop("before")


CALM = Statistic("vol_21d", 252, 60, p=0.4)


def all_gates(df: DataFrame, point_in_time: bool = False, also: tuple[Statistic, ...] = (), gates: dict[str, tuple[str, tuple]] = ENSEMBLE) -> DataFrame:
    """The ensemble's gates of the signals that are there, a two-state label, the
    pools of mean-reverting and trending gated signals, and their switch."""
    out = presets(df, gates, (CALM, *also))
    low = F.col("vol_21d") < _bound(out, CALM, point_in_time)
    out = out.withColumn("regime_label2", F.when(_known(low), "range_bound").otherwise("trending")).drop(CALM.name)
    half = lambda a, b: sign((F.col(a) + F.col(b)) / 2)
    out = out.withColumns({"signal_mr_pool": half("signal_rsi_vol_trend_gated", "signal_zscore_vol_bb_gated"), "signal_trend_pool": half("signal_macd_trend_gated", "signal_bb_breakout_gated")})
    return out.withColumn("signal_regime_adaptive", F.when(F.col("regime_label2") == "range_bound", F.col("signal_mr_pool")).otherwise(F.col("signal_trend_pool")))
