"""What a run does, as one object that all stages read."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import costs
from ..operators import gates, learning, trees
from ..operators.backtest import Setup
from ..operators.signals import Rules

COSTS = {"zero": costs.ZERO, "liquid_equity": costs.LIQUID_EQUITY, "small_cap": costs.SMALL_CAP}
#: Calendar units of the intervals that daily bars can be put together to.
UNITS = {"1d": None, "1wk": "week", "1mo": "month", "3mo": "quarter"}


@dataclass(frozen=True)
class Plan:
    """The defaults are those of the registered queries."""

    start: str | None = None
    end: str | None = None
    symbols: tuple[str, ...] = ()
    interval: str = "1d"
    vol_windows: tuple[int, ...] = (5, 21, 63)
    z_windows: tuple[int, ...] = (20, 60)
    band: tuple[int, float] = (20, 2.0)
    rules: Rules = Rules()
    method: str = "majority_vote"
    scale: tuple[float, float] = (0.0, 2.0)
    gates: dict = field(default_factory=lambda: gates.ENSEMBLE, hash=False)
    setup: Setup = Setup()
    rf_annual: float = 0.05

    def bars(self, walked: DataFrame) -> DataFrame:
        """The bars of the chosen symbols in [start, end), by the interval."""
        if self.interval not in UNITS:
            raise ValueError(f"the tables hold daily bars: interval {self.interval!r} is none of {', '.join(UNITS)}")
        out = walked
        if self.symbols:
            out = out.filter(F.col("symbol").isin(list(self.symbols)))
        if self.start:
            out = out.filter(F.col("d") >= F.lit(self.start).cast("date"))
        if self.end:
            out = out.filter(F.col("d") < F.lit(self.end).cast("date"))
        unit = UNITS[self.interval]
        if unit is None:
            return out
        return out.groupBy("symbol", F.trunc("d", unit).alias("first")).agg(
            F.min_by("open", "d").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "d").alias("close"), F.sum("volume").alias("volume")).withColumnRenamed("first", "d")

    @property
    def step(self) -> str:
        return {"1d": "interval 1 day", "1wk": "interval 7 days", "1mo": "interval 1 month", "3mo": "interval 3 months"}[self.interval]


@dataclass(frozen=True)
class Learned:
    """How the learned signal is made."""

    model: str | trees.Trees = "xgboost"
    target: str = "returns_fwd_5"
    deadband: float = 0.005
    folds: learning.Folds = learning.Folds()


def learned_of(made: dict[str, Any]) -> Learned | None:
    """The learned signal of settings, or None where it is off."""
    told = made.get("ml_signal") or {}
    if not told.get("enabled", False):
        return None
    own = learning.Folds()
    folds = learning.Folds(
        n_folds=int(told.get("n_folds", own.n_folds)), min_train=int(told.get("min_train_bars", own.min_train)), test=int(told.get("test_bars", own.test)),
        expanding=bool(told.get("expanding", own.expanding)), train_window=int(told.get("train_window_bars", own.train_window)), embargo=int(told.get("embargo_bars", own.embargo)))
    model = str(told.get("model_type", "xgboost"))
    if model not in trees.MODELS:
        raise ValueError(f"unknown model {model!r}; there are {', '.join(trees.MODELS)}")
    return Learned(model, str(told.get("target_col", "returns_fwd_5")), float(told.get("deadband", 0.005)), folds)


def plan_of(made: dict[str, Any]) -> Plan:
    """The plan of settings as ``config.load`` gives them: sections that are absent leave
    the defaults."""
    signals, features, told, back = (made.get(k) or {} for k in ("signals", "features", "regime_filter", "backtest"))
    rsi, z, bands, hold = (signals.get(k) or {} for k in ("rsi", "zscore", "bollinger", "holding"))
    own = Rules()
    rules = replace(
        own, oversold=float(rsi.get("oversold", own.oversold)), overbought=float(rsi.get("overbought", own.overbought)), rsi_exit=float(rsi.get("exit", own.rsi_exit)), smoothing=int(rsi.get("smoothing", own.smoothing)),
        z_entry=float(z.get("entry_threshold", own.z_entry)), z_exit=float(z.get("exit_threshold", own.z_exit)), z_window=int(z.get("window", own.z_window)),
        squeeze_percentile=float(bands.get("squeeze_percentile", own.squeeze_percentile)), bb_max_holding=int(bands.get("max_holding_bars", own.bb_max_holding)),
        min_holding=int(hold.get("min_bars", own.min_holding)), max_holding=int(hold.get("max_bars", own.max_holding)))
    vol, zs = config.needed_windows(made)
    band = features.get("bollinger") or {}
    model = str(back.get("cost_model", "liquid_equity"))
    if model not in COSTS:
        raise ValueError(f"unknown cost model {model!r}; there are {', '.join(COSTS)}")
    base = Setup()
    limit = back.get("max_drawdown_exit")
    setup = replace(
        base, capital=float(back.get("initial_capital", base.capital)), notional=float(back.get("target_notional", base.notional)), sizing=str(back.get("position_sizing", base.sizing)),
        vol_target=float(back.get("vol_target", base.vol_target)), costs=COSTS[model], max_drawdown_exit=None if limit is None else float(limit))
    low = told.get("vol_percentile", 20.0)
    gated = gates.gate_set(rsi=low, zscore=low, macd=50, bb=50, trend=float(told.get("max_trend_annual", 0.06)), width=float(told.get("bb_percentile", 25.0)))
    scale = signals.get("vol_scale") or {}
    return Plan(
        start=made.get("start"), end=made.get("end"), symbols=tuple(made.get("symbols") or ()), interval=made.get("interval") or "1d", vol_windows=vol, z_windows=zs,
        band=(int(band.get("window", 20)), float(band.get("num_std", 2.0))), rules=rules, method=str((signals.get("ensemble") or {}).get("method", "majority_vote")),
        scale=(float(scale.get("floor", 0.0)), float(scale.get("ceiling", 2.0))), gates=gated, setup=setup, rf_annual=float((made.get("factor") or {}).get("rf_annual", 0.05)))
