"""Backtests of every (symbol, signal) pair in one plan.

Signals are unpivoted to rows, so all pairs share the same windows and one shuffle,
and there are as many groups as pairs. The event-driven engine, whose sizes depend
on its own cash, is a kernel on the same groups.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.costs import LIQUID_EQUITY, Costs
from ..functions.windows import ordered, require, up_to_now
from .kernels import event_engine

PAIR = ("symbol", "signal")


@dataclass(frozen=True)
class Setup:
    capital: float = 100_000.0
    sizing: str = "fixed_notional"
    notional: float = 100_000.0
    vol_target: float = 0.10
    costs: Costs = field(default=LIQUID_EQUITY)
    max_drawdown_exit: float | None = None
    breaker_mode: str = "reference"
    fill: str = "open"


def signal_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("signal_") and not c.endswith("_strength")]


def unpivoted(df: DataFrame, signals: list[str] | None = None) -> DataFrame:
    """(symbol, d, signal, value, scale, bar columns): the adaptive signal uses
    its own scale."""
    signals = signals or signal_columns(df)
    require(df, "symbol", "d", "close", "volume", *signals)
    base = F.col("position_scale") if "position_scale" in df.columns else F.lit(1.0)
    own = F.col("position_scale_adaptive") if "position_scale_adaptive" in df.columns else base
    bars = ["symbol", "d", "open", "high", "low", "close", "volume", "vol_21d"]
    vol = F.col("vol_21d") if "vol_21d" in df.columns else F.lit(None).cast("double")
    wide = df.select(*bars[:-1], vol.alias("vol_21d"), base.alias("_scale"), own.alias("_own"), *[F.col(s).cast("int").alias(s) for s in signals])
    long = wide.unpivot([*bars, "_scale", "_own"], signals, "signal", "value")
    return long.select(*bars, "signal", "value", F.when(F.col("signal") == "signal_adaptive", F.col("_own")).otherwise(F.col("_scale")).alias("scale"))


def _size(s: Setup, has_vol: bool = True) -> Column:
    price = F.nullif(F.col("close"), F.lit(0.0))
    if s.sizing == "fixed_shares":
        return F.lit(100.0)
    if s.sizing == "vol_target" and has_vol:
        vol = F.coalesce(F.nullif(F.col("vol_21d"), F.lit(0.0)), F.lit(0.02)) * F.sqrt(F.lit(252.0))
        return s.capital * s.vol_target / F.greatest(vol, F.lit(0.01)) / price
    if s.sizing in ("fixed_notional", "vol_target"):
        return s.notional / price
    raise ValueError(f"unknown sizing {s.sizing!r}")


def curve(long: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """Positions, costs and equity per bar. The signal of a bar is held over the
    next one."""
    w, run = ordered(PAIR), up_to_now(PAIR)
    lag = lambda c, none: F.coalesce(F.lag(c).over(w), F.lit(none))
    value, scale = F.coalesce(F.col("value"), F.lit(0)), F.coalesce(F.col("scale"), F.lit(1.0))
    held = long.withColumns({"position": lag(value, 0), "held_scale": lag(scale, 1.0)})
    held = held.withColumn("shares", F.coalesce(F.col("position") * F.col("held_scale") * _size(setup), F.lit(0.0)))
    moved = held.withColumn("delta_shares", F.col("shares") - F.coalesce(F.lag("shares").over(w), F.lit(0.0)))
    moved = moved.withColumn("cost", F.when(F.col("delta_shares") != 0, setup.costs.column(F.col("close"), F.col("delta_shares"), F.col("volume"))).otherwise(0.0))
    moved = moved.withColumn("move", F.coalesce(F.col("close") - F.lag("close").over(w), F.lit(0.0)))
    out = moved.withColumn("pnl", F.col("shares") * F.col("move") - F.col("cost")).withColumn("equity", setup.capital + F.sum("pnl").over(run))
    if setup.max_drawdown_exit is not None:
        out = _broken(out, setup)
    before = F.coalesce(F.lag("equity").over(w), F.lit(setup.capital))
    out = out.withColumns({"ret": F.col("pnl") / F.nullif(before, F.lit(0.0)), "peak": F.max("equity").over(run)})
    return out.withColumn("drawdown", (F.col("equity") - F.col("peak")) / F.nullif(F.col("peak"), F.lit(0.0))).drop("held_scale", "move")


def _broken(out: DataFrame, setup: Setup) -> DataFrame:
    """The one-shot breaker. ``reference``: no shares from the breach on, it
    included, and costs as they were; ``strict``: flat from the bar after it, and
    costs follow."""
    w, run, pair = ordered(PAIR), up_to_now(PAIR), Window.partitionBy(*PAIR)
    peak = F.max("equity").over(run)
    out = out.withColumn("breach", (F.col("equity") - peak) / F.nullif(peak, F.lit(0.0)) < -setup.max_drawdown_exit)
    first = F.min(F.when(F.col("breach"), F.col("d"))).over(pair)
    out = out.withColumn("first_breach", first)
    reference = setup.breaker_mode == "reference"
    stopped = F.coalesce(F.col("d") >= F.col("first_breach") if reference else F.col("d") > F.col("first_breach"), F.lit(False))
    out = out.withColumn("shares", F.when(stopped, 0.0).otherwise(F.col("shares")))
    if not reference:
        out = out.withColumn("delta_shares", F.col("shares") - F.coalesce(F.lag("shares").over(w), F.lit(0.0)))
        out = out.withColumn("cost", F.when(F.col("delta_shares") != 0, setup.costs.column(F.col("close"), F.col("delta_shares"), F.col("volume"))).otherwise(0.0))
    out = out.withColumn("pnl", F.col("shares") * F.col("move") - F.col("cost"))
    return out.withColumn("equity", setup.capital + F.sum("pnl").over(run)).drop("breach", "first_breach")


def trades(bars: DataFrame) -> DataFrame:
    """Round trips from the positions of ``curve``: runs of one side. A reversal
    is charged to the leg it closes; what is open at the end closes at no cost."""
    w = ordered(PAIR)
    before = F.coalesce(F.lag("position").over(w), F.lit(0))
    turn = (F.col("position") != before) | F.lag("position").over(w).isNull()
    marked = bars.withColumns({
        "turn": turn.cast("int"), "reversal": before != 0, "next_d": F.lead("d").over(w), "next_price": F.lead("close").over(w), "next_cost": F.lead("cost").over(w)})
    marked = marked.withColumn("run", F.sum("turn").over(up_to_now(PAIR))).filter("position <> 0")
    first, last = (lambda c: F.min_by(c, "d")), (lambda c: F.max_by(c, "d"))
    found = marked.groupBy(*PAIR, "run").agg(
        F.min("d").alias("entry_d"), F.coalesce(last("next_d"), F.max("d")).alias("exit_d"), first("position").alias("direction"), first("close").alias("entry_price"),
        F.coalesce(last("next_price"), last("close")).alias("exit_price"), F.abs(first("shares")).alias("shares"),
        F.when(first("reversal"), 0.0).otherwise(first("cost")).alias("entry_cost"), F.coalesce(last("next_cost"), F.lit(0.0)).alias("exit_cost"))
    pnl = F.col("direction") * (F.col("exit_price") - F.col("entry_price")) * F.col("shares") - F.col("entry_cost") - F.col("exit_cost")
    notional = F.col("entry_price") * F.col("shares")
    done = found.drop("run").withColumn("pnl", pnl)
    return done.withColumns({"pnl_pct": F.when(notional > 0, F.col("pnl") / notional).otherwise(0.0), "holding_days": F.date_diff(F.col("exit_d").cast("date"), F.col("entry_d").cast("date"))})


CURVE = "symbol string, signal string, d date, position int, shares double, cost double, equity double, ret double, close double"
TRADES = "symbol string, signal string, entry_d date, exit_d date, direction int, entry_price double, exit_price double, shares double, entry_cost double, exit_cost double, pnl double, pnl_pct double, holding_days int"


def event_driven(long: DataFrame, setup: Setup = Setup(), want: str = "curve") -> DataFrame:
    """The bar-by-bar engine: orders of a bar fill on the next one. ``want`` is
    'curve' or 'trades'."""
    told = {"capital": setup.capital, "sizing": setup.sizing, "notional": setup.notional, "vol_target": setup.vol_target, "fill": setup.fill}
    costs = setup.costs.values()

    def run(key: tuple, bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("d")
        num = lambda c: bars[c].to_numpy(float, na_value=np.nan)
        vol = num("vol_21d")
        rows, done = event_engine(num("open"), num("high"), num("low"), num("close"), num("volume"), num("value"), num("scale"), None if np.isnan(vol).all() else vol, told, costs)
        days = bars["d"].tolist()
        if want == "curve":
            return pd.DataFrame(rows).assign(symbol=key[0], signal=key[1], d=days, close=num("close"))[["symbol", "signal", "d", "position", "shares", "cost", "equity", "ret", "close"]]
        out = []
        for t in done:
            pnl = t["direction"] * (t["exit_price"] - t["entry_price"]) * t["shares"] - t["entry_cost"] - t["exit_cost"]
            notional = t["entry_price"] * t["shares"]
            a, b = days[t["entry"]], days[t["exit"]]
            out.append((key[0], key[1], a, b, t["direction"], t["entry_price"], t["exit_price"], t["shares"], t["entry_cost"], t["exit_cost"], pnl, pnl / notional if notional > 0 else 0.0, (b - a).days))
        return pd.DataFrame(out, columns=[c.split()[0] for c in TRADES.split(", ")])

    return long.groupBy(*PAIR).applyInPandas(run, CURVE if want == "curve" else TRADES)


def both_engines(long: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """Curves of both engines with an ``engine`` column."""
    keep = ["symbol", "signal", "d", "position", "equity", "ret"]
    a = curve(long, setup).select(*keep, F.lit("vectorised").alias("engine"))
    return a.unionByName(event_driven(long, setup).select(*keep, F.lit("event_driven").alias("engine")))


def with_costs(setup: Setup, costs: Costs) -> Setup:
    return replace(setup, costs=costs)
