"""The stages of the engine over the driver tables, each from the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtest, clean, factors, features, gates, metrics, regimes, signals
from ..sources import bars
from .settings import Plan

TRADED = [
    "signal_rsi", "signal_macd", "signal_zscore", "signal_bb", "signal_ensemble", "signal_rsi_vol_trend_gated", "signal_zscore_vol_bb_gated",
    "signal_macd_trend_gated", "signal_bb_breakout_gated", "signal_mr_pool", "signal_trend_pool", "signal_regime_adaptive", "signal_adaptive"]


EVERY = Plan()


def walk(spark: SparkSession, sf: str, plan: Plan = EVERY) -> DataFrame:
    return plan.bars(bars.bars_walk(spark, sf))


def cleaned(spark: SparkSession, sf: str, plan: Plan = EVERY) -> DataFrame:
    return clean.clean(walk(spark, sf, plan), step=plan.step)


def features_of(bars_: DataFrame, plan: Plan = EVERY) -> DataFrame:
    return features.all_features(bars_, vol=plan.vol_windows, z=plan.z_windows, band=plan.band)


def featured(spark: SparkSession, sf: str, plan: Plan = EVERY) -> DataFrame:
    return features_of(cleaned(spark, sf, plan), plan)


def signals_of(featured_: DataFrame, plan: Plan = EVERY) -> DataFrame:
    return signals.all_signals(featured_, plan.rules, plan.method, scale=plan.scale)


def signalled(spark: SparkSession, sf: str, plan: Plan = EVERY) -> DataFrame:
    return signals_of(featured(spark, sf, plan), plan)


def gates_of(signalled_: DataFrame, plan: Plan = EVERY) -> DataFrame:
    """Gated signals, with the rank that the regimes take from the same pass."""
    return gates.all_gates(signalled_, also=(regimes.volatility_rank(),), gates=plan.gates)


def gated(spark: SparkSession, sf: str, plan: Plan = EVERY) -> DataFrame:
    return gates_of(signalled(spark, sf, plan), plan)


def preset_gated(spark: SparkSession, sf: str) -> DataFrame:
    """Each preset alone, at its own percentiles."""
    return gates.presets(signalled(spark, sf))


def detected(spark: SparkSession, sf: str, plan: Plan = EVERY) -> DataFrame:
    return regimes.adaptive(regimes.classify(gated(spark, sf, plan)))


def longs(spark: SparkSession, sf: str, plan: Plan = EVERY) -> DataFrame:
    return backtest.unpivoted(detected(spark, sf, plan), TRADED)


def curve(spark: SparkSession, sf: str, setup: backtest.Setup | None = None, plan: Plan = EVERY) -> DataFrame:
    return backtest.curve(longs(spark, sf, plan), setup or plan.setup)


def trades(spark: SparkSession, sf: str) -> DataFrame:
    return backtest.trades(curve(spark, sf))


def performance(spark: SparkSession, sf: str, plan: Plan = EVERY) -> DataFrame:
    return performance_of(curve(spark, sf, plan=plan))


def performance_of(c: DataFrame) -> DataFrame:
    """All metrics of a curve; infinite ratios as null, so that tables of them compare."""
    m = metrics.compute(c, backtest.trades(c))
    finite = lambda x: F.when(F.abs(x) != float("inf"), F.col(x))
    return m.withColumns({"calmar": finite("calmar"), "profit_factor": finite("profit_factor")})


def market(spark: SparkSession, sf: str) -> DataFrame:
    return bars.factors_walk(spark, sf)


def excess(spark: SparkSession, sf: str, plan: Plan = EVERY) -> DataFrame:
    return factors.excess_returns(curve(spark, sf, plan=plan), market(spark, sf), plan.rf_annual)


def market_performance(spark: SparkSession, sf: str, plan: Plan = EVERY) -> DataFrame:
    """Performance of every pair by the market's regime."""
    return factors.performance_by_regime(curve(spark, sf, plan=plan), factors.market_regimes(market(spark, sf)))


def directory(spark: SparkSession, sf: str) -> DataFrame:
    """A ticker directory of the parts table."""
    p = bars.table(spark, sf, "part")
    return p.select(F.col("p_partkey").cast("string").alias("symbol"), F.col("p_name").alias("name"), F.col("p_brand").alias("sector"), F.col("p_type").alias("industry"))
