"""Performance metrics of backtest curves and trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import changed, up_to_now
from .backtest import PAIR

YEAR = 252


#: A drawdown below this is the noise of sums of doubles: the equity is at its peak.
LEAST = 1e-12


def drawdown_runs(curve: DataFrame) -> DataFrame:
    """(symbol, signal, max_drawdown_days): longest run of bars under the peak."""
    under = (F.col("equity") < F.max("equity").over(up_to_now(PAIR)) * (1 - LEAST)).alias("under")
    marked = curve.select(*PAIR, "d", under)
    flagged = marked.withColumn("flip", changed(F.col("under"), PAIR).cast("int")).withColumn("run", F.sum("flip").over(up_to_now(PAIR)))
    runs = flagged.groupBy(*PAIR, "run").agg(F.count_if("under").alias("n"))
    return runs.groupBy(*PAIR).agg(F.max("n").cast("double").alias("max_drawdown_days"))


def of_curve(curve: DataFrame, rf_annual: float = 0.05) -> DataFrame:
    """Return, risk and tail metrics per (symbol, signal)."""
    rf = (1 + rf_annual) ** (1 / YEAR) - 1
    x, r = F.col("ret") - rf, F.col("ret")
    tail = F.percentile(r, F.lit(0.05)).over(Window.partitionBy(*PAIR))
    marked = curve.withColumns({"var": tail, "_peak": F.max("equity").over(up_to_now(PAIR))})
    dd = (F.col("equity") - F.col("_peak")) / F.nullif(F.col("_peak"), F.lit(0.0))
    first, last = F.min_by("equity", "d"), F.max_by("equity", "d")
    grown, n, std, low = F.product(1 + r), F.count(r), F.stddev_samp(x), F.stddev_samp(F.when(x < 0, x))
    cagr = F.when((n > 0) & (grown > 0), F.pow(grown, float(YEAR) / n) - 1).otherwise(0.0)
    agg = marked.groupBy(*PAIR).agg(
        F.when(F.count("*") >= 2, F.coalesce((last - first) / F.nullif(first, F.lit(0.0)), F.lit(0.0))).otherwise(0.0).alias("total_return"), cagr.alias("annual_return"),
        (F.stddev_samp(r) * F.sqrt(F.lit(float(YEAR)))).alias("annual_vol"),
        F.when(F.coalesce(std, F.lit(0.0)) < 1e-10, 0.0).otherwise(F.avg(x) / F.nullif(std, F.lit(0.0)) * F.sqrt(F.lit(float(YEAR)))).alias("sharpe"),
        F.coalesce(F.avg(x) / F.nullif(low, F.lit(0.0)) * F.sqrt(F.lit(float(YEAR))), F.lit(0.0)).alias("sortino"),
        F.min(dd).alias("max_drawdown"), F.coalesce(F.avg(F.when(dd < -LEAST, dd)), F.lit(0.0)).alias("avg_drawdown"), F.first("var").alias("var_95"),
        F.when(n > 20, F.avg(F.when(r <= F.col("var"), r))).otherwise(0.0).alias("cvar_95"), F.count("*").alias("n_bars"))
    return agg.withColumn("calmar", F.when(F.col("max_drawdown") == 0, F.lit(float("inf"))).otherwise(F.col("annual_return") / F.abs("max_drawdown")))


def of_trades(trades: DataFrame) -> DataFrame:
    p = F.col("pnl")
    won, lost = F.when(p > 0, p), F.when(p <= 0, p)
    zero = F.lit(0.0)
    losses = F.coalesce(F.sum(lost), zero)
    return trades.groupBy(*PAIR).agg(
        F.count("*").cast("double").alias("n_trades"), (F.count(won) / F.count("*")).alias("hit_rate"), F.coalesce(F.avg(won), zero).alias("avg_win"), F.coalesce(F.avg(lost), zero).alias("avg_loss"),
        F.when(losses != 0, F.coalesce(F.sum(won), zero) / F.nullif(F.abs(losses), zero)).otherwise(float("inf")).alias("profit_factor"),
        F.avg(F.col("holding_days").cast("double")).alias("avg_hold_days"), F.avg("pnl_pct").alias("avg_pnl_pct"), F.sum(F.col("entry_cost") + F.col("exit_cost")).alias("total_costs"))


def capm(curve: DataFrame, benchmark: DataFrame, rf_annual: float = 0.05) -> DataFrame:
    """(symbol, signal, alpha, beta, r2) against benchmark (d, benchmark). The
    covariance is the sample's, the variance the population's."""
    rf = (1 + rf_annual) ** (1 / YEAR) - 1
    both = curve.filter("ret is not null").join(benchmark.filter("benchmark is not null"), "d").select(*PAIR, (F.col("ret") - rf).alias("y"), (F.col("benchmark") - rf).alias("x"))
    sums = both.groupBy(*PAIR).agg(
        F.count("*").alias("n"), F.avg("y").alias("my"), F.avg("x").alias("mx"), F.covar_samp("y", "x").alias("cov"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("y", "x").alias("cp"))
    beta = F.coalesce(F.col("cov") / F.nullif(F.col("vx"), F.lit(0.0)), F.lit(0.0))
    alpha = F.col("my") - beta * F.col("mx")
    # mean square residual of y on beta x + alpha, from the moments
    rest = F.col("vy") - 2 * beta * F.col("cp") + beta * beta * F.col("vx")
    few = F.col("n") < 30
    return sums.select(*PAIR, F.when(few, 0.0).otherwise(F.pow(1 + alpha, float(YEAR)) - 1).alias("alpha"), F.when(few, 1.0).otherwise(beta).alias("beta"), F.when(few | (F.col("vy") == 0), 0.0).otherwise(1 - rest / F.nullif(F.col("vy"), F.lit(0.0))).alias("r2"))


COLUMNS = ["total_return", "annual_return", "annual_vol", "sharpe", "sortino", "calmar", "max_drawdown", "avg_drawdown", "max_drawdown_days", "n_trades", "hit_rate", "avg_win", "avg_loss", "profit_factor", "avg_hold_days", "avg_pnl_pct", "total_costs", "var_95", "cvar_95", "turnover", "alpha", "beta", "r2"]


def compute(curve: DataFrame, trades: DataFrame, benchmark: DataFrame | None = None, rf_annual: float = 0.05) -> DataFrame:
    """All 23 metrics per (symbol, signal)."""
    out = of_curve(curve, rf_annual).join(drawdown_runs(curve), list(PAIR)).join(of_trades(trades), list(PAIR), "left")
    names = ["n_trades", "hit_rate", "avg_win", "avg_loss", "profit_factor", "avg_hold_days", "avg_pnl_pct", "total_costs"]
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in names}).withColumn("turnover", F.col("n_trades") / F.col("n_bars") * float(YEAR))
    if benchmark is not None:
        out = out.join(capm(curve, benchmark, rf_annual), list(PAIR), "left")
    else:
        out = out.withColumns({"alpha": F.lit(0.0), "beta": F.lit(1.0), "r2": F.lit(0.0)})
    out = out.withColumns({"alpha": F.coalesce("alpha", F.lit(0.0)), "beta": F.coalesce("beta", F.lit(1.0)), "r2": F.coalesce("r2", F.lit(0.0))})
    return out.select(*PAIR, *COLUMNS)



