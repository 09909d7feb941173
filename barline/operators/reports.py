"""Comparisons and consolidated report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: base signal -> gated signal
PAIRS = {
    "signal_rsi": "signal_rsi_vol_trend_gated", "signal_zscore": "signal_zscore_vol_bb_gated", "signal_macd": "signal_macd_trend_gated",
    "signal_bb": "signal_bb_breakout_gated", "signal_ensemble": "signal_regime_adaptive"}
FEW_TRADES = 15


def gating_comparison(metrics: DataFrame, pairs: dict[str, str] = PAIRS) -> DataFrame:
    """Gated against ungated signals, with a verdict."""
    spark = metrics.sparkSession
    named = F.broadcast(spark.createDataFrame(list(pairs.items()), "base_signal string, gated_signal string"))  # a handful of rows
    cols = ["sharpe", "max_drawdown", "total_return", "n_trades"]
    base = metrics.select("symbol", F.col("signal").alias("base_signal"), *[F.col(c).alias(f"base_{c}") for c in cols])
    gated = metrics.select("symbol", F.col("signal").alias("gated_signal"), *[F.col(c).alias(f"gated_{c}") for c in cols])
    met = base.join(named, "base_signal").join(gated, ["symbol", "gated_signal"])
    delta = {f"{c}_delta": F.col(f"gated_{c}") - F.col(f"base_{c}") for c in cols[:3]}
    out = met.withColumns(delta).withColumns({
        "trade_reduction_pct": F.when(F.col("base_n_trades") > 0, (1 - F.col("gated_n_trades") / F.nullif(F.col("base_n_trades"), F.lit(0.0))) * 100).otherwise(0.0),
        "low_sample_size": F.col("gated_n_trades") < FEW_TRADES})
    better, worse, low = F.col("max_drawdown_delta") > 0.02, F.col("max_drawdown_delta") < -0.02, F.col("low_sample_size")
    verdict = (
        F.when(worse, "gating_hurt").when(low & better & (F.col("total_return_delta") > -0.02), "gating_helped_low_sample").when(low & better, "gating_helped_dd_only_low_sample")
        .when(low, "inconclusive_low_sample").when(better & (F.col("sharpe_delta") > -0.5), "gating_helped").when(better, "gating_helped_but_sharpe_cost").otherwise("inconclusive"))
    return out.withColumn("verdict", verdict)


def watchlist(metrics: DataFrame, signal: str = "signal_ensemble") -> DataFrame:
    """A signal's metrics across symbols, best Sharpe first."""
    return metrics.filter(F.col("signal") == signal).drop("signal").orderBy(F.desc("sharpe"), "symbol")


def comparison(metrics: DataFrame, digits: int = 4) -> DataFrame:
    """All signals, rounded, best Sharpe first within a symbol."""
    return metrics.select("symbol", "signal", *[F.round(c, digits).alias(c) for c in metrics.columns if c not in ("symbol", "signal")]).orderBy("symbol", F.desc("sharpe"), "signal")


def with_ticker(df: DataFrame, suffix: str) -> DataFrame:
    """The ticker of a row from the name of its file, ``<ticker><suffix>``."""
    return df.withColumn("ticker", F.regexp_extract(F.input_file_name(), r"([^/]+)" + suffix.replace(".", r"\.") + "$", 1)).withColumn("ticker", F.url_decode("ticker"))


def load_tables(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """The union of all tickers' CSV tables; columns that some lack are null."""
    return with_ticker(spark.read.csv(f"{folder}/*{suffix}", header=True, inferSchema=True), suffix)


def _documents(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(ticker, value): whole files. A report of a ticker is some kilobytes."""
    return with_ticker(spark.read.text(f"{folder}/*{suffix}", wholetext=True), suffix)


def regimes_of(documents: DataFrame) -> DataFrame:
    """(ticker, regime, signal, sharpe, pct_time_in_regime) of documents (ticker, value): maps
    by regime and signal, shares under ``pct_<regime>``. NaN is read as null."""
    parsed = F.from_json("value", "map<string,map<string,double>>")
    each = documents.select("ticker", parsed.alias("m")).select("ticker", "m", F.explode("m").alias("regime", "signals")).filter(~F.startswith("regime", F.lit("pct_")))
    by = each.select("ticker", "m", "regime", F.explode("signals").alias("signal", "sharpe"))
    share = F.try_element_at(F.try_element_at("m", F.concat(F.lit("pct_"), "regime")), F.col("signal"))
    known = lambda c: F.when(~F.isnan(c), c)
    return by.select("ticker", "regime", "signal", known(F.col("sharpe")).alias("sharpe"), known(share).alias("pct_time_in_regime"))


def load_regime_reports(spark: SparkSession, folder: str, suffix: str = "_regime_report.json") -> DataFrame:
    """``regimes_of`` of the files of a folder."""
    return regimes_of(_documents(spark, folder, suffix))


def flat_regressions(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined): rows (ticker, regressions) exploded, betas as columns;
    tickers without a single observation go to quarantine."""
    rows = raw.select("ticker", F.explode("regressions").alias("r")).select("ticker", "r.*")
    betas = [F.try_element_at("betas", F.lit(f)).alias(f"beta_{f}") for f in ("MKT", "SMB", "HML", "MOM")]
    flat = rows.select(*[c for c in rows.columns if c != "betas"], (F.col("n_obs") < 30).alias("low_sample_size"), *betas)
    empty = flat.groupBy("ticker").agg(F.max("n_obs").alias("most")).filter("most < 1").select("ticker")
    return flat.join(empty, "ticker", "left_anti"), flat.join(empty, "ticker", "left_semi").select("ticker").distinct()


REGRESSION = "struct<model:string,alpha_annual:double,alpha_daily:double,t_stat:double,p_value:double,significant:boolean,r2:double,adj_r2:double,ic:double,ir:double,n_obs:long,betas:map<string,double>>"


def regressions_of(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined) of factor report documents (ticker, value): regressions by signal,
    flattened to a row each with a column per beta."""
    parsed = F.from_json("value", f"struct<regressions:map<string,array<{REGRESSION}>>>")
    each = documents.select("ticker", F.explode(parsed["regressions"]).alias("signal", "list")).select("ticker", "signal", F.explode("list").alias("r"))
    return flat_regressions(each.groupBy("ticker").agg(F.collect_list(F.struct("signal", "r.*")).alias("regressions")))


def load_factor_reports(spark: SparkSession, folder: str, suffix: str = "_factor_report.json") -> tuple[DataFrame, DataFrame]:
    """``regressions_of`` of the files of a folder."""
    return regressions_of(_documents(spark, folder, suffix))


def load_rolling_alpha(spark: SparkSession, folder: str, suffix: str = "_rolling_alpha.csv") -> tuple[DataFrame, DataFrame]:
    """(rows, quarantined): the union of rolling tables with their ticker, the first
    column as the date; the tickers of files that hold a header alone."""
    lines = with_ticker(spark.read.text(f"{folder}/*{suffix}"), suffix)
    empty = lines.filter(F.length(F.trim("value")) > 0).groupBy("ticker").agg(F.count("*").alias("n")).filter("n < 2").select("ticker")
    read = spark.read.csv(f"{folder}/*{suffix}", header=True, inferSchema=True)
    return with_ticker(read.withColumnRenamed(read.columns[0], "date"), suffix), empty


def union_all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def regime_sharpe_long(performance: DataFrame) -> DataFrame:
    return performance.select(F.col("symbol").alias("ticker"), "regime", "signal", F.round("sharpe", 3).alias("sharpe"), F.round("pct", 3).alias("pct_time_in_regime"))
