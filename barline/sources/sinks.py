"""What a run writes, and the consolidated tables that are rebuilt from it.

Layout: ``<folder>/<output>/interval=<i>/symbol=<s>/``. A run of all symbols replaces an
output's interval; a run of named symbols replaces those symbols' partitions alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import reports

FORMATS = ("csv", "parquet", "json", "excel")
#: Rows that a sheet holds; what goes into one is collected.
SHEET_ROWS = 1_048_575


def write(df: DataFrame, path: str, fmt: str = "csv", by: tuple[str, ...] = ()) -> None:
    """A table as csv (with a header), parquet or json, or as a sheet of its own."""
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r} is none of {FORMATS}")
    if fmt == "excel":
        write_sheets({"table": df}, path)
        return
    out = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        out = out.option("header", True)
    (out.partitionBy(*by) if by else out).save(path)


def sheet_name(name: str, taken: set[str]) -> str:
    """A name that a sheet may have: 31 characters, none of those it may not, and not twice."""
    clean = re.sub(r"[\[\]:*?/\\]", "_", name)[:31] or "table"
    k, out = 1, clean
    while out.lower() in taken:
        k += 1
        out = f"{clean[: 31 - len(str(k)) - 1]}~{k}"
    taken.add(out.lower())
    return out


def write_sheets(tables: dict[str, DataFrame], path: str) -> None:
    """Report tables as the sheets of one file. Needs openpyxl."""
    try:
        import openpyxl  # noqa: F401
        import pandas as pd
    except ImportError as missing:
        raise ImportError("spreadsheets need openpyxl") from missing
    taken: set[str] = set()
    with pd.ExcelWriter(path, engine="openpyxl") as book:
        for name, df in tables.items():
            if len(df.take(SHEET_ROWS + 1)) > SHEET_ROWS:
                raise ValueError(f"{name} has more rows than a sheet holds: write it as csv or parquet")
            df.toPandas().to_excel(book, sheet_name=sheet_name(name, taken), index=False)


def rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


def factor_report(regressed: DataFrame, table: DataFrame) -> DataFrame:
    """(symbol, document): a JSON document per symbol, with its regressions by signal and
    the rows of the attribution table. A symbol has a few dozen regressions."""
    digits = {"alpha_annual": 6, "alpha_daily": 8, "t_stat": 4, "p_value": 6, "r2": 4, "adj_r2": 4, "ic": 4, "ir": 4}
    told = [F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in ("model", "alpha_annual", "alpha_daily", "t_stat", "p_value", "significant", "r2", "adj_r2", "ic", "ir", "n_obs")]
    betas = F.transform_values(F.transform_keys("betas", lambda k, _: F.upper(k)), lambda _, v: F.round(v, 4)).alias("betas")
    lists = regressed.groupBy("symbol", "signal").agg(F.collect_list(F.struct(*told, betas)).alias("all"))
    lists = lists.withColumn("all", F.array_sort("all", lambda x, y: F.when(x["model"] < y["model"], -1).when(x["model"] > y["model"], 1).otherwise(0)))
    by = lists.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("signal", "all"))).alias("regressions"))
    rows = table.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct(*[c for c in table.columns if c != "symbol"]))).alias("attribution_table"))
    whole = by.join(rows, "symbol", "left")
    return whole.select("symbol", F.to_json(F.struct(F.col("symbol").alias("ticker"), "regressions", "attribution_table")).alias("document"))


def regime_report(performance: DataFrame) -> DataFrame:
    """(symbol, document): Sharpe by regime and signal, and the share of bars by
    ``pct_<regime>`` and signal."""
    entries = lambda value, digits: F.map_from_entries(F.collect_list(F.struct("signal", F.round(value, digits).alias("x"))))
    by = performance.groupBy("symbol", "regime").agg(entries("sharpe", 3).alias("sharpe"), entries("pct", 4).alias("pct"))
    each = by.select("symbol", F.explode(F.array(F.struct(F.col("regime").alias("name"), F.col("sharpe").alias("m")), F.struct(F.concat(F.lit("pct_"), "regime").alias("name"), F.col("pct").alias("m")))).alias("e"))
    # signals without a figure stay, as nulls
    return each.groupBy("symbol").agg(F.to_json(F.map_from_entries(F.collect_list("e")), {"ignoreNullFields": "false"}).alias("document"))


def _shape(c: str) -> list:
    """Sample skewness and excess kurtosis, corrected for bias; null under 3 and 4 values."""
    n = F.count(c).cast("double")
    over = lambda x: F.nullif(F.greatest(x, F.lit(0.0)), F.lit(0.0))
    skew = F.skewness(c) * F.sqrt(over(n * (n - 1))) / over(n - 2)
    kurt = (n - 1) / over((n - 2) * F.greatest(n - 3, F.lit(0.0))) * ((n + 1) * F.kurtosis(c) + 6)
    return [F.round(skew, 4).alias("skew"), F.round(kurt, 4).alias("kurt")]


def quality_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(symbol, n_bars, first, last, columns): missing share, mean, deviation, shape and
    quartiles of each column, a document per symbol."""
    quartiles = lambda c: F.percentile(c, F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
    named = lambda c: [F.round(F.get(quartiles(c), F.lit(i)), 6).alias(k) for i, k in enumerate(("min", "q25", "median", "q75", "max"))]
    stats = [F.struct(F.lit(c).alias("column"), F.round(F.count_if(F.col(c).isNull()) / F.count("*") * 100, 4).alias("missing_pct"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("std"), *_shape(c), *named(c)) for c in columns]
    return df.groupBy("symbol").agg(F.count("*").alias("n_bars"), F.min("d").alias("first"), F.max("d").alias("last"), F.array(*stats).alias("columns"))


def _drop_partition(spark: SparkSession, path: str, symbol: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/symbol={jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(symbol)}")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_by_symbol(df: DataFrame, path: str, fmt: str, symbols: tuple[str, ...] = ()) -> None:
    """A partition per symbol. With symbols named, only theirs are replaced; those of them
    that have no rows any more lose their partition after the others are written."""
    # a task's rows go to few partitions, and a long symbol may be split over tasks
    out = df.hint("rebalance", "symbol").write.mode("overwrite").format(fmt).partitionBy("symbol")
    if fmt == "csv":
        out = out.option("header", True)
    out.option("partitionOverwriteMode", "dynamic" if symbols else "static").save(path)
    if symbols:
        # no other column is made for this; at most the named symbols come back
        found = {r["symbol"] for r in df.filter(F.col("symbol").isin(list(symbols))).select("symbol").distinct().collect()}
        for s in sorted(set(symbols) - found):
            _drop_partition(df.sparkSession, path, s)


def write_run(outputs: dict[str, Callable[[], DataFrame]], folder: str, fmt: str = "csv", interval: str = "1d", symbols: tuple[str, ...] = ()) -> list[str]:
    """Writes each output into its folder; documents are always text, nested tables json.
    The names of those written, in order."""
    for name, make in outputs.items():
        df, at = make(), f"{folder}/{name}/interval={interval}"
        nested = any(kind.startswith(("array", "map", "struct")) for _, kind in df.dtypes)
        kind = "text" if set(df.columns) == {"symbol", "document"} else "json" if nested else fmt
        if "symbol" in df.columns:
            write_by_symbol(df, at, kind, symbols)
        else:
            write(df, at, kind)
    return list(outputs)


def read_run(spark: SparkSession, folder: str, name: str, interval: str = "1d", fmt: str = "csv") -> DataFrame | None:
    """An output as it was written, symbols as strings; None where none is there."""
    at = f"{folder}/{name}/interval={interval}"
    try:
        reader = spark.read.format(fmt).option("header", True)
        found = reader.option("inferSchema", True).load(at).schema
    except AnalysisException as absent:
        if absent.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    for f in found.fields:
        if f.name in ("symbol", "signal"):  # else a symbol of digits is read as a number
            f.dataType = T.StringType()
    return spark.read.format(fmt).option("header", True).schema(found).load(at)


def read_documents(spark: SparkSession, folder: str, name: str, interval: str = "1d") -> DataFrame | None:
    """(ticker, value): the documents of an output; None where no symbol has one."""
    at = f"{folder}/{name}/interval={interval}"
    try:
        if "symbol" not in spark.read.text(at).columns:
            return None
    except AnalysisException as absent:
        if absent.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return spark.read.schema("value string, symbol string").text(at).select(F.col("symbol").alias("ticker"), "value")


#: Consolidated table -> the output that it is the union of.
CONSOLIDATED = {
    "backtest_results": "backtest", "gating_comparison": "gating_comparison", "rolling_alpha": "rolling_alpha",
    "ml_fold_report": "ml_folds", "ml_threshold_sweep": "ml_thresholds"}


def consolidated(spark: SparkSession, folder: str, interval: str = "1d", fmt: str = "csv") -> dict[str, DataFrame]:
    """The tables over all tickers from what runs have written, with the ticker first, and
    ``quarantined`` (ticker, output): tickers with a backtest whose factor report has no
    observation or whose rolling table has no row. Tables of outputs that are not there are
    left out."""
    out, tickers = {}, None
    for name, output in CONSOLIDATED.items():
        df = read_run(spark, folder, output, interval, fmt)
        if df is not None:
            out[name] = df.select(F.col("symbol").alias("ticker"), *[c for c in df.columns if c != "symbol"])
    if "backtest_results" in out:
        tickers = out["backtest_results"].select("ticker").distinct()
    lost = []
    if (docs := read_documents(spark, folder, "regime_report", interval)) is not None:
        out["regime_sharpe"] = reports.regimes_of(docs)
    if (docs := read_documents(spark, folder, "factor_report", interval)) is not None:
        out["factor_attribution"], empty = reports.regressions_of(docs)
        lost.append(empty.select("ticker", F.lit("factor_report").alias("output")))
        if tickers is not None:
            rolling = out["rolling_alpha"].select("ticker") if "rolling_alpha" in out else tickers.limit(0)
            lost.append(tickers.join(rolling, "ticker", "left_anti").select("ticker", F.lit("rolling_alpha").alias("output")))
    if lost:
        out["quarantined"] = reports.union_all(lost)
    return out


def consolidate(spark: SparkSession, folder: str, to: str, interval: str = "1d", fmt: str = "csv") -> list[str]:
    """Rebuilds the consolidated tables as CSV under ``to``; the names of those written."""
    made = consolidated(spark, folder, interval, fmt)
    for name, df in made.items():
        write(df, f"{to}/{name}")
    return list(made)


def add_to_watchlist(text: str, symbols: list[str]) -> str:
    """The text of a settings file with symbols added to its ``watchlist`` block.
    Comments, line ends and all other lines stay; symbols that YAML would read as
    something else are quoted, those that are there are not added again."""
    end = "\r\n" if "\r\n" in text else "\n"
    lines = text.split(end)
    head = next((i for i, x in enumerate(lines) if re.match(r"watchlist\s*:\s*(#.*)?$", x)), None)
    if head is None:
        lines = [*(lines[:-1] if lines[-1] == "" else lines), "watchlist:", ""]
        head = len(lines) - 2
    last, indent, there = head, "  ", set()
    for i in range(head + 1, len(lines)):
        item = re.match(r"(\s*)-\s*(?:\"([^\"]*)\"|'([^']*)'|([^#\s]+))", lines[i])
        if item:
            last, indent = i, item[1]
            there.add(next(g for g in item.groups()[1:] if g is not None).upper())
        elif lines[i].strip() and not lines[i].lstrip().startswith("#"):
            break
    new = [s for s in dict.fromkeys(x.strip().upper() for x in symbols) if s and s not in there]
    plain = lambda s: re.fullmatch(r"[A-Z][A-Z0-9._-]*", s) and s not in ("ON", "OFF", "YES", "NO", "TRUE", "FALSE", "NULL", "Y", "N")
    return end.join([*lines[: last + 1], *[f"{indent}- {s if plain(s) else chr(34) + s + chr(34)}" for s in new], *lines[last + 1 :]])
