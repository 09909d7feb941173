"""Bars from files and from event tables: (symbol, d, open, high, low, close, volume)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INTERVALS = ("1m", "2m", "5m", "15m", "30m", "60m", "90m", "1h", "1d", "5d", "1wk", "1mo", "3mo")  # fixed values
BAR = ["symbol", "d", "open", "high", "low", "close", "volume"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order prices, a symbol per priority; days without orders are gaps."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("date").alias("d")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count("*").cast("double").alias("volume"))


def _walk(daily: DataFrame) -> DataFrame:
    """Bars of a random walk from daily averages (symbol, d, ap, n)."""
    whole = Window.partitionBy("symbol")
    running = whole.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    r = 0.02 * (F.col("ap") / F.avg("ap").over(whole) - 1)
    walk = daily.withColumn("r", r).withColumn("close", F.round(100 * F.exp(F.sum("r").over(running)), 6))
    walk = walk.withColumn("open", F.coalesce(F.lag("close").over(whole.orderBy("d")), F.col("close")))
    wide = 1 + F.col("n") % 3
    # prices are whole millionths, rounded by a sum and a floor that any engine repeats exactly
    micro = lambda x: F.floor(x * 1e6 + 0.5) / 1e6
    return walk.select(
        "symbol", "d", "open", micro(F.greatest("open", "close") * (1 + 0.005 * wide)).alias("high"),
        micro(F.least("open", "close") * (1 - 0.005 * wide)).alias("low"), "close", (1000.0 * F.col("n")).alias("volume"))


def bars_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return _walk(o.groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("date").alias("d")).agg(F.avg("o_totalprice").alias("ap"), F.count("*").alias("n")))


def bars_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As bars_walk with a symbol per supplier: grows with the scale factor. Nearly every row
    is a day of its own, so rows go to their symbol at once, in the one shuffle there is."""
    x = table(spark, sf_dir, "lineitem")
    x = x.select(F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_shipdate").cast("date").alias("d"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    return _walk(x.repartition("symbol").groupBy("symbol", "d").agg(F.avg("p").alias("ap"), F.count("*").alias("n")))


def bars_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of event values, a symbol per event type."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("d")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").cast("double").alias("volume"))


def factors_walk(spark: SparkSession, sf_dir: str, rf_annual: float = 0.05) -> DataFrame:
    """Daily factors (d, mkt, smb, hml, mom, rf): the mean return of all symbols,
    and differences of two symbols' returns."""
    w = Window.partitionBy("symbol").orderBy("d")
    r = bars_walk(spark, sf_dir).withColumn("r", F.col("close") / F.lag("close").over(w) - 1)
    by_day = r.groupBy("d").pivot("symbol", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]).agg(F.first("r"))
    u, h, m, n, x = (F.col(f"`{c}`") for c in by_day.columns[1:])
    rf = (1 + rf_annual) ** (1 / 252) - 1
    return by_day.dropna().select("d", ((u + h + m + n + x) / 5 - rf).alias("mkt"), (u - h).alias("smb"), (m - n).alias("hml"), (x - u).alias("mom"), F.lit(rf).alias("rf"))


def fetch(bars: DataFrame, symbols: list[str], start: str, end: str, interval: str = "1d") -> DataFrame:
    """The bars of some symbols in [start, end); filters reach the scan."""
    if interval not in INTERVALS:
        raise ValueError(f"interval {interval!r} is none of {INTERVALS}")
    return bars.filter(F.col("symbol").isin(symbols) & (F.col("d") >= F.lit(start).cast("date")) & (F.col("d") < F.lit(end).cast("date")))


def read_csv(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Bars of CSV files whose first column is the time; naive times are UTC."""
    raw = spark.read.csv(path, header=True, inferSchema=True)
    raw = raw.toDF(*[c.strip().lower().replace(" ", "_") for c in raw.columns])
    first = raw.columns[0]
    named = raw.withColumnRenamed(first, "ts") if first != "ts" else raw
    named = named.withColumn("ts", F.to_timestamp("ts")).withColumn("d", F.to_date("ts"))
    return named if symbol is None else named.withColumn("symbol", F.lit(symbol))


def write_cache(bars: DataFrame, path: str) -> None:
    """A bar cache, partitioned by symbol so that reads of a few prune the rest."""
    bars.write.mode("overwrite").partitionBy("symbol").parquet(path)


def read_cache(spark: SparkSession, path: str, symbols: list[str], start: str, end: str) -> DataFrame:
    """From the cache, then by date: the cached range does not decide the result."""
    return fetch(spark.read.parquet(path), symbols, start, end)


def usable_factors(cached: DataFrame) -> bool:
    """A factor cache with other factors than the risk-free rate, and with rows."""
    return any(c.lower() not in ("rf", "d", "date") for c in cached.columns) and bool(cached.take(1))


def join_factors(ff3: DataFrame, mom: DataFrame) -> DataFrame:
    """Library factors in percent, joined on the day, as fractions."""
    both = ff3.join(mom, "d", "inner")
    return both.select("d", *[(F.col(c) / 100).alias(c) for c in both.columns if c != "d"])


#: What library files write for a missing value (fixed values), in percent.
MISSING = (-99.99, -999.0)
LIBRARY_NAMES = {"mkt-rf": "mkt", "smb": "smb", "hml": "hml", "rf": "rf", "mom": "mom", "umd": "mom"}  # fixed names


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """(d, factors in percent) of a library's text file: prose, a header that begins with a
    comma, daily rows by yyyymmdd, then perhaps a block of years and more prose. Rows are
    told by the width of their date, so that the file may be split anywhere; the header is
    the one line that is looked at apart. Missing values are null; a day twice is kept once."""
    lines = spark.read.text(path).select(F.trim("value").alias("value"))
    headers = {tuple(x.strip().lower() for x in r["value"].split(",")[1:] if x.strip()) for r in lines.filter(F.startswith("value", F.lit(","))).distinct().take(10)}
    if len(headers) != 1:
        raise ValueError(f"{path} has {len(headers)} headers of factors")
    names = [LIBRARY_NAMES.get(x, x) for x in headers.pop()]
    parts = lines.filter(F.col("value").rlike(r"^\d{8}\s*,")).select(F.split("value", ",").alias("p"))
    value = lambda i: F.trim(F.get("p", F.lit(i))).try_cast("double")
    known = lambda x: F.when(~x.isin(*MISSING), x)
    day = F.to_date(F.trim(F.get("p", F.lit(0))), "yyyyMMdd")
    return parts.select(day.alias("d"), *[known(value(i + 1)).alias(n) for i, n in enumerate(names)]).dropDuplicates(["d"])


def cached_factors(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The cache where it is there and usable; else what is made, which becomes the cache if
    it is usable itself, so that an empty download is never kept."""
    try:
        there = spark.read.parquet(path)
        if usable_factors(there):
            return there
    except AnalysisException as absent:
        if absent.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    made = make()
    if not usable_factors(made):
        return made
    made.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def load_factors(library: DataFrame | None, proxies: DataFrame, start: str, end: str, rf_annual: float = 0.05) -> DataFrame:
    """Daily factors in [start, end): the library's where it is there and has rows,
    else the proxies'; a missing risk-free rate is the annual default."""
    inside = lambda df: df.filter((F.col("d") >= F.lit(start).cast("date")) & (F.col("d") < F.lit(end).cast("date")))
    chosen = inside(proxies)
    if library is not None and usable_factors(inside(library)):
        chosen = inside(library)
    rf = F.lit((1 + rf_annual) ** (1 / 252) - 1)
    return chosen.withColumn("rf", F.coalesce("rf", rf) if "rf" in chosen.columns else rf)


def validity(bars: DataFrame, requested: DataFrame, start: str, end: str) -> DataFrame:
    """Per requested symbol: whether there are bars, the first day, bars in range."""
    inside = (F.col("d") >= F.lit(start).cast("date")) & (F.col("d") < F.lit(end).cast("date"))
    have = bars.groupBy("symbol").agg(F.min("d").alias("first_day"), F.count_if(inside).alias("n_bars"))
    return requested.join(have, "symbol", "left").select("symbol", F.col("first_day").isNotNull().alias("valid"), "first_day", F.coalesce("n_bars", F.lit(0)).cast("long").alias("n_bars"))
