"""Cleaning and alignment of bars to a calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from ..functions.moments import Moment, moments
from ..functions.windows import ordered, past, up_to_now

PRICES = ("open", "high", "low", "close", "volume")
DAY = "interval 1 day"
#: What the z-score of returns is made of.
NORM = {"_mean": Moment("returns", 252, 30), "_std": Moment("returns", 252, 30, "std")}


def standardise(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])


def to_zone(df: DataFrame, zone: str, column: str = "ts") -> DataFrame:
    """Wall-clock time and day in a zone; strings are read as UTC."""
    local = F.from_utc_timestamp(F.to_timestamp(column), zone)
    return df.withColumn(column, local).withColumn("d", F.to_date(local))


def drop_repeats(df: DataFrame, arrival: str, keys: tuple[str, ...] = ("symbol", "d")) -> DataFrame:
    """The first row to arrive of each symbol and time."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(arrival))
    return df.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def _daily(df: DataFrame) -> DataFrame:
    """A row for every day: each row is followed by the days until the next one, without
    a grid to join. Null symbols equal none, so their days have no values."""
    day, until = F.col("d"), F.date_sub(F.lead("d").over(ordered()), 1)
    days = df.withColumn("_days", F.sequence(day, F.coalesce(F.greatest(day, until), day)))
    others = [c for c in df.columns if c not in ("symbol", "d")]
    out = days.select("symbol", F.posexplode("_days").alias("_nth", "d"), *others)
    return out.select("symbol", "d", *[F.when((F.col("_nth") == 0) & F.col("symbol").isNotNull(), F.col(c)).alias(c) for c in others])


def align(df: DataFrame, step: str = DAY) -> DataFrame:
    """A row for every step from a symbol's first to its last time."""
    if step == DAY and isinstance(df.schema["d"].dataType, DateType):
        return _daily(df)
    spans = df.groupBy("symbol").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    grid = spans.select("symbol", F.explode(F.sequence("lo", "hi", F.expr(step))).alias("d"))
    return grid.join(df, ["symbol", "d"], "left")


def _gap(x: Column, ahead: bool) -> Column:
    """Rows since (or until) the row of the nearest value, 0 on it."""
    at = F.when(x.isNotNull(), F.col("_rn"))
    return (F.min(at).over(ordered().rowsBetween(0, 2**31 - 1)) - F.col("_rn")) if ahead else (F.col("_rn") - F.max(at).over(up_to_now()))


def forward(x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(up_to_now())


def backward(x: Column) -> Column:
    return F.first(x, ignorenulls=True).over(ordered().rowsBetween(0, Window.unboundedFollowing))


def between_times(df: DataFrame, name: str) -> Column:
    """Linear in elapsed days between the nearest values; after the last value
    that value, before the first one null."""
    x, day = F.col(name), F.unix_date(F.col("d").cast("date"))
    at = F.when(x.isNotNull(), day)
    a, b, ta, tb = forward(x), backward(x), forward(at), backward(at)
    return F.coalesce(x, F.when(b.isNull(), a).otherwise(a + (b - a) * (day - ta) / F.nullif(tb - ta, F.lit(0))))


def fill(df: DataFrame, method: str = "ffill", limit: int | None = None, columns: tuple[str, ...] = PRICES) -> DataFrame:
    """Fills nulls; with a limit, the first ``limit`` rows of every gap (for
    ``bfill`` the last)."""
    if method not in ("ffill", "bfill", "interpolate"):
        raise ValueError(f"unknown fill method {method!r}")
    columns = tuple(c for c in columns if c in df.columns)
    numbered = df.withColumn("_rn", F.row_number().over(ordered()))
    out = {}
    for c in columns:
        x = F.col(c)
        value = forward(x) if method == "ffill" else backward(x) if method == "bfill" else between_times(df, c)
        out[c] = value if limit is None else F.when(x.isNotNull() | (_gap(x, method == "bfill") <= limit), value)
    return numbered.withColumns(out).drop("_rn")


def moved(df: DataFrame, price: str = "close", method: str = "log", periods: int = 1) -> DataFrame:
    """returns, and returns 1 and 5 rows ahead. With ``simple`` the forward ones are
    p(t) / p(t+k) - 1."""
    if method not in ("log", "simple"):
        raise ValueError(f"unknown return method {method!r}")
    p = F.col(price)
    ahead = {k: F.lead(p, k).over(ordered()) for k in (1, 5)}
    safe = lambda x, y: F.try_divide(x, y)
    if method == "log":
        now = F.ln(safe(p, past(p, periods)))
        fwd = {f"returns_fwd_{k}": F.ln(safe(q, p)) for k, q in ahead.items()}
    else:
        now = safe(p, past(p, periods)) - 1
        fwd = {f"returns_fwd_{k}": safe(p, q) - 1 for k, q in ahead.items()}
    return df.withColumns({"returns": now} | fwd)


def normed(df: DataFrame) -> DataFrame:
    """The z-score of returns from the moments of ``NORM``, which go."""
    norm = (F.col("returns") - F.col("_mean")) / F.nullif(F.col("_std"), F.lit(0.0))
    return df.withColumn("returns_norm", norm).drop(*NORM)


def returns(df: DataFrame, price: str = "close", method: str = "log", periods: int = 1) -> DataFrame:
    """``moved``, with the 252-row z-score of returns."""
    return normed(moments(moved(df, price, method, periods), NORM))


def filled(df: DataFrame, step: str | None = DAY, align_fill: str | None = "ffill", max_gap: int = 5, fill_method: str = "ffill") -> DataFrame:
    out = standardise(df)
    if step:
        out = align(out, step)
        if align_fill:
            out = fill(out, align_fill)
            if align_fill == fill_method:
                return out  # filled without a limit: a second time the same way changes nothing
    return fill(out, fill_method, max_gap)


def clean(df: DataFrame, step: str | None = DAY, align_fill: str | None = "ffill", max_gap: int = 5, fill_method: str = "ffill", method: str = "log") -> DataFrame:
    return returns(filled(df, step, align_fill, max_gap, fill_method), method=method)


def quality(df: DataFrame) -> DataFrame:
    """Per symbol: first and last day, rows, share of missing closes, moments of
    returns (bias-corrected skewness and excess kurtosis), quartiles."""
    r, n = F.col("returns"), F.count("returns")
    g1, g2 = F.skewness(r), F.kurtosis(r)
    skew = F.when(n > 2, g1 * F.sqrt((n * (n - 1)).cast("double")) / (n - 2))
    kurt = F.when(n > 3, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)))
    return df.groupBy("symbol").agg(
        F.min("d").alias("start"), F.max("d").alias("end"), F.count("*").alias("n_rows"),
        (F.count_if(F.col("close").isNull()) / F.count("*") * 100).alias("missing_pct"), skew.alias("returns_skew"), kurt.alias("returns_kurt"),
        F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), F.min(r).alias("min"), F.percentile(r, F.lit(0.25)).alias("q25"),
        F.percentile(r, F.lit(0.5)).alias("q50"), F.percentile(r, F.lit(0.75)).alias("q75"), F.max(r).alias("max"))

