"""Rolling expressions over the bars of a symbol.

All of them share one partitioning and one order, so Catalyst plans a single
exchange and sort for any number of rolling columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("symbol",)
TIME = "d"
ALL = Window.unboundedPreceding


def ordered(keys: tuple[str, ...] = KEYS, time: str = TIME) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(time)


def whole(keys: tuple[str, ...] = KEYS) -> WindowSpec:
    return Window.partitionBy(*keys)


def last_rows(n: int, keys: tuple[str, ...] = KEYS, time: str = TIME, ending: int = 0) -> WindowSpec:
    return ordered(keys, time).rowsBetween(ending - (n - 1), ending)


def up_to_now(keys: tuple[str, ...] = KEYS, time: str = TIME) -> WindowSpec:
    return ordered(keys, time).rowsBetween(ALL, 0)


def rolling(agg: Callable[[Column], Column], x: Column, n: int, least: int | None = None, keys: tuple[str, ...] = KEYS, time: str = TIME) -> Column:
    """``agg(x)`` over the last n rows, null if fewer than ``least`` (n by default)
    of them have a value."""
    w = last_rows(n, keys, time)
    return F.when(F.count(x).over(w) >= (n if least is None else least), agg(x).over(w))


def quantile(p: float) -> Callable[[Column], Column]:
    """Exact quantile with linear interpolation."""
    return lambda x: F.percentile(x, F.lit(p))


def past(x: Column, k: int = 1, keys: tuple[str, ...] = KEYS, time: str = TIME) -> Column:
    return F.lag(x, k).over(ordered(keys, time))


def changed(x: Column, keys: tuple[str, ...] = KEYS, time: str = TIME) -> Column:
    """True where x differs from the row before, and on the first row."""
    return ~x.eqNullSafe(past(x, 1, keys, time)) | (F.row_number().over(ordered(keys, time)) == 1)


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def per(x: Column, y: Column) -> Column:
    """x / y, null where y is 0."""
    return x / F.nullif(y, F.lit(0.0))


def sign(x: Column) -> Column:
    return F.signum(F.coalesce(x, F.lit(0.0)).cast("double")).cast("int")


def require(df, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns {missing}; there are {df.columns}")
