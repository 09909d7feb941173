"""Cleaned bars of every day, made in the pass over a symbol.

What ``clean.filled``, ``clean.moved`` and the true range of ``features`` make by windows, on
a symbol's sorted Arrow table: bars are shuffled and sorted as they come. Where a symbol has
a bar on a day in several, the days between them are most of its rows, and sorting these
again is most of what a task would hold or spill.
"""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .clean import PRICES
from .passes import ERROR, Rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MADE = ("returns", "returns_fwd_1", "returns_fwd_5", "tr", "_turnover")
#: In workers, which need not know Spark's columns.
FILLED = frozenset(PRICES)


def fits(df: DataFrame) -> bool:
    """Whether the bars are of days and doubles; others go by windows."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return isinstance(kinds.get("d"), T.DateType) and all(isinstance(kinds.get(c), T.DoubleType) for c in PRICES) and not {ERROR, *MADE} & set(kinds)


def _rows_on(x: pa.Array, k: int) -> pa.Array:
    """The value k rows on, or back where k is negative; null beyond the ends."""
    none = pa.nulls(min(abs(k), len(x)), x.type)
    return pa.concat_arrays([x.slice(k), none] if k > 0 else [none, x.slice(0, max(len(x) + k, 0))])


def _log_ratio(x: pa.Array, y: pa.Array) -> pa.Array:
    """ln(x / y), null where Spark's is: y is 0, or the ratio not above 0."""
    none = pa.scalar(None, pa.float64())
    ratio = pc.divide(x, pc.if_else(pc.equal(y, 0.0), none, y))
    return pc.ln(pc.if_else(pc.less_equal(ratio, 0.0), none, ratio))


def _greatest(*values: pa.Array) -> pa.Array:
    """The greatest that is known; NaN is above all, as in Spark."""
    odd = reduce(pc.or_, [pc.fill_null(pc.is_nan(x), False) for x in values])
    return pc.if_else(odd, float("nan"), pc.max_element_wise(*values))


def _spread(bars: pa.Table) -> pa.Table:
    bars = bars.filter(pc.is_valid(bars["d"])).combine_chunks()
    day = bars["d"].cast(pa.int32()).to_numpy()
    times = np.maximum(np.append(day[1:] - 1, day[-1:]), day) - day + 1
    at = np.repeat(np.arange(len(day)), times)
    nth = np.arange(len(at)) - np.repeat(times.cumsum() - times, times)
    own = pa.array(at, mask=nth > 0)
    nameless = bars["symbol"].null_count > 0  # null symbols equal none: their days have no values
    out = {}
    for name in bars.column_names:
        x = pa.concat_arrays(bars[name].chunks) if len(bars) else pa.nulls(0, bars[name].type)
        if name == "symbol":
            out[name] = x.take(pa.array(at))
        elif name == "d":
            out[name] = pa.array((day[at] + nth).astype(np.int32)).cast(x.type)
        elif nameless:
            out[name] = pa.nulls(len(at), x.type)
        else:
            out[name] = pc.fill_null_forward(x).take(pa.array(at)) if name in FILLED else x.take(own)
    close, before = out["close"], _rows_on(out["close"], -1)
    out["returns"] = _log_ratio(close, before)
    for k in (1, 5):
        out[f"returns_fwd_{k}"] = _log_ratio(_rows_on(close, k), close)
    high, low = out["high"], out["low"]
    out["tr"] = _greatest(pc.subtract(high, low), pc.abs(pc.subtract(high, before)), pc.abs(pc.subtract(low, before)))
    out["_turnover"] = pc.multiply(close, out["volume"])
    return pa.table(out)


def daily(df: DataFrame) -> Rows:
    """A symbol's days with filled prices, returns, true range and turnover, of bars that ``fits``."""
    return Rows(T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in MADE]]), _spread)
