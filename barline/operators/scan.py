"""Recursive exponential means over blocks of time, so that one long series spans tasks.

A step of such a mean is an affine map of the value before it, and maps compose. Each
block of a series folds into the map of its rows (with its first value apart, whose weight
depends on the gap before it); the maps of a series, a row a block, are applied one after
another to give the value that enters each block; then the blocks are replayed from there.
Rows are shuffled by series and block, once for the fold and the replay of all means; what
goes by series is a row a block.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .passes import floats

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = "_block"


@dataclass(frozen=True)
class Mean:
    """A mean of a column, from its first value on; null until ``least`` values were seen."""

    column: str
    alpha: float
    least: int


def blocked(df: DataFrame, days: int, time: str = "d") -> DataFrame:
    """df with the number of the block of so many days that a row is in."""
    return df.withColumn(BLOCK, F.floor(F.unix_date(F.col(time).cast("date")) / days))


def past_in_blocks(df: DataFrame, column: str, name: str, time: str = "d") -> DataFrame:
    """df with the column's value of the row before, across blocks: inside a block by a
    window of its own, at its first row from the last row of the block before."""
    last = df.groupBy("symbol", BLOCK).agg(F.max_by(F.struct(F.col(column).alias("v")), time).alias("_last"))
    edge = last.select("symbol", BLOCK, F.lag("_last").over(Window.partitionBy("symbol").orderBy(BLOCK)).alias("_edge"))
    inside = Window.partitionBy("symbol", BLOCK).orderBy(time)
    out = df.withColumn("_in", F.lag(F.struct(F.col(column).alias("v"))).over(inside)).join(edge, ["symbol", BLOCK])
    return out.withColumn(name, F.coalesce(F.col("_in"), F.col("_edge"))["v"]).drop("_in", "_edge")


def decayed(alpha: float, rows: int | np.ndarray, v: float, before: float) -> float:
    """The mean after value v, so many rows after it was ``before``."""
    weight = (1 - alpha) ** rows
    return (weight * before + alpha * v) / (weight + alpha)


def fold(x: np.ndarray, alpha: float) -> tuple[float, float, float, int, int, int]:
    """(a, b, first value, its place, values, rows after the last value) of a block: with y
    the mean at its first value, a y + b is that at its last one."""
    at = np.flatnonzero(~np.isnan(x))
    if not len(at):
        return 1.0, 0.0, float("nan"), len(x), 0, len(x)
    weight = (1 - alpha) ** np.diff(at)
    kept = weight / (weight + alpha)
    after = np.append(np.cumprod(kept[::-1])[::-1], 1.0)  # what stays of the mean before each value, at the end
    b = float((after[1:] * alpha * x[at[1:]] / (weight + alpha)).sum())
    return float(after[0]), b, float(x[at[0]]), int(at[0]), len(at), int(len(x) - 1 - at[-1])


def enter(maps: list[tuple[float, float, float, int, int, int]], alpha: float) -> list[tuple[float, int, int]]:
    """(mean, values seen, rows since the last value) before each block of a series."""
    mean, seen, gap, out = float("nan"), 0, 0, []
    for a, b, first, place, n, after in maps:
        out.append((mean, seen, gap))
        if n:
            mean = a * (decayed(alpha, gap + place + 1, first, mean) if seen else first) + b
            seen, gap = seen + n, after
        else:
            gap += after
    return out


def replay(x: np.ndarray, alpha: float, least: int, mean: float, seen: int, gap: int) -> np.ndarray:
    """The means of a block's rows, from what entered it."""
    known = ~np.isnan(x)
    if seen and known.any():
        first = int(known.argmax())
        x = x.copy()
        x[first] = decayed(alpha, gap + first + 1, x[first], mean)
    out = pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy(copy=True) if len(x) else x.copy()
    if seen:
        out[np.cumsum(known) == 0] = mean
    out[seen + np.cumsum(known) < least] = np.nan
    return out


def blocked_means(df: DataFrame, means: dict[str, Mean], time: str = "d") -> DataFrame:
    """df, which has its blocks, with a column for each mean."""
    told = list(means.items())
    numbers = "array<double>"

    def folded(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(time)
        found = [fold(floats(rows, m.column), m.alpha) for _, m in told]
        return pa.table({"symbol": [key[0].as_py()], BLOCK: [key[1].as_py()], "maps": [[float(v) for f in found for v in f]]}, pa.schema([("symbol", pa.string()), (BLOCK, pa.int64()), ("maps", pa.list_(pa.float64()))]))

    def entered(key: tuple, blocks: pa.Table) -> pa.Table:
        blocks = blocks.sort_by(BLOCK)
        maps = np.array(blocks.column("maps").to_pylist()).reshape(len(blocks), len(told), 6)
        states = [enter([(a, b, v, int(p), int(n), int(g)) for a, b, v, p, n, g in maps[:, k].tolist()], m.alpha) for k, (_, m) in enumerate(told)]
        flat = [[float(v) for s in states for v in s[i]] for i in range(len(blocks))]
        return pa.table({"symbol": [key[0].as_py()] * len(blocks), BLOCK: blocks.column(BLOCK), "state": flat}, pa.schema([("symbol", pa.string()), (BLOCK, pa.int64()), ("state", pa.list_(pa.float64()))]))

    kept = [f.name for f in df.schema.fields if f.name not in means]

    def replayed(rows: pa.Table, states: pa.Table) -> pa.Table:
        rows, state = rows.sort_by(time), states.column("state")[0].as_py()
        out = rows.select(kept)
        for k, (name, m) in enumerate(told):
            mean, seen, gap = state[3 * k : 3 * k + 3]
            out = out.append_column(name, pa.array(replay(floats(rows, m.column), m.alpha, m.least, mean, int(seen), int(gap)), pa.float64(), from_pandas=True))
        return out

    by_block = df.groupBy("symbol", BLOCK)
    states = by_block.applyInArrow(folded, f"symbol string, {BLOCK} long, maps {numbers}").groupBy("symbol").applyInArrow(entered, f"symbol string, {BLOCK} long, state {numbers}")
    schema = T.StructType([*[df.schema[n] for n in kept], *[T.StructField(n, T.DoubleType()) for n in means]])
    return by_block.cogroup(states.groupBy("symbol", BLOCK)).applyInArrow(replayed, schema)


def strength_index(gain: Column, loss: Column) -> Column:
    """From 0 to 100 by mean gains and losses; 100 without losses."""
    return F.when(loss.isNotNull(), F.when(loss == 0, 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - 100 / (1 + gain / loss)))))


def averages(df: DataFrame, days: int, rsi: int = 14, atr: int = 14, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """The true range, RSI, ATR and MACD columns of bars, by blocks of so many days."""
    out = past_in_blocks(blocked(df, days), "close", "_before")
    h, low, close, before = F.col("high"), F.col("low"), F.col("close").cast("double"), F.col("_before").cast("double")
    move = close - before
    out = out.withColumns({
        "tr": F.greatest(h - low, F.abs(h - before), F.abs(low - before)),
        "_gain": F.when(move.isNotNull(), F.greatest(move, F.lit(0.0))), "_loss": F.when(move.isNotNull(), F.greatest(-move, F.lit(0.0)))})
    out = blocked_means(out, {"_up": Mean("_gain", 1 / rsi, rsi), "_down": Mean("_loss", 1 / rsi, rsi), f"atr_{atr}": Mean("tr", 1 / atr, atr), f"ema_{fast}": Mean("close", 2 / (fast + 1), fast), f"ema_{slow}": Mean("close", 2 / (slow + 1), slow)})
    out = out.withColumn("macd_line", F.col(f"ema_{fast}") - F.col(f"ema_{slow}"))
    out = blocked_means(out, {"macd_signal": Mean("macd_line", 2 / (signal + 1), signal)})
    return out.withColumns({f"rsi_{rsi}": strength_index(F.col("_up"), F.col("_down")), "macd_histogram": F.col("macd_line") - F.col("macd_signal")}).drop(BLOCK, "_before", "_gain", "_loss", "_up", "_down")
