"""Recursive means and the oscillator's positions of a stream of bars, by keyed state.

A symbol's state is a row of numbers whatever its length: each mean with the rows since its
last value, the position with its age, the last levels that the rule smooths over.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.kernels import hold_from, rsi_rules
from ..operators.scan import decayed
from ..operators.signals import Rules
from .bars import event_stream, windowed_bars

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Mean -> (weight, values it needs): the settings of the batch features.
MEANS = {"gain": (1 / 14, 14), "loss": (1 / 14, 14), "quick": (2 / 13, 12), "late": (2 / 27, 26), "smooth": (2 / 10, 9)}
MADE = "rsi_14 double, macd_line double, macd_signal double, macd_histogram double, signal_rsi int, out_of_order boolean"
STATE = "last timestamp, close double, side int, held int, tail array<double>, value array<double>, gap array<long>, seen array<long>"


def carried(x: np.ndarray, alpha: float, least: int, value: float, gap: int, seen: int) -> tuple[np.ndarray, tuple[float, int, int]]:
    """A recursive mean that goes on from (value, rows since, values seen), and those after x."""
    out = np.full(len(x), np.nan)
    for t, v in enumerate(x):
        gap += 1
        if not np.isnan(v):
            value = decayed(alpha, gap, v, value) if seen else v
            gap, seen = 0, seen + 1
        if seen >= least:
            out[t] = value
    return out, (float(value), gap, seen)


def _extremes(level: np.ndarray, tail: list[float], n: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """The least and greatest known level of the last n rows, of which ``tail`` came before."""
    longer = np.concatenate([np.full(n - 1 - len(tail), np.nan), tail, level])
    views = np.lib.stride_tricks.sliding_window_view(longer, n)
    return np.fmin.reduce(views, axis=1), np.fmax.reduce(views, axis=1), [float(x) for x in longer[len(longer) - n + 1 :]]


def advanced(bars: pd.DataFrame, state: tuple | None, rules: Rules) -> tuple[pd.DataFrame, tuple]:
    """The bars of one symbol, sorted and all later than the state's, with their columns, and
    the state after them."""
    fresh = state is None
    last, before, side, held, tail, *parts = state or (None, float("nan"), 0, 0, [], [float("nan")] * len(MEANS), [0] * len(MEANS), [0] * len(MEANS))
    means = dict(zip(MEANS, zip(*parts, strict=True), strict=True))

    def mean(name: str, x: np.ndarray) -> np.ndarray:
        out, means[name] = carried(x, *MEANS[name], *means[name])
        return out

    close = bars["close"].to_numpy("float64", na_value=np.nan)
    move = np.diff(close, prepend=before)
    gain, loss = mean("gain", np.where(move < 0, 0.0, move)), mean("loss", np.where(move > 0, 0.0, -move))
    with np.errstate(divide="ignore", invalid="ignore"):
        level = np.where(np.isnan(loss), np.nan, np.where(loss == 0, 100.0, np.clip(100 - 100 / (1 + gain / loss), 0, 100)))
    line = mean("quick", close) - mean("late", close)
    smooth = mean("smooth", line)
    low, high, tail = _extremes(level, list(tail), rules.smoothing)
    found, side, held = hold_from(level, *rsi_rules(low, high, level, rules.oversold, rules.overbought, rules.rsi_exit), rules.min_holding, rules.max_holding, False, side, held, int(fresh))
    out = bars.assign(rsi_14=level, macd_line=line, macd_signal=smooth, macd_histogram=line - smooth, signal_rsi=found, out_of_order=False)
    last = bars["d"].iloc[-1].to_pydatetime()
    return out, (last, float(close[-1]), side, held, tail, *[list(x) for x in zip(*means.values(), strict=True)])


def streamed(bars: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """A stream (symbol, d timestamp, close) with RSI, MACD and ``signal_rsi``, as the batch
    stages make them. The bars of a symbol have to come in order from batch to batch, as
    windows do that the watermark closes; one that is not later than those before it comes
    back with nulls and ``out_of_order``, and changes no state. A bar without a close counts
    as a row of the means. Of equal times in a batch the first is taken."""

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        had = tuple(state.get) if state.exists else None
        batch = pd.concat(list(chunks), ignore_index=True).sort_values("d", kind="stable", ignore_index=True)
        behind = batch["d"].duplicated()
        if had is not None:
            behind |= batch["d"] <= pd.Timestamp(had[0])
        if behind.any():
            yield batch[behind].assign(rsi_14=None, macd_line=None, macd_signal=None, macd_histogram=None, signal_rsi=None, out_of_order=True)
        if not behind.all():
            out, after = advanced(batch[~behind].reset_index(drop=True), had, rules)
            state.update(after)
            yield out

    named = bars.select("symbol", F.col("d").cast("timestamp").alias("d"), F.col("close").cast("double").alias("close"))
    return named.groupBy("symbol").applyInPandasWithState(step, f"symbol string, d timestamp, close double, {MADE}", STATE, "append", GroupStateTimeout.NoTimeout)


def run_available(spark: SparkSession, events: str, folder: str, rules: Rules = Rules(), width: str = "1 hour", late: str = "2 hours") -> None:
    """Takes what has come into the folder of events on to ``<folder>/positions``, and goes
    on from there at the next call. State cannot follow an aggregation in one query, so a
    first one appends the bars of closed windows to ``<folder>/bars`` and a second one reads
    its commits whole, in their order. The folder is a shared one on a cluster."""
    closed = windowed_bars(event_stream(spark, events), width, late)
    _append(closed, folder, "bars")
    # no limit on files: a commit is never cut, so a symbol's bars stay in order
    told = spark.readStream.schema(closed.schema).parquet(f"{folder}/bars")
    _append(streamed(told, rules), folder, "positions")


def _append(stream: DataFrame, folder: str, name: str) -> None:
    out = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/_checkpoints/{name}")
    out.trigger(availableNow=True).start(f"{folder}/{name}").awaitTermination()
