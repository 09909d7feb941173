"""Quantiles and ranks over the last rows, from a sorted list that slides along.

A row enters the list and one leaves it; every quantile and rank that is asked of a
column is read from that list, in place of sorting the whole window for each. The list is
kept in blocks of bounded length, so that an insert moves few values however long the
window is.
"""

from __future__ import annotations

import math
import sys
from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import last_rows, quantile, rolling
from .passes import Step, by_group, floats

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class SortedBlocks:
    """A sorted list of numbers in blocks of at most ``most`` of them."""

    def __init__(self, most: int = 512):
        self.most, self.blocks, self.size = most, [[]], 0

    def __len__(self) -> int:
        return self.size

    def _block_of(self, v: float) -> int:
        """The first block whose last number is not below v, else the last block."""
        lo, hi = 0, len(self.blocks) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.blocks[mid][-1] < v else (lo, mid)
        return lo

    def add(self, v: float) -> None:
        k = self._block_of(v)
        block = self.blocks[k]
        insort(block, v)
        self.size += 1
        if len(block) > self.most:
            self.blocks[k : k + 1] = [block[: len(block) // 2], block[len(block) // 2 :]]

    def remove(self, v: float) -> None:
        k = self._block_of(v)
        block = self.blocks[k]
        del block[bisect_left(block, v)]
        self.size -= 1
        if not block and len(self.blocks) > 1:
            del self.blocks[k]

    def at(self, k: int) -> float:
        for block in self.blocks:
            if k < len(block):
                return block[k]
            k -= len(block)
        raise IndexError(k)

    def below(self, v: float) -> int:
        k = self._block_of(v)
        return sum(map(len, self.blocks[:k])) + bisect_left(self.blocks[k], v)

    def up_to(self, v: float) -> int:
        """How many are not above v."""
        total = 0
        for block in self.blocks:
            if block and block[0] > v:
                break
            total += len(block) if block and block[-1] <= v else bisect_right(block, v)
        return total

    def quantile(self, p: float) -> float:
        """With linear interpolation."""
        place = (self.size - 1) * p
        low, high = math.floor(place), math.ceil(place)
        a = self.at(low)
        b = a if low == high else self.at(high)
        return a if a == b else (high - place) * a + (place - low) * b


@dataclass(frozen=True)
class Statistic:
    """Of the last ``lookback`` rows' values of a column (or of their sizes): a
    ``quantile``; the ``rank`` of the row's own value in percent, ties averaged; or the
    ``share`` of the rows before it, if there are as many, whose value is less. Null with
    fewer than ``least`` values."""

    column: str
    lookback: int
    least: int
    kind: str = "quantile"
    p: float = 0.0
    absolute: bool = False

    @property
    def name(self) -> str:
        return f"_{self.kind}_{round(self.p * 10_000)}_{'size_' if self.absolute else ''}{self.column}_{self.lookback}_{self.least}"

    def value(self, df: DataFrame) -> Column:
        """The column that a pass has made, else a frame that is sorted at every row."""
        if self.name in df.columns:
            return F.col(self.name)
        x = F.abs(self.column) if self.absolute else F.col(self.column)
        if self.kind == "quantile":
            return rolling(quantile(self.p), x, self.lookback, self.least)
        if self.kind == "rank":
            seen = F.collect_list(x).over(last_rows(self.lookback))
            less, same = F.size(F.filter(seen, lambda v: v < x)), F.size(F.filter(seen, lambda v: v == x))
            return F.when(x.isNotNull() & (F.size(seen) >= self.least), (less + (same + 1) / 2) / F.size(seen) * 100)
        before = last_rows(self.lookback, ending=-1)
        seen = F.collect_list(x).over(before)
        known = x.isNotNull() & (F.count(F.lit(1)).over(before) >= self.lookback) & (F.size(seen) >= self.least)
        return F.when(known, F.size(F.filter(seen, lambda v: v < x)) / F.size(seen))


def _slide(x: np.ndarray, lookback: int, before: bool, wanted: list[tuple[str, str, float, int]]) -> dict[str, np.ndarray]:
    """All wanted statistics (name, kind, p, least) of one series and length of window, with
    the row itself or of the rows before it."""
    held, out = SortedBlocks(), {w[0]: np.full(len(x), np.nan) for w in wanted}
    values = x.tolist()
    for t, v in enumerate(values):
        known = v == v
        gone = t - lookback - before
        if gone >= 0 and values[gone] == values[gone]:
            held.remove(values[gone])
        if known and not before:
            held.add(v)
        n = len(held)
        for name, kind, p, least in wanted:
            if n < least or (kind != "quantile" and not known) or not n:
                continue
            if kind == "quantile":
                out[name][t] = held.quantile(p)
            elif kind == "rank":
                less = held.below(v)
                out[name][t] = (less + (held.up_to(v) - less + 1) / 2) / n * 100
            elif t >= lookback:
                out[name][t] = held.below(v) / n
        if known and before:
            held.add(v)
    return out


def step(statistics: list[Statistic]) -> Step:
    """A step that makes all of them: one list for each series, length and set of rows."""
    groups: dict[tuple, list[tuple[str, str, float, int]]] = {}
    for s in dict.fromkeys(statistics):
        groups.setdefault((s.column, s.absolute, s.lookback, s.kind == "share"), []).append((s.name, s.kind, s.p, s.least))

    def run(bars: pa.Table) -> dict[str, np.ndarray]:
        out = {}
        for (column, absolute, lookback, before), own in groups.items():
            x = floats(bars, column)
            out |= _slide(np.abs(x) if absolute else x, lookback, before, own)
        return out

    return Step({w[0]: "double" for own in groups.values() for w in own}, run)


def missing(df: DataFrame, statistics: list[Statistic]) -> list[Statistic]:
    """Those that have their column in df, and no column of their own yet."""
    return [s for s in dict.fromkeys(statistics) if s.column in df.columns and s.name not in df.columns]


def with_statistics(df: DataFrame, statistics: list[Statistic]) -> DataFrame:
    wanted = missing(df, statistics)
    return by_group(df, [step(wanted)]) if wanted else df
