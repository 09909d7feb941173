"""Moments of ``functions.moments`` as a step of a pass over a symbol's bars.

The same running sums by blocks as there, on arrays: where bars go through a pass anyway,
rolling columns cost it a few vector operations each, not windows of their own. Deviations
are taken from each window's mean, so that they stay right where prices hardly move after
a large move.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from ..functions.moments import Moment
from .passes import Step, floats

cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: Rows whose windows are laid out at once.
ROWS = 4096


class Sums:
    """Running counts and sums of a series, anew in every block of ``size`` rows and
    against the block's first value, with what is left of them until the block ends."""

    def __init__(self, x: np.ndarray, size: int):
        rows, known = len(x), ~np.isnan(x)
        padded = np.full(-(-rows // size) * size, np.nan)
        padded[:rows] = x
        by_block = padded.reshape(-1, size)
        there = ~np.isnan(by_block)
        first = by_block[np.arange(len(by_block)), there.argmax(1)]
        running = [v.cumsum(1) for v in (there.astype(float), np.where(there, by_block - first[:, None], 0.0))]
        self.x, self.block = x, np.arange(rows) // size
        self.origin = first[self.block]
        self.now = [r.ravel()[:rows] for r in running]
        self.left = [(r[:, -1:] - r).ravel()[:rows] for r in running]
        self.seen = known.cumsum()
        values = x[known]
        changes = np.zeros(rows, np.int64)  # values before the last change of value
        changes[known] = np.where(np.append(True, values[1:] != values[:-1])[: len(values)], np.arange(len(values)), 0)
        self.changed = np.maximum.accumulate(changes)

    def told(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, sum, mean) over the last n rows."""
        rows = np.arange(len(self.block))
        then, there = np.maximum(rows - n, 0), rows >= n
        same = there & (self.block[then] == self.block)
        other = there & ~same
        before = np.where(there, self.origin[then], np.nan)
        origin = np.where(np.isnan(self.origin), before, self.origin)
        a, s = (np.where(other, v[then], 0.0) for v in self.left)
        own = [np.where(same, v - v[then], v) for v in self.now]
        count, total = own[0] + a, own[1] + s + a * np.nan_to_num(before - origin)
        return count, origin * count + total, origin + total / count

    def deviation(self, n: int, count: np.ndarray, mean: np.ndarray) -> np.ndarray:
        """The sample's deviation over the last n rows; exactly 0 where all values are equal."""
        x, out = np.append(np.full(n - 1, np.nan), self.x), np.empty(len(self.x))
        for at in range(0, len(out), ROWS):
            off = np.lib.stride_tricks.sliding_window_view(x[at : at + ROWS + n - 1], n) - mean[at : at + ROWS, None]
            off[np.isnan(off)] = 0.0
            out[at : at + ROWS] = np.einsum("ij,ij->i", off, off) - off.sum(1) ** 2 / count[at : at + ROWS]
        rows = np.arange(len(out))
        one = self.changed <= np.where(rows >= n, self.seen[np.maximum(rows - n, 0)], 0)
        return np.where(count > 1, np.sqrt(np.where(one, 0.0, np.maximum(out, 0.0)) / (count - 1)), np.nan)


def step(wanted: dict[str, Moment]) -> Step:
    """All wanted moments; they share the sums of their columns."""
    size = max(m.n for m in wanted.values())
    told = [(name, m.column, m.n, m.least, m.kind) for name, m in wanted.items()]  # workers need not know Moment

    def run(bars: pa.Table) -> dict[str, np.ndarray]:
        sums = {c: Sums(floats(bars, c), size) for c in {c for _, c, _, _, _ in told}}
        out = {}
        with np.errstate(divide="ignore", invalid="ignore"):
            windows = {(c, n): sums[c].told(n) for c, n in {(c, n) for _, c, n, _, _ in told}}
            for name, c, n, least, kind in told:
                count, total, mean = windows[c, n]
                value = {"mean": lambda: mean, "sum": lambda: total, "std": lambda: sums[c].deviation(n, count, mean)}[kind]()  # noqa: B023
                out[name] = np.where(count >= least, value, np.nan)
        return out

    return Step(dict.fromkeys(wanted, "double"), run)
