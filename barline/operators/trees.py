"""Regression trees on histograms, for many small models: a group of rows, a model.

A tree grows a level at a time: sums of residuals and weights by (node, column, bin) give
every split of the level at once. Rows of weight 0 take no part in the sums and are only
led to their leaves, so rows to predict grow along with those to learn from, and no tree
outlives its round. Equal gains go to the earlier node's lower column, then lower bin.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Gains up to this are rounding, not splits.
EPS = 1e-6


@dataclass(frozen=True)
class Trees:
    """``rate`` None: trees are averaged, not added up. ``rows`` is the share drawn for a
    tree without replacement, or None for as many as there are with replacement."""

    n: int = 200
    depth: int = 4
    rate: float | None = 0.05
    rows: float | None = 0.8
    columns: float = 0.8
    l1: float = 0.1
    l2: float = 1.0
    least: int = 1
    bins: int = 256
    seed: int = 42


# The settings of the two kinds of model.
MODELS = {"xgboost": Trees(), "random_forest": Trees(depth=6, rate=None, rows=None, columns=1.0, l1=0.0, l2=0.0, least=20)}


def binned(learn: np.ndarray, every: np.ndarray, bins: int) -> np.ndarray:
    """Bin numbers of a column: cuts lie between its distinct values, or at quantiles of
    them where there are more values than bins."""
    values = np.unique(learn)
    cuts = (values[1:] + values[:-1]) / 2
    if len(values) > bins:
        cuts = np.unique(np.quantile(learn, np.linspace(0, 1, bins + 1)[1:-1]))
    return np.searchsorted(cuts, every, side="left")


def _shrunk(total: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(total) * np.maximum(np.abs(total) - l1, 0)


def _score(total: np.ndarray, weight: np.ndarray, t: Trees) -> np.ndarray:
    return _shrunk(total, t.l1) ** 2 / np.maximum(weight + t.l2, EPS)


def grown(codes: np.ndarray, picked: np.ndarray, g: np.ndarray, w: np.ndarray, t: Trees, gains: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """The leaf value of every row in one tree over the picked columns; adds the tree's
    gains and splits to those by column."""
    node, seen, p = np.zeros(codes.shape[1], np.int64), np.flatnonzero(w), len(picked)
    inside, sums, weights = codes[np.ix_(picked, seen)], np.tile(g[seen] * w[seen], p), np.tile(w[seen], p)
    bins = int(codes.max(initial=0)) + 1
    for level in range(t.depth):
        width = 2**level
        at = ((node[seen] * p + np.arange(p)[:, None]) * bins + inside).ravel()
        left, n = (np.bincount(at, v, width * p * bins).reshape(width, p, bins).cumsum(2) for v in (sums, weights))
        total, all_n = left[:, :1, -1:], n[:, :1, -1:]
        gain = _score(left, n, t) + _score(total - left, all_n - n, t) - _score(total, all_n, t)
        gain = np.where((n >= t.least) & (all_n - n >= t.least), gain, 0).reshape(width, -1)
        best = gain.argmax(1)
        won = gain[np.arange(width), best]
        column, cut, good = picked[best // bins], best % bins, won > EPS
        np.add.at(gains, column[good], won[good])
        np.add.at(splits, column[good], 1)
        node = 2 * node + (good[node] & (codes[column[node], np.arange(len(node))] > cut[node]))
    total, n = (np.bincount(node[seen], v, 2**t.depth) for v in (g[seen] * w[seen], w[seen]))
    return (_shrunk(total, t.l1) / np.maximum(n + t.l2, EPS))[node]


def fitted(learn: np.ndarray, target: np.ndarray, ask: np.ndarray, t: Trees) -> tuple[np.ndarray, np.ndarray]:
    """(predictions for ``ask``, importances by column) of a model of ``learn``; rows are
    rows, columns are columns. Importances sum to 1, or to 0 without a split: the mean gain
    of a column's splits, or their total where trees are averaged."""
    codes = np.stack([binned(a, np.concatenate([a, b]), t.bins) for a, b in zip(learn.T, ask.T, strict=True)])
    n, k, draw = len(learn), learn.shape[1], np.random.default_rng(t.seed)
    base = target.mean()
    told, gains, splits = np.zeros(codes.shape[1]), np.zeros(k), np.zeros(k)
    for _ in range(t.n):
        w = np.zeros(codes.shape[1])
        if t.rows is None:
            w[:n] = np.bincount(draw.integers(n, size=n), minlength=n)
        else:
            w[draw.permutation(n)[: max(1, round(t.rows * n))]] = 1
        picked = np.sort(draw.permutation(k)[: max(1, int(t.columns * k))])
        g = np.zeros(codes.shape[1])
        g[:n] = target - base - (told[:n] if t.rate is not None else 0)
        told += (1 / t.n if t.rate is None else t.rate) * grown(codes, picked, g, w, t, gains, splits)
    weighed = gains if t.rate is None else gains / np.maximum(splits, 1)
    return base + told[n:], weighed / weighed.sum() if weighed.sum() > 0 else weighed
