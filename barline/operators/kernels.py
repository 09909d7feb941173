"""Kernels for results that depend on their own previous value.

Each runs over the rows of one group in time order, on NumPy arrays; the callers
wrap them in ``applyInPandas``, so Spark groups and shuffles, and one symbol's bars
are what a task holds at a time. NaN stands for missing inside, null outside.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def ema(x: np.ndarray, alpha: float, least: int) -> np.ndarray:
    """Recursive exponential mean from the first value on; a gap lets the weight
    of what was before decay. Missing until ``least`` values were seen."""
    return pd.Series(x).ewm(alpha=alpha, adjust=False, min_periods=least).mean().to_numpy()


def rsi_rules(low: np.ndarray, high: np.ndarray, level: np.ndarray, oversold: float, overbought: float, exit_: float) -> tuple:
    """(entry, leaves) of the oscillator rule; low and high are its smoothed extremes."""

    def entry(t: int) -> int:
        return 1 if low[t] < oversold else -1 if high[t] > overbought else 0

    def leaves(t: int, side: int) -> bool:
        return level[t] > exit_ if side > 0 else level[t] < exit_

    return entry, leaves


def rsi_machine(close: np.ndarray, low: np.ndarray, high: np.ndarray, level: np.ndarray, oversold: float, overbought: float, exit_: float, least: int, most: int) -> np.ndarray:
    """Positions of the oscillator rule."""
    return hold(level, *rsi_rules(low, high, level, oversold, overbought, exit_), least, most, reenter=False)


def hold(known: np.ndarray, entry, leaves, least: int, most: int, reenter: bool) -> np.ndarray:
    """A position machine: row 0 and rows with missing input give 0 and change
    nothing; a position ends after ``most`` rows, or by rule after ``least``;
    entries are tried when flat, on a row of forced exit only if ``reenter``."""
    return hold_from(known, entry, leaves, least, most, reenter)[0]


def hold_from(known: np.ndarray, entry, leaves, least: int, most: int, reenter: bool, side: int = 0, held: int = 0, first: int = 1) -> tuple[np.ndarray, int, int]:
    """``hold`` that goes on from a position and its age, and (positions, position, age)."""
    out = np.zeros(len(known), np.int32)
    for t in range(first, len(known)):
        if math.isnan(known[t]):
            continue
        if side:
            held += 1
        forced = side != 0 and held > most
        if forced or (side and (held >= least or held == 0) and leaves(t, side)):
            side = held = 0
        if side == 0 and (reenter or not forced):
            side = entry(t)
            held = 1 if side else 0
        out[t] = side
    return out, side, held


def zscore_machine(z: np.ndarray, enter: float, exit_: float, least: int, most: int) -> np.ndarray:
    return hold(z, lambda t: 1 if z[t] < -enter else -1 if z[t] > enter else 0, lambda t, s: z[t] >= exit_ if s > 0 else z[t] <= -exit_, least, most, reenter=False)


def macd_machine(h: np.ndarray, line: np.ndarray, zero_cross: bool, least: int, most: int) -> np.ndarray:
    """Flips with the sign of the histogram; a forced exit emits 0 and skips the
    rest of its row, a cross in the held direction restarts the count."""
    out = np.zeros(len(h), np.int32)
    side = held = 0
    for t in range(1, len(h)):
        a, b = h[t - 1], h[t]
        if math.isnan(a) or math.isnan(b):
            continue
        if side:
            held += 1
        if side and held > most:
            side = held = 0
            continue
        up, down = a <= 0 < b, a >= 0 > b
        if zero_cross:
            up, down = up and line[t - 1] <= 0 < line[t], down and line[t - 1] >= 0 > line[t]
        if (up or down) and (held == 0 or held >= least):
            side, held = (1 if up else -1), 1
        out[t] = side
    return out


def band_machine(p: np.ndarray, upper: np.ndarray, lower: np.ndarray, mid: np.ndarray, squeeze: np.ndarray, mode: str, least: int, most: int) -> np.ndarray:
    """Breakouts of a band in a squeeze, or reversion from its edges."""
    if mode not in ("breakout", "reversion"):
        raise ValueError(f"unknown mode {mode!r}")
    known = p + upper + lower + mid

    def entry(t: int) -> int:
        if mode == "reversion":
            return -1 if p[t - 1] <= upper[t] <= p[t] else 1 if p[t - 1] >= lower[t] >= p[t] else 0
        if not squeeze[t]:
            return 0
        return 1 if p[t - 1] <= upper[t] < p[t] else -1 if p[t - 1] >= lower[t] > p[t] else 0

    def leaves(t: int, s: int) -> bool:
        return p[t] >= mid[t] if s > 0 else p[t] <= mid[t]

    return hold(known, entry, leaves, least, most, reenter=True)


def breaker(signal: np.ndarray, ret: np.ndarray, most: float, recovery: float) -> np.ndarray:
    """True where trading is allowed: a simulated equity's drawdown beyond
    ``most`` closes the gate, up to and with the row that recovers."""
    held = np.r_[0.0, np.nan_to_num(signal[:-1].astype(float))] if len(signal) else np.zeros(0)
    equity = np.cumprod(1 + held * np.nan_to_num(ret))
    out = np.ones(len(signal), bool)
    peak, closed = 1.0, False
    for t, e in enumerate(equity):
        if closed:
            out[t] = False
            if e >= recovery * peak:
                closed, peak = False, e
        else:
            peak = max(peak, e)
            if (e - peak) / peak < -most:
                closed, out[t] = True, False
    return out


def trade_cost(price: float, shares: float, volume: float, c: dict) -> float:
    notional = abs(shares) * price
    adv = volume if volume and volume > 0 else 1_000_000.0
    return c["spread_bps"] / 1e4 * notional + c["slippage_bps"] / 1e4 * notional * math.sqrt(abs(shares) / adv) + max(c["commission"], c["commission_pct"] * notional)


def event_engine(o, h, low, c, volume, signal, scale, vol, cfg: dict, costs: dict) -> tuple[list[dict], list[dict]]:
    """Fills the order of the row before, marks to the close. (curve, trades)."""
    cash, pos, side, size = cfg["capital"], 0.0, 0, 1.0
    before, opened = cfg["capital"], None
    curve, trades = [], []

    def want(fill: float) -> float:
        if side == 0 or fill == 0:
            return 0.0
        if cfg["sizing"] == "fixed_shares":
            n = 100.0
        elif cfg["sizing"] == "vol_target" and vol is not None:
            v = vol[len(curve)]
            v = 0.02 if math.isnan(v) or v == 0 else v
            n = cash * cfg["vol_target"] / max(v * math.sqrt(252), 0.01) / fill
        else:
            n = cfg["notional"] / fill
        return side * size * n

    def close_trade(t: int, price: float, cost: float) -> None:
        trades.append({"entry": opened[0], "exit": t, "direction": 1 if opened[2] > 0 else -1, "entry_price": opened[1], "exit_price": price, "shares": abs(opened[2]), "entry_cost": opened[3], "exit_cost": cost})

    for t in range(len(c)):
        fill = {"open": o[t], "close": c[t]}.get(cfg["fill"], (h[t] + low[t]) / 2)
        paid = 0.0
        if side or pos:
            target = want(fill)
            delta = target - pos
            if abs(delta) > 0.01:
                paid = trade_cost(fill, delta, volume[t], costs)
                turned = target == 0 or (pos > 0) != (target > 0)
                if pos and turned:
                    close_trade(t, fill, trade_cost(fill, pos, volume[t], costs))
                    opened = None
                if target and (pos == 0 or turned):
                    opened = (t, fill, target, paid)
                cash -= delta * fill + paid
                pos = target
        equity = cash + pos * c[t]
        curve.append({"position": int(np.sign(pos)), "shares": pos, "cost": paid, "equity": equity, "ret": (equity - before) / before if t and before > 0 else 0.0})
        before = equity
        side = 0 if math.isnan(signal[t]) else int(signal[t])
        size = 1.0 if math.isnan(scale[t]) else scale[t]
    if pos and opened:
        close_trade(len(c) - 1, c[-1], 0.0)
    return curve, trades


class GaussianHMM:
    """Hidden Markov model with Gaussian states, fitted by expectation
    maximisation on z-scored rows."""

    def __init__(self, states: int = 4, steps: int = 100, seed: int = 42, full: bool = False):
        self.k, self.steps, self.seed, self.full = states, steps, seed, full

    def _log_density(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), self.k))
        for j in range(self.k):
            d = x - self.mean[j]
            out[:, j] = -0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(self.cov[j]), d) + np.linalg.slogdet(2 * np.pi * self.cov[j])[1])
        return out

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) / self.spread

    def fit(self, x: np.ndarray) -> GaussianHMM:
        if len(x) < 30 * self.k:
            raise ValueError(f"{len(x)} rows are too few for {self.k} states")
        self.centre, self.spread = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
        x = self._scaled(x)
        rng = np.random.default_rng(self.seed)
        self.mean = x[rng.choice(len(x), self.k, replace=False)]
        for _ in range(20):  # a start by k-means
            near = ((x[:, None] - self.mean[None]) ** 2).sum(2).argmin(1)
            self.mean = np.array([x[near == j].mean(0) if (near == j).any() else self.mean[j] for j in range(self.k)])
        self.cov = np.array([np.cov(x.T).reshape(x.shape[1], -1) + 1e-3 * np.eye(x.shape[1])] * self.k)
        self.start, self.move = np.full(self.k, 1 / self.k), np.full((self.k, self.k), 0.1 / max(self.k - 1, 1))
        np.fill_diagonal(self.move, 0.9 if self.k > 1 else 1.0)
        last = -np.inf
        for _ in range(self.steps):
            alpha, beta, scale, b = self._passes(x)
            gamma = alpha * beta
            gamma /= gamma.sum(1, keepdims=True)
            xi = self.move * (alpha[:-1].T @ (b[1:] * beta[1:] / scale[1:, None]))
            self.start, self.move = gamma[0], xi / np.maximum(xi.sum(1, keepdims=True), 1e-300)
            weight = gamma.sum(0)
            self.mean = gamma.T @ x / weight[:, None]
            for j in range(self.k):
                d = x - self.mean[j]
                c = (gamma[:, j, None] * d).T @ d / weight[j]
                self.cov[j] = (c if self.full else np.diag(np.diag(c))) + 1e-3 * np.eye(x.shape[1])
            score = float(np.log(scale).sum() + self._shift)
            if score - last < 1e-4:
                break
            last = score
        return self

    def _emissions(self, x: np.ndarray) -> np.ndarray:
        log = self._log_density(x)
        top = log.max(1, keepdims=True)
        self._shift = float(top.sum())
        return np.exp(log - top)

    def _passes(self, x: np.ndarray):
        b = self._emissions(x)
        alpha, scale = np.empty_like(b), np.empty(len(b))
        a = self.start * b[0]
        for t in range(len(b)):
            if t:
                a = (alpha[t - 1] @ self.move) * b[t]
            scale[t] = max(a.sum(), 1e-300)
            alpha[t] = a / scale[t]
        beta = np.ones_like(b)
        for t in range(len(b) - 2, -1, -1):
            beta[t] = self.move @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
        return alpha, beta, scale, b

    def filtered(self, x: np.ndarray) -> np.ndarray:
        """P(state at t | rows up to t), by the forward recursion alone."""
        return self._passes(self._scaled(x))[0]

    def smoothed(self, x: np.ndarray) -> np.ndarray:
        """P(state at t | all rows): looks ahead."""
        alpha, beta, _, _ = self._passes(self._scaled(x))
        out = alpha * beta
        return out / out.sum(1, keepdims=True)

    def path(self, x: np.ndarray) -> np.ndarray:
        """The most likely sequence of states."""
        log, move = self._log_density(self._scaled(x)), np.log(np.maximum(self.move, 1e-300))
        best, back = np.log(np.maximum(self.start, 1e-300)) + log[0], np.zeros(log.shape, int)
        for t in range(1, len(log)):
            through = best[:, None] + move
            back[t] = through.argmax(0)
            best = through.max(0) + log[t]
        out = np.empty(len(log), int)
        out[-1] = int(best.argmax())
        for t in range(len(log) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out


def state_names(path: np.ndarray, ret: np.ndarray, vol: np.ndarray, k: int) -> dict[int, str]:
    """Names of states by their mean return and volatility."""
    mean = {j: ret[path == j].mean() if (path == j).any() else 0.0 for j in range(k)}
    risk = {j: vol[path == j].mean() if (path == j).any() else 0.0 for j in range(k)}
    by_risk = sorted(range(k), key=lambda j: risk[j])
    if k == 4:
        calm = sorted(by_risk[:-1], key=lambda j: mean[j])
        return {by_risk[-1]: "crisis", calm[0]: "trending_down", calm[1]: "range_bound", calm[2]: "trending_up"}
    if k == 3:
        middle = by_risk[1]
        return {by_risk[2]: "crisis", by_risk[0]: "range_bound", middle: "trending_up" if mean[middle] >= 0 else "trending_down"}
    return {j: f"state_{j}_vol_{rank}" for rank, j in enumerate(by_risk)}
