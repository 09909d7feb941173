import math

import numpy as np
import pandas as pd
import pytest

from barline.operators import kernels as k
from regression import ols_hac, student_tail

NAN = float("nan")


def test_ema_matches_pandas_with_gaps():
    x = np.array([NAN, 1.0, 2.0, NAN, 3.0, 4.0])
    want = pd.Series(x).ewm(alpha=0.5, adjust=False, min_periods=2).mean().to_numpy()
    np.testing.assert_allclose(k.ema(x, 0.5, 2), want)


def test_rsi_machine_enters_holds_and_leaves():
    r = np.array([50, 25, 40, 55, 60, 75, 60, 45.0])
    out = k.rsi_machine(r, r, r, r, 30, 70, 50, 2, 20)
    assert out.tolist() == [0, 1, 1, 0, 0, -1, -1, 0]


def test_missing_input_emits_zero_and_keeps_the_position():
    z = np.array([0.0, -3.0, NAN, -1.0, 0.5])
    assert k.zscore_machine(z, 2, 0, 1, 20).tolist() == [0, 1, 0, 1, 0]


def test_forced_exit_does_not_reenter_on_its_row():
    z = np.full(6, -3.0)
    assert k.zscore_machine(z, 2, 0, 1, 2).tolist() == [0, 1, 1, 0, 1, 1]


def test_macd_flips_and_skips_the_row_of_a_forced_exit():
    h = np.array([-1, 1, 1, -1, -1, -1, -1.0])
    assert k.macd_machine(h, h, False, 1, 2).tolist() == [0, 1, 1, 0, 0, 0, 0]
    assert k.macd_machine(np.array([-1, 1, 1, -1, -1.0]), h, False, 1, 20).tolist() == [0, 1, 1, -1, -1]


def test_unknown_band_mode():
    with pytest.raises(ValueError):
        k.band_machine(*[np.ones(3)] * 4, np.ones(3, bool), "other", 2, 10)


def test_breaker_closes_and_opens_again():
    ret = np.r_[np.zeros(50), np.full(30, -0.03), np.full(40, 0.04), np.zeros(80)]
    gate = k.breaker(np.ones(200), ret, 0.15, 0.95)
    assert gate[:50].all() and not gate[60] and gate[-1]


def test_ols_recovers_alpha_and_beta():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.01, (2000, 1))
    r = ols_hac(0.001 + 1.5 * x[:, 0] + rng.normal(0, 0.001, 2000), x)
    assert abs(r["betas"][0] - 1.5) < 0.02 and r["t_stat"] > 2 and r["p_value"] < 0.05
    assert ols_hac(np.zeros(10), x[:10])["n_obs"] == 0


def test_hmm_filter_looks_at_no_later_row():
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(0, 1, (200, 2)), rng.normal(5, 1, (200, 2))]
    m = k.GaussianHMM(2, 20).fit(x)
    np.testing.assert_allclose(m.filtered(x)[:250], m.filtered(x[:250]), atol=1e-9)
    np.testing.assert_allclose(m.smoothed(x).sum(1), 1)
    np.testing.assert_allclose(m.move.sum(1), 1)
    with pytest.raises(ValueError):
        k.GaussianHMM(4).fit(x[:50])


def test_event_engine_fills_on_the_next_bar():
    costs = {"spread_bps": 0.0, "slippage_bps": 0.0, "commission": 0.0, "commission_pct": 0.0}
    cfg = {"capital": 1000.0, "sizing": "fixed_shares", "notional": 0.0, "vol_target": 0.1, "fill": "close"}
    c = np.array([10.0, 11.0, 12.0, 11.0])
    curve, trades = k.event_engine(c, c, c, c, np.ones(4), np.array([1, 1, 0, 0.0]), np.ones(4), None, cfg, costs)
    assert [round(r["equity"]) for r in curve] == [1000, 1000, 1100, 1000]
    assert len(trades) == 1 and trades[0]["entry"] == 1 and trades[0]["exit"] == 3
    assert math.isclose(trades[0]["shares"], 100)
