"""Regressions by aggregates against least squares of each group in NumPy."""

import datetime as dt

import numpy as np
import pytest

from barline.operators import factors
from regression import ols_hac

MODELS = {"CAPM": ["mkt"], "FF3": ["mkt", "smb", "hml"], "Carhart4": ["mkt", "smb", "hml", "mom"]}
SCHEMA = "symbol string, signal string, d date, excess double, mkt double, smb double, hml double, mom double"


@pytest.fixture(scope="module")
def groups():
    """Days of groups: many, as few as count, too few, none with factors, without variation."""
    draw, out = np.random.default_rng(5), {}
    for name, n in (("long", 900), ("short", 30), ("few", 29), ("calm", 60), ("bare", 50)):
        x = draw.normal(0, 0.01, (n, 4))
        noise = draw.normal(0, 0.004, n)
        y = 0.001 + x @ [1.2, -0.5, 0.3, 0.0] + noise + 0.5 * np.r_[0, noise[:-1]]  # residuals that depend on the day before
        out[name] = np.column_stack([y, x])
    out["calm"][:, 0] = 0.002
    out["bare"][:, 1:] = np.nan
    out["long"][5, 2], out["long"][9, 0] = np.nan, np.nan
    return out


@pytest.mark.parametrize("errors", ["hac", "classic"])
def test_regressions_against_numpy(spark, groups, errors):
    start = dt.date(2001, 1, 1)
    rows = [("s", g, start + dt.timedelta(days=i), *[None if v != v else float(v) for v in day]) for g, days in groups.items() for i, day in enumerate(days)]
    got = {(r.signal, r.model): r for r in factors.regressions(spark.createDataFrame(rows, SCHEMA).repartition(3), errors=errors).collect()}
    assert len(got) == len(groups) * len(MODELS)
    for (g, m), r in got.items():
        used = [0, *[1 + ["mkt", "smb", "hml", "mom"].index(f) for f in MODELS[m]]]
        days = groups[g][:, used]
        days = days[~np.isnan(days).any(1)]
        want = ols_hac(days[:, 0], days[:, 1:], errors)
        assert r.n_obs == want["n_obs"] and set(r.betas) == set(MODELS[m])
        np.testing.assert_allclose([r.betas[f] for f in MODELS[m]], want["betas"], rtol=1e-7, atol=1e-12)
        for c in ("alpha_daily", "alpha_annual", "t_stat", "p_value", "r2", "adj_r2", "ic", "ir"):
            assert r[c] == pytest.approx(want[c], rel=1e-6, abs=1e-9), (g, m, c)
        assert r.significant == (abs(want["t_stat"]) > 2 and want["p_value"] < 0.05)


def test_a_repeated_factor_adds_nothing(spark, groups):
    start = dt.date(2001, 1, 1)
    rows = [("s", "g", start + dt.timedelta(days=i), float(y), float(a), float(a), float(b), 0.0) for i, (y, a, _, b, _) in enumerate(groups["short"])]
    got = {r.model: r for r in factors.regressions(spark.createDataFrame(rows, SCHEMA), {"one": ["mkt", "hml"], "same": ["mkt", "smb", "hml", "mom"]}).collect()}
    assert got["same"].r2 == pytest.approx(got["one"].r2) and got["same"].betas["smb"] == 0 == got["same"].betas["mom"]
    with pytest.raises(ValueError):
        factors.regressions(spark.createDataFrame(rows, SCHEMA), errors="other")
