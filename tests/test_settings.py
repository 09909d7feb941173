"""Every setting reaches the plan of a run, and the plan its stages."""

import pytest
from pyspark.sql import functions as F

from barline import cli, config
from barline.operators import learning
from barline.plans import frames
from barline.plans.settings import Learned, Plan, learned_of, plan_of

SF = "/root/testdata/sf0.001"


def planned(*flags):
    return plan_of(cli.settings(cli.parser().parse_args(list(flags))))


def test_no_flags_are_the_plan_of_the_queries():
    assert planned() == Plan()


def test_each_flag_changes_the_plan(tmp_path):
    assert (planned("--start", "1996-01-01").start, planned("--end", "1997-01-01").end) == ("1996-01-01", "1997-01-01")
    assert planned("--period", "max").start == "1970-01-01" and planned("--symbols", "a", "b").symbols == ("a", "b") and planned("--interval", "1wk").interval == "1wk"
    crypto = planned("--preset", "crypto")
    assert crypto.rules.z_window == 30 and {3, 14, 21, 30} <= set(crypto.vol_windows) and crypto.band == (20, 2.5) and crypto.gates != Plan().gates
    file = tmp_path / "run.yaml"
    file.write_text("backtest: {position_sizing: vol_target, cost_model: small_cap, initial_capital: 5000, max_drawdown_exit: 0.2}\nsignals: {rsi: {oversold: 20}, holding: {min_bars: 4}}\nregime_filter: {bb_percentile: 10}\nfactor: {rf_annual: 0.01}\n")
    told = planned("--config", str(file))
    assert (told.setup.sizing, told.setup.capital, told.setup.max_drawdown_exit, told.setup.costs.spread_bps) == ("vol_target", 5000.0, 0.2, 10.0)
    assert (told.rules.oversold, told.rules.min_holding, told.rf_annual) == (20.0, 4, 0.01) and told.gates != Plan().gates
    with pytest.raises(ValueError):
        plan_of(config.merged(config.load(), {"backtest": {"cost_model": "other"}}))


def test_the_learned_signal_comes_from_its_section(tmp_path):
    said = lambda *flags: learned_of(cli.settings(cli.parser().parse_args(list(flags))))
    assert said() is None and said("--ml") == Learned()
    file = tmp_path / "run.yaml"
    file.write_text("ml_signal: {enabled: true, model_type: random_forest, deadband: 0.01, target_col: returns_fwd_1, n_folds: 3, min_train_bars: 100, test_bars: 20, expanding: false, train_window_bars: 90, embargo_bars: 1}\n")
    assert said("--config", str(file)) == Learned("random_forest", "returns_fwd_1", 0.01, learning.Folds(3, 100, 20, False, 90, 1))
    with pytest.raises(ValueError):
        learned_of({"ml_signal": {"enabled": True, "model_type": "other"}})


def test_dates_symbols_and_interval_choose_the_bars(spark):
    got = frames.cleaned(spark, SF, planned("--start", "1996-01-01", "--end", "1997-01-01", "--symbols", "5-LOW")).agg(F.min("d").alias("a"), F.max("d").alias("b"), F.count_distinct("symbol").alias("n")).first()
    assert got.n == 1 and "1996-01-01" <= str(got.a) <= str(got.b) < "1997-01-01"
    daily, weekly = frames.walk(spark, SF), frames.walk(spark, SF, planned("--interval", "1wk"))
    assert weekly.agg(F.sum("volume")).first()[0] == daily.agg(F.sum("volume")).first()[0] and weekly.count() < daily.count()
    assert frames.cleaned(spark, SF, planned("--interval", "1wk")).filter("close is null").count() == 0
    with pytest.raises(ValueError):
        frames.walk(spark, SF, planned("--interval", "5m"))


def test_a_preset_changes_the_signals(spark):
    usual, crypto = frames.signalled(spark, SF), frames.signalled(spark, SF, planned("--preset", "crypto"))
    assert {"z_price_30d", "vol_14d", "vol_21d"} <= set(crypto.columns)
    active = lambda df: df.agg(F.count_if(F.col("signal_zscore") != 0)).first()[0]
    assert active(usual) != active(crypto)
