"""Whole runs: isolation of symbols, sinks that come back, consolidated tables."""

import json

import pytest
from pyspark.sql import functions as F

from barline import cli
from barline.operators import learning, passes, quarantine, reports, trees
from barline.plans.run import Run
from barline.plans.settings import Learned, Plan
from barline.sources import sinks

SF = "/root/testdata/sf0.01"
BARS = "symbol string, d date, open double, high double, low double, close double, volume double"


def bar(symbol, day, close):
    return f"select '{symbol}' as symbol, date '2020-01-{day:02}' as d, {close} as open, {close} as high, {close} as low, {close} as close, 1D as volume"


def test_faulty_symbols_are_named_and_the_others_stay(spark):
    rows = [bar("good", 1, "1D"), bar("good", 2, "2D"), bar("zero", 1, "0D"), bar("zero", 2, "1D"), bar("none", 1, "cast(null as double)"), bar("odd", 1, "double('NaN')")]
    df = spark.sql(" union all ".join(rows))
    bad = quarantine.examined(df, ("good", "absent", "absent"))
    assert {tuple(r) for r in bad.collect()} == {("zero", "a price is 0 or less"), ("none", "no close"), ("odd", "a price is not finite"), ("absent", "no bars in range")}
    assert {r.symbol for r in quarantine.sound(df, bad).collect()} == {"good"}
    nothing = spark.createDataFrame([], BARS)
    assert quarantine.examined(nothing).count() == 0 and quarantine.sound(nothing, quarantine.examined(nothing)).count() == 0


def test_a_failing_pass_sets_its_symbol_apart(spark):
    df = spark.sql(" union all ".join([bar("a", 1, "1D"), bar("b", 1, "2D"), bar("b", 2, "3D")]))

    def broken(bars):
        if bars.column("symbol")[0].as_py() == "b":
            raise ValueError("no such bar")
        return {"twice": passes.floats(bars, "close") * 2}

    def again(bars):
        return {"thrice": passes.floats(bars, "twice") * 1.5}

    steps = [passes.Step({"twice": "double"}, broken)], [passes.Step({"thrice": "double"}, again)]
    out = passes.by_group(passes.by_group(quarantine.watched(df), steps[0]), steps[1])
    good, failed = quarantine.split(out)
    assert [(r.symbol, r.twice, r.thrice) for r in good.collect()] == [("a", 2.0, 3.0)] and "error" not in good.columns
    assert [tuple(r) for r in failed.collect()] == [("b", "ValueError: no such bar")]
    with pytest.raises(Exception, match="no such bar"):
        passes.by_group(df, steps[0]).collect()


def test_symbols_named_replace_their_partitions_alone(spark, tmp_path):
    at = f"{tmp_path}/t"
    table = lambda rows: spark.createDataFrame(rows, "symbol string, x int")
    sinks.write_by_symbol(table([("007", 1), ("^G/x", 2), ("c", 3)]), f"{at}/interval=1d", "csv")
    sinks.write_by_symbol(table([("007", 9)]), f"{at}/interval=1d", "csv", ("007", "^G/x"))
    read = lambda: {tuple(r) for r in sinks.read_run(spark, str(tmp_path), "t").select("symbol", "x").collect()}
    assert read() == {("007", 9), ("c", 3)}
    sinks.write_by_symbol(table([("d", 4)]), f"{at}/interval=1d", "csv")
    assert read() == {("d", 4)} and sinks.read_run(spark, str(tmp_path), "absent") is None


def test_factor_documents_come_back(spark, tmp_path):
    regressed = spark.sql("""select * from values
        ('A', 'signal_x', 'CAPM', 0.1234567D, 0.00123456789D, 2.5D, 0.01D, true, 0.5D, 0.4D, 0.1D, 0.2D, 40L, map('mkt', 1.23456D)),
        ('A', 'signal_x', 'FF3', 0.1D, 0.0D, 0D, 1D, false, 0D, 0D, 0D, 0D, 12L, map('mkt', 1D, 'smb', 2D, 'hml', 3D)),
        ('B', 'signal_x', 'CAPM', 0D, 0D, 0D, 1D, false, 0D, 0D, 0D, 0D, 0L, map('mkt', 0D))
        as t(symbol, signal, model, alpha_annual, alpha_daily, t_stat, p_value, significant, r2, adj_r2, ic, ir, n_obs, betas)""")
    sinks.write_run({"factor_report": lambda: sinks.factor_report(regressed, regressed.select("symbol", "signal", "model"))}, str(tmp_path))
    docs = sinks.read_documents(spark, str(tmp_path), "factor_report")
    one = json.loads(docs.filter("ticker = 'A'").first().value)
    assert one["ticker"] == "A" and [x["model"] for x in one["regressions"]["signal_x"]] == ["CAPM", "FF3"] and one["regressions"]["signal_x"][0]["betas"] == {"MKT": 1.2346}
    assert one["attribution_table"][0] == {"signal": "signal_x", "model": "CAPM"}
    kept, out = reports.regressions_of(docs)
    assert {(r.ticker, r.model, r.alpha_annual, r.n_obs, r.low_sample_size, r.beta_MKT, r.beta_HML) for r in kept.collect()} == {("A", "CAPM", 0.123457, 40, False, 1.2346, None), ("A", "FF3", 0.1, 12, True, 1.0, 3.0)}
    assert [r.ticker for r in out.collect()] == ["B"]


def test_quality_of_a_column_has_its_shape(spark):
    df = spark.sql("select 'a' as symbol, date '2020-01-01' as d, explode(array(1D, 2D, 3D, 10D, null)) as x union all select 'b', date '2020-01-01', 1D")
    got = {r.symbol: r["columns"][0] for r in sinks.quality_report(df, ["x"]).collect()}
    a = got["a"]
    # as the bias-corrected sample statistics of 1, 2, 3, 10
    assert (a.missing_pct, a.mean, a.min, a.q25, a.median, a.q75, a.max) == (20.0, 4.0, 1.0, 1.75, 2.5, 4.75, 10.0)
    assert (a["skew"], a.kurt) == (pytest.approx(1.7636, abs=1e-4), pytest.approx(3.2280, abs=1e-4))
    assert (got["b"]["skew"], got["b"].kurt, got["b"]["std"]) == (None, None, None)


def test_learned_signal_is_the_prediction_of_its_bar(spark):
    df = spark.sql("select 'a' as symbol, explode(sequence(date '2020-01-01', date '2020-01-04')) as d")
    told = spark.sql("select 'a' as symbol, date '2020-01-02' as d, 0.02D as prediction union all select 'a', date '2020-01-03', -0.02D union all select 'a', date '2020-01-04', 0.001D")
    assert [r.signal_ml for r in learning.with_signal(df, told).orderBy("d").collect()] == [0, 1, -1, 0]


def test_a_run_writes_reads_and_consolidates(spark, tmp_path, monkeypatch):
    out, to = str(tmp_path / "out"), str(tmp_path / "bi")
    real = Run.bars

    def with_a_broken_symbol(self):
        b = real(self)
        return b.withColumn("close", F.when(F.col("symbol") == "2-HIGH", F.lit(0.0)).otherwise(F.col("close")))

    monkeypatch.setattr(Run, "bars", with_a_broken_symbol)
    plan = Plan(symbols=("1-URGENT", "2-HIGH", "5-LOW"), start="1994-01-01")
    made = cli.settings(cli.parser().parse_args(["--ml"]))
    assert sinks.consolidate(spark, out, to) == []
    run = Run(spark, SF, plan, f"{out}/_stages", Learned(trees.Trees(n=2), folds=learning.Folds(n_folds=2)))
    names = sinks.write_run(cli.outputs(run, made), out, "csv", plan.interval, plan.symbols)
    assert {"backtest", "factor_report", "regime_report", "quarantine", "ml_folds", "feature_correlations"} <= set(names)
    assert [tuple(r) for r in sinks.read_run(spark, out, "quarantine").select("symbol", "reason").collect()] == [("2-HIGH", "a price is 0 or less")]
    back = sinks.read_run(spark, out, "backtest")
    pairs = {(r.symbol, r.signal) for r in back.collect()}
    assert {s for s, _ in pairs} == {"1-URGENT", "5-LOW"} and len(pairs) == 2 * 14 and ("5-LOW", "signal_ml") in pairs
    assert set(sinks.consolidate(spark, out, to)) == {"backtest_results", "gating_comparison", "rolling_alpha", "ml_fold_report", "ml_threshold_sweep", "regime_sharpe", "factor_attribution", "quarantined"}
    table = lambda name: spark.read.csv(f"{to}/{name}", header=True)
    assert table("backtest_results").columns[0] == "ticker" and table("backtest_results").count() == 28
    assert table("factor_attribution").count() == run.regressions.count() and table("regime_sharpe").count() == run.market_performance.count()
    assert {r.ticker for r in table("ml_fold_report").collect()} == {"1-URGENT", "5-LOW"} and table("quarantined").count() == 0
