"""Settings files, sinks, the chart source and report readers."""

import json
import math

import pytest
from pyspark.sql import functions as F

from barline import cli, config
from barline.operators import gates, reports
from barline.sources import bars, charts, sinks
from regression import student_tail


def test_settings_merge_by_section(tmp_path):
    path = tmp_path / "run.yaml"
    path.write_text("interval: 1h\nbacktest:\n  target_notional: 5\nextra:\n  a: 1\n")
    made = config.load(str(path), "crypto", timezone="Asia/Tokyo")
    assert (made["interval"], made["timezone"], made["extra"]) == ("1d", "Asia/Tokyo", {"a": 1})
    assert made["backtest"] == {**config.DEFAULTS["backtest"], "target_notional": 5} and "_description" not in made
    config.export(made, str(tmp_path / "out.yaml"))
    assert config.load(str(tmp_path / "out.yaml")) == made


def test_watchlist_keeps_comments_and_line_ends():
    text = "a: 1\r\nwatchlist:  # mine\r\n  - AAPL # fruit\r\n  # note\r\n  - \"ON\"\r\nb: 2\r\n"
    out = sinks.add_to_watchlist(text, ["msft", "^gspc", "on", "aapl", "no"])
    assert out == "a: 1\r\nwatchlist:  # mine\r\n  - AAPL # fruit\r\n  # note\r\n  - \"ON\"\r\n  - MSFT\r\n  - \"^GSPC\"\r\n  - \"NO\"\r\nb: 2\r\n"
    assert sinks.add_to_watchlist("a: 1\n", ["X"]) == "a: 1\nwatchlist:\n  - X\n"


def test_command_line_without_a_session(tmp_path, capsys):
    path = tmp_path / "c.yaml"
    path.write_text("watchlist:\n  - A\n")
    assert cli.main(["--config", str(path), "--add", "b"]) == 0 and path.read_text() == "watchlist:\n  - A\n  - B\n"
    assert cli.main(["--preset", "forex", "--export-config", str(tmp_path / "o.yaml")]) == 0 and config.load(str(tmp_path / "o.yaml"))["signals"]["rsi"]["oversold"] == 35
    assert cli.main(["--tables", "x", "--dry-run", "--start", "2020-01-01", "--no-factor"]) == 0 and "factors False" in capsys.readouterr().out


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "s", 1.23456), ("b", "s", None)], "symbol string, signal string, sharpe double")
    for fmt in ("csv", "parquet", "json"):
        sinks.write(sinks.rounded(df, 2), f"{tmp_path}/{fmt}", fmt)
        back = spark.read.option("header", True).format(fmt).load(f"{tmp_path}/{fmt}")
        assert {(r.symbol, None if r.sharpe is None else float(r.sharpe)) for r in back.collect()} == {("a", 1.23), ("b", None)}
    with pytest.raises(ValueError, match="none of"):
        sinks.write(df, "x", "orc2")
    taken = set()
    assert [len(sinks.sheet_name("x" * 40, taken)) for _ in range(2)] == [31, 31] and len(taken) == 2
    wide = df.withColumns({"regime": F.lit("crisis"), "pct": F.lit(0.5)})
    docs = {r.symbol: json.loads(r.document) for r in sinks.regime_report(wide).collect()}
    assert docs == {"a": {"crisis": {"s": 1.235}, "pct_crisis": {"s": 0.5}}, "b": {"crisis": {"s": None}, "pct_crisis": {"s": 0.5}}}
    assert sinks.write_run({"flat": lambda: df, "documents": lambda: sinks.regime_report(wide)}, f"{tmp_path}/run") == ["flat", "documents"]


def test_charts_are_read_with_adjusted_prices(spark, tmp_path):
    quote = {"open": [1.0, 2.0, None], "high": [2.0, 4.0, None], "low": [1.0, 2.0, None], "close": [2.0, 4.0, None], "volume": [10, None, 5]}
    chart = {"chart": {"result": [{"meta": {"symbol": "A"}, "timestamp": [1577836800, 1577923200, 1578009600], "indicators": {"quote": [quote], "adjclose": [{"adjclose": [1.0, 4.0, None]}]}}]}}
    (tmp_path / "a.json").write_text(json.dumps(chart))
    (tmp_path / "b.json").write_text('{"chart": {"result": null}}')
    got = {str(r.ts.date()): (r.symbol, r.open, r.close, r.volume) for r in charts.read_charts(spark, str(tmp_path)).collect()}
    assert got == {"2020-01-01": ("A", 0.5, 1.0, 10.0), "2020-01-02": ("A", 2.0, 4.0, 0.0)}
    assert charts.read_charts(spark, str(tmp_path), start="2020-01-02").count() == 1


def test_report_readers_quarantine(spark, tmp_path):
    (tmp_path / "A_rolling_alpha.csv").write_text(",alpha\n2020-01-01,0.5\n")
    (tmp_path / "B_rolling_alpha.csv").write_text(",alpha\n")
    rows, empty = reports.load_rolling_alpha(spark, str(tmp_path))
    assert [(r.ticker, r.alpha) for r in rows.collect()] == [("A", 0.5)] and [r.ticker for r in empty.collect()] == ["B"]
    for t, n in (("A", 40), ("B", 0)):
        (tmp_path / f"{t}_factor_report.json").write_text(json.dumps({"regressions": {"signal_x": [{"model": "CAPM", "n_obs": n, "alpha_annual": 0.1, "betas": {"MKT": 1.5}}]}}))
    kept, out = reports.load_factor_reports(spark, str(tmp_path))
    assert [(r.ticker, r.signal, r.beta_MKT, r.low_sample_size) for r in kept.collect()] == [("A", "signal_x", 1.5, False)] and [r.ticker for r in out.collect()] == ["B"]


def test_factors_come_from_the_library_first(spark):
    mine = spark.sql("select date '2020-01-02' as d, 0.1D as mkt, 0.0D as rf")
    proxies = spark.sql("select date '2020-01-02' as d, 0.2D as mkt")
    at = ("2020-01-01", "2021-01-01")
    assert bars.load_factors(mine, proxies, *at).first().mkt == 0.1
    fallback = bars.load_factors(mine.limit(0), proxies, *at).first()
    assert fallback.mkt == 0.2 and fallback.rf == pytest.approx(1.05 ** (1 / 252) - 1)
    assert bars.load_factors(None, proxies, "2021-01-01", "2022-01-01").count() == 0


def test_students_tail():
    for t, df, p in ((0.0, 5, 1.0), (1.0, 1, 0.5), (2.0, 2, 0.18350342), (2.776445, 4, 0.05), (2.570582, 5, 0.05), (1.959964, 100_000, 0.0500)):
        assert math.isclose(student_tail(t, df), p, abs_tol=2e-5)


def test_presets_and_ensemble_have_their_own_percentiles():
    at = lambda s, k: s[k][1][0].percentile
    assert [at(gates.PRESETS, k) for k in gates.PRESETS] == [20, 25, 50, 40] and [at(gates.ENSEMBLE, k) for k in gates.ENSEMBLE] == [20, 20, 50, 50]
    assert gates.base_of("signal_bb_breakout_gated", ["signal_bb"]) is None and gates.base_of("signal_rsi_vol_trend_gated", ["signal_rsi"]) == "signal_rsi"
