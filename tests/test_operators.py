import datetime as dt

import pytest
from pyspark.sql import functions as F

from barline import config
from barline.operators import clean, features, gates, learning
from barline.sources import bars, search
from barline.streaming import bars as stream


def made(spark, closes):
    day = dt.date(2020, 1, 1)
    return spark.createDataFrame([("x", day + dt.timedelta(days=i), float(c)) for i, c in closes], "symbol string, d date, close double")


def test_limited_fill_takes_the_first_rows_of_a_gap(spark):
    df = clean.align(made(spark, [(0, 1), (4, 5)]))
    out = [r.close for r in clean.fill(df, "ffill", 2, ("close",)).orderBy("d").collect()]
    assert out == [1, 1, 1, None, 5]
    out = [r.close for r in clean.fill(df, "interpolate", None, ("close",)).orderBy("d").collect()]
    assert out == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        clean.fill(df, "other")


def test_required_columns(spark):
    with pytest.raises(KeyError):
        features.volatility(made(spark, [(0, 1)]))


def test_missing_gate_columns_are_closed_and_composites_need_conditions(spark):
    df = made(spark, [(0, 1)])
    assert df.select(gates.VolPercentile().column(df).alias("g")).first().g is False
    with pytest.raises(ValueError):
        gates.Composite(()).column(df)


def test_folds_keep_the_embargo():
    for _, lo, hi, a, b in learning.Folds().rows(700):
        assert lo == 0 and hi <= a - 5 and b - a == 63
    with pytest.raises(ValueError):
        learning.Folds().rows(100)


def test_csv_and_cache_round_trip(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Date,Open,Close Price\n2020-01-02,1,2\n2020-01-03,3,4\n")
    df = bars.read_csv(spark, str(tmp_path / "x.csv"), "x")
    assert {"symbol", "d", "open", "close_price"} <= set(df.columns)
    bars.write_cache(made(spark, [(0, 1), (1, 2), (2, 3)]), str(tmp_path / "cache"))
    assert bars.read_cache(spark, str(tmp_path / "cache"), ["x"], "2020-01-02", "2020-01-03").count() == 1
    with pytest.raises(ValueError):
        bars.fetch(df, ["x"], "2020-01-01", "2020-02-01", "2h")


def test_poisoned_factor_cache(spark):
    assert not bars.usable_factors(spark.createDataFrame([(0.1,)], "RF double"))
    assert bars.usable_factors(spark.createDataFrame([(0.1, 0.2)], "RF double, MKT double"))


def test_search_rejects_unknown_fields(spark):
    d = spark.createDataFrame([("A", "Alpha", "Tech", "Chips")], "symbol string, name string, sector string, industry string")
    assert search.search(d, "alp").count() == 1
    with pytest.raises(ValueError):
        search.search(d, "a", "price")


def test_presets_merge_and_dates():
    merged = config.apply_preset({"signals": {"rsi": {"oversold": 1, "own": 2}}}, "crypto")
    assert merged["signals"]["rsi"] == {"oversold": 25, "overbought": 75, "exit": 50, "smoothing": 2, "own": 2} and "_description" not in merged
    assert config.needed_windows(merged)[0] == (3, 14, 21, 30)
    assert config.period_dates("1y", dt.date(2021, 1, 1)) == ("2020-01-02", "2021-01-01")
    assert config.resolve_dates("max", None, "2020-05-05") == ("1970-01-01", "2020-05-05")
    with pytest.raises(ValueError):
        config.period_dates("5w")


def test_streamed_bars_equal_batch_bars(spark, tmp_path):
    folder = str(tmp_path / "events")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(folder)
    query = stream.windowed_bars(stream.event_stream(spark, folder)).writeStream.format("memory").queryName("bars_out").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("bars_out").agg(F.count("*").alias("n"), F.sum("volume").alias("v")).first()
    want = bars.bars_events(spark, "/root/testdata/sf0.001").agg(F.count("*").alias("n"), F.sum("volume").alias("v")).first()
    assert (got.n, got.v) == (want.n, want.v)


def test_reports_of_columns_without_spread(spark):
    told = spark.createDataFrame([(0, 0.5, float(x)) for x in range(4)] + [(1, float(x), 2.0 * x + 1) for x in range(4)] + [(2, 1.0, 3.0)], "fold_id int, prediction double, target double")
    assert {r.fold_id: round(r.ic, 12) for r in learning.fold_report(told).collect()} == {0: 0.0, 1: 1.0, 2: 0.0}
    df = spark.createDataFrame([(1.0, 2.0, 7.0), (2.0, None, 7.0), (3.0, 1.0, 7.0)], "a double, b double, c double")
    got = {(r.a, r.b): r.corr for r in features.correlations(df, ["a", "b", "c"]).collect()}
    assert round(got["a", "b"], 12) == -1 and round(got["a", "a"], 12) == 1
    assert all(got[pair] != got[pair] for pair in [("a", "c"), ("b", "c"), ("c", "c")])
