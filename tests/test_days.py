"""Days made in the pass over a symbol equal those made by windows."""

import datetime
import math

import pytest

from barline.operators import clean, days, features
from barline.sources import bars as sources

DAY = datetime.date(2024, 1, 1)
SCHEMA = "symbol string, d date, open double, high double, low double, close double, volume double, note string"


def bar(symbol, day, close, high=2.0, low=-2.0, volume=10.0):
    return (symbol, None if day is None else DAY + datetime.timedelta(day), close, None if close is None else close + high, None if close is None else close + low, close, volume, f"{symbol} {day}")


ODD = [
    *[bar("A", 3 * i + i % 5, 100 + 7 * math.sin(i)) for i in range(120)], *[bar("B", i, 50.0 + i % 4) for i in range(60)],
    bar("C", 0, None), bar("C", 4, 5.0), bar("C", 5, None, volume=None), bar("C", 9, 0.0), bar("C", 12, -3.0), bar("C", 13, float("nan")), bar("C", 20, 8.0), bar("C", 21, float("inf")), bar("C", 30, 4.0),
    bar(None, 0, 1.0), bar(None, 3, 2.0), bar("D", 7, 3.0), bar("E", None, 3.0), bar("F", None, 1.0), bar("F", 2, 1.0), bar("F", 4, 2.0)]


def rows_of(df):
    told = lambda x: None if x is None else "nan" if isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) and math.isfinite(x) else x
    return sorted((tuple(told(x) for x in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("rows", [ODD, [], [bar("F", None, 1.0)]])
def test_days_of_the_pass_equal_those_of_windows(spark, rows):
    given = spark.createDataFrame(rows, SCHEMA)
    by_windows = clean.normed(features.all_features(clean.moved(clean.filled(given)), also=clean.NORM))
    by_pass = features.of_bars(given)
    assert days.fits(given) and by_pass.columns == by_windows.columns and by_pass.dtypes == by_windows.dtypes
    assert rows_of(by_pass) == rows_of(by_windows)
    assert len(rows) < 2 or by_pass.count() > 400


def test_bars_of_other_kinds_go_by_windows(spark):
    given = spark.createDataFrame([bar("A", i, 1.0 + i) for i in range(9)], SCHEMA).withColumn("volume", features.F.col("volume").cast("long"))
    assert not days.fits(given) and features.of_bars(given).count() == 9


def test_supplier_features_shuffle_once_and_sort_no_days(spark):
    plan = features.of_bars(sources.bars_supplier(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().simpleString()
    assert plan.count("Exchange") == 1 and "explode" not in plan
    assert plan.count("Sort [") == 2  # of bars
