"""Library factor files and their cache."""

import pytest

from barline import cli
from barline.plans.run import Run
from barline.plans.settings import Plan
from barline.sources import bars

SF = "/root/testdata/sf0.001"
THREE = """Made of daily returns, 199601 on.
Missing values are -99.99 or -999.

,Mkt-RF,SMB,HML,RF
19960102,   0.10,  -0.25,  -0.27,   0.009
19960103,  -99.99,   1.00,   -999,   0.009
19960104,   0.30,   0.30,   0.30,   0.009

 Annual Factors: January-December
,Mkt-RF,SMB,HML,RF
  1996,   29.47,   -2.04,   -4.54,    3.12

Copyright, all rights
"""
MOMENTUM = ",Mom\n19960102, 0.5\n19960103, 0.6\n19960103, 0.6\n"


@pytest.fixture
def files(tmp_path):
    (tmp_path / "three.csv").write_text(THREE)
    (tmp_path / "mom.csv").write_text(MOMENTUM)
    return str(tmp_path / "three.csv"), str(tmp_path / "mom.csv")


def test_library_files_skip_prose_and_years(spark, files):
    got = {str(r.d): (r.mkt, r.smb, r.hml, r.rf) for r in bars.read_library(spark, files[0]).collect()}
    assert got == {"1996-01-02": (0.1, -0.25, -0.27, 0.009), "1996-01-03": (None, 1.0, None, 0.009), "1996-01-04": (0.3, 0.3, 0.3, 0.009)}
    joined = {str(r.d): r for r in bars.join_factors(*[bars.read_library(spark, f) for f in files]).collect()}
    assert set(joined) == {"1996-01-02", "1996-01-03"} and joined["1996-01-02"].mom == pytest.approx(0.005) and joined["1996-01-02"].mkt == pytest.approx(0.001)


def test_a_file_without_a_header_is_refused(spark, tmp_path):
    (tmp_path / "none.csv").write_text("19960102, 1\n")
    with pytest.raises(ValueError, match="0 headers"):
        bars.read_library(spark, str(tmp_path / "none.csv"))


def test_the_cache_keeps_only_usable_factors(spark, tmp_path):
    made = []

    def make(sql):
        return lambda: made.append(sql) or spark.sql(sql)

    at = str(tmp_path / "cache")
    empty, poor, good = "select date '2020-01-01' as d, 0.1D as mkt limit 0", "select date '2020-01-01' as d, 0.1D as rf", "select date '2020-01-01' as d, 0.1D as mkt"
    assert bars.cached_factors(spark, at, make(empty)).count() == 0 and bars.cached_factors(spark, at, make(poor)).count() == 1
    assert bars.cached_factors(spark, at, make(good)).first().mkt == 0.1 and bars.cached_factors(spark, at, make(empty)).first().mkt == 0.1
    assert made == [empty, poor, good]
    spark.sql(poor).write.mode("overwrite").parquet(at)
    assert bars.cached_factors(spark, at, make(good)).first().mkt == 0.1 and len(made) == 4


def test_a_run_takes_the_library_before_the_tables(spark, files, tmp_path):
    assert cli.parser().parse_args(["--factors", *files]).factors == list(files)
    run = Run(spark, SF, Plan(start="1996-01-01", end="1997-01-01"), str(tmp_path / "stages"), library=files)
    assert {str(r.d): r.mom for r in run.market.collect()} == {"1996-01-02": pytest.approx(0.005), "1996-01-03": pytest.approx(0.006)}
    outside = Run(spark, SF, Plan(start="1997-01-01"), library=files).market
    assert outside.filter("d < date '1997-01-01'").count() == 0 and outside.columns == Run(spark, SF).market.columns
