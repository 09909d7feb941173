"""Queries against their SQL on the smallest tables, a sample of each family."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from barline.plans import registry

SF = "/root/testdata/sf0.001"
CHECKED = ["src_03_bars_walk", "cln_01_clean", "fea_00_all", "sig_00_all", "gat_15_all_presets", "gat_16_ensemble", "gat_17_filter_stats", "sig_07_correlations", "bt_10_event_driven", "fac_03_classic_capm", "reg_12_adaptive", "met_00_all", "pip_02_gating_comparison", "fac_13_performance_by_regime", "ml_08_threshold_sweep", "sch_03_sector_counts"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        return None if v is None or pd.isna(v) else round(v, 5) + 0.0 if isinstance(v, float) else str(v)[:10] if hasattr(v, "year") else v

    cols = sorted(df.columns)
    return sorted((tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert [(x, y) for x, y in zip(a, b, strict=True) if str(x) != str(y)] == []


def test_every_sql_belongs_to_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
