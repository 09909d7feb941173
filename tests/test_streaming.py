"""Streamed state against the batch stages."""

import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barline.operators import features, signals
from barline.operators.signals import Rules
from barline.streaming import bars as stream
from barline.streaming import positions

EVENTS = "/root/testdata/sf0.01/events.parquet"
MEANS = ["rsi_14", "macd_line", "macd_signal", "macd_histogram"]


def series(n, seed, gaps=()):
    x = 100 + np.cumsum(np.random.default_rng(seed).normal(0, 1, n))
    x[list(gaps)] = np.nan
    return pd.DataFrame({"symbol": "a", "d": pd.date_range("2020-01-01", periods=n, freq="D"), "close": x})


def test_state_in_pieces_equals_one_pass():
    bars = series(200, 5, (0, 1, 30, 31, 90))
    for rules in (Rules(), Rules(smoothing=3, min_holding=1, max_holding=4)):
        whole, _ = positions.advanced(bars, None, rules)
        state, out = None, []
        for lo, hi in ((0, 1), (1, 2), (2, 32), (32, 91), (91, 200)):
            piece, state = positions.advanced(bars[lo:hi].reset_index(drop=True), state, rules)
            out.append(piece)
        pd.testing.assert_frame_equal(pd.concat(out, ignore_index=True), whole)
        assert len(state[4]) == rules.smoothing - 1 and {-1, 0, 1} == set(whole.signal_rsi)


def test_state_equals_the_batch_stages(spark):
    bars = pd.concat([series(300, 1, (40, 41, 120)), series(150, 2).assign(symbol="b")])
    full = bars.assign(open=bars.close, high=bars.close, low=bars.close, volume=1000.0)
    batch = signals.positions(features.all_features(spark.createDataFrame(full).withColumn("d", F.to_date("d")).withColumns({c: F.nanvl(c, F.lit(None)) for c in ("open", "high", "low", "close")}).withColumn("returns", F.lit(0.0))))
    want = batch.select("symbol", "d", *MEANS, "signal_rsi").toPandas().sort_values(["symbol", "d"], ignore_index=True)
    got = pd.concat([positions.advanced(g.reset_index(drop=True), None, Rules())[0] for _, g in bars.groupby("symbol")], ignore_index=True)
    assert (got.signal_rsi == want.signal_rsi).all() and got.signal_rsi.abs().sum() > 0
    np.testing.assert_allclose(got[MEANS].astype(float), want[MEANS].astype(float), rtol=1e-9, atol=1e-9)


def test_micro_batches_of_events_equal_one_batch(spark, tmp_path):
    events = pd.read_parquet(EVENTS).sort_values("ts", ignore_index=True)
    folder, out = tmp_path / "events", str(tmp_path / "out")
    folder.mkdir()
    for k, part in enumerate(np.array_split(np.arange(len(events)), 3)):
        events.iloc[part].sample(frac=1, random_state=k).to_parquet(folder / f"{k}.parquet", coerce_timestamps="us", index=False)
        positions.run_available(spark, str(folder), out, late="1 hour")
    columns = ["symbol", "d", "close"]
    ordered = lambda df: df.toPandas().sort_values(["symbol", "d"], ignore_index=True)
    got = ordered(spark.read.parquet(f"{out}/positions"))
    bars = ordered(stream.windowed_bars(spark.read.parquet(str(folder))).select(*columns))
    bars = bars[bars.d + pd.Timedelta("1h") <= events.ts.max() - pd.Timedelta("1h")]
    want = pd.concat([positions.advanced(g.reset_index(drop=True), None, Rules())[0] for _, g in bars.groupby("symbol")], ignore_index=True)
    assert len(got) == len(want) > 100 and not got.out_of_order.any()
    assert (got[columns].astype(str) == want[columns].astype(str)).all(axis=None) and (got.signal_rsi == want.signal_rsi).all() and got.signal_rsi.abs().sum() > 0
    np.testing.assert_allclose(got[MEANS].astype(float), want[MEANS].astype(float), rtol=1e-9, atol=1e-9)


def test_bars_behind_their_symbol_are_marked(spark, tmp_path):
    for k, days in enumerate(([1, 2, 4], [3, 5, 5])):
        path = f"{tmp_path}/{k}.parquet"
        pd.DataFrame({"symbol": "a", "d": pd.to_datetime([f"2020-01-0{x}" for x in days]), "close": [1.0, 2.0, 3.0]}).to_parquet(path, coerce_timestamps="us")
        os.utime(path, (1_700_000_000 + 60 * k,) * 2)
    read = spark.readStream.schema("symbol string, d timestamp, close double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    query = positions.streamed(read).writeStream.format("memory").queryName("behind_out").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(100)
    got = sorted((r.d.day, r.close, r.out_of_order, r.signal_rsi) for r in spark.table("behind_out").collect() if r.d.day in (3, 4, 5))
    assert [(d, late) for d, _, late, _ in got] == [(3, True), (4, False), (5, False), (5, True)] and all((s is None) == late for _, _, late, s in got)
