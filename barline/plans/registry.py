"""All queries of the engine by name, with the SQL that checks them.

A query is a stage of the engine and a list of typed columns; the same list makes
the SQL's projection, so names, types and rounding agree. Letters: s string, d
date, t timestamp, i int, l long, b boolean, f double at six decimals, e at four.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.costs import SMALL_CAP
from ..operators import backtest, clean, factors, features, gates, learning, metrics, regimes, reports, signals
from ..sources import bars, search
from . import frames as at
from . import oracle as o

TYPES = {"s": ("string", "varchar"), "d": ("date", "date"), "t": ("timestamp_ntz", "timestamp"), "i": ("int", "integer"), "l": ("bigint", "bigint"), "b": ("boolean", "boolean")}
BAR = "symbol:s d:d"
PAIRED = "symbol:s signal:s"


#: Decimals of doubles; e is for equities, sums over thousands of bars.
DIGITS = {"f": 6, "e": 4}


@dataclass(frozen=True)
class Query:
    make: Callable[[SparkSession, str], DataFrame]
    columns: str
    ctes: list[tuple[str, str]] | None = None
    select: str | None = None

    def run(self, spark: SparkSession, sf: str) -> DataFrame:
        df = self.make(spark, sf)
        out = []
        for spec in self.columns.split():
            name, kind = spec.split(":")
            # the shift keeps exact decimals off the rounding's ties; adding 0 turns -0.0 into 0.0
            out.append((F.round(F.col(name).cast("double") + F.lit(3.1e-9), DIGITS[kind]) + F.lit(0.0) if kind in DIGITS else F.col(name).cast(TYPES[kind][0])).alias(name))
        return df.select(*out)

    def oracle(self) -> str | None:
        if self.select is None:
            return None
        out = []
        for spec in self.columns.split():
            name, kind = spec.split(":")
            out.append(f'round(cast("{name}" as double) + 3.1e-9, {DIGITS[kind]}) + 0.0::double as "{name}"' if kind in DIGITS else f'cast("{name}" as {TYPES[kind][1]}) as "{name}"')
        return o.sql([*self.ctes, ("answer", self.select)], f"select {', '.join(out)} from answer")


ALL: dict[str, Query] = {}


def add(name: str, make: Callable, columns: str, ctes: list | None = None, select: str | None = None) -> None:
    ALL[name] = Query(make, columns, ctes, select)


S = o.STAGES
OHLCV = "open:f high:f low:f close:f volume:f"

# Sources
add("src_01_fetch", lambda s, f: bars.fetch(at.walk(s, f), ["1-URGENT", "5-LOW"], "1996-01-01", "1999-01-01"), f"{BAR} {OHLCV}", S["bars"], "select * from bars where symbol in ('1-URGENT', '5-LOW') and d >= date '1996-01-01' and d < date '1999-01-01'")
add("src_03_bars_orders", at.bars.bars_orders, f"{BAR} {OHLCV}", [], "select o_orderpriority as symbol, cast(o_orderdate as date) as d, arg_min(o_totalprice, o_orderkey) as open, max(o_totalprice) as high, min(o_totalprice) as low, arg_max(o_totalprice, o_orderkey) as close, count(*) as volume from orders group by 1, 2")
add("src_03_bars_walk", at.walk, f"{BAR} {OHLCV}", S["bars"], "select * from bars")
add("src_03_bars_supplier", bars.bars_supplier, f"{BAR} {OHLCV}", o.walk("lineitem"), "select * from bars")
add("src_03_bars_events", bars.bars_events, f"symbol:s d:t {OHLCV}", [], "select event_type as symbol, date_trunc('hour', ts) as d, arg_min(value, ts) as open, max(value) as high, min(value) as low, arg_max(value, ts) as close, count(*) as volume from events group by 1, 2")
add("src_07_factors", at.market, "d:d mkt:f smb:f hml:f mom:f rf:f", S["factors"], "select * from factors")
add("src_06_join_factors", lambda s, f: bars.join_factors(at.market(s, f).select("d", "mkt", "smb", "hml"), at.market(s, f).select("d", "mom")), "d:d mkt:f smb:f hml:f mom:f", S["factors"], "select d, mkt / 100 as mkt, smb / 100 as smb, hml / 100 as hml, mom / 100 as mom from factors")
_WANTED = "1-URGENT", "5-LOW", "UNKNOWN"
add("src_13_validate", lambda s, f: search.validate(at.walk(s, f).select("symbol"), s.createDataFrame([(x,) for x in _WANTED], "symbol string")), "symbol:s valid:b", S["bars"], "select w.symbol, w.symbol in (select symbol from bars) as valid from (values ('1-URGENT'), ('5-LOW'), ('UNKNOWN')) w(symbol)")
add("src_14_dry_run", lambda s, f: bars.validity(at.walk(s, f), s.createDataFrame([(x,) for x in _WANTED], "symbol string"), "1996-01-01", "1997-01-01"), "symbol:s valid:b first_day:d n_bars:l", S["bars"],
    "select w.symbol, min(b.d) is not null as valid, min(b.d) as first_day, count(*) filter (where b.d >= date '1996-01-01' and b.d < date '1997-01-01') as n_bars from (values ('1-URGENT'), ('5-LOW'), ('UNKNOWN')) w(symbol) left join bars b on w.symbol = b.symbol group by 1")

# Cleaning
ARRIVED = "select o_orderpriority as symbol, cast(o_orderdate as date) as d, o_orderkey as k, o_totalprice as price from orders"
add("cln_04_first_arrival", lambda s, f: clean.drop_repeats(at.bars.table(s, f, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("date").alias("d"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price")), "k"), f"{BAR} k:l price:f", [("a", ARRIVED)],
    "select symbol, d, k, price from (select *, row_number() over (partition by symbol, d order by k) as n from a) where n = 1")
ALIGNED = [*S["bars"], *o.ALIGN]
add("cln_06_align", lambda s, f: clean.align(at.walk(s, f)), f"{BAR} {OHLCV}", ALIGNED, "select * from aligned")


def _fill(name: str, method: str, limit: int | None, expr: str, ctes: list) -> None:
    add(name, lambda s, f: clean.fill(clean.align(at.walk(s, f)), method, limit, ("close", "volume")), f"{BAR} close:f volume:f", ctes, f"select symbol, d, {expr.format(c='close')} as close, {expr.format(c='volume')} as volume from numbered")


RUN, AHEAD = f"({o.BY} rows between unbounded preceding and current row)", f"({o.BY} rows between current row and unbounded following)"
NUMBERED = [*ALIGNED, ("n0", f"select *, row_number() over ({o.BY}) as rn, date_diff('day', date '1970-01-01', d) as day from aligned"), ("numbered", "select *, case when close is not null then rn end as vn, case when close is not null then day end as vd from n0")]
FF, BF = f"last_value({{c}} ignore nulls) over {RUN}", f"first_value({{c}} ignore nulls) over {AHEAD}"
LIN = f"coalesce({{c}}, case when {BF} is null then {FF} else {FF} + ({BF} - {FF}) * (day - max(vd) over {RUN}) / nullif(min(vd) over {AHEAD} - max(vd) over {RUN}, 0) end)"
_fill("cln_07a_ffill", "ffill", None, FF, NUMBERED)
_fill("cln_07b_bfill", "bfill", None, BF, NUMBERED)
_fill("cln_07c_interpolate", "interpolate", None, LIN, NUMBERED)
_fill("cln_08a_ffill_limit", "ffill", 1, f"case when {{c}} is not null or rn - max(vn) over {RUN} <= 1 then {FF} end", NUMBERED)
_fill("cln_08b_bfill_limit", "bfill", 1, f"case when {{c}} is not null or min(vn) over {AHEAD} - rn <= 1 then {BF} end", NUMBERED)
_fill("cln_08c_interpolate_limit", "interpolate", 1, f"case when {{c}} is not null or rn - max(vn) over {RUN} <= 1 then {LIN} end", NUMBERED)
add("cln_01_clean", at.cleaned, f"{BAR} {OHLCV} returns:f returns_norm:f returns_fwd_1:f returns_fwd_5:f", S["clean"], "select * from clean")
add("cln_09a_simple_returns", lambda s, f: clean.returns(at.walk(s, f), method="simple"), f"{BAR} returns:f returns_fwd_1:f returns_fwd_5:f", S["bars"],
    f"select symbol, d, close / lag(close) over ({o.BY}) - 1 as returns, close / lead(close, 1) over ({o.BY}) - 1 as returns_fwd_1, close / lead(close, 5) over ({o.BY}) - 1 as returns_fwd_5 from bars")
add("cln_10_quality", lambda s, f: clean.quality(at.cleaned(s, f)), "symbol:s start:d end:d n_rows:l missing_pct:f returns_skew:f returns_kurt:f mean:f std:f min:f q25:f q50:f q75:f max:f", S["clean"],
    "select symbol, min(d) as start, max(d) as \"end\", count(*) as n_rows, 100.0 * count(*) filter (where close is null) / count(*) as missing_pct, skewness(returns) as returns_skew, kurtosis(returns) as returns_kurt, avg(returns) as mean, stddev_samp(returns) as std, min(returns) as min, quantile_cont(returns, 0.25) as q25, quantile_cont(returns, 0.5) as q50, quantile_cont(returns, 0.75) as q75, max(returns) as max from clean group by 1")

# Features
FEATS = {
    "fea_01_volatility": (lambda d: features.volatility(d), "vol_5d vol_21d vol_63d vol_5d_annual vol_21d_annual vol_63d_annual"),
    "fea_02_rsi": (lambda d: features.averages(features.true_range(d)), "rsi_14"),
    "fea_03_atr": (lambda d: features.averages(features.true_range(d)), "tr atr_14"),
    "fea_04_volume": (lambda d: features.volume(d), "vol_ratio_20 vwap_20d vwap_dev"),
    "fea_05_bollinger": (lambda d: features.bollinger(d), "bb_middle bb_upper bb_lower bb_width bb_pct"),
    "fea_06_macd": (lambda d: features.averages(features.true_range(d)), "ema_12 ema_26 macd_line macd_signal macd_histogram"),
    "fea_07_zscores": (lambda d: features.zscores(d), "z_price_20d z_price_60d"),
}
for _name, (_make, _cols) in FEATS.items():
    add(_name, lambda s, f, m=_make: m(at.cleaned(s, f)), BAR + " " + " ".join(f"{c}:f" for c in _cols.split()), S["feat"], "select * from feat")
NAMES = ["vol_21d", "rsi_14", "atr_14", "vol_ratio_20", "vwap_dev", "bb_width", "bb_pct", "macd_line", "macd_histogram", "z_price_20d", "z_price_60d"]
#: All numeric feature columns.
FEATS = [
    *(f"vol_{n}d{year}" for n in (5, 21, 63) for year in ("", "_annual")), "rsi_14", "atr_14", "vol_ratio_20", "vwap_20d", "vwap_dev", "bb_middle", "bb_upper", "bb_lower", "bb_width", "bb_pct",
    "ema_12", "ema_26", "macd_line", "macd_signal", "macd_histogram", "z_price_20d", "z_price_60d"]
add("fea_00_all", at.featured, BAR + " " + " ".join(f"{c}:f" for c in NAMES), S["feat"], "select * from feat")
add("fea_00_supplier", lambda s, f: features.of_bars(bars.bars_supplier(s, f)), BAR + " " + " ".join(f"{c}:f" for c in NAMES), o.over("lineitem", "feat"), "select * from feat")
add("fea_00_blocks", lambda s, f: features.all_features(at.cleaned(s, f), block_days=50), BAR + " " + " ".join(f"{c}:f" for c in NAMES), S["feat"], "select * from feat")
add("fea_08_report", lambda s, f: features.report(at.featured(s, f), FEATS), "feature:s missing_pct:f mean:f std:f min:f q25:f median:f q75:f max:f", S["feat"],
    " union all ".join(f"select '{c}' as feature, 100.0 * count(*) filter (where {c} is null) / count(*) as missing_pct, avg({c}) as mean, stddev_samp({c}) as std, min({c}) as min, quantile_cont({c}, 0.25) as q25, quantile_cont({c}, 0.5) as median, quantile_cont({c}, 0.75) as q75, max({c}) as max from feat" for c in FEATS))
add("fea_08_correlations", lambda s, f: features.correlations(at.featured(s, f), FEATS), "a:s b:s corr:f", S["feat"], " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as corr from feat" for i, a in enumerate(FEATS) for b in FEATS[i:]))

# Signals
for _name, _cols in {
    "sig_01_rsi": "signal_rsi:i signal_rsi_strength:f", "sig_02_macd": "signal_macd:i signal_macd_strength:f", "sig_03_zscore": "signal_zscore:i signal_zscore_strength:f",
    "sig_04_bollinger": "signal_bb:i signal_bb_strength:f", "sig_05_position_scale": "position_scale:f", "sig_06a_majority_vote": "signal_ensemble:i",
    "sig_00_all": "signal_rsi:i signal_macd:i signal_zscore:i signal_bb:i signal_ensemble:i position_scale:f",
}.items():
    add(_name, at.signalled, f"{BAR} {_cols}", S["sig"], "select * from sig")
add("sig_06b_weighted", lambda s, f: at.signalled(s, f).withColumn("signal_weighted", signals.ensemble("weighted")), f"{BAR} signal_weighted:i", S["sig"], "select * from sig")
add("sig_06c_regime_switch", lambda s, f: at.signalled(s, f).withColumn("signal_switch", signals.ensemble("regime_switch")), f"{BAR} signal_switch:i", S["sig"], "select * from sig")
REVERTED = [*S["feat"], o.SIGNALS[0], o.hold("m_rev", "sig0", "f.close is null or f.bb_upper is null", ("(c1prev >= bb_lower and close <= bb_lower and not (c1prev <= bb_upper and close >= bb_upper))", "(c1prev <= bb_upper and close >= bb_upper)"), ("close >= bb_middle", "close <= bb_middle"), 2, 10, True)]
add("sig_04b_reversion", lambda s, f: signals.positions(at.featured(s, f), signals.Rules(bb_mode="reversion")), f"{BAR} signal_bb:i", REVERTED, "select s.symbol, s.d, m.sig as signal_bb from sig0 s join m_rev m on s.symbol = m.symbol and s.rn = m.rn")
FIVE = ["signal_rsi", "signal_macd", "signal_zscore", "signal_bb", "signal_ensemble"]
STRONG = [*FIVE[:4], *(f"{x}_strength" for x in FIVE[:4]), FIVE[4]]
add("sig_07_correlations", lambda s, f: signals.correlations(at.signalled(s, f)), "a:s b:s corr:f", S["sig"],
    " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}::double, {b}::double) as corr from sig where " + " and ".join(f"{x} is not null" for x in STRONG) for i, a in enumerate(STRONG) for b in STRONG[i:]))
add("sig_07_values", lambda s, f: signals.values(at.signalled(s, f)), f"{PAIRED} unique_values:s mean_strength:f", S["sig"],
    " union all ".join(f"select symbol, '{x}' as signal, array_to_string(list_sort(list_distinct(list({x}::int))), ',') as unique_values, " + (f"avg({x}_strength)" if x in FIVE[:4] else "null::double") + " as mean_strength from sig group by 1" for x in FIVE))
add("sig_07_report", lambda s, f: signals.report(at.signalled(s, f)), f"{PAIRED} turnover:f long_pct:f short_pct:f flat_pct:f",
    [*S["sig"], ("sl", "select symbol, d, u.signal, u.value from (select symbol, d, unnest([" + ", ".join(f"{{'signal': '{x}', 'value': {x}}}" for x in FIVE) + "]) as u from sig)"), ("sc", f"select *, lag(value) over ({o.PAIR}) as was from sl")],
    "select symbol, signal, avg((was is null or was <> value)::int) as turnover, 100.0 * avg((value = 1)::int) as long_pct, 100.0 * avg((value = -1)::int) as short_pct, 100.0 * avg((value = 0)::int) as flat_pct from sc group by 1, 2")

# Gates
CONDITIONS = {
    "gat_01_vol_percentile": (gates.VolPercentile(), "coalesce(vol_21d < vq30, false)"),
    "gat_02_trend": (gates.Trend(), "coalesce(abs(trend63) < 0.1 / 252, false)"),
    "gat_02_trend_up": (gates.Trend(directional="up"), "coalesce(trend63 > 0.1 / 252, false)"),
    "gat_03_macd_positive": (gates.Macd("positive"), "coalesce(macd_line > 0, false)"),
    "gat_03_macd_weak": (gates.Macd("weak"), "coalesce(abs(macd_line) < mw25, false)"),
    "gat_04_band_width": (gates.BandWidth(), "coalesce(bb_width < bq40, false)"),
    "gat_05_rsi_range": (gates.RsiRange(), "coalesce(rsi_14 between 35 and 65, false)"),
    "gat_06_composite": (gates.Composite((gates.RsiRange(), gates.Macd("positive")), "OR"), "coalesce(rsi_14 between 35 and 65, false) or coalesce(macd_line > 0, false)"),
    "gat_07_trend_confirmation": (gates.TrendConfirmation("signal_macd"), "coalesce(sign(signal_macd) = sign(macd_line) and abs(macd_line) >= mq25, false)"),
}
for _name, (_cond, _expr) in CONDITIONS.items():
    add(_name, lambda s, f, c=_cond: (lambda d: d.withColumn("gate", c.column(d)))(at.signalled(s, f)), f"{BAR} gate:b", S["gat"], f"select symbol, d, {_expr} as gate from gat0")
_DD = ["gate_dd_signal_rsi_150", "gate_dd_signal_zscore_150", "gate_dd_signal_macd_200", "gate_dd_signal_bb_200"]
add("gat_08_drawdown", at.gated, BAR + " " + " ".join(f"{c}:b" for c in _DD), S["gat"], "select * from gat")
add("gat_08_drawdown_tight", lambda s, f: gates.with_breakers(at.signalled(s, f), [gates.Drawdown("signal_macd", 0.05)]), f"{BAR} gate_dd_signal_macd_50:b", [*S["sig"], *o.broken("b_tight", "signal_macd", 0.05)],
    "select s.symbol, s.d, b.gate as gate_dd_signal_macd_50 from sig s join b_tight b on s.symbol = b.symbol and s.rn = b.rn")
add("gat_09_filter", lambda s, f: gates.gated(at.signalled(s, f), "signal_rsi", [gates.RsiRange()]), f"{BAR} signal_rsi_filtered:i", S["sig"], "select symbol, d, case when coalesce(rsi_14 between 35 and 65, false) then signal_rsi else 0 end as signal_rsi_filtered from sig")
add("gat_09_filter_inverted", lambda s, f: gates.gated(at.signalled(s, f), "signal_rsi", [gates.RsiRange()], invert=True), f"{BAR} signal_rsi_filtered:i", S["sig"], "select symbol, d, case when coalesce(rsi_14 between 35 and 65, false) then 0 else signal_rsi end as signal_rsi_filtered from sig")
#: Gated columns and the signal that their name leads to: up to the first condition in it.
FILTERED = {
    "signal_rsi_vol_trend_gated": "signal_rsi", "signal_zscore_vol_bb_gated": "signal_zscore", "signal_macd_trend_gated": "signal_macd", "signal_bb_breakout_gated": None,
    "signal_mr_pool": "signal_mr_pool", "signal_trend_pool": None, "signal_regime_adaptive": "signal_regime_adaptive"}
PRESET_GATED = "select symbol, d, signal_rsi_vol_trend_gated, preset_zscore as signal_zscore_vol_bb_gated, signal_macd_trend_gated, preset_bb as signal_bb_breakout_gated from gat"
for _name, _col in {"gat_11_rsi_preset": "signal_rsi_vol_trend_gated", "gat_12_zscore_preset": "signal_zscore_vol_bb_gated", "gat_13_macd_preset": "signal_macd_trend_gated", "gat_14_bb_preset": "signal_bb_breakout_gated"}.items():
    add(_name, at.preset_gated, f"{BAR} {_col}:i", S["gat"], PRESET_GATED)
add("gat_15_all_presets", at.preset_gated, BAR + " " + " ".join(f"{c}:i" for c in ("signal_rsi_vol_trend_gated", "signal_zscore_vol_bb_gated", "signal_macd_trend_gated", "signal_bb_breakout_gated")), S["gat"], PRESET_GATED)
add("gat_17_filter_stats", lambda s, f: gates.filter_stats(at.gated(s, f)), "symbol:s filtered_signal:s original_signal:s active_pct:f n_trades:l turnover:f trade_reduction_pct:f",
    [*S["gat"], ("fs0", "select symbol, d, u.name, u.base, coalesce(u.x, 0) as x, coalesce(u.y, 0) as y from (select symbol, d, unnest([" + ", ".join(
        f"{{'name': '{c}', 'base': {f"'{b}'" if b else 'null::varchar'}, 'x': {c}::int, 'y': {b or '0'}::int}}" for c, b in FILTERED.items()) + "]) as u from gat)"),
     ("fs1", "select *, lag(x) over w as wx, lag(y) over w as wy from fs0 window w as (partition by symbol, name order by d)"),
     ("fs2", """select symbol, name as filtered_signal, base as original_signal, 100.0 * avg((x <> 0)::int) as active_pct, count(*) filter (where wx is null or wx <> x) as n_trades,
        252.0 * avg((wx is null or wx <> x)::int) as turnover, count(*) filter (where wy is null or wy <> y) as b from fs1 group by 1, 2, 3""")],
    "select *, case when original_signal is not null then (1 - n_trades::double / greatest(b, 1)) * 100 end as trade_reduction_pct from fs2")
add("gat_16_ensemble", at.gated, f"{BAR} regime_label2:s signal_mr_pool:i signal_trend_pool:i signal_regime_adaptive:i", S["gat"], "select * from gat")
add("gat_10_stats", lambda s, f: gates.stats(at.gated(s, f), "signal_macd", "signal_macd_trend_gated"), "symbol:s n_bars:l active_pct:f base_trades:l gated_trades:l reduction_pct:f",
    [*S["gat"], ("gc", f"select *, lag(signal_macd) over ({o.BY}) as wa, lag(signal_macd_trend_gated) over ({o.BY}) as wb from gat"), ("gs", "select symbol, count(*) as n_bars, 100.0 * avg((signal_macd_trend_gated <> 0)::int) as active_pct, count(*) filter (where wa is null or wa <> signal_macd) as base_trades, count(*) filter (where wb is null or wb <> signal_macd_trend_gated) as gated_trades from gc group by 1")],
    "select *, (1 - gated_trades::double / greatest(base_trades, 1)) * 100 as reduction_pct from gs")

# Regimes
PROBS = " ".join(f"regime_prob_{n}:f" for n in regimes.NAMES)
add("reg_01_rules", lambda s, f: regimes.classify(at.featured(s, f)), f"{BAR} regime_label:s {PROBS}", S["reg"], "select * from reg")
add("reg_02_durations", lambda s, f: regimes.durations(regimes.classify(at.featured(s, f))), "symbol:s regime:s mean_bars:f",
    [*S["reg"], ("k0", f"select symbol, d, regime_label, lag(regime_label) over ({o.BY}) as was from reg where regime_label is not null"), ("k1", f"select *, sum((was is null or was <> regime_label)::int) over ({o.BY} rows between unbounded preceding and current row) as run from k0")],
    "select symbol, regime, avg(n) as mean_bars from (select symbol, regime_label as regime, run, count(*) as n from k1 group by 1, 2, 3) group by 1, 2")
add("reg_03_frequency", lambda s, f: regimes.frequency(regimes.classify(at.featured(s, f))), "symbol:s regime:s share:f", S["reg"], "select symbol, regime_label as regime, count(*)::double / sum(count(*)) over (partition by symbol) as share from reg where regime_label is not null group by 1, 2")
add("reg_04_hmm_smoothed", lambda s, f: regimes.hmm(at.featured(s, f), online=False), f"{BAR} regime_label:s {PROBS}")
add("reg_06_hmm_online", lambda s, f: regimes.hmm(at.featured(s, f)), f"{BAR} regime_label:s {PROBS}")
add("reg_08_transitions", lambda s, f: regimes.transitions(regimes.classify(at.featured(s, f))), "symbol:s from_state:s to_state:s prob:f",
    [*S["reg"], ("t0", f"select symbol, lag(regime_label) over ({o.BY}) as from_state, regime_label as to_state from reg where regime_label is not null")],
    "select symbol, from_state, to_state, count(*)::double / sum(count(*)) over (partition by symbol, from_state) as prob from t0 where from_state is not null group by 1, 2, 3")
add("reg_09_blend", lambda s, f: (lambda d: d.withColumn("blend", regimes.blend(d.columns)))(regimes.classify(at.signalled(s, f))), f"{BAR} blend:f", S["reg"], "select * from reg")
add("reg_10_discrete", lambda s, f: (lambda d: d.withColumn("direction", regimes.discrete(regimes.blend(d.columns), 0.6)))(regimes.classify(at.signalled(s, f))), f"{BAR} direction:i", S["reg"], "select symbol, d, case when blend > 0.6 then 1 when blend < -0.6 then -1 else 0 end as direction from reg")
add("reg_12_adaptive", at.detected, f"{BAR} signal_adaptive:i position_scale_adaptive:f", S["reg"], "select * from reg")

# Backtests
add("bt_09_longs", at.longs, f"{PAIRED} d:d value:i scale:f", S["longs"], "select * from longs")
CURVED = f"{PAIRED} d:d position:i shares:f cost:f pnl:f equity:e ret:f drawdown:f"
add("bt_05_curve", at.curve, CURVED, S["curve"], "select * from curve")
for _name, _setup, _size in [
    ("bt_04_fixed_shares", backtest.Setup(sizing="fixed_shares"), "100.0"),
    ("bt_04_vol_target", backtest.Setup(sizing="vol_target"), "100000.0 * 0.1 / greatest(coalesce(nullif(vol_21d, 0), 0.02) * sqrt(252), 0.01) / nullif(close, 0)"),
]:
    add(_name, lambda s, f, x=_setup: at.curve(s, f, x), CURVED, [*S["longs"], *o.curve(_size)], "select * from curve")
_STOP = backtest.Setup(sizing="vol_target", max_drawdown_exit=0.1)
_VT = "100000.0 * 0.1 / greatest(coalesce(nullif(vol_21d, 0), 0.02) * sqrt(252), 0.01) / nullif(close, 0)"
add("bt_06_breaker", lambda s, f: at.curve(s, f, _STOP), CURVED, [*S["longs"], *o.curve(_VT, 0.1)], "select * from curve")
add("bt_06_breaker_strict", lambda s, f: at.curve(s, f, replace(_STOP, breaker_mode="strict")), CURVED, [*S["longs"], *o.curve(_VT, 0.1, "strict")], "select * from curve")
add("bt_01_small_cap_costs", lambda s, f: at.longs(s, f).filter("value <> 0").withColumn("cost", SMALL_CAP.column(F.col("close"), F.col("value") * 100.0, F.col("volume"))), f"{PAIRED} d:d cost:f", S["longs"],
    f"select *, {o.cost('close', '(value * 100.0)', 'volume', 10.0, 5.0, 1.0, 0.001)} as cost from longs where value <> 0")
add("bt_07_trades", at.trades, f"{PAIRED} entry_d:d exit_d:d direction:i entry_price:f exit_price:f shares:f entry_cost:f exit_cost:f pnl:f pnl_pct:f holding_days:i", S["trades"], "select * from trades")
EVENT = [*S["longs"],
    ("ev", f"""select symbol, signal, rn, open as fill, close, volume, coalesce(value, 0) as v, coalesce(scale, 1.0) as k, 0.0::double as cash, 0.0::double as pos, 0.0::double as paid, 100000.0::double as equity, 0.0::double as ret from longs where rn = 1
      union all select symbol, signal, rn, fill, close, volume, v, k, cash2, pos2, paid, e2, case when was > 0 then (e2 - was) / was else 0.0 end from (
        select *, cash2 + pos2 * close as e2 from (
          select *, case when traded then target else pos end as pos2, case when traded then cash - delta * fill - fee else cash end as cash2, case when traded then fee else 0.0 end as paid from (
            select *, abs(delta) > 0.01 as traded, {o.cost('fill', 'delta', 'volume')} as fee from (
              select *, target - pos as delta from (
                select f.symbol, f.signal, f.rn, f.open as fill, f.close, f.volume, coalesce(f.value, 0) as v, coalesce(f.scale, 1.0) as k, s.pos, s.equity as was,
                  case when s.rn = 1 then 100000.0 else s.cash end as cash, case when s.v = 0 or f.open = 0 then 0.0 else s.v * s.k * 100000.0 / f.open end as target
                from ev s join longs f on f.symbol = s.symbol and f.signal = s.signal and f.rn = s.rn + 1)))))""")]
add("bt_10_event_driven", lambda s, f: backtest.event_driven(at.longs(s, f)).withColumnRenamed("cost", "paid"), f"{PAIRED} d:d shares:f paid:f equity:e ret:f", EVENT, "select l.symbol, l.signal, l.d, e.pos as shares, e.paid, e.equity, e.ret from ev e join longs l on l.symbol = e.symbol and l.signal = e.signal and l.rn = e.rn")
add("bt_10_event_trades", lambda s, f: backtest.event_driven(at.longs(s, f), want="trades"), f"{PAIRED} entry_d:d exit_d:d direction:i entry_price:f exit_price:f shares:f pnl:f holding_days:i")
add("bt_13_both_engines", lambda s, f: backtest.both_engines(at.longs(s, f)), f"{PAIRED} engine:s d:d equity:e ret:f", [*EVENT, *o.curve()],
    "select symbol, signal, 'vectorised' as engine, d, equity, ret from curve union all select l.symbol, l.signal, 'event_driven' as engine, l.d, e.equity, e.ret from ev e join longs l on l.symbol = e.symbol and l.signal = e.signal and l.rn = e.rn")

# Metrics
METRIC_GROUPS = {
    "met_00_all": metrics.COLUMNS, "met_01_returns": ["total_return", "annual_return", "annual_vol"], "met_02_sharpe": ["sharpe"], "met_03_sortino": ["sortino"], "met_04_calmar": ["calmar"],
    "met_05_drawdown": ["max_drawdown", "avg_drawdown"], "met_06_drawdown_days": ["max_drawdown_days"], "met_08_tail": ["var_95", "cvar_95"], "met_09_turnover": ["turnover"],
    "met_07_trades": ["n_trades", "hit_rate", "avg_win", "avg_loss", "profit_factor", "avg_hold_days", "avg_pnl_pct", "total_costs"],
}
for _name, _cols in METRIC_GROUPS.items():
    add(_name, at.performance, PAIRED + " " + " ".join(f"{c}:f" for c in _cols), S["metrics"], "select * from metrics")
add("met_10_capm", lambda s, f: metrics.capm(at.curve(s, f), at.market(s, f).select("d", F.col("mkt").alias("benchmark"))), f"{PAIRED} alpha:f beta:f r2:f",
    [*S["excess"], ("cy", f"select c.symbol, c.signal, c.ret - {o.RF} as y, f.mkt - {o.RF} as x from curve c join factors f on c.d = f.d where c.ret is not null"),
     ("cm", "select symbol, signal, covar_samp(y, x) / var_pop(x) as beta, avg(y) as my, avg(x) as mx, var_pop(y) as vy, covar_pop(y, x) as cp, var_pop(x) as vx from cy group by 1, 2")],
    "select symbol, signal, pow(1 + my - beta * mx, 252) - 1 as alpha, beta, case when vy = 0 then 0 else 1 - (vy - 2 * beta * cp + beta * beta * vx) / vy end as r2 from cm")

# Factors
REGR = "alpha_daily:f alpha_annual:f t_stat:f p_value:f significant:b r2:f adj_r2:f n_obs:l"
add("fac_01_hac_regressions", lambda s, f: factors.regressions(at.excess(s, f)), f"{PAIRED} model:s {REGR}", [*S["excess"], *o.regressions("hac")], "select * from regressed")
add("fac_10_attribution_table", lambda s, f: factors.attribution_table(factors.regressions(at.excess(s, f))), f"{PAIRED} model:s alpha_annual:f t_stat:f p_value:f significant:b n_obs:l low_sample_size:b beta_mkt:f beta_smb:f beta_hml:f beta_mom:f", [*S["excess"], *o.regressions("hac")],
    "select symbol, signal, model, significant, n_obs, n_obs < 30 as low_sample_size, " + ", ".join(f"round({c}, 4) as {c}" for c in ("alpha_annual", "t_stat", "p_value", *(f"beta_{x}" for x in o.FOUR))) + " from regressed")
add("fac_03_classic_regressions", lambda s, f: factors.regressions(at.excess(s, f), errors="classic"), f"{PAIRED} model:s {REGR}", [*S["excess"], *o.regressions("classic")], "select * from regressed")
add("fac_03_classic_capm", lambda s, f: factors.regressions(at.excess(s, f), {"CAPM": ["mkt"]}, "classic"), f"{PAIRED} alpha_daily:f t_stat:f r2:f n_obs:l",
    [*S["excess"], ("cl0", """select symbol, signal, count(y) as n, regr_intercept(y, x) as a, regr_slope(y, x) as b, regr_r2(y, x) as q, avg(x) as mx, var_pop(x) * count(x) as sxx,
       var_pop(y) * count(y) as syy, coalesce(stddev_pop(y), 0) as sd from (select symbol, signal, case when mkt is not null then excess end as y, case when excess is not null then mkt end as x from excess) group by 1, 2""")],
    """select symbol, signal, case when ok then a else 0.0 end as alpha_daily, case when ok then a / sqrt((syy - b * b * sxx) / (n - 2) * (1.0::double / n + mx * mx / sxx)) else 0.0 end as t_stat,
       case when ok then q else 0.0 end as r2, case when ok then n else 0 end as n_obs from (select *, n >= 30 and sd >= 1e-10 as ok from cl0)""")
add("fac_04_capm", lambda s, f: factors.capm(at.excess(s, f)), f"{PAIRED} beta:f alpha_annual:f r2:f n_obs:l",
    [*S["excess"], ("rg", "select symbol, signal, regr_slope(excess, mkt) as b, regr_intercept(excess, mkt) as a, regr_r2(excess, mkt) as q, count(*) as n from excess where excess is not null and mkt is not null group by 1, 2")],
    "select symbol, signal, case when n >= 30 then coalesce(b, 0) else 0 end as beta, case when n >= 30 then coalesce(pow(1 + a, 252) - 1, 0) else 0 end as alpha_annual, case when n >= 30 then coalesce(q, 0) else 0 end as r2, case when n >= 30 then n else 0 end as n_obs from rg")
add("fac_06_excess", at.excess, f"{PAIRED} d:d excess:f mkt:f smb:f hml:f mom:f", S["excess"], "select * from excess")
_B4, _63 = f"({o.PAIR} rows between 126 preceding and 1 preceding)", f"({o.PAIR} rows between 62 preceding and current row)"
add("fac_07_rolling_capm", lambda s, f: factors.rolling_capm(at.excess(s, f)), f"{PAIRED} d:d alpha_annual:f beta:f r2:f regime:s", [*S["excess"], ("ex", "select * from excess where excess is not null and mkt is not null")],
    f"""select symbol, signal, d, case when count(excess) over {_B4} >= 126 then pow(1 + regr_intercept(excess, mkt) over {_B4}, 252) - 1 end as alpha_annual, case when count(excess) over {_B4} >= 126 then regr_slope(excess, mkt) over {_B4} end as beta, case when count(excess) over {_B4} >= 126 then regr_r2(excess, mkt) over {_B4} end as r2,
      case when count(mkt) over {_63} < 63 then 'range_bound' when stddev_samp(mkt) over {_63} * sqrt(252) > 0.25 then 'crisis' when avg(mkt) over {_63} < -0.001 then 'trending_down' when avg(mkt) over {_63} > 0.001 then 'trending_up' else 'range_bound' end as regime from ex""")
MARKET = [("mr0", "select *, case when count(*) over (order by d rows between 20 preceding and current row) >= 21 then stddev_samp(mkt) over (order by d rows between 20 preceding and current row) * sqrt(252) end as vol, case when count(*) over (order by d rows between 62 preceding and current row) >= 63 then avg(mkt) over (order by d rows between 62 preceding and current row) * 252 end as ret63 from factors"),
    ("mregime", "select d, case when ret63 < -0.05 and vol <= 0.30 then 'trending_down' when ret63 > 0.05 and vol <= 0.30 then 'trending_up' when vol > 0.30 then 'crisis' else 'range_bound' end as regime from mr0")]
add("fac_12_market_regimes", lambda s, f: factors.market_regimes(at.market(s, f)), "d:d regime:s", [*S["factors"], *MARKET], "select * from mregime")
BY_REGIME = [*S["excess"], *MARKET, ("pr", "select c.symbol, c.signal, m.regime, count(c.ret) as n, count(*) as rows_, case when count(c.ret) >= 5 then case when stddev_samp(c.ret) > 1e-10 then avg(c.ret) / stddev_samp(c.ret) * sqrt(252) else 0.0 end end as sharpe from curve c join mregime m on c.d = m.d group by 1, 2, 3"), ("pq", "select symbol, signal, regime, n, sharpe, rows_::double / sum(rows_) over (partition by symbol, signal) as pct from pr")]
_by_regime = lambda s, f: factors.performance_by_regime(at.curve(s, f), factors.market_regimes(at.market(s, f)))
add("fac_13_performance_by_regime", _by_regime, f"{PAIRED} regime:s n:l sharpe:f pct:f", BY_REGIME, "select * from pq")
_WIDE = [f"{n}_{c}" for n in ("range_bound", "trending_up", "trending_down", "crisis") for c in ("sharpe", "pct")]
add("fac_13_wide", lambda s, f: factors.wide_by_regime(_by_regime(s, f)), PAIRED + " " + " ".join(f"{c}:f" for c in _WIDE), BY_REGIME,
    "select symbol, signal, " + ", ".join(f"max({c.rsplit('_', 1)[1]}) filter (where regime = '{c.rsplit('_', 1)[0]}') as {c}" for c in _WIDE) + " from pq group by 1, 2")

# Learning
add("ml_02_folds", lambda s, f: learning.fold_table(at.cleaned(s, f)), "symbol:s fold_id:i train_lo:i train_hi:i test_lo:i test_hi:i", S["clean"],
    "select symbol, k as fold_id, 0 as train_lo, 252 + k * 63 - 5 as train_hi, 252 + k * 63 as test_lo, 252 + (k + 1) * 63 as test_hi from (select symbol, count(*) as n from clean group by 1), (select unnest(range(5)) as k) where n >= 252 + (k + 1) * 63")
_JOINED = "select c.symbol, c.d, k.k as fold_id, case when c.rn < 247 + k.k * 63 then 'train' else 'test' end as part from (select *, row_number() over (partition by symbol order by d) - 1 as rn, count(*) over (partition by symbol) as n from clean) c join (select unnest(range(5)) as k) k on c.n >= 252 + (k.k + 1) * 63 and (c.rn < 247 + k.k * 63 or (c.rn >= 252 + k.k * 63 and c.rn < 315 + k.k * 63))"
add("ml_02_fold_rows", lambda s, f: learning.with_folds(at.cleaned(s, f)).withColumn("part", F.col("part")), f"{BAR} fold_id:i part:s", S["clean"], _JOINED)
_models = lambda s, f: learning.models(at.featured(s, f))
_told = lambda s, f: learning.predictions(_models(s, f))
add("ml_05_walk_forward", _told, f"{BAR} fold_id:i target:f prediction:f")
add("ml_07_fold_report_model", lambda s, f: learning.fold_report(_told(s, f), ("symbol",)), "symbol:s fold_id:i n:l mse:f mae:f ic:f direction_acc:f")
add("ml_07_importance_report", lambda s, f: learning.importance_report(learning.importances(_models(s, f))), "symbol:s feature:s mean:f std:f n_nonzero:l")
add("ml_08_threshold_sweep_model", lambda s, f: learning.threshold_sweep(_told(s, f), by=("symbol",)), "symbol:s threshold:f active_pct:f direction_acc:f mean_abs_active_pred:f")
# the same reports over a stand-in for predictions, which SQL can follow
add("ml_07_fold_report", lambda s, f: learning.fold_report(_guess(s, f), flat=float("nan")), "fold_id:i n:l mse:f mae:f ic:f direction_acc:f", S["clean"],
    "select 0 as fold_id, count(*) as n, avg(pow(p - t, 2)) as mse, avg(abs(p - t)) as mae, corr(p, t) as ic, avg((sign(p) = sign(t))::int) as direction_acc from (select returns as p, returns_fwd_5 as t from clean where returns is not null and returns_fwd_5 is not null)")
add("ml_08_threshold_sweep", lambda s, f: learning.threshold_sweep(_guess(s, f)), "threshold:f active_pct:f direction_acc:f mean_abs_active_pred:f", S["clean"],
    "select threshold, 100.0 * avg((abs(p) > threshold)::int) as active_pct, avg(case when abs(p) > threshold then (sign(p) = sign(t))::int end) as direction_acc, avg(case when abs(p) > threshold then abs(p) end) as mean_abs_active_pred from (select returns as p, returns_fwd_5 as t from clean where returns is not null and returns_fwd_5 is not null), (select unnest([0.0, 0.0025, 0.005, 0.0075, 0.01, 0.015, 0.02])::double as threshold) group by 1")
add("ml_06_threshold", lambda s, f: at.cleaned(s, f).withColumn("signal_ml", learning.thresholded(F.col("returns"))), f"{BAR} signal_ml:i", S["clean"], "select symbol, d, case when returns > 0.005 then 1 when returns < -0.005 then -1 else 0 end as signal_ml from clean")


def _guess(spark: SparkSession, sf: str) -> DataFrame:
    """Returns standing in for predictions of the returns ahead."""
    return at.cleaned(spark, sf).filter("returns is not null and returns_fwd_5 is not null").select(F.lit(0).alias("fold_id"), F.col("returns").alias("prediction"), F.col("returns_fwd_5").alias("target"))


# Reports
PAIR_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in reports.PAIRS.items())
COMPARED = [*S["metrics"], ("gp", f"select * from (values {PAIR_ROWS}) p(base_signal, gated_signal)"),
    ("gm", "select b.symbol, p.base_signal, p.gated_signal, g.sharpe - b.sharpe as sharpe_delta, g.max_drawdown - b.max_drawdown as max_drawdown_delta, g.total_return - b.total_return as total_return_delta, b.n_trades as base_n_trades, g.n_trades as gated_n_trades, case when b.n_trades > 0 then (1 - g.n_trades / b.n_trades) * 100 else 0.0 end as trade_reduction_pct, g.n_trades < 15 as low_sample_size from gp p join metrics b on b.signal = p.base_signal join metrics g on g.symbol = b.symbol and g.signal = p.gated_signal")]
add("pip_02_gating_comparison", lambda s, f: reports.gating_comparison(at.performance(s, f)), "symbol:s base_signal:s gated_signal:s sharpe_delta:f max_drawdown_delta:f total_return_delta:f base_n_trades:f gated_n_trades:f trade_reduction_pct:f low_sample_size:b verdict:s", COMPARED,
    """select *, case when max_drawdown_delta < -0.02 then 'gating_hurt' when low_sample_size and max_drawdown_delta > 0.02 and total_return_delta > -0.02 then 'gating_helped_low_sample' when low_sample_size and max_drawdown_delta > 0.02 then 'gating_helped_dd_only_low_sample'
      when low_sample_size then 'inconclusive_low_sample' when max_drawdown_delta > 0.02 and sharpe_delta > -0.5 then 'gating_helped' when max_drawdown_delta > 0.02 then 'gating_helped_but_sharpe_cost' else 'inconclusive' end as verdict from gm""")
add("pip_03_active_bars", lambda s, f: factors.active_bars(at.curve(s, f)), f"{PAIRED} d:d position:i ret:f", [*S["curve"], ("ab", "select *, count(*) filter (where position <> 0) over (partition by symbol, signal) as n from curve")], "select * from ab where n <= 30 or position <> 0")
add("pip_04_watchlist", lambda s, f: reports.watchlist(at.performance(s, f)), "symbol:s sharpe:f total_return:f max_drawdown:f n_trades:f", S["metrics"], "select * from metrics where signal = 'signal_ensemble' order by sharpe desc, symbol")
add("snk_04_comparison", lambda s, f: reports.comparison(at.performance(s, f)), f"{PAIRED} sharpe:f annual_return:f max_drawdown:f", S["metrics"], "select symbol, signal, round(sharpe, 4) as sharpe, round(annual_return, 4) as annual_return, round(max_drawdown, 4) as max_drawdown from metrics order by symbol, sharpe desc, signal")
add("bi_02_regime_sharpe", lambda s, f: reports.regime_sharpe_long(_by_regime(s, f)), "ticker:s regime:s signal:s sharpe:f pct_time_in_regime:f", BY_REGIME, "select symbol as ticker, regime, signal, round(sharpe, 3) as sharpe, round(pct, 3) as pct_time_in_regime from pq")
add("bi_05_union", lambda s, f: reports.union_all([at.performance(s, f).filter("signal = 'signal_rsi'").select("symbol", "signal", "sharpe"), at.performance(s, f).filter("signal = 'signal_macd'").select("symbol", "signal", "sharpe", "calmar")]), f"{PAIRED} sharpe:f calmar:f", S["metrics"],
    "select symbol, signal, sharpe, null::double as calmar from metrics where signal = 'signal_rsi' union all select symbol, signal, sharpe, calmar from metrics where signal = 'signal_macd'")

# Search
DIR = [("dir", "select cast(p_partkey as varchar) as symbol, p_name as name, p_brand as sector, p_type as industry from part")]
add("sch_01_search", lambda s, f: search.search(at.directory(s, f), "RING"), "symbol:s name:s sector:s industry:s", DIR, "select * from dir where contains(lower(concat_ws(chr(10), symbol, name, sector, industry)), 'ring') order by symbol limit 20")
add("sch_01_search_all", lambda s, f: search.search(at.directory(s, f), "econ", "industry", None), "symbol:s name:s sector:s industry:s", DIR, "select * from dir where contains(lower(industry), 'econ')")
add("sch_02_sectors", lambda s, f: search.distinct_values(at.directory(s, f), "sector"), "sector:s", DIR, "select distinct sector from dir where sector is not null order by 1")
add("sch_03_sector_counts", lambda s, f: search.sector_counts(at.directory(s, f)), "sector:s n:l", DIR, "select n.sector, least(count(*), 20) as n from (select distinct sector from dir) n join dir d on contains(lower(d.sector), lower(n.sector)) group by 1")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of every (symbol, signal) pair, from bars to backtest in one plan."""
    return ALL["met_00_all"].run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, q in ALL.items() if (text := q.oracle())}
