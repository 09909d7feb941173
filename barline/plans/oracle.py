"""The same stages as SQL, built from common table expressions in order.

Used to check the DataFrame plans: window operators are plain SQL, recursive ones
(exponential means, position machines, breakers, the event engine) are recursive
CTEs over row numbers.
"""

from __future__ import annotations

BY = "partition by symbol order by d"
NUM = ("open", "high", "low", "close", "volume")


def roll(agg: str, x: str, n: int, least: int, by: str = BY) -> str:
    frame = f"over ({by} rows between {n - 1} preceding and current row)"
    return f"case when count({x}) {frame} >= {least} then {agg.format(x=x)} {frame} end"


AVG, STD, MIN, MAX = "avg({x})", "stddev_samp({x})", "min({x})", "max({x})"


def quant(p: float) -> str:
    return f"quantile_cont({{x}}, {p})"


def walk(source: str) -> list[tuple[str, str]]:
    daily = {
        "orders": "select o_orderpriority as symbol, cast(o_orderdate as date) as d, avg(o_totalprice) as ap, count(*) as n from orders group by 1, 2",
        "lineitem": "select cast(l_suppkey as varchar) as symbol, cast(l_shipdate as date) as d, avg(l_extendedprice / l_quantity) as ap, count(*) as n from lineitem group by 1, 2",
    }[source]
    return [
        ("daily", daily),
        ("walk0", "select *, 0.02 * (ap / avg(ap) over (partition by symbol) - 1) as r from daily"),
        ("walk1", f"select *, round(100 * exp(sum(r) over ({BY} rows between unbounded preceding and current row)), 6) as close from walk0"),
        ("walk2", f"select *, coalesce(lag(close) over ({BY}), close) as open from walk1"),
        ("bars", "select symbol, d, open, floor(greatest(open, close) * (1 + 0.005::double * (1 + n % 3)) * 1e6 + 0.5) / 1e6 as high, floor(least(open, close) * (1 - 0.005::double * (1 + n % 3)) * 1e6 + 0.5) / 1e6 as low, close, 1000.0::double * n as volume from walk2"),
    ]


ALIGN = [
    ("grid", "select symbol, cast(unnest(generate_series(min(d), max(d), interval 1 day)) as date) as d from bars group by symbol"),
    ("aligned", "select g.symbol, g.d, b.open, b.high, b.low, b.close, b.volume from grid g left join bars b on g.symbol = b.symbol and g.d = b.d"),
]
FILL = [("filled", "select symbol, d, " + ", ".join(f"last_value({c} ignore nulls) over ({BY} rows between unbounded preceding and current row) as {c}" for c in NUM) + " from aligned")]
RETURNS = [
    ("ret0", f"select *, ln(close / lag(close) over ({BY})) as returns, ln(lead(close, 1) over ({BY}) / close) as returns_fwd_1, ln(lead(close, 5) over ({BY}) / close) as returns_fwd_5 from filled"),
    ("clean", f"select *, (returns - ({roll(AVG, 'returns', 252, 30)})) / nullif({roll(STD, 'returns', 252, 30)}, 0) as returns_norm from ret0"),
]


def _ema(alpha: float, y: str, x: str, started: str) -> str:
    return f"case when {started} then {1 - alpha!r}::double * {y} + {alpha!r}::double * {x} else {x} end"


FEATURES = [
    ("tr0", f"""select *, row_number() over ({BY}) as rn, greatest(high - low, abs(high - lag(close) over ({BY})), abs(low - lag(close) over ({BY}))) as tr,
      greatest(close - lag(close) over ({BY}), 0) as gain, greatest(lag(close) over ({BY}) - close, 0) as loss from clean"""),
    ("emas", f"""select symbol, rn, cast(null as double) as ag, cast(null as double) as al, tr as ar, close as ef, close as es, cast(null as double) as sg from tr0 where rn = 1
      union all select symbol, rn, ag, al, ar, ef, es, case when rn < 26 then null when rn = 26 then ef - es else {_ema(2 / 10, 'sg', '(ef - es)', 'true')} end from (
        select f.symbol, f.rn, {_ema(1 / 14, 's.ag', 'f.gain', 's.ag is not null')} as ag, {_ema(1 / 14, 's.al', 'f.loss', 's.al is not null')} as al, {_ema(1 / 14, 's.ar', 'f.tr', 'true')} as ar,
          {_ema(2 / 13, 's.ef', 'f.close', 'true')} as ef, {_ema(2 / 27, 's.es', 'f.close', 'true')} as es, s.sg
        from emas s join tr0 f on f.symbol = s.symbol and f.rn = s.rn + 1)"""),
    ("feat0", """select t.*, case when t.rn < 15 then null when e.al = 0 then 100 else least(100, greatest(0, 100 - 100 / (1 + e.ag / e.al))) end as rsi_14,
      case when t.rn >= 14 then e.ar end as atr_14, case when t.rn >= 12 then e.ef end as ema_12, case when t.rn >= 26 then e.es end as ema_26,
      case when t.rn >= 26 then e.ef - e.es end as macd_line, case when t.rn >= 34 then e.sg end as macd_signal, case when t.rn >= 34 then e.ef - e.es - e.sg end as macd_histogram
      from tr0 t join emas e on t.symbol = e.symbol and t.rn = e.rn"""),
    ("feat1", "select *, " + ", ".join(f"round({roll(STD, 'returns', n, max(2, n // 2))}, 12) as vol_{n}d" for n in (5, 21, 63)) + f""",
      volume / nullif({roll(AVG, 'volume', 20, 10)}, 0) as vol_ratio_20,
      case when count(volume) over ({BY} rows between 19 preceding and current row) >= 10 then sum(close * volume) over ({BY} rows between 19 preceding and current row) / nullif(sum(volume) over ({BY} rows between 19 preceding and current row), 0) end as vwap_20d,
      {roll(AVG, 'close', 20, 10)} as bb_middle, {roll(STD, 'close', 20, 10)} as bb_std,
      (close - ({roll(AVG, 'close', 20, 10)})) / nullif({roll(STD, 'close', 20, 10)}, 0) as z_price_20d, (close - ({roll(AVG, 'close', 60, 30)})) / nullif({roll(STD, 'close', 60, 30)}, 0) as z_price_60d from feat0"""),
    ("feat", """select *, vol_5d * sqrt(252) as vol_5d_annual, vol_21d * sqrt(252) as vol_21d_annual, vol_63d * sqrt(252) as vol_63d_annual, (close - vwap_20d) / nullif(close, 0) as vwap_dev,
      bb_middle + 2 * bb_std as bb_upper, bb_middle - 2 * bb_std as bb_lower, 4 * bb_std / nullif(bb_middle, 0) as bb_width, (close - (bb_middle - 2 * bb_std)) / nullif(4 * bb_std, 0) as bb_pct from feat1"""),
]


def hold(name: str, source: str, unknown: str, enter: tuple[str, str], leave: tuple[str, str], least: int, most: int, reenter: bool) -> tuple[str, str]:
    """A position machine as a recursive CTE (symbol, rn, pos, held, sig)."""
    free = "p1 = 0" if reenter else "p1 = 0 and not forced"
    side = f"(case when {enter[0]} then 1 when {enter[1]} then -1 else 0 end)"
    return name, f"""select symbol, rn, 0 as pos, 0 as held, 0 as sig from {source} where rn = 1
      union all select symbol, rn, case when unknown then pos else p2 end, case when unknown then held else h2 end, case when unknown then 0 else p2 end from (
        select *, case when {free} then {side} else p1 end as p2, case when {free} then abs({side}) else h1 end as h2 from (
          select *, case when forced or ruled then 0 else pos end as p1, case when forced or ruled then 0 else hh end as h1 from (
            select *, not forced and pos <> 0 and hh >= {least} and ((pos = 1 and {leave[0]}) or (pos = -1 and {leave[1]})) as ruled from (
              select f.*, s.pos, s.held, s.held + (s.pos <> 0)::int as hh, (s.pos <> 0 and s.held + 1 > {most}) as forced, ({unknown}) as unknown
              from {name} s join {source} f on f.symbol = s.symbol and f.rn = s.rn + 1))))"""


SIGNALS = [
    ("sig0", f"""select *, lag(macd_histogram) over ({BY}) as h1prev, lag(close) over ({BY}) as c1prev, {roll(quant(0.2), 'bb_width', 252, 60)} as sqz,
      {roll(MAX, 'abs(macd_histogram)', 63, 10)} as htop from feat"""),
    hold("m_rsi", "sig0", "f.rsi_14 is null", ("rsi_14 < 30", "rsi_14 > 70"), ("rsi_14 > 50", "rsi_14 < 50"), 2, 20, False),
    hold("m_z", "sig0", "f.z_price_60d is null", ("z_price_60d < -2", "z_price_60d > 2"), ("z_price_60d >= 0", "z_price_60d <= 0"), 2, 20, False),
    hold("m_bb", "sig0", "f.close is null or f.bb_upper is null", ("(c1prev <= bb_upper and close > bb_upper and (sqz is null or bb_width <= sqz))", "(c1prev >= bb_lower and close < bb_lower and (sqz is null or bb_width <= sqz))"), ("close >= bb_middle", "close <= bb_middle"), 2, 10, True),
    ("m_macd", """select symbol, rn, 0 as pos, 0 as held, 0 as sig from sig0 where rn = 1
      union all select symbol, rn, case when unknown then pos when forced then 0 when crossed <> 0 then crossed else pos end,
        case when unknown then held when forced then 0 when crossed <> 0 then 1 else hh end, case when unknown or forced then 0 when crossed <> 0 then crossed else pos end from (
        select *, case when not (hh = 0 or hh >= 2) then 0 when h1prev <= 0 and macd_histogram > 0 then 1 when h1prev >= 0 and macd_histogram < 0 then -1 else 0 end as crossed from (
          select f.*, s.pos, s.held, s.held + (s.pos <> 0)::int as hh, (s.pos <> 0 and s.held + 1 > 20) as forced, (f.macd_histogram is null or f.h1prev is null) as unknown
          from m_macd s join sig0 f on f.symbol = s.symbol and f.rn = s.rn + 1))"""),
    ("sig1", """select s.*, a.sig as signal_rsi, b.sig as signal_macd, c.sig as signal_zscore, e.sig as signal_bb from sig0 s
      join m_rsi a on s.symbol = a.symbol and s.rn = a.rn join m_macd b on s.symbol = b.symbol and s.rn = b.rn join m_z c on s.symbol = c.symbol and s.rn = c.rn join m_bb e on s.symbol = e.symbol and s.rn = e.rn"""),
    ("sig2", f"""select *, list(vol_21d) filter (where vol_21d is not null) over ({BY} rows between 252 preceding and 1 preceding) as vols, count(*) over ({BY} rows between 252 preceding and 1 preceding) as nrows,
      lag(signal_macd) over ({BY}) as mprev from sig1"""),
    ("sig", f"""select * exclude (vols, nrows, mprev),
      case signal_rsi when 1 then least(1, greatest(0, (30 - rsi_14) / 30)) when -1 then least(1, greatest(0, (rsi_14 - 70) / 30)) else 0 end as signal_rsi_strength,
      case when h1prev is not null and not (signal_macd = 0 and coalesce(mprev, 0) <> 0) and htop > 0 then least(1, abs(macd_histogram) / htop) else 0 end as signal_macd_strength,
      case when signal_zscore <> 0 then least(1, greatest(abs(z_price_60d) - 2, 0) / 2) else 0 end as signal_zscore_strength,
      case signal_bb when 1 then least(1, greatest(bb_middle - close, 0) / nullif(bb_upper - bb_lower, 0)) when -1 then least(1, greatest(close - bb_middle, 0) / nullif(bb_upper - bb_lower, 0)) else 0 end as signal_bb_strength,
      case when vol_21d is not null and nrows >= 252 and len(vols) >= 10 then greatest(0, least(2, 2 - 2 * len(list_filter(vols, lambda v: v < vol_21d))::double / len(vols))) else 1.0 end as position_scale,
      cast(sign(signal_rsi + signal_macd + signal_zscore) as int) as signal_ensemble,
      cast(sign((signal_rsi + signal_macd + signal_zscore) / 3.0::double) as int) as signal_weighted,
      case when vol_21d > ({roll(AVG, 'vol_21d', 63, 20)}) then signal_macd else signal_rsi end as signal_switch from sig2"""),
]


def broken(name: str, signal: str, most: float) -> list[tuple[str, str]]:
    """The resettable drawdown breaker of a signal (symbol, rn, equity, peak, closed, gate)."""
    return [
        (f"{name}_e", f"select symbol, rn, exp(sum(ln(1 + held * coalesce(returns, 0))) over (partition by symbol order by rn)) as equity from (select symbol, rn, returns, coalesce(lag({signal}) over (partition by symbol order by rn), 0) as held from sig)"),
        (name, f"""select symbol, rn, greatest(1.0, equity) as peak, (equity - greatest(1.0, equity)) / greatest(1.0, equity) < -{most} as closed, not ((equity - greatest(1.0, equity)) / greatest(1.0, equity) < -{most}) as gate from {name}_e where rn = 1
          union all select symbol, rn, case when closed then (case when equity >= 0.95 * peak then equity else peak end) else greatest(peak, equity) end,
            case when closed then equity < 0.95 * peak else (equity - greatest(peak, equity)) / greatest(peak, equity) < -{most} end,
            case when closed then false else not ((equity - greatest(peak, equity)) / greatest(peak, equity) < -{most}) end from (
              select f.symbol, f.rn, f.equity, s.peak, s.closed from {name} s join {name}_e f on f.symbol = s.symbol and f.rn = s.rn + 1)"""),
    ]


def rollq(x: str, n: int, least: int, p: float) -> str:
    return roll(quant(p), x, n, least)


_CONFIRM = "coalesce(sign({s}) = sign(macd_line) and abs(macd_line) >= mq25, false)"
GATES = [
    *broken("b_rsi", "signal_rsi", 0.15), *broken("b_z", "signal_zscore", 0.15), *broken("b_macd", "signal_macd", 0.20), *broken("b_bb", "signal_bb", 0.20),
    ("gat0", f"""select *, {rollq('vol_21d', 252, 126, 0.20)} as vq20, {rollq('vol_21d', 252, 126, 0.25)} as vq25, {rollq('vol_21d', 252, 126, 0.40)} as vq40, {rollq('vol_21d', 252, 126, 0.30)} as vq30, {rollq('vol_21d', 252, 126, 0.50)} as vq50, {rollq('bb_width', 252, 63, 0.25)} as bq25, {rollq('bb_width', 252, 63, 0.40)} as bq40,
      {roll(AVG, 'returns', 63, 31)} as trend63, coalesce({rollq('abs(macd_line)', 252, 63, 0.25)}, quantile_cont(abs(macd_line), 0.5) over (partition by symbol)) as mq25,
      coalesce({rollq('abs(macd_line)', 252, 60, 0.25)}, quantile_cont(abs(macd_line), 0.5) over (partition by symbol)) as mw25,
      coalesce({rollq('vol_21d', 252, 60, 0.40)}, quantile_cont(vol_21d, 0.5) over (partition by symbol)) as vlab from sig"""),
    ("gat1", f"""select g.*, a.gate as gate_dd_signal_rsi_150, b.gate as gate_dd_signal_zscore_150, c.gate as gate_dd_signal_macd_200, e.gate as gate_dd_signal_bb_200,
      case when coalesce(vol_21d < vq20, false) and coalesce(abs(trend63) < 0.06 / 252, false) and a.gate then signal_rsi else 0 end as signal_rsi_vol_trend_gated,
      case when coalesce(vol_21d < vq20, false) and coalesce(bb_width < bq25, false) and b.gate then signal_zscore else 0 end as signal_zscore_vol_bb_gated,
      case when coalesce(vol_21d < vq25, false) and coalesce(bb_width < bq25, false) and b.gate then signal_zscore else 0 end as preset_zscore,
      case when coalesce(vol_21d > vq40, false) and {_CONFIRM.format(s='signal_bb')} and e.gate then signal_bb else 0 end as preset_bb,
      case when coalesce(vol_21d > vq50, false) and {_CONFIRM.format(s='signal_macd')} and c.gate then signal_macd else 0 end as signal_macd_trend_gated,
      case when coalesce(vol_21d > vq50, false) and {_CONFIRM.format(s='signal_bb')} and e.gate then signal_bb else 0 end as signal_bb_breakout_gated,
      case when coalesce(vol_21d < vlab, false) then 'range_bound' else 'trending' end as regime_label2
      from gat0 g join b_rsi a on g.symbol = a.symbol and g.rn = a.rn join b_z b on g.symbol = b.symbol and g.rn = b.rn join b_macd c on g.symbol = c.symbol and g.rn = c.rn join b_bb e on g.symbol = e.symbol and g.rn = e.rn"""),
    ("gat2", "select *, cast(sign((signal_rsi_vol_trend_gated + signal_zscore_vol_bb_gated) / 2.0) as int) as signal_mr_pool, cast(sign((signal_macd_trend_gated + signal_bb_breakout_gated) / 2.0) as int) as signal_trend_pool from gat1"),
    ("gat", "select *, case when regime_label2 = 'range_bound' then signal_mr_pool else signal_trend_pool end as signal_regime_adaptive from gat2"),
]
REGIMES = [
    ("reg0", f"select *, list(vol_21d) filter (where vol_21d is not null) over ({BY} rows between 251 preceding and current row) as vols, ({roll(AVG, 'returns', 63, 31)}) * 252 as trend from gat"),
    ("reg1", "select *, case when vol_21d is not null and len(vols) >= 63 then (len(list_filter(vols, lambda v: v < vol_21d)) + (len(list_filter(vols, lambda v: v = vol_21d)) + 1) / 2.0::double) / len(vols) * 100 end as vrank from reg0"),
    ("reg2", """select * exclude (vols), case when vrank is null or trend is null then null when vrank > 90 then 'crisis' when abs(trend) < 0.05 then 'range_bound'
      when trend > 0 and macd_line > 0 then 'trending_up' when trend < 0 and macd_line < 0 then 'trending_down' else 'range_bound' end as regime_label from reg1"""),
    ("reg3", "select *, " + ", ".join(f"cast(regime_label = '{n}' as int)::double as regime_prob_{n}" for n in ("range_bound", "trending_up", "trending_down", "crisis")) + " from reg2"),
    ("reg4", """select *, coalesce((w1 * (signal_rsi + signal_zscore) + w2 * (signal_macd + signal_bb)) / nullif(2 * w1 + 2 * w2, 0), 0) as blend from (
      select *, coalesce(regime_prob_range_bound, 0) as w1, coalesce(regime_prob_trending_up, 0) + coalesce(regime_prob_trending_down, 0) as w2 from reg3)"""),
    ("reg", "select *, cast(sign(blend) as int) as signal_adaptive, least(1, abs(blend)) as position_scale_adaptive from reg4"),
]
TRADED = ["signal_rsi", "signal_macd", "signal_zscore", "signal_bb", "signal_ensemble", "signal_rsi_vol_trend_gated", "signal_zscore_vol_bb_gated", "signal_macd_trend_gated", "signal_bb_breakout_gated", "signal_mr_pool", "signal_trend_pool", "signal_regime_adaptive", "signal_adaptive"]
LONG = [("longs", "select symbol, d, rn, open, high, low, close, volume, vol_21d, u.signal, u.value, case when u.signal = 'signal_adaptive' then position_scale_adaptive else position_scale end as scale from (select *, unnest([" + ", ".join(f"{{'signal': '{s}', 'value': {s}}}" for s in TRADED) + "]) as u from reg)")]
PAIR = "partition by symbol, signal order by d"


def cost(price: str, shares: str, volume: str, spread: float = 2.0, slip: float = 1.0, commission: float = 1.0, pct: float = 0.0005) -> str:
    n = f"abs({shares}) * {price}"
    return f"({spread} / 1e4 * {n} + {slip} / 1e4 * {n} * sqrt(abs({shares}) / (case when {volume} > 0 then {volume} else 1000000.0 end)) + greatest({commission}, {pct} * {n}))"


def curve(size: str = "100000.0 / nullif(close, 0)", exit_: float | None = None, mode: str = "reference", name: str = "curve") -> list[tuple[str, str]]:
    run = f"over ({PAIR} rows between unbounded preceding and current row)"
    out = [
        ("cur0", f"select *, coalesce(lag(value) over ({PAIR}), 0) as position, coalesce(lag(scale) over ({PAIR}), 1.0) as held_scale from longs"),
        ("cur1", f"select *, coalesce(position * held_scale * ({size}), 0.0) as shares from cur0"),
        ("cur2", f"select *, shares - coalesce(lag(shares) over ({PAIR}), 0) as delta_shares, coalesce(close - lag(close) over ({PAIR}), 0) as move from cur1"),
        ("cur3", f"select *, case when delta_shares <> 0 then {cost('close', 'delta_shares', 'volume')} else 0.0 end as cost from cur2"),
        ("cur4", "select *, shares * move - cost as pnl from cur3"),
        ("cur5", f"select *, 100000.0 + sum(pnl) {run} as equity from cur4"),
    ]
    last = "cur5"
    if exit_ is not None:
        cmp, redo = (">=", "cost") if mode == "reference" else (">", None)
        out += [
            ("brk0", f"select *, (equity - max(equity) {run}) / nullif(max(equity) {run}, 0) < -{exit_} as breach from cur5"),
            ("brk1", "select *, min(case when breach then d end) over (partition by symbol, signal) as first_breach from brk0"),
            ("brk2", f"select * exclude (shares, pnl, equity), case when coalesce(d {cmp} first_breach, false) then 0.0 else shares end as shares from brk1"),
        ]
        if redo:
            out += [("brk3", "select * from brk2")]
        else:
            out += [("brk2a", f"select * exclude (delta_shares, cost), shares - coalesce(lag(shares) over ({PAIR}), 0) as delta_shares from brk2"), ("brk3", f"select *, case when delta_shares <> 0 then {cost('close', 'delta_shares', 'volume')} else 0.0 end as cost from brk2a")]
        out += [("brk4", "select *, shares * move - cost as pnl from brk3"), ("brk5", f"select *, 100000.0 + sum(pnl) {run} as equity from brk4")]
        last = "brk5"
    out += [
        ("cur6", f"select *, pnl / nullif(coalesce(lag(equity) over ({PAIR}), 100000.0), 0) as ret, max(equity) {run} as peak from {last}"),
        (name, "select *, (equity - peak) / nullif(peak, 0) as drawdown from cur6"),
    ]
    return out


TRADES = [
    ("trd0", f"select *, coalesce(lag(position) over ({PAIR}), 0) as before, lag(position) over ({PAIR}) is null as opening, lead(d) over ({PAIR}) as next_d, lead(close) over ({PAIR}) as next_price, lead(cost) over ({PAIR}) as next_cost from curve"),
    ("trd1", f"select *, sum((position <> before or opening)::int) over ({PAIR} rows between unbounded preceding and current row) as run from trd0"),
    ("trd2", """select symbol, signal, run, min(d) as entry_d, coalesce(arg_max(next_d, d), max(d)) as exit_d, max(d) as last_d, arg_min(position, d) as direction, arg_min(close, d) as entry_price,
      arg_max(coalesce(next_price, close), d) as exit_price, abs(arg_min(shares, d)) as shares, arg_min(case when before <> 0 then 0.0 else cost end, d) as entry_cost, arg_max(coalesce(next_cost, 0.0), d) as exit_cost
      from trd1 where position <> 0 group by 1, 2, 3"""),
    ("trades", """select *, case when entry_price * shares > 0 then pnl / (entry_price * shares) else 0.0 end as pnl_pct, cast(date_diff('day', entry_d, exit_d) as int) as holding_days from (
      select symbol, signal, entry_d, exit_d, direction, entry_price, exit_price, shares, entry_cost, exit_cost, direction * (exit_price - entry_price) * shares - entry_cost - exit_cost as pnl from trd2)"""),
]
RF = "(pow(1.05::double, 1.0::double / 252) - 1)"
METRICS = [
    ("met0", f"select *, ret - {RF} as x, quantile_cont(ret, 0.05) over (partition by symbol, signal) as var from curve"),
    ("met1", """select symbol, signal, (arg_max(equity, d) - arg_min(equity, d)) / nullif(arg_min(equity, d), 0) as total_return,
      case when count(ret) > 0 and product(1 + ret) > 0 then pow(product(1 + ret), 252.0 / count(ret)) - 1 else 0.0 end as annual_return, stddev_samp(ret) * sqrt(252) as annual_vol,
      case when coalesce(stddev_samp(x), 0) < 1e-10 then 0.0 else avg(x) / nullif(stddev_samp(x), 0) * sqrt(252) end as sharpe,
      coalesce(avg(x) / nullif(stddev_samp(case when x < 0 then x end), 0) * sqrt(252), 0.0) as sortino,
      min(drawdown) as max_drawdown, coalesce(avg(case when drawdown < -1e-12 then drawdown end), 0.0) as avg_drawdown, min(var) as var_95,
      case when count(ret) > 20 then avg(case when ret <= var then ret end) else 0.0 end as cvar_95, count(*) as n_bars from met0 group by 1, 2"""),
    ("und0", f"select symbol, signal, d, equity < peak * (1 - 1e-12) as under, lag(equity < peak * (1 - 1e-12)) over ({PAIR}) as was from curve"),
    ("und1", f"select *, sum((was is null or was <> under)::int) over ({PAIR} rows between unbounded preceding and current row) as run from und0"),
    ("und2", "select symbol, signal, max(n)::double as max_drawdown_days from (select symbol, signal, run, count(*) filter (where under) as n from und1 group by 1, 2, 3) group by 1, 2"),
    ("tst", """select symbol, signal, count(*)::double as n_trades, (count(*) filter (where pnl > 0))::double / count(*) as hit_rate, coalesce(avg(pnl) filter (where pnl > 0), 0.0) as avg_win, coalesce(avg(pnl) filter (where pnl <= 0), 0.0) as avg_loss,
      case when coalesce(sum(pnl) filter (where pnl <= 0), 0) <> 0 then coalesce(sum(pnl) filter (where pnl > 0), 0) / abs(sum(pnl) filter (where pnl <= 0)) end as profit_factor,
      avg(holding_days::double) as avg_hold_days, avg(pnl_pct) as avg_pnl_pct, sum(entry_cost + exit_cost) as total_costs from trades group by 1, 2"""),
    ("metrics", """select m.*, u.max_drawdown_days, case when m.max_drawdown = 0 then null else annual_return / abs(m.max_drawdown) end as calmar,
      coalesce(t.n_trades, 0) as n_trades, coalesce(t.hit_rate, 0) as hit_rate, coalesce(t.avg_win, 0) as avg_win, coalesce(t.avg_loss, 0) as avg_loss, case when t.n_trades is null then 0.0 else t.profit_factor end as profit_factor,
      coalesce(t.avg_hold_days, 0) as avg_hold_days, coalesce(t.avg_pnl_pct, 0) as avg_pnl_pct, coalesce(t.total_costs, 0) as total_costs, coalesce(t.n_trades, 0) / n_bars * 252 as turnover, 0.0::double as alpha, 1.0::double as beta, 0.0::double as r2
      from met1 m join und2 u on m.symbol = u.symbol and m.signal = u.signal left join tst t on m.symbol = t.symbol and m.signal = t.signal"""),
]
FACTORS = [
    ("fac0", f"select symbol, d, close / lag(close) over ({BY}) - 1 as r from bars"),
    ("fac1", """select d, max(r) filter (where symbol = '1-URGENT') as u, max(r) filter (where symbol = '2-HIGH') as h, max(r) filter (where symbol = '3-MEDIUM') as m,
      max(r) filter (where symbol = '4-NOT SPECIFIED') as n, max(r) filter (where symbol = '5-LOW') as x from fac0 group by d"""),
    ("factors", f"select d, (u + h + m + n + x) / 5 - {RF} as mkt, u - h as smb, m - n as hml, x - u as mom, {RF} as rf from fac1 where u is not null and h is not null and m is not null and n is not null and x is not null"),
]
EXCESS = [("excess", f"select c.symbol, c.signal, c.d, c.ret - coalesce(f.rf, {RF}) as excess, f.mkt, f.smb, f.hml, f.mom from curve c left join factors f on c.d = f.d")]
MODELS = {"CAPM": ("mkt",), "FF3": ("mkt", "smb", "hml"), "Carhart4": ("mkt", "smb", "hml", "mom")}
FOUR = MODELS["Carhart4"]


def _simpson(f: str, end: str) -> str:
    """The integral of f(x) from 0 to ``end``."""
    return f"(list_sum([(case when i in (0, 400) then 1 when i % 2 = 1 then 4 else 2 end) * {f.format(x=f'(i * {end} / 400)')} for i in range(0, 401)]) * {end} / 1200)"


def regressions(errors: str) -> list[tuple[str, str]]:
    """(symbol, signal, model, ...) of least squares, from ``excess``. The algebra of a group
    is the text that the engine uses; tests compare its results with NumPy."""
    from ..operators import factors as f

    if errors == "hac":
        p = f"1 - {_simpson('exp(-{x} * {x} / 2)', 'least(abs(t), 9.0::double)')} * 2 / sqrt(2 * pi())"
    else:
        end, density = "least(pi() / 2, 12 / sqrt(free))", "pow(cos({x}), free - 1)"
        p = f"1 - {_simpson(density, f'least({end}, atan(abs(t) / sqrt(free)))')} / {_simpson(density, end)}"
    each = " union all ".join(f"select symbol, signal, d, '{m}' as model, {len(used)} as used, excess as y, " + ", ".join(f"{c if c in used else '0.0::double'} as x{i}" for i, c in enumerate(FOUR)) + " from excess" for m, used in MODELS.items())
    known = " and ".join(["y is not null", *[f"x{i} is not null" for i in range(4)]])
    by = "partition by symbol, signal, model order by d"
    shown = {"alpha_daily": "alpha", "alpha_annual": "annual", "t_stat": "t", "r2": "fit", "adj_r2": "adjusted", "ic": "agreement", "ir": "ratio", **{f"beta_{c}": f"b{i}" for i, c in enumerate(FOUR)}}
    has = {f"beta_{c}": "k.model in (" + ", ".join(f"'{m}'" for m, used in MODELS.items() if c in used) + ")" for c in FOUR}
    return [
        ("rg0", each), ("rg1", f"select * from rg0 where {known}"),
        ("rg2", f"select *, {', '.join(f.solved_columns(4))} from (select symbol, signal, model, used, {', '.join(f.moment_columns(4))} from rg1 group by all)"),
        ("rg3", f"select r.symbol, r.signal, r.model, d, {', '.join(f.residual_columns(4))} from rg1 r join rg2 g on r.symbol = g.symbol and r.signal = g.signal and r.model = g.model"),
        ("rg4", "select *, " + ", ".join(f"h * lag(h, {j}) over ({by}) as h{j}" for j in range(1, f.LAGS + 1)) + " from rg3"),
        ("rg5", "select symbol, signal, model, sum(u * u) as uu, sum(h * h) as h0, " + ", ".join(f"sum(h{j}) as h{j}" for j in range(1, f.LAGS + 1)) + " from rg4 group by all"),
        ("rg6", f"select *, (n - used - 1)::double as free, {', '.join(f.told_columns(4, errors))} from rg2 join rg5 using (symbol, signal, model)"),
        ("rg7", f"select *, greatest(0.0::double, {p}) as p from rg6 where not bare"),
        ("regressed", "select k.symbol, k.signal, k.model, " + ", ".join((f"case when {has[c]} then coalesce({x}, 0.0::double) end" if c in has else f"coalesce({x}, 0.0::double)") + f" as {c}" for c, x in shown.items()) + """,
           coalesce(p, 1.0::double) as p_value, coalesce(abs(t) > 2 and p < 0.05, false) as significant, coalesce(n, 0) as n_obs
           from (select distinct symbol, signal, m as model from excess, (values ('CAPM'), ('FF3'), ('Carhart4')) v(m)) k left join rg7 g on k.symbol = g.symbol and k.signal = g.signal and k.model = g.model"""),
    ]


#: The stages in order.
CLEAN = [*walk("orders"), *ALIGN, *FILL, *RETURNS]
STAGES = {"bars": walk("orders"), "clean": CLEAN}
STAGES["feat"] = [*STAGES["clean"], *FEATURES]
STAGES["sig"] = [*STAGES["feat"], *SIGNALS]
STAGES["gat"] = [*STAGES["sig"], *GATES]
STAGES["reg"] = [*STAGES["gat"], *REGIMES]
STAGES["longs"] = [*STAGES["reg"], *LONG]
STAGES["curve"] = [*STAGES["longs"], *curve()]
STAGES["trades"] = [*STAGES["curve"], *TRADES]
STAGES["metrics"] = [*STAGES["trades"], *METRICS]
STAGES["factors"] = [*STAGES["bars"], *FACTORS]
STAGES["excess"] = [*STAGES["curve"], *FACTORS, *EXCESS]


def over(source: str, stage: str) -> list[tuple[str, str]]:
    """A stage over the bars of another table."""
    bars = walk(source)
    return [*bars, *STAGES[stage][len(bars) :]]


def sql(ctes: list[tuple[str, str]], select: str) -> str:
    return "with recursive " + ",\n".join(f"{name} as ({body})" for name, body in ctes) + f"\n{select}"
