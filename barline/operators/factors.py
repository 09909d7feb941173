"""Factor attribution with HAC inference, rolling CAPM and regime analytics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import last_rows
from .backtest import PAIR

FACTORS = ("mkt", "smb", "hml", "mom")
YEAR = 252


def models_for(factors: list[str]) -> dict[str, list[str]]:
    """The models that the available factors allow."""
    have = [f for f in FACTORS if f in [x.lower() for x in factors]]
    if "mkt" not in have:
        return {"Single": have[:1]} if have else {}
    out = {"CAPM": ["mkt"]}
    if {"smb", "hml"} <= set(have):
        out["FF3"] = ["mkt", "smb", "hml"]
        if "mom" in have:
            out["Carhart4"] = ["mkt", "smb", "hml", "mom"]
    elif "smb" in have:
        out["FF2"] = ["mkt", "smb"]
    elif "mom" in have:
        out["CAPM_MOM"] = ["mkt", "mom"]
    return out


def active_bars(curve: DataFrame, least: int = 30) -> DataFrame:
    """Bars in a position, for pairs with over ``least`` of them; all bars of the
    others."""
    active = F.sum((F.col("position") != 0).cast("long")).over(Window.partitionBy(*PAIR))
    return curve.withColumn("_n", active).filter((F.col("_n") <= least) | (F.col("position") != 0)).drop("_n")


def excess_returns(curve: DataFrame, factors: DataFrame, rf_annual: float = 0.05) -> DataFrame:
    """(symbol, signal, d, excess, factor columns) of days with a factor row or
    not; a missing risk-free rate is the default."""
    rf = (1 + rf_annual) ** (1 / YEAR) - 1
    # a row per calendar day, at most a few ten thousand: the broadcast is bounded by the calendar
    met = curve.join(F.broadcast(factors), "d", "left")
    return met.select(*PAIR, "d", (F.col("ret") - F.coalesce("rf", F.lit(rf))).alias("excess"), *[c for c in FACTORS if c in factors.columns])


#: Lags of the Newey-West errors at most, and places of Simpson's rule for p-values.
LAGS, PLACES = 12, 400
GROUP = ("symbol", "signal", "model")
REGRESSED = ("alpha_daily", "alpha_annual", "t_stat", "p_value", "significant", "r2", "adj_r2", "ic", "ir", "n_obs")


def moment_columns(k: int) -> list[str]:
    """SQL of the moments of y and x0 ... of a group."""
    own = [f"avg(x{i}) as m{i}" for i in range(k)] + [f"covar_pop(x{i}, x{j}) as c{i}{j}" for i in range(k) for j in range(i + 1)]
    return ["count(*) as n", "avg(y) as my", "var_pop(y) as vy", *own, *[f"covar_pop(x{i}, y) as c{i}y" for i in range(k)]]


def solved_columns(k: int) -> list[str]:
    """SQL of the slopes b0 ... and of q0 ..., the covariances' inverse times the means, by
    a factorisation without roots; a factor that the ones before it explain has slope 0."""
    out = []
    for j in range(k):
        known = "".join(f" - l{j}{m} * l{j}{m} * d{m}" for m in range(j))
        out += [f"c{j}{j}{known} as d{j}", f"case when d{j} > 1e-12 * c{j}{j} then 1 / d{j} else 0.0 end as i{j}"]
        out += [f"(c{i}{j}" + "".join(f" - l{i}{m} * l{j}{m} * d{m}" for m in range(j)) + f") * i{j} as l{i}{j}" for i in range(j + 1, k)]
    for name, right in (("b", "c{}y"), ("q", "m{}")):
        out += [right.format(i) + "".join(f" - l{i}{m} * w{name}{m}" for m in range(i)) + f" as w{name}{i}" for i in range(k)]
        out += [f"w{name}{i} * i{i}" + "".join(f" - l{m}{i} * {name}{m}" for m in range(i + 1, k)) + f" as {name}{i}" for i in reversed(range(k))]
    return [*out, "my" + "".join(f" - b{i} * m{i}" for i in range(k)) + " as alpha"]


def residual_columns(k: int) -> list[str]:
    """SQL of a row's residual u and of h, whose sum is the error of the intercept."""
    fitted = "".join(f" - b{i} * x{i}" for i in range(k))
    return [f"y - alpha{fitted} as u", "u * (1" + "".join(f" - (x{i} - m{i}) * q{i}" for i in range(k)) + ") / n as h"]


def told_columns(k: int, errors: str) -> list[str]:
    """SQL of what a regression tells but for the p-value, from n, the solution, the sum of
    squared residuals uu and the products of h with its lags h0 ..."""
    lags = f"least(floor(sqrt(n)), {LAGS})"
    hac = "h0" + "".join(f" + case when {j} <= {lags} then 2 * (1 - {j} / ({lags} + 1.0)) * coalesce(h{j}, 0.0) else 0.0 end" for j in range(1, LAGS + 1))
    classic = "(1" + "".join(f" + m{i} * q{i}" for i in range(k)) + ") / n * uu / (n - used - 1)"
    explained = " + ".join(f"b{i} * c{i}y" for i in range(k))
    return [
        "n < 30 or sqrt(vy) < 1e-10 as bare", f"{hac if errors == 'hac' else classic} as variance", "case when variance > 0 then alpha / sqrt(variance) else 0.0 end as t", "power(1 + alpha, 252) - 1 as annual",
        "case when vy > 0 then 1 - uu / (n * vy) else 0.0 end as fit", "case when n > used + 1 then 1 - (1 - fit) * (n - 1) / (n - used - 1) else fit end as adjusted",
        f"case when {explained} > 1e-30 then sqrt(({explained}) / vy) else 0.0 end as agreement", "sqrt(uu / (n - 1)) as spread", f"case when spread > 1e-12 then annual / (spread * sqrt({YEAR})) else 0.0 end as ratio"]


def _simpson(f, end: Column) -> Column:  # noqa: ANN001
    """The integral of f from 0 to ``end``."""
    step = end / PLACES
    weight = lambda i: F.when(i.isin(0, PLACES), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    return F.aggregate(F.sequence(F.lit(0), F.lit(PLACES)), F.lit(0.0), lambda acc, i: acc + weight(i) * f(i * step)) * step / 3


def p_value(t: Column, freedom: Column | None) -> Column:
    """Two-sided, of the normal distribution or of Student's."""
    if freedom is None:
        inside = _simpson(lambda x: F.exp(-x * x / 2), F.least(F.abs(t), F.lit(9.0))) * 2 / math.sqrt(2 * math.pi)
    else:
        density = lambda x: F.pow(F.cos(x), freedom - 1)
        end = F.least(F.lit(math.pi / 2), 12 / F.sqrt(freedom))
        inside = _simpson(density, F.least(end, F.atan(F.abs(t) / F.sqrt(freedom)))) / _simpson(density, end)
    return F.greatest(F.lit(0.0), 1 - inside)


def regressions(excess: DataFrame, models: dict[str, list[str]] | None = None, errors: str = "hac") -> DataFrame:
    """One row per (symbol, signal, model): least squares on a constant and the factors, with
    Newey-West errors (Bartlett weights, min(floor(sqrt n), 12) lags) and normal p-values, or
    ``classic`` ones with Student's. All from aggregates: the moments of a group give its
    coefficients, a second pass its residuals; as only the intercept's error is told, the
    lagged products are those of one series. Groups of under 30 days, or without variation,
    have zeros and n_obs 0."""
    if errors not in ("hac", "classic"):
        raise ValueError(f"unknown errors {errors!r}")
    models = models or models_for([c for c in FACTORS if c in excess.columns])
    names = list(dict.fromkeys(f for used in models.values() for f in used))
    k = len(names)
    value = lambda f, used: F.col(f).cast("double") if f in used else F.lit(0.0)
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(len(used)).alias("used"), *[value(f, used).alias(f"x{i}") for i, f in enumerate(names)]) for m, used in models.items()])
    rows = excess.select(*PAIR, "d", F.col("excess").cast("double").alias("y"), F.explode(each).alias("s")).select(*PAIR, "d", "y", "s.*")
    known = rows.filter(" and ".join(["y is not null", *[f"x{i} is not null" for i in range(k)]]))
    fitted = known.groupBy(*GROUP, "used").agg(*map(F.expr, moment_columns(k))).selectExpr("*", *solved_columns(k))
    order = Window.partitionBy(*GROUP).orderBy("d")
    solution = fitted.select(*GROUP, "alpha", "n", *[f"{c}{i}" for c in "bqm" for i in range(k)])
    resid = known.join(solution, list(GROUP)).selectExpr(*GROUP, "d", *residual_columns(k))
    lagged = resid.withColumns({f"h{j}": F.col("h") * F.lag("h", j).over(order) for j in range(1, LAGS + 1)})
    sums = lagged.groupBy(*GROUP).agg(F.sum(F.col("u") * F.col("u")).alias("uu"), F.sum(F.col("h") * F.col("h")).alias("h0"), *[F.sum(f"h{j}").alias(f"h{j}") for j in range(1, LAGS + 1)])
    told = fitted.join(sums, list(GROUP)).selectExpr("*", *told_columns(k, errors))
    told = told.withColumn("p", p_value(F.col("t"), None if errors == "hac" else (F.col("n") - F.col("used") - 1).cast("double")))
    return _whole(excess, told, models, names)


def _whole(excess: DataFrame, told: DataFrame, models: dict[str, list[str]], names: list[str]) -> DataFrame:
    """A row for every pair and model, with zeros where there is nothing to tell."""
    keys = excess.select(*PAIR).distinct().withColumn("model", F.explode(F.array(*map(F.lit, models))))
    met, zero, bare = keys.join(told, list(GROUP), "left"), F.lit(0.0), F.coalesce(F.col("bare"), F.lit(True))
    shown = {"alpha_daily": "alpha", "alpha_annual": "annual", "t_stat": "t", "r2": "fit", "adj_r2": "adjusted", "ic": "agreement", "ir": "ratio"}
    out = {c: F.when(bare, zero).otherwise(F.col(x)) for c, x in shown.items()}
    out |= {"p_value": F.when(bare, 1.0).otherwise(F.col("p")), "n_obs": F.when(bare, 0).otherwise(F.col("n")).cast("long"), "significant": ~bare & (F.abs("t") > 2) & (F.col("p") < 0.05)}
    betas = F.lit(None)
    for m, used in models.items():
        pairs = [x for f in used for x in (F.lit(f), F.when(bare, zero).otherwise(F.col(f"b{names.index(f)}")))]
        betas = F.when(F.col("model") == m, F.create_map(*pairs)).otherwise(betas)
    return met.select(*GROUP, *[out[c].alias(c) for c in REGRESSED], betas.alias("betas"))


def attribution_table(regressed: DataFrame) -> DataFrame:
    """Flat rows with a column per beta."""
    return regressed.select(
        *PAIR, "model", *[F.round(c, 4).alias(c) for c in ("alpha_annual", "alpha_daily", "t_stat", "p_value", "r2", "adj_r2", "ic", "ir")], "significant", "n_obs",
        (F.col("n_obs") < 30).alias("low_sample_size"), *[F.round(F.try_element_at("betas", F.lit(f)), 4).alias(f"beta_{f}") for f in FACTORS])


def capm(excess: DataFrame) -> DataFrame:
    """CAPM point estimates per (symbol, signal) by built-in regression aggregates;
    fewer than 30 days give the empty regression."""
    met = excess.filter("excess is not null and mkt is not null")
    r = met.groupBy(*PAIR).agg(F.regr_slope("excess", "mkt").alias("b"), F.regr_intercept("excess", "mkt").alias("a"), F.regr_r2("excess", "mkt").alias("q"), F.count("*").alias("n"))
    enough = F.col("n") >= 30
    zero = lambda c: F.when(enough, F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    return r.select(*PAIR, zero(F.col("b")).alias("beta"), zero(F.pow(1 + F.col("a"), float(YEAR)) - 1).alias("alpha_annual"), zero(F.col("q")).alias("r2"), F.when(enough, F.col("n")).otherwise(0).alias("n_obs"))


def rolling_capm(excess: DataFrame, window: int = 126) -> DataFrame:
    """alpha, beta and r2 of the ``window`` rows before each one, with a label of
    the market's state."""
    met = excess.filter("excess is not null and mkt is not null")
    before = last_rows(window, PAIR, ending=-1)
    full = F.count("excess").over(before) >= window
    y, x = F.col("excess"), F.col("mkt")
    mean, risk, n63 = F.avg(x).over(last_rows(63, PAIR)), F.stddev_samp(x).over(last_rows(63, PAIR)) * F.sqrt(F.lit(float(YEAR))), F.count(x).over(last_rows(63, PAIR)) >= 63
    label = F.when(n63 & (risk > 0.25), "crisis").when(n63 & (mean < -0.001), "trending_down").when(n63 & (mean > 0.001), "trending_up").otherwise("range_bound")
    return met.select(
        *PAIR, "d", F.when(full, F.pow(1 + F.regr_intercept(y, x).over(before), float(YEAR)) - 1).alias("alpha_annual"), F.when(full, F.regr_slope(y, x).over(before)).alias("beta"),
        F.when(full, F.regr_r2(y, x).over(before)).alias("r2"), label.alias("regime"))


def market_regimes(factors: DataFrame, vol_window: int = 21, window: int = 63) -> DataFrame:
    """(d, regime) of a market return series (d, mkt)."""
    # one series: its window is one partition, a row per calendar day
    day = factors.select(F.lit("market").alias("symbol"), "d", "mkt")
    full = lambda n, c: F.when(F.count("mkt").over(last_rows(n)) >= n, c)
    vol = full(vol_window, F.stddev_samp("mkt").over(last_rows(vol_window)) * F.sqrt(F.lit(float(YEAR))))
    ret = full(window, F.avg("mkt").over(last_rows(window)) * YEAR)
    label = F.when((ret < -0.05) & (vol <= 0.30), "trending_down").when((ret > 0.05) & (vol <= 0.30), "trending_up").when(vol > 0.30, "crisis").otherwise("range_bound")
    return day.select("d", label.alias("regime"))


def performance_by_regime(curve: DataFrame, regimes: DataFrame) -> DataFrame:
    """(symbol, signal, regime, n, sharpe, pct): Sharpe without a risk-free rate,
    null under 5 bars."""
    met = curve.select(*PAIR, "d", "ret").join(F.broadcast(regimes), "d")  # a row per calendar day
    by = met.groupBy(*PAIR, "regime").agg(F.count("ret").alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.count("*").alias("rows"))
    total = by.groupBy(*PAIR).agg(F.sum("rows").alias("total"))
    sharpe = F.when(F.col("n") >= 5, F.when(F.col("s") > 1e-10, F.col("m") / F.col("s") * math.sqrt(YEAR)).otherwise(0.0))
    return by.join(total, list(PAIR)).select(*PAIR, "regime", "n", sharpe.alias("sharpe"), (F.col("rows") / F.col("total")).alias("pct"))


def wide_by_regime(performance: DataFrame) -> DataFrame:
    """A row per (symbol, signal), a Sharpe and a share column per regime."""
    names = ["range_bound", "trending_up", "trending_down", "crisis"]
    wide = performance.groupBy(*PAIR).pivot("regime", names).agg(F.first("sharpe").alias("sharpe"), F.first("pct").alias("pct"))
    return wide


