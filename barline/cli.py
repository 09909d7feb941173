"""Command line: run the engine over a folder of tables, or look things up."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql.types import DoubleType

from . import config
from .operators import factors, features, learning, regimes, reports, signals
from .plans import frames
from .plans.run import Run
from .plans.settings import learned_of, plan_of
from .sources import bars, search, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="barline", description=__doc__)
    p.add_argument("--config", help="YAML file of settings")
    p.add_argument("--preset", help="settings of a market")
    p.add_argument("--tables", help="folder of Parquet tables")
    p.add_argument("--symbols", nargs="+", help="these symbols alone")
    p.add_argument("--period", help="5y, ytd or max")
    p.add_argument("--start")
    p.add_argument("--end")
    p.add_argument("--interval", choices=bars.INTERVALS)
    p.add_argument("--tz", help="time zone of the calendar")
    p.add_argument("--no-factor", action="store_true", help="leave the factor reports out")
    p.add_argument("--factors", nargs=2, metavar=("THREE", "MOMENTUM"), help="library files of daily factors, before those of the tables")
    p.add_argument("--ml", action="store_true", help="add the walk-forward reports")
    p.add_argument("--out", help="folder for the results; without it the metrics are shown")
    p.add_argument("--format", choices=sinks.FORMATS, default="csv")
    p.add_argument("--consolidate", metavar="FOLDER", help="rebuild the tables over all symbols there from what --out holds")
    p.add_argument("--export-config", metavar="FILE", help="write the settings in effect")
    p.add_argument("--search", metavar="TEXT")
    p.add_argument("--search-field", default="all")
    p.add_argument("--add", nargs="+", metavar="SYMBOL", help="add symbols to the watchlist of --config")
    p.add_argument("--list-sectors", action="store_true")
    p.add_argument("--list-presets", action="store_true")
    p.add_argument("--dry-run", action="store_true", help="say what would be done")
    return p


def settings(args: argparse.Namespace) -> dict:
    made = config.load(args.config, args.preset, interval=args.interval, timezone=args.tz, symbols=args.symbols)
    if args.period or args.start or args.end or made.get("start") or made.get("end"):
        made["start"], made["end"] = config.resolve_dates(args.period, args.start, args.end, made.get("start") or "1970-01-01", made.get("end"))
    made = config.merged(made, {"factor": {"enabled": not args.no_factor and made.get("factor", {}).get("enabled", True)}})
    return config.merged(made, {"ml_signal": {"enabled": args.ml or made.get("ml_signal", {}).get("enabled", False)}})


def outputs(run: Run, made: dict) -> dict:
    """name -> what makes the output, for the stages that are switched on."""
    numeric = lambda df: [f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType)]
    out = {
        "processed": lambda: run.judged,
        "data_report": lambda: sinks.quality_report(run.cleaned, ["close", "volume", "returns"]),
        "feature_report": lambda: sinks.quality_report(run.featured, numeric(run.featured)),
        "feature_correlations": lambda: features.correlations(run.featured, numeric(run.featured)),
        "signal_report": lambda: signals.report(run.signalled),
        "backtest": lambda: reports.comparison(run.performance),
        "gating_comparison": lambda: reports.gating_comparison(run.performance),
        "watchlist_comparison": lambda: reports.watchlist(run.performance),
        "regime_frequency": lambda: regimes.frequency(run.judged),
        "regime_report": lambda: sinks.regime_report(run.market_performance),
        "quarantine": lambda: run.quarantined,
    }
    if made["factor"]["enabled"]:
        out["factor_report"] = lambda: sinks.factor_report(run.regressions, factors.attribution_table(run.regressions))
        out["rolling_alpha"] = lambda: factors.rolling_capm(run.excess.filter("signal = 'signal_ensemble'"))
    if made["ml_signal"]["enabled"]:
        out |= {
            "ml_folds": lambda: learning.fold_report(run.predictions, ("symbol",)), "ml_importance": lambda: learning.importance_report(learning.importances(run.models)),
            "ml_thresholds": lambda: learning.threshold_sweep(run.predictions, by=("symbol",))}
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.list_presets:
        for name, what in config.list_presets().items():
            print(f"{name}: {what}")
        return 0
    if args.add:
        if not args.config:
            parser().error("--add needs --config")
        with open(args.config, encoding="utf-8", newline="") as f:
            text = sinks.add_to_watchlist(f.read(), args.add)
        if not args.dry_run:
            with open(args.config, "w", encoding="utf-8", newline="") as f:
                f.write(text)
        return 0
    made = settings(args)
    if args.export_config:
        config.export(made, args.export_config)
        return 0
    if not args.tables:
        parser().error("--tables is needed")
    if args.dry_run:
        print(f"{args.tables}: {made['start']} to {made['end']}, symbols {made['symbols'] or 'all'}, factors {made['factor']['enabled']}, ml {made['ml_signal']['enabled']}")
        return 0
    spark = SparkSession.builder.appName("barline").getOrCreate()
    if args.search:
        search.search(frames.directory(spark, args.tables), args.search, args.search_field).show(truncate=False)
    elif args.list_sectors:
        search.sector_counts(frames.directory(spark, args.tables)).orderBy("sector").show(100, truncate=False)
    else:
        plan = plan_of(made)
        run = Run(spark, args.tables, plan, f"{args.out}/_stages" if args.out and args.format != "excel" else None, learned_of(made), library=args.factors and tuple(args.factors))
        if args.out and args.format == "excel":
            flat = {name: make() for name, make in outputs(run, made).items() if name not in ("processed", "data_report", "feature_report", "regime_report", "factor_report")}
            sinks.write_sheets(flat, args.out)
        elif args.out:
            print(*sinks.write_run(outputs(run, made), args.out, args.format, plan.interval, plan.symbols), sep="\n")
            if args.consolidate:
                print(*sinks.consolidate(spark, args.out, args.consolidate, plan.interval, args.format), sep="\n")
        else:
            run.performance.orderBy("symbol", "signal").show(200, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
