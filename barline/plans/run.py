"""A run over all symbols: every stage made once, those that fail set apart."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtest, clean, factors, learning, quarantine, regimes
from ..sources import bars
from . import frames
from .settings import Learned, Plan


class Run:
    """The stages of one run. With a folder for them (a shared one, on a cluster) the
    stages that several outputs read are written once and read back; without one they stay
    lazy. ``learned`` switches the learned signal on, which is then traded as the others are.
    ``library`` names the files of three factors and of momentum, which go before the
    factors that the tables give."""

    def __init__(self, spark: SparkSession, tables: str, plan: Plan = frames.EVERY, stages: str | None = None, learned: Learned | None = None, library: tuple[str, str] | None = None):
        self.spark, self.tables, self.plan, self.stages, self.learned, self.library = spark, tables, plan, stages, learned, library

    def _kept(self, name: str, df: DataFrame) -> DataFrame:
        if self.stages is None:
            return df
        path = f"{self.stages}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bars(self) -> DataFrame:
        return self.plan.bars(bars.bars_walk(self.spark, self.tables))

    @cached_property
    def rejected(self) -> DataFrame:
        return self._kept("rejected", quarantine.examined(self.bars(), self.plan.symbols))

    @cached_property
    def cleaned(self) -> DataFrame:
        return self._kept("cleaned", clean.clean(quarantine.sound(self.bars(), self.rejected), step=self.plan.step))

    @cached_property
    def _stages(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        featured = frames.features_of(quarantine.watched(self.cleaned), self.plan)
        signalled = frames.signals_of(featured, self.plan)
        return featured, signalled, regimes.adaptive(regimes.classify(frames.gates_of(signalled, self.plan)))

    @cached_property
    def detected(self) -> DataFrame:
        return self._kept("detected", self._stages[2])

    def _columns_of(self, stage: int) -> DataFrame:
        """What a stage had, of the bars as they are after all of them."""
        good = quarantine.split(self.detected)[0]
        return good.select([c for c in self._stages[stage].columns if c in good.columns])

    @property
    def featured(self) -> DataFrame:
        return self._columns_of(0)

    @property
    def signalled(self) -> DataFrame:
        return self._columns_of(1)

    @cached_property
    def quarantined(self) -> DataFrame:
        """(symbol, reason) of the symbols that the outputs lack, and of those whose learned
        signal failed: these are in the outputs, with that signal at 0."""
        out = self.rejected.unionByName(quarantine.split(self.detected)[1])
        if self.learned is None:
            return out
        failed = self.models.filter("error is not null").groupBy("symbol").agg(F.min_by("error", "fold_id").alias("reason"))
        return out.unionByName(failed.select("symbol", F.concat(F.lit("learned signal: "), "reason").alias("reason")))

    @cached_property
    def models(self) -> DataFrame:
        """The walk-forward models of every symbol and fold, fitted once."""
        told = self.learned or Learned()
        return self._kept("models", learning.models(self.featured, told.target, told.folds, told.model, watched=True))

    @property
    def predictions(self) -> DataFrame:
        return learning.predictions(self.models)

    @cached_property
    def judged(self) -> DataFrame:
        good = quarantine.split(self.detected)[0]
        return good if self.learned is None else learning.with_signal(good, self.predictions, self.learned.deadband)

    @property
    def traded(self) -> list[str]:
        return frames.TRADED if self.learned is None else [*frames.TRADED, "signal_ml"]

    @cached_property
    def curve(self) -> DataFrame:
        return self._kept("curve", backtest.curve(backtest.unpivoted(self.judged, self.traded), self.plan.setup))

    @cached_property
    def performance(self) -> DataFrame:
        return self._kept("performance", frames.performance_of(self.curve))

    @cached_property
    def market(self) -> DataFrame:
        proxies = frames.market(self.spark, self.tables)
        if self.library is None:
            return proxies
        read = lambda: bars.join_factors(*[bars.read_library(self.spark, path) for path in self.library])
        kept = read() if self.stages is None else bars.cached_factors(self.spark, f"{self.stages}/factors", read)
        return bars.load_factors(kept, proxies, self.plan.start or "0001-01-01", self.plan.end or "9999-12-31", self.plan.rf_annual)

    @cached_property
    def excess(self) -> DataFrame:
        return factors.excess_returns(self.curve, self.market, self.plan.rf_annual)

    @cached_property
    def regressions(self) -> DataFrame:
        return self._kept("regressions", factors.regressions(self.excess))

    @cached_property
    def market_performance(self) -> DataFrame:
        return self._kept("market_performance", factors.performance_by_regime(self.curve, factors.market_regimes(self.market)))
