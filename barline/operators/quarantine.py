"""Symbols that cannot be run are set apart, with the reason, and the others go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .passes import ERROR

PRICES = ("open", "high", "low", "close")


def _faults() -> dict[str, Column]:
    """Reason -> whether a symbol's bars have it, in the order in which one is told. Each
    would end the job of all symbols in a stage without a pass of its own per symbol."""
    some = lambda c: F.count_if(c) > 0
    anyone = lambda test: F.exists(F.array(*[F.col(c).cast("double") for c in PRICES]), test)
    return {
        "no close": F.count("close") == 0,
        "a price is not finite": some(anyone(lambda x: F.isnan(x) | (F.abs(x) == float("inf")))),
        "a price is 0 or less": some(anyone(lambda x: x <= 0)),
    }


def examined(bars: DataFrame, requested: tuple[str, ...] = ()) -> DataFrame:
    """(symbol, reason): the symbols whose bars have a fault, and those requested that have
    no bars. One aggregation with partial sums; a symbol of any length is no group in memory."""
    told = F.coalesce(*[F.when(c, F.lit(reason)) for reason, c in _faults().items()])
    bad = bars.groupBy("symbol").agg(told.alias("reason"))
    if requested:
        spark = bars.sparkSession
        asked = spark.createDataFrame([(s,) for s in dict.fromkeys(requested)], "symbol string")
        absent = asked.join(bars.select("symbol").distinct(), "symbol", "left_anti").select("symbol", F.lit("no bars in range").alias("reason"))
        bad = bad.unionByName(absent)
    return bad.filter("reason is not null")


def sound(bars: DataFrame, rejected: DataFrame) -> DataFrame:
    return bars.join(rejected, "symbol", "left_anti")


def watched(df: DataFrame) -> DataFrame:
    """From here on, a symbol that fails in a pass carries its failure in ``error``."""
    return df.withColumn(ERROR, F.lit(None).cast("string"))


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bars of the symbols without a failure, (symbol, reason) of the others)."""
    failed = df.filter(F.col(ERROR).isNotNull()).groupBy("symbol").agg(F.min(ERROR).alias("reason"))
    return df.filter(F.col(ERROR).isNull()).drop(ERROR), failed
