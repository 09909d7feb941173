"""A data source of price charts kept as JSON documents, for ``spark.read.format("charts")``.

A document is what price services answer for a symbol: time stamps, prices as
parallel lists, and adjusted closes. The connector is offline: it reads documents that
are in a folder, one partition each; documents without prices give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


class Document(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ChartReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.start, self.end = options.get("start"), options.get("end")

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        return [Document(str(p)) for p in sorted(Path(self.folder).glob("*.json"))]

    def read(self, partition: Document) -> Iterator[tuple]:
        from datetime import UTC, datetime

        try:
            with open(partition.path, encoding="utf-8") as f:
                told = json.load(f)["chart"]["result"][0]
            times, quote = told["timestamp"], told["indicators"]["quote"][0]
            adjusted = told["indicators"].get("adjclose", [{}])[0].get("adjclose") or quote["close"]
        except (KeyError, IndexError, TypeError, ValueError):
            return
        for k, t in enumerate(times):
            close = quote["close"][k]
            if close is None:
                continue
            day = datetime.fromtimestamp(t, UTC)
            if (self.start and day.date().isoformat() < self.start) or (self.end and day.date().isoformat() >= self.end):
                continue
            part = adjusted[k] / close if close and adjusted[k] is not None else 1.0  # splits and dividends move all prices
            prices = [None if quote[c][k] is None else float(quote[c][k]) * part for c in ("open", "high", "low")]
            yield (told["meta"]["symbol"], day, *prices, float(close) * part, float(quote["volume"][k] or 0))


class ChartSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "charts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return ChartReader(self.options)


def read_charts(spark: SparkSession, folder: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """(symbol, ts, open, high, low, close, volume) of the documents in a folder, with
    adjusted prices, in [start, end)."""
    spark.dataSource.register(ChartSource)
    given = {k: v for k, v in (("start", start), ("end", end)) if v}
    return spark.read.format("charts").options(**given).load(folder)
