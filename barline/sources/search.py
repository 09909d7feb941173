"""A ticker directory: (symbol, name, sector, industry)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("symbol", "name", "sector", "industry")


def from_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True).select(*FIELDS)


def search(directory: DataFrame, query: str, field: str = "all", most: int | None = 20) -> DataFrame:
    """Rows whose field (or any field) contains the query, in any case; the first
    ``most`` by symbol."""
    if field != "all" and field not in FIELDS:
        raise ValueError(f"unknown field {field!r}")
    names = FIELDS if field == "all" else (field,)
    text = F.concat_ws("\n", *[F.lower(c) for c in names])
    found = directory.filter(text.contains(query.strip().lower()))
    return found if most is None else found.orderBy("symbol").limit(most)


def by_sector(directory: DataFrame, sector: str, most: int | None = 20) -> DataFrame:
    return search(directory, sector, "sector", most)


def distinct_values(directory: DataFrame, field: str) -> DataFrame:
    return directory.select(field).filter(F.col(field).isNotNull()).distinct().orderBy(field)


def sector_counts(directory: DataFrame, most: int = 20) -> DataFrame:
    """(sector, n): rows whose sector contains the sector's name, at most
    ``most``. Sectors are compared with each other, not with every row."""
    sizes = directory.groupBy(F.col("sector")).agg(F.count("*").alias("rows")).filter("sector is not null")
    other = F.broadcast(sizes.select(F.col("sector").alias("_name")))  # the distinct sectors of a directory
    met = sizes.join(other, F.lower("sector").contains(F.lower("_name")))
    return met.groupBy(F.col("_name").alias("sector")).agg(F.least(F.sum("rows"), F.lit(most)).alias("n"))


def validate(directory: DataFrame, requested: DataFrame) -> DataFrame:
    """(symbol, valid) of the requested symbols."""
    known = directory.select("symbol", F.lit(True).alias("_known")).distinct()
    return requested.join(known, "symbol", "left").select("symbol", F.coalesce("_known", F.lit(False)).alias("valid"))
