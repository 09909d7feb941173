"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def ship(module: str) -> None:
    """Sends what tasks use of a module along with them, so that executors need
    not have this package on their path."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where the
    optimizer would otherwise inline it into a lambda and evaluate it per
    element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def n_words(column: Column) -> Column:
    return F.regexp_count(column, F.lit(WORD)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.
    Only a session on one machine that sets none (tests) gets a local one."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_dir = tempfile.mkdtemp(prefix="barline-")
        spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir.rstrip("/")


#: Whether a query's shuffle files go when it ends. By default they stay until the driver
#: happens to collect its garbage, which the size of the data does not hasten.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of queries that run herein go when these end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def saved(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes ``df`` as a Parquet table in the shared folder
    and returns the reader of it, so a lost executor costs no recomputation. What was
    shuffled for it is needed no more, and removed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with tidied(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of the largest bitmap of ids: 16 MB, which is what is broadcast at most.
MOST_BITS = 1 << 27


def _bitmap(rows: DataFrame, column: str, ids: DataFrame) -> tuple[DataFrame, Column, DataFrame] | None:
    """rows with the place ``_bucket`` of their column, whether its bit is set in ``_bits``,
    and the bitmap of ids (_bucket, _bits), 512 words a row; none where it would be too full."""
    n = ids.count()
    bits = min(MOST_BITS, max(1 << 15, 1 << (16 * n).bit_length()))
    if n > bits // 2:
        return None
    at = F.pmod(F.xxhash64(column), F.lit(bits)).cast("long")
    word, bit = F.shiftright(at, 6), F.expr("shiftleft(1L, cast(_at % 64 as int))")
    some = ids.select(at.alias("_at")).select(F.shiftright("_at", 6).alias("_word"), bit.alias("_bit"))
    none = ids.sparkSession.range(bits // 64).select(F.col("id").alias("_word"), F.lit(0).cast("long").alias("_bit"))
    words = some.unionByName(none).groupBy("_word").agg(F.bit_or("_bit").alias("_bit"))
    held = words.groupBy(F.shiftright("_word", 9).alias("_bucket")).agg(F.sort_array(F.collect_list(F.struct("_word", "_bit"))).alias("_all"))
    held = held.select("_bucket", F.transform("_all", lambda w: w["_bit"]).alias("_bits"))
    is_set = F.getbit(F.get("_bits", (word % 512).cast("int")), (at % 64).cast("int")) == 1
    return rows.withColumn("_bucket", F.shiftright(word, 9)), is_set, held


def may_hold(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose column is probably among ``ids``, a written table of distinct ids in
    a column of that name: all that are, few others. A bitmap of 16 bits an id is
    broadcast in rows of 4 KB; where the ids are too many for 2 bits each, all rows
    pass. Whoever needs these rows alone joins them with the ids next, by an inner join:
    the optimizer moves a semi-join below the bitmap."""
    made = _bitmap(rows, column, ids)
    if made is None:
        return rows
    placed, is_set, held = made
    return placed.join(F.broadcast(held), "_bucket").filter(is_set).drop("_bucket", "_bits")  # at most MOST_BITS


def probably_among(rows: DataFrame, column: str, ids: DataFrame, flag: str) -> DataFrame:
    """rows with a boolean column ``flag``: true where the column is among ``ids``, a
    written table of distinct ids in a column of that name, false for nearly all others.
    As in ``may_hold``, a bitmap of at most ``MOST_BITS`` is broadcast; where it would
    hold more ids than half its bits, the flag is true for all rows."""
    made = _bitmap(rows, column, ids)
    if made is None:
        return rows.withColumn(flag, F.lit(True))
    placed, is_set, held = made
    return placed.join(F.broadcast(held), "_bucket", "left").withColumn(flag, F.coalesce(is_set, F.lit(False))).drop("_bucket", "_bits")  # at most MOST_BITS
