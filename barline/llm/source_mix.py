"""Mixing sources to target weights: weighted fair queueing.

Documents of a source are shuffled by a hash of their id; a document's virtual
finish time is the number of its source's tokens up to and with it, divided by
the source's target. Later epochs continue the same queue. Sorted by finish time
over all sources, the mix is the longest start of that order within the total
budget.

No step sorts a source in one task: the queue of a source is cut into
``BLOCKS`` ranges of the shuffle hash, block sums give each range its start, and
only documents of one range meet in a task. The global order is cut into as many
ranges of finish time, and only the range that holds the end of the budget is
sorted, to find the last (time, hash, id, epoch) that fits.

Defined results: null texts have size 0, documents of size 0 are never taken;
a null source is a source of its own, after all others; equal rows share their
place in the queue, one after the other; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, saved, table, text_of

#: Of the shuffle hash and of finish times. A range holds 1/4096 of a source.
BLOCKS = 4096
#: Sources that a mix may have; their list is held by the driver.
MOST_SOURCES = 100_000
WEIGHTS = (3.0, 1.0, 2.0)


def fair_targets(sizes: dict, weights: dict, budget: float, most: float) -> dict:
    """Splits ``budget`` by weight among sources of the given sizes; none gets
    over ``most`` times its size, and what it would is shared by the others."""
    targets, free, left = {}, [k for k in sizes if sizes[k] > 0], budget
    while free:
        total = sum(weights[k] for k in free)
        over = [k for k in free if left * weights[k] / total > most * sizes[k]]
        if not over:
            return targets | {k: left * weights[k] / total for k in free} | {k: 0.0 for k in sizes if sizes[k] <= 0}
        for k in over:
            targets[k] = most * sizes[k]
        left -= sum(targets[k] for k in over)
        free = [k for k in free if k not in over]
    return {k: 0.0 for k in sizes} | targets


def _targets(blocks: DataFrame, share: float, most: float, weights: tuple[float, ...]) -> DataFrame:
    """(source, source_size, target): a row per source. The list of sources and
    their sizes is the mix's own specification, so the driver holds it."""
    spark = blocks.sparkSession
    # sources are named in the mix's specification, so there are few: more than this many are an error
    if blocks.select("source").distinct().limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources: weights are given by source, group them first")
    rows = blocks.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = {r["source"]: r["size"] for r in rows}
    by = {r["source"]: weights[i % len(weights)] for i, r in enumerate(rows)}
    targets = fair_targets(sizes, by, share * sum(sizes.values()), most)
    return spark.createDataFrame([(s, int(sizes[s]), float(targets[s])) for s in sizes], "source string, source_size long, target double")


def _finish(epoch: int) -> Column:
    """Virtual finish time: below it, the range it falls into."""
    return F.try_divide((F.col("reach") + epoch * F.col("source_size")).cast("double"), F.col("target"))


def _band(time: Column) -> Column:
    return F.floor(time * (BLOCKS / 2)).cast("long")


def mix(docs: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) per row of docs
    (doc_id, source, size, mark), with its mark: rows of one id differ by it."""
    place = F.xxhash64(F.lit(41), "doc_id", "mark")
    sized = docs.select("doc_id", "source", "size", "mark", place.alias("place"), F.shiftrightunsigned(place, 52).alias("block"))
    blocks = saved(sized.groupBy("source", "block").agg(F.sum("size").alias("size")))
    targets = _targets(blocks, share, most, weights)
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("source", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("source", "block").orderBy("place", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, 0)
    queued = sized.withColumn("within", F.sum("size").over(within))
    same = queued["source"].eqNullSafe(starts["source"]) & (queued["block"] == starts["block"])
    placed = queued.join(starts, same).select(queued["doc_id"], queued["source"], "size", "mark", "place", (F.col("start") + F.col("within")).alias("reach"))
    placed = saved(placed.join(targets, placed["source"].eqNullSafe(targets["source"])).select("doc_id", placed["source"], "size", "mark", "place", "reach", "source_size", "target"))
    end = _end_of_budget(placed, most)
    taken = F.lit(0).cast("long")
    for epoch in range(most):
        taken = taken + F.when((F.col("target") > 0) & (F.struct(_finish(epoch).alias("time"), F.col("place"), F.col("doc_id"), F.col("reach"), F.lit(epoch).alias("epoch")) <= end), F.col("size")).otherwise(0)
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "mark")


def _end_of_budget(placed: DataFrame, most: int) -> Column:
    """The last (time, place, doc_id, reach, epoch) of the global order whose
    running total is within the budget."""
    times = F.array(*[F.struct(_finish(e).alias("time"), F.lit(e).alias("epoch")) for e in range(most)])
    queue = placed.filter("target > 0 and size > 0").select("doc_id", "place", "reach", "size", F.explode(times).alias("at")).select("doc_id", "place", "reach", "size", "at.time", "at.epoch", _band(F.col("at.time")).alias("band"))
    total = placed.select("source", "target").distinct().agg(F.sum("target").alias("b")).first()["b"] or 0.0
    bands = sorted(queue.filter(f"band <= {BLOCKS}").groupBy("band").agg(F.sum("size").alias("size")).collect())  # at most BLOCKS + 1 rows
    done, last = 0, None
    for band in bands:
        last = band["band"]
        if done + band["size"] > total:
            break
        done += band["size"]
    none = F.struct(F.lit(-1.0).alias("time"), F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("reach"), F.lit(0).alias("epoch"))
    if last is None:
        return none
    order = Window.partitionBy("band").orderBy("time", "place", "doc_id", "reach", "epoch").rowsBetween(Window.unboundedPreceding, 0)
    fits = queue.filter(F.col("band") == last).withColumn("run", F.sum("size").over(order)).filter(F.col("run") + done <= total)
    row = fits.agg(F.max(F.struct("time", "place", "doc_id", "reach", "epoch")).alias("end")).first()["end"]
    if row is None:  # nothing of that range fits: all ranges before it do
        return F.struct(F.lit(last / (BLOCKS / 2)).alias("time"), F.lit(-(2**63)).cast("long").alias("place"), F.lit(-(2**63)).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("reach"), F.lit(-1).alias("epoch"))
    return F.struct(F.lit(row["time"]).alias("time"), F.lit(row["place"]).cast("long").alias("place"), F.lit(row["doc_id"]).cast("long").alias("doc_id"), F.lit(row["reach"]).cast("long").alias("reach"), F.lit(row["epoch"]).alias("epoch"))


def keys_of() -> list[Column]:
    """(doc_id, source, size, mark) of documents: what the mix knows of a row."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(text_of()).alias("size"), F.xxhash64(text_of()).alias("mark")]


def sizes_of(docs: DataFrame) -> DataFrame:
    return saved(docs.select(*keys_of()))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sizes_of(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")
