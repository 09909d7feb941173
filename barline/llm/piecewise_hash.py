"""Document fingerprints by context-triggered piecewise hashing.

A hash of the last seven bytes rolls over the UTF-8 of a text; where its lowest k bits
are zero a chunk ends, so that on average a chunk has 2^k bytes and an edit moves no
boundary but those beside it. Each chunk becomes one of 64 characters by a hash of its
bytes. The block size 2^k is the least that gives at most 64 chunks; a fingerprint is
``block size:signature:signature at twice the block size``. Two fingerprints are
compared where they have a block size in common: their signatures' edit distance
(insertions and deletions) against their lengths gives a likeness from 0 to 1, the
greater one of the common sizes; signatures without a common run of four characters (of
a third of the shorter, if that is less) are unlike, as chance alone makes some distance
small. Equal fingerprints have likeness 1.

The edited text of a document borrows from the next one by doc_id. Documents are cut into
ranges of doc_id at quantiles; the first document of every range is also sent to the range
before it (that of the first range to the last one), so each range is read as a sorted
stream of which a task holds one batch, and no order of the whole table is needed. Texts
move through one shuffle.

Defined results: a null text is an empty one, whose signatures are empty; documents
without a doc_id come before the others; of rows with one doc_id, that with the lesser text
comes first; a table of one row is its own next one; other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, ship, table, text_of

ship(__name__)

WINDOW, CHUNKS, RUN = 7, 64, 4
LETTERS = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"
#: Bytes that are hashed at a time.
SLAB = 1 << 20
#: Multipliers of the rolling hash and of the chunk hash (odd, so that it has an inverse).
ROLL, STEP = 0x9E3779B1, 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)
WORD64 = (1 << 64) - 1
POWERS: list[np.ndarray] = []


def powers() -> np.ndarray:
    """Powers of the multiplier, made where they are needed first."""
    if not POWERS:
        POWERS.append(np.cumprod(np.r_[np.uint64(1), np.full(SLAB - 1, STEP, np.uint64)], dtype=np.uint64))
    return POWERS[0]


def levels(raw: np.ndarray) -> np.ndarray:
    """For every byte, how many low bits of the rolling hash that ends there are zero."""
    h = np.zeros(len(raw), np.uint32)
    x = raw.astype(np.uint32) + np.uint32(1)
    for k in range(min(WINDOW, len(raw))):
        h[k:] += np.uint32(pow(ROLL, k + 1, 1 << 32)) * x[: len(raw) - k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return np.bitwise_count((h & (~h + np.uint32(1))) - np.uint32(1))


def slabs(data: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, bytes, levels) of the slabs of a text, one after another."""
    for at in range(0, len(data), SLAB):
        known = min(at, WINDOW - 1)
        raw = np.frombuffer(data, np.uint8, min(SLAB, len(data) - at) + known, at - known)
        yield at, raw[known:], levels(raw)[known:]


def pieces(data: bytes) -> tuple[int, list[tuple[int, int, int]]]:
    """k and (level, end, sum up to the end) of the chunks of 2^k bytes on average."""
    found = list(slabs(data)) if len(data) <= SLAB else None
    counts = sum((np.bincount(lv, minlength=33) for _, _, lv in found or slabs(data)), np.zeros(33, np.int64))
    at_least = counts[::-1].cumsum()[::-1]
    k = next((k for k in range(33) if at_least[k] < CHUNKS), 33)
    ends, total = [], 0
    for at, raw, lv in found or slabs(data):
        sums = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers()[: len(raw)], dtype=np.uint64)
        scale, places = pow(STEP, at, 1 << 64), np.flatnonzero(lv >= k)
        ends += [(int(lv[p]), at + int(p) + 1, total + scale * int(sums[p]) & WORD64) for p in places]
        total = total + scale * int(sums[-1]) & WORD64
    if data and (not ends or ends[-1][1] < len(data)):
        ends.append((33, len(data), total))  # what is left is a chunk at any level
    return k, ends


def signature(ends: list[tuple[int, int, int]]) -> str:
    out, start, before = [], 0, 0
    for _, end, total in ends:
        value = (total - before) * pow(BACK, start, 1 << 64) & WORD64
        value = (value ^ value >> 29) * STEP & WORD64
        out.append(LETTERS[value >> 58])
        start, before = end, total
    return "".join(out)


def fingerprint(text: str) -> str:
    k, ends = pieces(text.encode())
    wider = [e for e in ends if e[0] > k]
    if ends and (not wider or wider[-1][1] < ends[-1][1]):
        wider.append(ends[-1])
    return f"{1 << k}:{signature(ends)}:{signature(wider)}"


def distance(x: str, y: str) -> int:
    """Insertions and deletions that make y of x: lengths less twice the longest common
    subsequence, which is found for all places of x at once in the bits of a number."""
    masks: dict[str, int] = {}
    for i, c in enumerate(x):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for c in y:
        met = row & masks.get(c, 0)
        row = (row + met | row - met) & full
    return len(x) + len(y) - 2 * (len(x) - row.bit_count())


def alike(x: str, y: str) -> float:
    """Likeness of two signatures of one block size."""
    if x == y:
        return 1.0
    run = max(1, min(RUN, min(len(x), len(y)) // 3))
    if not {x[i : i + run] for i in range(len(x) - run + 1)} & {y[i : i + run] for i in range(len(y) - run + 1)}:
        return 0.0
    return 1 - distance(x, y) / (len(x) + len(y))


def likeness(x: str, y: str) -> float:
    if x == y:
        return 1.0
    a, b = x.split(":"), y.split(":")
    one = {int(a[0]): a[1], 2 * int(a[0]): a[2]}
    two = {int(b[0]): b[1], 2 * int(b[0]): b[2]}
    return max((alike(one[s], two[s]) for s in one.keys() & two.keys() if one[s] and two[s]), default=0.0)


def edited(text: str, after: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + after[:n]


def _range(column: Column, cuts: list[int], first: int = 0) -> Column:
    """How many of the cuts are not above the column, by halving."""
    if not cuts:
        return F.lit(first)
    mid = len(cuts) // 2
    return F.when(column >= cuts[mid], _range(column, cuts[mid + 1 :], first + mid + 1)).otherwise(_range(column, cuts[:mid], first))


def ranged(docs: DataFrame, ranges: int) -> DataFrame:
    """(range, head, doc_id, text): docs (doc_id, text) by ranges of doc_id, with the
    first document of the next range at the end of each."""
    at = [k / ranges for k in range(1, ranges)]
    cuts = docs.agg(F.percentile_approx("doc_id", at, 10 * ranges).alias("c")).first()["c"] or [] if at else []
    rows = docs.withColumn("range", F.coalesce(_range(F.col("doc_id"), sorted(set(cuts))), F.lit(0)))
    least = rows.groupBy("range").agg(F.count_if(F.col("doc_id").isNull()).alias("n"), F.min("doc_id").alias("least"))
    firsts = sorted((r["range"], None if r["n"] else r["least"]) for r in least.collect())  # a row a range
    if not firsts:
        return rows.select("range", F.lit(False).alias("head"), "doc_id", "text")
    known = docs.sparkSession.createDataFrame([(i, *f) for f, (i, _) in zip(firsts, [firsts[-1], *firsts[:-1]], strict=True)], "before int, range int, first long")
    met = rows.join(F.broadcast(known), "range").filter(F.col("doc_id").eqNullSafe(F.col("first")))
    heads = saved(met.groupBy("before").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text")))
    return rows.select("range", F.lit(False).alias("head"), "doc_id", "text").unionByName(heads.select(F.col("before").alias("range"), F.lit(True).alias("head"), "doc_id", "text"))


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id string, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) per row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    n = max(64, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if ranges is None else ranges
    rows = ranged(docs, n).repartition(n, "range").sortWithinPartitions("range", "head", F.col("doc_id").asc_nulls_first(), "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # (doc_id, text, fingerprint) of the row before, if its next row is to come
        for batch in batches:
            out = []
            for head, doc, text in zip(batch["head"], batch["doc_id"], batch["text"], strict=True):
                print_ = fingerprint(text)
                if last is not None:
                    changed = edited(last[1], text)
                    own = fingerprint(changed)
                    out.append((last[0], len(last[1]), hashlib.sha256(changed.encode()).hexdigest(), last[2], own, likeness(last[2], own), likeness(last[2], print_)))
                last = None if head else (doc, text, print_)
            yield pd.DataFrame(out, columns=names)

    shown = rows.select("head", F.col("doc_id").cast("string").alias("doc_id"), "text")
    return shown.mapInPandas(run, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op11_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents")).withColumn("doc_id", F.col("doc_id").cast("long"))
