"""Best-fit packing with certified bin counts.

Documents become token ids (then one separator id); documents longer than a bin
are cut so that all pieces but the first are full bins. Full pieces fill bins of
their own. The rest is packed by partitions: each packs its pieces by best-fit
decreasing, and a lower bound from dual-feasible functions certifies its bin
count. Partitions whose count exceeds the bound hand their bins that are not full to
a round of exchange: the pieces of those bins are dealt anew to as many partitions as
they need and packed again, until the bounds are met, a round saves no bin or the pool
fits in one partition. Only lengths travel; at no point does one task hold more than
``GROUP`` pieces, but for the chance of the deal. Each piece carries the certificate of
the partition that packed it; ``certificate`` compares all sequences with the bound
for all pieces.

Bins are filled to 2048 tokens at most. Token ids come from byte-level BPE. A text is
handed to the tokenizer whole: looking its words up in a cache took longer, as new words
keep coming and each costs a call.

Defined results: a null text is an empty document (one separator); repeated rows
are packed each for itself; equal lengths are packed in the order of their rows; other columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, ship, table, text_of

ship(__name__)

BIN = 2048
GROUP = 20_000
#: Tokens that a bin may lack and count as full.
SLACK = 8
#: Parameters of the dual-feasible step functions, as parts of a bin.
STEPS = tuple(range(1, 50))


class Ids:
    """ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = "<|endoftext|>"
        self.special = special
        self.codec = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={special: len(ranks)})

    def __call__(self, text: str) -> bytes:
        return self.codec.encode_to_numpy(text, allowed_special={self.special}, disallowed_special=()).astype("<u4", copy=False).tobytes()


def cut(length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``length`` ids."""
    head = length % BIN if length > BIN else length
    starts = [0] if head else []
    starts += range(head, length, BIN) if length > BIN else []
    ends = [*starts[1:], length]
    return [(a, b - a) for a, b in zip(starts, ends, strict=True)]


def pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of docs (doc_id, text)."""

    def tokenised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = Ids(vocabulary)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = ids_of(text) + b"\0\0\0\0"
                rows += [(doc, k, a, n, zlib.crc32(ids[4 * a : 4 * (a + n)])) for k, (a, n) in enumerate(cut(len(ids) // 4))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_of().alias("text"))
    return named.mapInPandas(tokenised, "doc_id string, piece int, start long, length long, ids_crc32 long").withColumn("doc_id", F.col("doc_id").cast("long"))


def lower_bound(lengths: np.ndarray, room: int = BIN) -> int:
    """Bins that these lengths need at least (see ``bound_of_counts``)."""
    return bound_of_counts(np.bincount(lengths, minlength=room + 1), room) if len(lengths) else 0


def bound_of_counts(count: np.ndarray, room: int = BIN) -> int:
    """Bins that pieces need at least, by the number of each length: the greatest of
    the sums of dual-feasible functions. ``u(e)`` drops what is shorter than e and
    counts what is longer than a bin less e as a whole bin; ``w(k)`` rounds (k + 1) x
    down."""
    x = np.arange(room + 1)
    best = -(-int((count * x).sum()) // room)
    for e in range(1, room // 2 + 1, 16):
        value = np.where(x > room - e, room, np.where(x < e, 0, x))
        best = max(best, -(-int((count * value).sum()) // room))
    for k in STEPS:
        whole = (k + 1) * x % room == 0
        value = np.where(whole, x * k, (k + 1) * x // room * room)
        best = max(best, -(-int((count * value).sum()) // (room * k)))
    return best


def best_fit(lengths: np.ndarray, room: int = BIN) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length, by best-fit decreasing."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_at: list[list[int]] = [[] for _ in range(room + 1)]  # bins by room left
    rooms: list[int] = []  # sorted, the rooms that open_at has bins for
    used = 0
    for i in order.tolist():
        n = int(lengths[i])
        at = bisect_left(rooms, n)
        if at < len(rooms):
            left = rooms[at]
            b = open_at[left].pop()
            if not open_at[left]:
                rooms.pop(at)
        else:
            b, left, used = used, room, used + 1
        bins[i], offsets[i] = b, room - left
        left -= n
        if left:
            if not open_at[left]:
                insort(rooms, left)
            open_at[left].append(b)
    return bins, offsets


PLACED = "row long, length long, part long, bin long, offset long, part_bins long, part_bound long"


def _packed(part: DataFrame) -> DataFrame:
    """Packs each part (row, length, part); part_bins and part_bound are its bins and
    their lower bound."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row"], ascending=[False, True])
        lengths = group["length"].to_numpy()
        bins, offsets = best_fit(lengths)
        return group.assign(bin=bins, offset=offsets, part_bins=int(bins.max()) + 1, part_bound=lower_bound(lengths))[[c.split()[0] for c in PLACED.split(", ")]]

    return part.groupBy("part").applyInPandas(pack, PLACED)


def pack(sized: DataFrame) -> DataFrame:
    """(row, sequence_id, offset, part_bins, part_bound) of sized (row, length): lengths
    of 1 to 2048. The last two certify the part that packed a row: its bins, and how many
    they are at least; a full row is a part of its own."""
    one = F.lit(1).cast("long")
    full = sized.filter(F.col("length") == BIN).select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), one.alias("part_bins"), one.alias("part_bound"))
    pool = saved(sized.filter(F.col("length") < BIN).select("row", "length"))
    done, turn, before = [full], 0, None
    while True:
        parts = max(1, -(-pool.count() // GROUP))
        placed = saved(_packed(pool.withColumn("part", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(parts)))))
        facts = placed.select("part", "part_bins", "part_bound").distinct().agg(F.sum("part_bins").alias("bins"), F.sum("part_bound").alias("bound")).first()
        bins, gap = facts["bins"] or 0, (facts["bins"] or 0) - (facts["bound"] or 0)
        if before is not None and bins >= before[1]:  # the exchange gained nothing: what it had stays
            done.append(before[0])
            break
        # a part has under 2^16 bins: GROUP rows but for the chance of the deal
        name = (F.lit(turn << 48) + F.col("part") * (1 << 16) + F.col("bin")).alias("sequence_id")
        told = ["row", name, "offset", "part_bins", "part_bound"]
        if gap <= 0 or parts == 1:
            done.append(placed.select(*told))
            break
        fill = placed.groupBy("part", "bin").agg(F.sum("length").alias("fill"))
        loose = fill.filter(F.col("fill") < BIN - SLACK).select("part", "bin", F.lit(1).alias("loose"))
        given = (F.col("part_bins") > F.col("part_bound")) & F.col("loose").isNotNull()
        marked = saved(placed.join(loose, ["part", "bin"], "left").withColumn("given", given))
        done.append(marked.filter("not given").select(*told))
        back = marked.filter("given")
        before = back.select(*told), back.select("part", "bin").distinct().count()
        pool, turn = saved(back.select("row", "length")), turn + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def certificate(packed: DataFrame) -> tuple[int, int]:
    """(sequences, lower bound) of packed pieces (sequence_id, length). What comes to
    the driver is the number of pieces of each length: at most 2048 rows."""
    count = np.zeros(BIN + 1, np.int64)
    for length, n in packed.groupBy("length").agg(F.count("*")).collect():
        count[length] = n
    return packed.select("sequence_id").distinct().count(), bound_of_counts(count)


def pack_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, part_bins,
    part_bound) per piece."""
    cut_up = saved(pieces(docs).withColumn("row", F.monotonically_increasing_id()))
    return cut_up.join(pack(cut_up.select("row", "length")), "row").drop("row")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
