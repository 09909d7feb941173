"""N-gram Jaccard join with filters from several global token orders.

Two documents link when the sets of their 3-word shingles have a Jaccard
similarity of 0.9 or more. Under any global order of the tokens, linked sets share
a token among their first ``n - ceil(0.9 n) + 1``. The first order makes the
candidates: tokens whose hash falls below a share come first, the rarer the
earlier (their document counts cover all documents), the others follow by hash,
so only a share of all tokens is ever shuffled and common passages stay out of the
prefixes. Linked sets differ in size by a tenth at most, so sets are compared in
bands of size, each in its own and the next, and each band has its own share: 0.15
of large sets, about 100 tokens of small ones, which a common passage could fill.

Each set carries its prefixes under two more orders (by two other hashes, 32 bits of
a token): a pair is a candidate only if it shares a token in all three, and that is
tested before any text moves. Each set also carries the parity of
its tokens' count in cells: sets differ in as many tokens at least as they have
different parities, so most pairs of a group of copies that are not near enough are
ruled out without loss: where they meet by 128 cells, then by about as many cells as
a set has tokens. Members of large buckets that are not linked with them get prefixes
under a fourth order, rare tokens first among them alone (see ``components``).

Exact copies are one class from the start. Candidates are compared in steps
(see ``components``), so a group of copies costs links in proportion to its size.
Shingles are compared by 64-bit hashes.

Defined results: null and word-less texts have no shingles and link with nothing;
texts of fewer than 3 words are one shingle; repeated rows are in one component; rows
without a doc_id are compared with none and have null results;
columns other than doc_id and text are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import may_hold, saved, ship, table, text_of
from .components import link_buckets

ship(__name__)

WORDS, SIMILAR, OF = 3, 90, 100
#: The least share of hashes in the first part of the order, and the tokens that a
#: set of any size should have there.
SHARE, TOKENS = 0.15, 100
WORD_CACHE = 200_000
#: Documents whose token sets a task holds at once.
HELD = 500
#: Cells of the parities: the fewest, two longs, and the most.
CELLS, MOST_CELLS = 128, 1 << 20


class WordHashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORD_CACHE:
            self[word] = value
        return value


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Another pseudo-random order of 64-bit hashes."""
    x = (x ^ np.uint64(seed)) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    return x * np.uint64(0xC4CEB9FE1A85EC53)


def shingles(text: str, words: WordHashes, size: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    found = text.encode().translate(_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.array([words[w] for w in found], np.uint64)
    out = np.full(max(1, len(h) - size + 1), np.uint64(min(len(h), size)))
    for k in range(min(len(h), size)):
        part = h[k : k + len(out)]
        out = mixed(out ^ (part + np.uint64(0x9E3779B97F4A7C15)), 0x5851F42D4C957F2D + k)
    return np.unique(out)


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def parities(s: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """A bit per cell, set where the cell holds an odd number of tokens, as bytes."""
    odd = np.bincount((s % np.uint64(cells)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def cells_for(n: int) -> int:
    return min(MOST_CELLS, max(CELLS, 1 << max(n - 1, 1).bit_length()))


def least_difference(x: bytes, y: bytes) -> int:
    """How many tokens two sets differ in at least, by their parities. The longer is
    folded: a cell of half as many holds the tokens of two."""
    u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(u) != len(v):
        if len(u) < len(v):
            u, v = v, u
        u = u[: len(u) // 2] ^ u[len(u) // 2 :]
    return int(np.bitwise_count(u ^ v).sum())


def prefix_length(n: int, similar: int = SIMILAR, of: int = OF) -> int:
    return n - -(-similar * n // of) + 1


def band_of(n: int, similar: int, of: int) -> int:
    return int(math.floor(math.log(max(n, 1)) / math.log(of / similar)))


def band_bound(band: int, similar: int, of: int) -> int:
    """Hashes whose upper 63 bits are below this come first in a band."""
    return min(2**63 - 1, int(min(1.0, max(SHARE, TOKENS / (of / similar) ** band)) * 2**63))


#: Seeds of the second and third order, by another hash of each token.
ORDERS = {"order2": 0xA5A5, "order3": 0x5A5A}


def _start(s: np.ndarray, seed: int, prefix: int) -> np.ndarray:
    """The prefix of a set under the order of another hash, as 32 bits of each token."""
    order = mixed(s, seed)
    least = np.partition(order, prefix - 1)[:prefix] if len(s) else order
    return (least & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def _tokens(docs: DataFrame, size: int, similar: int, of: int) -> DataFrame:
    """(k1, k2, doc_id, n, odd1, odd2, cells, order2, order3, band, low, low_next,
    tokens): the size and parities of each token set, its prefixes in two orders, and
    its start in the first order of the hashes, all below its band's bound and at least
    a prefix."""

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for pdf in (whole.iloc[a : a + HELD] for whole in batches for a in range(0, len(whole), HELD)):
            rows = []
            for text in pdf["text"]:
                s = shingles(text, words, size)
                n, band = len(s), band_of(len(s), similar, of)
                bound, prefix = band_bound(band, similar, of), prefix_length(n, similar, of) if n else 0
                start = s[: max(int(np.searchsorted(s >> np.uint64(1), np.uint64(bound))), prefix)].view(np.int64)
                odd1, odd2 = parities(s).view(np.int64).tolist()
                rows.append((n, odd1, odd2, parities(s, cells_for(n)).tobytes(), *[_start(s, seed, prefix) for seed in ORDERS.values()], band, bound, band_bound(band + 1, similar, of), start))
            made = pd.DataFrame(rows, columns=["n", "odd1", "odd2", "cells", *ORDERS, "band", "low", "low_next", "tokens"], index=pdf.index)
            yield pd.concat([pdf[["k1", "k2", "doc_id"]], made], axis=1)

    return docs.mapInPandas(starts, "k1 long, k2 long, doc_id long, n long, odd1 long, odd2 long, cells binary, order2 array<int>, order3 array<int>, band int, low long, low_next long, tokens array<long>")


def _near(pairs: DataFrame, sets: DataFrame, similar: int, of: int) -> DataFrame:
    """The pairs whose sets (rep, n, cells, order2, order3) share prefix tokens under
    both orders and may be similar enough by their parities."""

    def nearby(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            apart = np.array([least_difference(x, y) for x, y in zip(pdf["x"], pdf["y"], strict=True)], np.int64)
            yield pdf.loc[(of + similar) * apart <= (of - similar) * pdf["n"].to_numpy(), ["a", "b"]]

    def side(key: str, tag: str) -> DataFrame:
        return sets.select(F.col("rep").alias(key), *[F.col(c).alias(f"{c}_{tag}") for c in ("n", "cells", *ORDERS)])

    met = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    for order in ORDERS:
        met = met.filter(F.arrays_overlap(f"{order}_x", f"{order}_y"))
    return met.select("a", "b", F.col("cells_x").alias("x"), F.col("cells_y").alias("y"), (F.col("n_x") + F.col("n_y")).alias("n")).mapInPandas(nearby, "a long, b long")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, text) of the documents in ``wanted`` (rep): a bitmap keeps the texts of all
    others out of the shuffle."""
    near = may_hold(docs.withColumnRenamed("doc_id", "rep"), "rep", wanted)
    return near.join(wanted, "rep", "left_semi").dropDuplicates(["rep"])


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, size: int, similar: int, of: int) -> DataFrame:
    """The pairs that share prefix tokens under all orders and are similar enough."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, last, s = WordHashes(), None, None
        for pdf in batches:
            out = []
            for a, b, x, y in zip(pdf["a"], pdf["b"], pdf["x"], pdf["y"], strict=True):
                if a != last:
                    last, s = a, shingles(x, words, size)
                t = shingles(y, words, size)
                both = len(np.intersect1d(s, t, assume_unique=True))
                if of * both >= similar * (len(s) + len(t) - both):
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    pairs = saved(_near(pairs, sets, similar, of))
    texts = _texts(docs, saved(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()))
    held = texts.select(F.col("rep").alias("a"), F.col("text").alias("x"))
    other = texts.select(F.col("rep").alias("b"), F.col("text").alias("y"))
    return pairs.join(held, "a").join(other, "b").sortWithinPartitions("a").select("a", "b", "x", "y").mapInPandas(compare, "a long, b long")


def _token_rows(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, token): the token sets of the documents in ``ids`` (id)."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for pdf in batches:
            for rep, text in zip(pdf["rep"], pdf["text"], strict=True):
                s = shingles(text, words, size).view(np.int64)
                yield pd.DataFrame({"id": np.full(len(s), rep, np.int64), "token": s})

    return _texts(docs, ids.withColumnRenamed("id", "rep")).mapInPandas(sets, "id long, token long")


def join_components(docs: DataFrame, size: int = WORDS, similar: int = SIMILAR, of: int = OF) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs (doc_id, text)."""
    none = [F.lit(None).cast("long").alias(c) for c in ("doc_id", "n_shingles", "component_id")]
    nameless = docs.filter(F.col("doc_id").cast("long").isNull()).select(*none)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).filter("doc_id is not null")
    keyed = keyed.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(7), "text")})
    carried = ["n", "odd1", "odd2", "cells", *ORDERS, "band", "low", "low_next", "tokens"]
    first = F.min(F.struct("doc_id", *carried)).alias("s")
    made = _tokens(keyed.select("k1", "k2", "doc_id", "text"), size, similar, of)
    reps = saved(made.groupBy("k1", "k2").agg(first).select("k1", "k2", F.col("s.doc_id").alias("rep"), *[f"s.{c}" for c in carried]))
    held = reps.filter("n > 0").select("rep", F.explode("tokens").alias("token"))
    shared = held.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    known = held.join(shared, "token").groupBy("rep").agg(F.collect_list(F.struct("df", "token")).alias("known"))
    below = lambda t, bound: F.shiftrightunsigned(t, 1) < bound
    bands = F.array(F.struct("band", F.col("low").alias("bound")), F.struct((F.col("band") + 1).alias("band"), F.col("low_next").alias("bound")))
    n_low = F.size(F.filter("tokens", lambda t: below(t, F.col("o.bound")))).alias("n_low")
    sizes = reps.filter("n > 0").select("rep", "n", "odd1", "odd2", "tokens", F.explode(bands).alias("o"))
    sizes = sizes.select("rep", "n", "odd1", "odd2", "tokens", "o.band", "o.bound", n_low)
    whole = sizes.join(known, "rep").withColumn("p", F.expr(f"n - (({similar} * n + {of - 1}) div {of}) + 1").cast("int"))
    whole = whole.withColumn("lows", F.sort_array(F.filter("known", lambda t: below(t["token"], F.col("bound")))))
    # tokens of one document only come first of the first part
    alone = F.col("n_low") - F.size("lows")
    low = F.transform("lows", lambda t, i: F.struct(t["token"].alias("token"), (alone + i).alias("pos")))
    # beyond the first part the order is by hash alone, and tokens holds it up to the prefix
    place = lambda t: (F.array_position("tokens", t["token"]) - 1).cast("int").alias("pos")
    others = F.filter("known", lambda t: ~below(t["token"], F.col("bound")))
    high = F.when(F.col("p") > F.col("n_low"), F.transform(others, lambda t: F.struct(t["token"].alias("token"), place(t))))
    held_there = F.filter(F.concat(low, F.coalesce(high, F.array().cast("array<struct<token:bigint,pos:int>>"))), lambda t: t["pos"] < F.col("p"))
    prefix = whole.select("rep", "n", "odd1", "odd2", "band", F.explode(held_there).alias("t"))
    rows = prefix.select(F.struct("t.token", "band").alias("key"), F.col("rep").alias("id"), "n", "odd1", "odd2", "t.pos")

    def fits(x, y):  # noqa: ANN001, ANN202
        """At its first common token a linked pair still has enough tokens left, and
        its sets differ in few enough cells."""
        cells = F.bit_count(x("odd1").bitwiseXOR(y("odd1"))) + F.bit_count(x("odd2").bitwiseXOR(y("odd2")))
        left = (of + similar) * F.least(x("n") - x("pos"), y("n") - y("pos")) >= similar * (x("n") + y("n"))
        return left & ((of + similar) * cells <= (of - similar) * (x("n") + y("n")))

    sets, texts = reps.select("rep", "n", "cells", *ORDERS), keyed.select("doc_id", "text")
    # who has the fewest tokens before a common one is nearest to the others
    found = link_buckets(
        saved(rows), lambda pairs: _verified(pairs, sets, texts, size, similar, of), lambda ids: _token_rows(texts, ids, size), similar, of, fits, ("pos",))
    classes = reps.join(found, reps["rep"] == found["id"], "left").select("k1", "k2", "n", F.coalesce("component", "rep").alias("component"))
    out = keyed.select("doc_id", "k1", "k2").join(classes, ["k1", "k2"])
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id")).unionByName(nameless)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
