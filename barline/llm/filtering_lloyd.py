"""Vector code compression: product codes by filtering Lloyd iterations.

Vectors become integers and are cut into 16 parts. Every partition builds, once, a
kd-tree over each part position of its blocks of vectors; a node has the box, the sum
and the count of its vectors' parts, and the trees are written to the shared folder. In
a round the codebook's entries descend the trees together: at a node the entry nearest
to the middle of its box eliminates those that are farther than it from every place of
the box (from the corner where they come nearest; at equal distance the lower index
wins), and where one entry is left the whole subtree goes to it by its cached sum and
count. Only vectors in leaves with several entries left are compared one by one, with
these entries alone. A task returns sums and counts by entry; the driver holds codebooks
(16 parts of 64 entries) and these sums, which do not grow with the vectors.

Defined results: rows are dropped whose vector is null, empty, holds a null or non-finite
component, or has another length than that of the least kept vec_id; if that length is
no multiple of 16, all are. Components beyond 2^22 in integers count as 2^22, so that
squared distances fit 64 bits. Rows without a vec_id are coded as others, but last as
initial entries; rows with one vec_id are ordered by their vectors. Fewer kept rows than
64 give as many entries. Other columns pass by; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, ship, table

ship(__name__)

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE, MOST = 256, 1 << 22
#: Vectors of a block, and of a leaf at most.
BLOCK, LEAF = 4096, 32


def integers(vectors: list) -> np.ndarray:
    """[vector, part, place] of equally long vectors."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return np.clip(np.floor(SCALE * x), -MOST, MOST).astype(np.int64).reshape(len(x), PARTS, -1)


def splits(n: int) -> list[np.ndarray]:
    """For every level of a tree of n points, where its nodes' ranges begin, and n."""
    levels = [np.array([0, n])]
    while (np.diff(levels[-1]) > LEAF).any():
        at = levels[-1]
        levels.append(np.append(np.stack([at[:-1], (at[:-1] + at[1:]) // 2], 1).ravel(), n))
    return levels


@dataclass
class Tree:
    """A kd-tree over the points of one part position: points in the tree's order, their
    places before, and low and high corners and sums of the nodes, level by level."""

    order: np.ndarray
    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @classmethod
    def grown(cls, points: np.ndarray) -> Tree:
        levels, order = splits(len(points)), np.arange(len(points))
        for at, below in zip(levels, levels[1:], strict=False):
            for k in range(len(at) - 1):
                own = order[at[k] : at[k + 1]]
                p = points[own]
                x = p[:, np.ptp(p, 0).argmax()]
                order[at[k] : at[k + 1]] = own[np.argpartition(x, below[2 * k + 1] - at[k])]
        points = points[order]
        corner = lambda how: np.concatenate([how.reduceat(points, at[:-1], axis=0) for at in levels])
        return cls(order, points, corner(np.minimum), corner(np.maximum), corner(np.add))

    def columns(self) -> list[bytes]:
        kinds = (np.int32, np.int32, np.int32, np.int32, np.int64)
        return [a.astype(k).tobytes() for a, k in zip((self.order, self.points, self.low, self.high, self.sums), kinds, strict=True)]

    @classmethod
    def read(cls, columns: list[bytes], n: int) -> Tree:
        order, points, low, high = (np.frombuffer(c, np.int32).astype(np.int64) for c in columns[:4])
        dims = len(points) // n
        return cls(order, points.reshape(n, dims), low.reshape(-1, dims), high.reshape(-1, dims), np.frombuffer(columns[4], np.int64).reshape(-1, dims))

    def filtered(self, book: np.ndarray) -> tuple[list[tuple[int, int, int, int]], np.ndarray, np.ndarray]:
        """(node, begin, end, entry) of subtrees that go to one entry as a whole; the places
        of the other points, and their entries."""
        levels, whole, first = splits(len(self.points)), [], 0
        nodes, left = np.array([0]), np.ones((1, len(book)), bool)
        for depth, at in enumerate(levels):
            low, high = self.low[first + nodes], self.high[first + nodes]
            best = self._nearest_to_middle(book, low + high, left)
            left &= ~self._farther(book, best, low, high)
            one = left.sum(1) == 1
            whole += [(first + n, at[n], at[n + 1], int(left[i].argmax())) for i, n in zip(np.flatnonzero(one), nodes[one], strict=True)]
            nodes, left = nodes[~one], left[~one]
            if depth + 1 < len(levels):
                first += len(at) - 1
                nodes, left = np.stack([2 * nodes, 2 * nodes + 1], 1).ravel(), left.repeat(2, 0)
        if not len(nodes):
            return whole, np.zeros(0, np.int64), np.zeros(0, np.int64)
        return whole, *self._leaves(book, levels[-1], nodes, left)

    @staticmethod
    def _nearest_to_middle(book: np.ndarray, twice: np.ndarray, left: np.ndarray) -> np.ndarray:
        far = ((2 * book[None] - twice[:, None]) ** 2).sum(2)
        return np.where(left, far, np.iinfo(np.int64).max).argmin(1)

    @staticmethod
    def _farther(book: np.ndarray, best: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """[node, entry]: entries that the best one of the node beats in all of its box."""
        kept = book[best][:, None]
        corner = np.where(book[None] > kept, high[:, None], low[:, None])
        more = ((book[None] - corner) ** 2).sum(2) - ((kept - corner) ** 2).sum(2)
        index = np.arange(len(book))
        return (more > 0) | ((more == 0) & (index[None] > best[:, None]))

    def _leaves(self, book: np.ndarray, at: np.ndarray, nodes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, size = at[nodes], at[nodes + 1] - at[nodes]
        place = begin[:, None] + np.arange(size.max())
        real = place < (begin + size)[:, None]
        points = self.points[np.where(real, place, begin[:, None])]
        leaf, entry = np.nonzero(left)
        far = ((points[leaf] - book[entry][:, None]) ** 2).sum(2) * ENTRIES + entry[:, None]
        nearest = np.minimum.reduceat(far, np.searchsorted(leaf, np.arange(len(nodes))), axis=0) % ENTRIES
        return place[real], nearest[real]

    def totals(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums and counts of the points by entry."""
        sums, counts = np.zeros_like(book), np.zeros(len(book), np.int64)
        whole, places, entries = self.filtered(book)
        for node, begin, end, entry in whole:
            sums[entry] += self.sums[node]
            counts[entry] += end - begin
        np.add.at(sums, entries, self.points[places])
        return sums, counts + np.bincount(entries, minlength=len(book))

    def codes(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries and squared distances of the points, in their order before."""
        owner = np.empty(len(self.points), np.int64)
        whole, places, entries = self.filtered(book)
        for _, begin, end, entry in whole:
            owner[begin:end] = entry
        owner[places] = entries
        out, far = np.empty_like(owner), np.empty_like(owner)
        out[self.order], far[self.order] = owner, ((self.points - book[owner]) ** 2).sum(1)
        return out, far


def kept(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, label) of vectors without missing or non-finite components."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    return own.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(F.forall("embedding", sound))


FOREST = "vec_id array<string>, label array<string>, trees array<array<binary>>"


def forest(rows: DataFrame) -> DataFrame:
    """A row for each block of vectors: ids, labels and the tree of every part position."""

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), BLOCK):
                own = batch.iloc[a : a + BLOCK]
                x = integers(own["embedding"].tolist())
                trees = [Tree.grown(x[:, p]).columns() for p in range(PARTS)]
                yield pd.DataFrame({"vec_id": [own["vec_id"].tolist()], "label": [own["label"].tolist()], "trees": [trees]})

    return saved(rows.select(F.col("vec_id").cast("string").alias("vec_id"), "embedding", "label").mapInPandas(grow, FOREST))


def next_books(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks [part, entry, place] after a round."""
    n_entries, dims = books.shape[1:]

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for ids, columns in zip(batch["vec_id"], batch["trees"], strict=True):
                for p in range(PARTS):
                    s, c = Tree.read(columns[p], len(ids)).totals(books[p])
                    sums[p] += s
                    counts[p] += c
        part, entry = np.nonzero(counts)
        yield pd.DataFrame({"part": part, "entry": entry, "n": counts[part, entry], "total": sums[part, entry].tolist()})

    told = trees.mapInPandas(total, "part int, entry int, n long, total array<long>")
    summed = told.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(j))).alias(f"t{j}") for j in range(dims)])
    out = books.copy()
    for r in summed.collect():  # PARTS * ENTRIES rows at most
        out[r["part"], r["entry"]] = [r[f"t{j}"] // r["n"] for j in range(dims)]
    return out


def coded(trees: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id string, label, code, error) of every vector."""

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, labels, columns in zip(batch["vec_id"], batch["label"], batch["trees"], strict=True):
                found = [Tree.read(columns[p], len(ids)).codes(books[p]) for p in range(PARTS)]
                digits = np.stack([e for e, _ in found], 1).astype(np.uint8)
                yield pd.DataFrame({"vec_id": ids, "label": labels, "code": [d.tobytes().hex() for d in digits], "error": sum(f for _, f in found)})

    return trees.mapInPandas(code, "vec_id string, label string, code string, error long")


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The codes (vec_id, label, code, error) of vectors (vec_id, embedding, label), and
    the codebooks [part, entry, place] that they refer to."""
    rows = kept(vectors)
    heads = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES)
    first = [r["embedding"] for r in heads.collect()]
    length = len(first[0]) if first else 0
    if length % PARTS or not length:
        return vectors.sparkSession.createDataFrame([], "vec_id string, label string, code string, error long"), np.zeros((PARTS, 0, 0), np.int64)
    rows = rows.filter(F.size("embedding") == length)
    if any(len(v) != length for v in first):
        first = [r["embedding"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).collect()]
    books, trees = integers(first).transpose(1, 0, 2), forest(rows)
    for _ in range(rounds):
        books = next_books(trees, books)
    return coded(trees, books), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    codes = saved(codes)
    by_label = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    told = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    met = codes.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return met.select(F.col("vec_id").cast("long").alias("vec_id"), "code", "error", "label_error", F.lit(told).alias("codebooks_sha256"))


def _assigned(parts: str, books: str) -> str:
    """SQL of (vec_id, part, e, far): the nearest entry of every part."""
    return f"""(SELECT vec_id, part, min(far * 64 + e) % 64 AS e, min(far * 64 + e) // 64 AS far FROM
      (SELECT vec_id, x.part, e, sum((x - c) * (x - c))::BIGINT AS far FROM {parts} x JOIN {books} b ON x.part = b.part AND x.j = b.j GROUP BY ALL) GROUP BY ALL)"""


def _renewed(books: str) -> str:
    return f"""SELECT b.part, b.e, b.j, coalesce(s.c, b.c) AS c FROM {books} b LEFT JOIN (
      SELECT part, e, j, floor(sum(x)::DOUBLE / count(*))::BIGINT AS c FROM comps JOIN {_assigned("comps", books)} a USING (vec_id, part) GROUP BY ALL) s USING (part, e, j)"""


OP13_SQL = f"""
WITH rows AS (
  SELECT vec_id, embedding, label FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), comps AS (
  SELECT vec_id, label, (k - 1) // 4 AS part, (k - 1) % 4 AS j, floor(256 * embedding[k]::DOUBLE)::BIGINT AS x
  FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS k FROM rows)
), firsts AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM rows ORDER BY vec_id LIMIT 64
), books0 AS MATERIALIZED (
  SELECT part, e, j, x AS c FROM comps JOIN firsts USING (vec_id)
), books1 AS MATERIALIZED ({_renewed("books0")}
), books2 AS MATERIALIZED ({_renewed("books1")}
), codes AS (
  SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM {_assigned("comps", "books2")} GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, e, j)) FROM books2) AS codebooks_sha256
FROM codes JOIN rows USING (vec_id)
"""
