"""Fill-in-middle transformation over an index of distinct texts.

Documents are grouped by the SHA-256 of their text. Texts that two documents or more
have get an entry of the index: the text of one of them and the list of its token
boundaries, computed once, as an Elias-Fano code. The entry is joined back to the
documents of its group, where its text is compared with theirs: only an equal text takes
the list, so groups are verified by content. Texts of one document have their list
computed where they are read and move through no shuffle; a bitmap of the digests of the
others (16 MB at most) tells the two apart, and where there are too many digests for it
all documents take the join. A hot text is one row of the index; the documents beside it
are split by the join as any skewed side.

A seeded cut then is two selections in the list: the code-point places where the prefix
and the middle end, which order the pieces.

Defined results: a null text is an empty one, its form is plain; a null doc_id is seeded
as the empty string; repeated rows give repeated results; other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import probably_among, saved, ship, table, text_of

ship(__name__)

SEED = 42
#: Documents in a hundred that are transformed, and of these that put the suffix first.
TRANSFORMED, SUFFIX_FIRST = 50, 80
MARKS = ("<P>", "<S>", "<M>")


class Boundaries:
    """An Elias-Fano code of a rising list of numbers: the low bits of each side by side,
    the high bits as gaps in unary. ``select`` reads one number without the others."""

    HEAD = "<QB"

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        n = len(values)
        if not n:
            return struct.pack(cls.HEAD, 0, 0)
        width = max(0, (int(values[-1]) // n).bit_length() - 1)
        low = (values[:, None] >> np.arange(width)) & 1
        high = np.zeros((int(values[-1]) >> width) + n, np.uint8)
        high[(values >> width) + np.arange(n)] = 1
        return struct.pack(cls.HEAD, n, width) + np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes() + np.packbits(high, bitorder="little").tobytes()

    def __init__(self, code: bytes):
        self.n, self.width = struct.unpack_from(self.HEAD, code)
        n_low = (self.n * self.width + 7) // 8
        start = struct.calcsize(self.HEAD)
        self.low, self.high = code[start : start + n_low], np.frombuffer(code, np.uint8, offset=start + n_low)
        self.ones = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)

    def select(self, k: int) -> int:
        """The number at place k, from 0."""
        at = int(np.searchsorted(self.ones, k + 1))
        before = int(self.ones[at - 1]) if at else 0
        bit = int(np.flatnonzero(np.unpackbits(self.high[at : at + 1], bitorder="little"))[k - before])
        start = k * self.width
        low = int.from_bytes(self.low[start // 8 : (start + self.width + 7) // 8], "little") >> start % 8 & ((1 << self.width) - 1)
        return (8 * at + bit - k) << self.width | low


def ends_of(text: str) -> np.ndarray:
    """Where tokens end: after each run of other characters than space and tab to
    carriage return, and after the ones of that kind at the end."""
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    word = (code != 32) & ((code < 9) | (code > 13))
    ends = np.flatnonzero(word & ~np.append(word[1:], False)) + 1
    return np.append(ends, len(code)) if len(code) and not word[-1] else ends


def numbers(doc_id: str | None) -> list[int]:
    told = hashlib.sha256(f"{SEED}:{doc_id or ''}".encode()).hexdigest()
    return [int(told[k : k + 8], 16) for k in range(0, 32, 8)]


def transform(doc_id: str | None, text: str, code: bytes) -> tuple[str, str, int | None, int | None]:
    """(output, form, prefix_chars, middle_chars) of a text with its boundary list."""
    h1, h2, h3, h4 = numbers(doc_id)
    if not text or any(m in text for m in MARKS) or h3 % 100 >= TRANSFORMED:
        return text, "plain", None, None
    ends = Boundaries(code)
    first, last = sorted((h1 % (ends.n + 1), h2 % (ends.n + 1)))
    a, b = (ends.select(k - 1) if k else 0 for k in (first, last))
    p, s, m = MARKS
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST:
        return f"{s}{suffix}{p}{prefix}{m}{middle}", "spm", a, b - a
    return f"{p}{prefix}{s}{suffix}{m}{middle}", "psm", a, b - a


def restore(output: str, form: str) -> str:
    """The text of an output; marks are found as texts that hold one stay plain."""
    if form == "plain":
        return output
    first, second = ("<S>", "<P>") if form == "spm" else ("<P>", "<S>")
    head, _, middle = output.removeprefix(first).partition("<M>")
    x, _, y = head.partition(second)
    return y + middle + x if form == "spm" else x + middle + y


def address() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def _indexed(texts: DataFrame) -> DataFrame:
    """(address, content, bounds) of texts (address, text)."""

    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"address": rows["address"], "content": rows["text"], "bounds": [Boundaries.encode(ends_of(t)) for t in rows["text"]]})

    return texts.select("address", "text").mapInPandas(lists, "address binary, content string, bounds binary")


def _cut(rows: DataFrame) -> DataFrame:
    """The transformed rows (doc_id, text, bounds); bounds may be null."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, code in zip(batch["doc_id"], batch["text"], batch["bounds"], strict=True):
                code = Boundaries.encode(ends_of(text)) if code is None else bytes(code)
                output, form, prefix, middle = transform(doc, text, code)
                out.append((doc, Boundaries(code).n, form, prefix, middle, output))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pd.DataFrame({"doc_id": columns[0], "n": columns[1], "form": columns[2], "prefix_chars": pd.array(columns[3], "Int64"), "middle_chars": pd.array(columns[4], "Int64"), "output": columns[5]})

    return rows.select("doc_id", "text", "bounds").mapInPandas(cut, "doc_id string, n long, form string, prefix_chars long, middle_chars long, output string")


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """(doc_id string, n, form, prefix_chars, middle_chars, output) per row of docs
    (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_of().alias("text")).withColumn("address", address())
    groups = rows.groupBy("address").agg(F.count("*").alias("n"), F.min("doc_id").alias("head"))
    repeated = saved(groups.filter("n > 1").select("address", "head"))
    marked = probably_among(rows, "address", repeated.select("address"), "repeated")
    heads = marked.filter("repeated").join(repeated, "address").filter(F.col("doc_id").eqNullSafe(F.col("head")))
    index = saved(_indexed(heads.dropDuplicates(["address"])))
    met = marked.filter("repeated").join(index, "address", "left")
    same = met.select("doc_id", "text", F.when(F.col("text") == F.col("content"), F.col("bounds")).alias("bounds"))
    alone = marked.filter("not repeated").select("doc_id", "text", F.lit(None).cast("binary").alias("bounds"))
    return _cut(same).unionByName(_cut(alone))


def digests(cut: DataFrame) -> DataFrame:
    """The rows with digests of the output and of the text that it gives back."""

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hexed = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for batch in batches:
            back = [hexed(restore(o, f)) for o, f in zip(batch["output"], batch["form"], strict=True)]
            yield batch.assign(output_sha256=[hexed(o) for o in batch["output"]], restored_sha256=back, prefix_chars=batch["prefix_chars"].astype("Int64"), middle_chars=batch["middle_chars"].astype("Int64")).drop(columns="output")

    return cut.mapInPandas(told, "doc_id string, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(fill_in_middle(table(spark, sf_dir, "documents"))).withColumn("doc_id", F.col("doc_id").cast("long"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), k AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM d
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM k
), c AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM c
"""
