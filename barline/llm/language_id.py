"""Language identification with error-correcting output codes.

Every language has a codeword; each bit is a binary classifier over hashed
character n-grams (1 to 3 characters) that tells the languages with a 1 there from
those with a 0. Classifiers are log-odds of smoothed n-gram frequencies, so one
distributed count (language by n-gram bucket) over all training texts fits every
bit. A text's margins are decoded by loss: the codeword with the least weighted
logistic loss wins; bits weigh by how well they tell languages apart. A text
whose two best codewords lie close together is flagged as ambiguous.

With up to six languages the code is exhaustive (every split of the languages is a
bit), beyond that its bits are drawn from a fixed seed, 16 log2(n) of them. The
model is a table of ``DIMS`` buckets by bits, whatever the corpus size.

Defined results: null texts and texts without a letter are ``und`` with score 0,
and so is every text if nothing is there to learn from; rows with a null language
or text are not learned from; repeated rows count each and are told each for itself; of codewords equally near the
language first by name is told; an empty table gives an
empty table; columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

ship(__name__)

DIMS = 1 << 13
FOLDS = 5
#: A margin is clipped to this, so that long texts decode like short ones.
MOST = 12.0
AMBIGUOUS = 0.2
#: Languages that a model may have; an error beyond.
MOST_LANGS = 1000
CHUNK = 1 << 20  # code points that are looked up at once


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def grams(text: str, seen: int = 0) -> np.ndarray:
    """Buckets of the 1-, 2- and 3-grams of a lower-cased text; other than
    letters, all characters count as one. Those that end in the first ``seen``
    characters are left out."""
    x = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    letter = (x >= 97) & (x <= 122) | (x >= 0xAA)
    x = np.where(letter, x, np.uint64(32))
    m = np.uint64(0x9E3779B97F4A7C15)
    two = x[:-1] * np.uint64(31) + x[1:] + np.uint64(1 << 40) if len(x) > 1 else x[:0]
    three = x[:-2] * np.uint64(961) + x[1:-1] * np.uint64(31) + x[2:] + np.uint64(1 << 41) if len(x) > 2 else x[:0]
    return (np.concatenate([x[seen:], two[max(0, seen - 1) :], three[max(0, seen - 2) :]]) * m >> np.uint64(51)).astype(np.int64) % DIMS


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def count(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over docs (text, lang)."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}
        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
                have = seen.setdefault(lang, np.zeros(DIMS, np.int64))
                have += np.bincount(grams(text.lower()), minlength=DIMS)
        for lang, have in seen.items():
            at = np.flatnonzero(have)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": have[at]})

    by_task = docs.select("text", "lang").mapInPandas(counts, "lang string, bucket long, n long")
    return by_task.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1, a column per bit."""
    if n <= 6:
        cols = [[1 if s >> k & 1 else -1 for k in range(n)] for s in range(1, 1 << n) if s & 1 and s != (1 << n) - 1]
    else:
        rng = np.random.default_rng(17)
        cols = []
        while len(cols) < int(16 * math.log2(n)):
            bit = rng.choice([-1, 1], n)
            if abs(int(bit.sum())) < n:
                cols.append(bit.tolist())
    return np.array(cols, np.float64).T.reshape(n, -1)


class Model:
    """Languages, codewords, weight tables and weights of the bits."""

    def __init__(self, counts: list[tuple[str, int, int]]):
        self.langs = sorted({c[0] for c in counts})
        index = {lang: k for k, lang in enumerate(self.langs)}
        table_ = np.zeros((len(self.langs), DIMS))
        for lang, bucket, n in counts:
            table_[index[lang], bucket] = n
        self.code = codewords(len(self.langs)) if len(self.langs) > 1 else np.zeros((len(self.langs), 0))
        share = (table_ + 0.5) / (table_.sum(1, keepdims=True) + 0.5 * DIMS) if len(self.langs) else table_
        bits = self.code.shape[1]
        self.table, self.weight = np.zeros((DIMS, bits), np.float32), np.ones(bits)
        for b in range(bits):
            yes, no = share[self.code[:, b] > 0].mean(0), share[self.code[:, b] < 0].mean(0)
            odds = np.log(yes / no)
            self.table[:, b] = odds
            # the mean margin a language of either side has, least of all
            self.weight[b] = max(1e-3, float((share @ odds * self.code[:, b]).min()))
        if bits:
            self.weight /= self.weight.sum()

    def margins(self, text: str) -> np.ndarray:
        total = np.zeros(self.table.shape[1])
        n, text = 0, text.lower()  # before it is cut, as this may lengthen it
        for a in range(0, len(text), CHUNK):
            g = grams(text[max(0, a - 2) : a + CHUNK], min(a, 2))
            total += np.bincount(g, minlength=DIMS) @ self.table if len(g) > 2 * DIMS else self.table[g].sum(0, dtype=np.float64)
            n += len(g)
        return np.clip(total / math.sqrt(max(n, 1)), -MOST, MOST)

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous)."""
        if not self.langs or not text or not has_letter(text):
            return "und", 0.0, False
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        loss = np.log1p(np.exp(-self.code * self.margins(text))) @ self.weight
        near = np.exp(-4 * (loss - loss.min()))
        score = near / near.sum()
        order = np.argsort(-score, kind="stable")
        return self.langs[order[0]], float(score[order[0]]), bool(score[order[0]] - score[order[1]] < AMBIGUOUS)


def fit(docs: DataFrame) -> Model:
    """docs (text, lang). What comes to the driver is one row per language and
    bucket: at most ``DIMS`` rows for each of at most ``MOST_LANGS`` languages."""
    if len(docs.select("lang").distinct().take(MOST_LANGS + 2)) > MOST_LANGS + 1:  # null among them
        raise ValueError(f"more than {MOST_LANGS} languages")
    usable = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    return Model([tuple(r) for r in count(usable).collect()])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) from doc_id and text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # DIMS rows by the bits of the code

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = Model([])
        vars(fitted).update(shared.value)
        for pdf in batches:
            told = [fitted.decode(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": [t[0] for t in told], "score": [t[1] for t in told], "ambiguous": [t[2] for t in told]})

    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = named.mapInPandas(decoded, "doc_id string, lang_pred string, score double, ambiguous boolean")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
