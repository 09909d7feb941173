"""Quality rules: a ledger of failure bits.

Every rule is evaluated once per document; the ledger keeps the measurements and
one bit per failed rule. A policy is a versioned bit mask: a document is kept if
it fails none of the policy's rules, so policies are compared and rules ablated by
bitwise aggregation over the ledger, without touching a text again.

Defined results: a null text has no words, lines or symbols (and so fails
``few_words``); repeated rows are judged each for itself; other columns pass
through ``apply_policy`` untouched; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, let, table, text_of

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
#: Columns that the ledger adds; they replace columns of the same name.
ADDED = ("n_words", "word_chars", "max_word", "n_repeat_words", "n_symbols", "n_exclaims", "n_lines", "n_dup_lines", "has_letter", "failed", "kept")


def repeat_words(words: Column) -> Column:
    """Words that lie in a window of ``WINDOW`` words which the text holds twice
    or more. Windows compare by a 64-bit hash of their words' hashes; only texts
    with a repeated window sort them."""
    def covered(hashes: Column) -> Column:
        at = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(pairs: Column) -> Column:
            n = F.size(pairs)
            same = lambda i, j: (j >= 0) & (j < n) & F.coalesce(F.get(pairs, i)["h"] == F.get(pairs, j)["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(pairs, lambda p, i: same(i, i - 1) | same(i, i + 1)), lambda p: p["i"]))

        def total(found: Column) -> Column:
            gaps = F.transform(found, lambda p, k: F.least(F.coalesce(F.get(found, k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

        return let(let(at, positions), total)

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered(hashes))

    def doubled(reach: int) -> Callable[[Column], Column]:
        return lambda ids: F.transform(F.sequence(F.lit(0), F.size(ids) - 1 - reach), lambda i: F.xxhash64(F.get(ids, i), F.get(ids, i + reach)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    for reach in (1, 2):  # windows of 2, then of 4 words
        hashes = let(hashes, doubled(reach))

    def longer(fours: Column) -> Column:  # without a repeated window of 4 words there is none of 8
        none = F.size(F.array_distinct(fours)) == F.size(fours)
        return F.when(none, F.lit(0).cast("long")).otherwise(let(doubled(4)(fours), counted))

    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, longer))


def measured(docs: DataFrame) -> DataFrame:
    """docs with the measurements of every rule (columns n_words to max_word)."""
    text = text_of()
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))

    def facts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.coalesce(F.array_max(F.transform(w, lambda x: F.length(x))), F.lit(0)).cast("long").alias("max_word"),
            repeat_words(w).alias("n_repeat_words"),
        )

    def line_facts(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    symbols = F.when(text.rlike(SYMBOLS), F.regexp_count(text, F.lit(SYMBOLS))).otherwise(0).cast("long")
    exclaims = F.when(text.contains("!!"), F.regexp_count(text, F.lit("!!"))).otherwise(0).cast("long")
    letters = F.when(text.rlike(r"\p{L}"), F.lit(1)).otherwise(0)
    out = docs.withColumns({"_words": let(words, facts), "_lines": let(lines, line_facts), "n_symbols": symbols, "n_exclaims": exclaims, "has_letter": letters == 1})
    added = {*ADDED, "_words", "_lines"}
    return out.select(*[c for c in docs.columns if c not in added], "_words.*", "n_symbols", "n_exclaims", "_lines.*", "has_letter")




def rules() -> dict[str, Column]:
    """name -> failure condition over the measurements, in bit order. Bits are
    never reused: a rule that goes out of use keeps its place."""
    n = F.col("n_words")
    return {
        "few_words": n < 20,
        "repeated_windows": 100 * F.col("n_repeat_words") > 30 * n,
        "many_symbols": 10 * F.col("n_symbols") > 3 * n,
        "repeated_lines": (F.col("n_lines") >= 4) & (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        "short_words": F.col("word_chars") < 2 * n,
        "long_words": F.col("word_chars") > 20 * n,
        "endless_word": F.col("max_word") > 1000,
        "no_letter": ~F.col("has_letter"),
        "exclaiming": 10 * F.col("n_exclaims") > 3 * n,
    }


BASE = ("few_words", "repeated_windows")
#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {1: BASE, 2: (*BASE, "many_symbols", "repeated_lines", "short_words", "long_words", "endless_word", "no_letter", "exclaiming")}


def mask_of(names: tuple[str, ...]) -> int:
    order = list(rules())
    return sum(1 << order.index(name) for name in names)


def ledger(docs: DataFrame) -> DataFrame:
    """docs with measurements and ``failed``, the bits of the rules they fail."""
    bits = F.lit(0).cast("long")
    for k, failed in enumerate(rules().values()):
        bits = bits.bitwiseOR(F.when(F.coalesce(failed, F.lit(False)), F.lit(1 << k)).otherwise(0).cast("long"))
    return measured(docs).withColumn("failed", bits)


def apply_policy(judged: DataFrame, version: int) -> DataFrame:
    return judged.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES[version])).cast("long")) == 0)


def ablations(judged: DataFrame, version: int) -> DataFrame:
    """Per rule of a policy (rule, n_failed, n_only): documents that fail it and
    those that it alone rejects, which would be kept without it."""
    mask = mask_of(POLICIES[version])
    by_mask = judged.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("failed")).agg(F.count("*").alias("n"))
    bit = {name: 1 << k for k, name in enumerate(rules())}
    listed = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit[r]).cast("long").alias("bit")) for r in POLICIES[version]]))
    each = by_mask.select("failed", "n", listed.alias("r")).select("failed", "n", "r.rule", "r.bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("failed") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_policy(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), max(POLICIES))
    base = F.lit(mask_of(BASE)).cast("long")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("failed").bitwiseAND(base) != 0).alias("base_failed"), "kept", "failed")


OP5_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
p as (select doc_id, unnest(range(1, len(words) - 6)) as i, words from w where len(words) >= 8),
g as (select doc_id, i, array_to_string(list_slice(words, i, i + 7), ' ') as k from p),
r as (select doc_id, i from (select *, count(*) over (partition by doc_id, k) as c from g) where c > 1),
m as (select doc_id, sum(least(coalesce(nxt - i, 8), 8)) as n from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from r) group by 1),
f as (select w.doc_id, len(words)::bigint as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(m.n, 0)::bigint as n_repeat_words,
  len(lines) as n_lines, coalesce(list_max(list_transform(words, lambda x: length(x))), 0) as max_word, regexp_matches(t, '\p{L}') as has_letter, len(regexp_extract_all(t, '!!')) as n_exclaims
  from w left join m on w.doc_id = m.doc_id),
b as (select *, (n_words < 20)::bigint + 2 * (100 * n_repeat_words > 30 * n_words)::bigint + 4 * (10 * n_symbols > 3 * n_words)::bigint
  + 8 * (n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines)::bigint + 16 * (word_chars < 2 * n_words)::bigint + 32 * (word_chars > 20 * n_words)::bigint
  + 64 * (max_word > 1000)::bigint + 128 * (not has_letter)::bigint + 256 * (10 * n_exclaims > 3 * n_words)::bigint as failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 as base_failed, failed = 0 as kept, failed from b
"""
