"""Secret scans: corpus-wide ownership frequency.

Base patterns of three kinds always stand. A generator of token-like strings
(prefixed keys, private-key headers, long mixed-case strings) proposes more. Every
candidate's value is hashed, and the hashes are aggregated over the whole corpus
by distinct repositories and owners: a value that many owners or many repositories
hold is a copied example, also within one owner; one that few of both hold looks
live. The bounds are ``EXAMPLE_OWNERS`` and ``EXAMPLE_REPOSITORIES``. A proposed span
is added when its value looks live; base spans keep the verdict beside them.

Aggregation runs in two steps (distinct (hash, owner, repository), then counts
by hash), so a value that a third of all rows hold is combined before it is
shuffled; the verdicts come back by a join that Spark can split by key.

Defined results: a null text counts as empty and has no spans; a null owner or
repository is one owner or repository of its own; repeated rows are judged each
for itself; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, saved, table, text_of
from .spans import matches, of_kind, sha256, written

KINDS = ("assign", "access", "hex", "token", "mixed")
# The base patterns. The lengths of access and hex are in the
# pattern, as a match that is too short holds no longer one.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_VALUE = r"""(?i:^(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
TOKEN = r"(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{30,}+|sk-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{12,}+|eyJ[A-Za-z0-9_-]{16,}+\.[A-Za-z0-9_-]{16,}+\.[A-Za-z0-9_-]{8,}+|-----BEGIN\x20[A-Z\x20]{0,20}PRIVATE\x20KEY-----)"
#: Whole runs of 24 key characters or more. Those of three classes of characters that
#: fall into many pieces (a capitalised word is one piece, so joined words are few) and
#: that touch no other candidate are proposed.
MIXED = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}+(?![A-Za-z0-9+/_-])"
#: Least pieces per hundred characters; random strings have about 44, names about 20.
MIXED_PIECES = 28
#: From this number of owners, or of repositories of all owners, on, a value is a copied
#: example. An owner's own secret may lie in a few repositories, copies and forks.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 10
MIN_VALUE = 12


def _value(s: Column) -> Column:
    return F.when(s["kind"] == 0, F.regexp_extract(s["match"], ASSIGN_VALUE, 1)).otherwise(s["match"])


def _random(match: Column) -> Column:
    """Whether a run has all three classes of characters and falls into many pieces."""
    pieces = F.regexp_count(match, F.lit("[A-Z]?[a-z]+|[A-Z]+|[0-9]+"))
    return match.rlike("[a-z]") & match.rlike("[A-Z]") & match.rlike("[0-9]") & (pieces * 100 >= F.length(match) * MIXED_PIECES)


def propose(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """(row, doc_id, owner, repository, found): candidates of every row as
    (start, kind, end, value hash), in order."""
    text = F.col("text")
    searched = [
        (ASSIGN, text.rlike(r"(?i)(?:passw(?:or)?d|secret|token|api_?key)[\"']?\x20*[:=]")),
        (ACCESS, text.contains("AKIA")),
        (HEX, text.rlike(r"[0-9a-f]{16}")),
        (TOKEN, text.rlike(r"gh[pousr]_|sk-|xox[abprs]-|eyJ|-----BEGIN")),
        (MIXED, text.rlike(r"[A-Za-z0-9+/_-]{24}")),
    ]
    spans = F.concat(*[matches(text, p, k, maybe, context=1) for k, (p, maybe) in enumerate(searched)])
    wanted = lambda s: F.when(s["kind"] == 0, F.length(_value(s)) >= MIN_VALUE).when(s["kind"] == 4, _random(s["match"])).otherwise(True)
    apart = lambda s, all_: (s["kind"] < 4) | ~F.exists(all_, lambda o: (o["kind"] < 4) & (o["start"] < s["end"]) & (s["start"] < o["end"]))
    held = let(let(spans, lambda all_: F.filter(all_, wanted)), lambda all_: F.transform(
        F.filter(all_, lambda s: apart(s, all_)),
        lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.xxhash64(_value(s)).alias("hash"))))
    named = docs.select("doc_id", F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), text_of().alias("text"))
    return saved(named.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository", F.sort_array(held).alias("found")))


def ownership(proposed: DataFrame) -> DataFrame:
    """(hash, owners, repositories): distinct holders of each candidate value."""
    held = proposed.select("owner", "repository", F.explode("found.hash").alias("hash"))
    by_owner = held.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("x")).groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Per row of docs (doc_id, base, spans, n_live, n_example): arrays of
    (start, kind, end), and how many of the spans look live or are examples."""
    proposed = propose(docs, owner, repository)
    spans = proposed.select("row", F.explode("found").alias("s"))
    judged = spans.join(ownership(proposed), spans["s.hash"] == F.col("hash")).select("row", F.struct("s.start", "s.kind", "s.end", ((F.col("owners") < EXAMPLE_OWNERS) & (F.col("repositories") < EXAMPLE_REPOSITORIES)).alias("live")).alias("s"))
    by_row = judged.groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("s"))
    base = F.filter("s", lambda x: x["kind"] < 3)
    added = F.filter("s", lambda x: (x["kind"] >= 3) & x["live"] & ~F.exists(F.filter("s", lambda b: b["kind"] < 3), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    bare = lambda a: F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = by_row.select("row", bare(base).alias("base"), F.sort_array(bare(F.concat(base, added))).alias("spans"), *[F.size(F.filter("s", keep)).cast("long").alias(name) for name, keep in (("n_live", lambda x: x["live"]), ("n_example", lambda x: ~x["live"]))])
    zero = F.lit(0).cast("long")
    return proposed.select("row", "doc_id").join(found, "row", "left").select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_example", zero).alias("n_example"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    counts = {f"n_{name}": of_kind(F.col("base"), k) for k, name in enumerate(KINDS[:3])}
    return found.withColumns(counts).select("doc_id", *counts, sha256(written(F.col("base"), KINDS)).alias("base_sha256"), written(F.col("spans"), KINDS).alias("spans"), "n_live", "n_example")
