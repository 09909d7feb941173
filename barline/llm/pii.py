"""PII: generators propose spans, boosted trees choose among them.

The base patterns of four kinds always stand. High-recall generators propose
more: mailboxes written out in words, number groups with other separators,
telephone numbers without a leading plus. A validator looks at each proposal (octet
range, check digit, digit count, country code, form of an address), and so do boosted
trees, which see small integer features of its format and of its context but not what
the validator looks at. They tell how often proposals that look alike pass. A further
span is added if it passes and its kind's threshold says that its likes do: a number
that meets a check digit among many that do not has met it by chance. Trees become
nested CASE expressions: scoring runs inside the scan, without a shuffle or a UDF.

Trees are fitted on the proposals of half of the documents, base and further ones
(grouped by feature vector, so the fit sees all of them but few rows). A kind's threshold
is the lowest margin above which the share of the other half's proposals of that kind
that pass is at least ``PASSING`` by its lower confidence bound; where a kind has too few
for any, that of all kinds together serves; where these are too few, nothing is added.

Defined results: a null text counts as empty and has no spans; repeated rows
give repeated rows; chosen proposals are taken by margin, then kind, then start, the
greatest first, each unless it overlaps a base span or one taken before; a null doc_id
is passed on; columns other than doc_id and text are ignored; with an empty table
nothing is fitted; where all proposals pass or none does, the margin is 0 for all.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, saved, table, text_of
from .spans import matches, of_kind, sha256, written

KINDS = ("email", "ip", "card", "phone")
# The base patterns, written so that no start inside a run is tried
# twice and no group repeats by recursion.
LOCAL = r"[A-Za-z0-9._%+-]"
BASE = (
    rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: Further proposals, by kind.
WIDE = (
    rf"(?:\G|(?<!{LOCAL})){LOCAL}++(?:\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]{1,3}+(?:\x20?[\[(]\.[\])]\x20?|\x20\.\x20)[0-9]{1,3}+(?:\x20?[\[(]?\.[\])]?\x20?)[0-9]{1,3}+(?:\x20?[\[(]?\.[\])]?\x20?)[0-9]{1,3}+",
    r"(?<![0-9])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{4,7}(?![0-9])",
    r"(?<![0-9+.-])(?:00[1-9][0-9]{0,2}[\x20.-]|\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
)
#: Every match of the first of them has this inside, or is not searched for.
WRITTEN_AT = r"(?:[\[(]\x20?at\x20?[\])]|\x20at\x20)"
#: Words that stand before a plain "at" in prose; they are no mailbox there.
#: Names that mailboxes have (info, contact, office) are not among them.
PROSE = "|".join("a all also and any are around arrive arrived at available back be been before begin begins but buy by can directly down each find first for found free from go good have held here home hosted i in is it join last later less live located look looking me meet met more most not now of on only open or out over place published read see seen starts stay stop that the them then there these they this time to today up us view visit was we were write you".split())
#: Assigned country calling codes.
COUNTRIES = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[12368]|2[2-4][0-9]|25[0-8]|26[0-9]|29[01789]|3[578][0-9]|42[0-9]|50[0-9]|59[0-9]|67[0-9]|68[0-9]|69[0-2]|80[08]|85[0-9]|87[0-9]|88[0-9]|96[0-9]|97[0-9]|99[2-68])"
HINTS = (r"(?i)(mail|contact|write|reach)", r"(?i)(\bip\b|host|server|addr)", r"(?i)(card|visa|pay|credit)", r"(?i)(phone|call|tel|fax|mobile)")
FEATURES = ("kind", "wide", "length", "digits", "groups", "hint", "glued_before", "glued_after", "spaces", "brackets")
#: Share of alike proposals that pass, at least, for one of them to be added.
PASSING = 0.9
#: Deviations that its lower bound is away from the share itself.
BOUND = 1.645
#: One document in so many is kept from the fit; thresholds are set on its proposals.
HELD_OUT = 2
TREES, DEPTH = 8, 3
SPANS = "array<struct<kind:int,start:int,end:int>>"


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def worth(c: Column, i: Column) -> Column:
        v = c.cast("int") * (1 + i % 2)
        return v - F.when(v > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, v: a + v) % 10 == 0


def octets(match: Column) -> Column:
    return F.forall(F.split(F.regexp_replace(match, r"[^0-9.]", ""), r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def valid(s: Column) -> Column:
    """What the validators of a span's kind say."""
    n = F.length(digits_of(s["match"]))
    return (
        F.when(s["kind"] == 0, F.lit(True))
        .when(s["kind"] == 1, octets(s["match"]))
        .when(s["kind"] == 2, F.when(n.between(16, 19), luhn(digits_of(s["match"]))).otherwise(False))
        .otherwise(n.between(8, 15))
    )


def mailbox(match: Column) -> Column:
    """Whether a mailbox written with "at" reads as an address: dots inside names only,
    labels that neither begin nor end in a hyphen, a top-level domain of letters of
    one case, and no word of prose before a plain "at" with a plain domain."""
    plain = F.regexp_replace(F.regexp_replace(match, r"\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20at\x20", "@"), r"\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20", ".")
    shape = plain.rlike(r"^[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+(?:[a-z]{2,24}|[A-Z]{2,24})$")
    return shape & ~match.rlike(rf"^(?i:{PROSE})\x20at\x20[A-Za-z0-9.-]+$")


def telephone(match: Column) -> Column:
    """Whether a number without a plus is of a country calling code that is assigned,
    or keeps the ten-digit plan: area code and exchange from 2 on, neither ends in 11."""
    digits = digits_of(match)
    return F.when(match.startswith("00"), match.rlike(rf"^00{COUNTRIES}[\x20.-]")).otherwise(digits.rlike(r"^[2-9](?!11)[0-9]{2}[2-9](?!11)[0-9]{2}[0-9]{4}$"))


def verdict(s: Column) -> Column:
    """What is said of a wide proposal: that of its kind, and more where the kind's
    own accepts all that the generator finds."""
    return F.when(s["kind"] == 0, mailbox(s["match"])).when(s["kind"] == 3, valid(s) & telephone(s["match"])).otherwise(valid(s))


def _found(text: Column, patterns: tuple[str, ...]) -> Column:
    digit = text.rlike("[0-9]")
    maybe = (text.contains("@") if patterns is BASE else text.rlike(WRITTEN_AT + r"\x20?[A-Za-z0-9-]++(?:\x20?[\[(]\x20?dot|\x20dot\x20|\.)"), digit, digit, text.contains("+") & digit if patterns is BASE else digit)
    return F.concat(*[matches(text, p, k, m) for k, (p, m) in enumerate(zip(patterns, maybe, strict=True))])


def _features(s: Column, wide: int) -> Column:
    hint = F.lit(False)
    for k, words in enumerate(HINTS):
        hint = F.when(s["kind"] == k, s["before"].rlike(words)).otherwise(hint)
    as_int = lambda c: c.cast("int")
    return F.struct(
        s["kind"].alias("kind"), F.lit(wide).alias("wide"), F.least(F.length(s["match"]), F.lit(40)).alias("length"),
        F.least(F.length(digits_of(s["match"])), F.lit(24)).alias("digits"), F.least(F.regexp_count(s["match"], F.lit("[0-9]+")), F.lit(8)).alias("groups"),
        as_int(hint).alias("hint"), as_int(s["before"].rlike(r"[\p{L}0-9]$")).alias("glued_before"), as_int(s["after"].rlike(r"^[\p{L}0-9]")).alias("glued_after"),
        F.least(F.regexp_count(s["match"], F.lit(" ")), F.lit(4)).alias("spaces"), F.least(F.regexp_count(s["match"], F.lit(r"[\[(]")), F.lit(3)).alias("brackets"))


def propose(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, base, proposals): base spans that their
    validators accept, and all proposals with features and the verdict."""
    text = F.col("text")

    def described(spans: Column, wide: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _features(s, wide).alias("f"), (verdict(s) if wide else valid(s)).alias("valid")))

    both = F.struct(_found(text, BASE).alias("base"), _found(text, WIDE).alias("wide"))
    return (
        docs.select("doc_id", text_of().alias("text"), (F.pmod(F.xxhash64("doc_id", "text"), F.lit(HELD_OUT)) == 0).alias("held_out"))
        .withColumn("found", F.when(text.rlike(r"[0-9@]") | text.rlike(WRITTEN_AT), let(both, lambda b: F.struct(
            F.transform(F.filter(b["base"], valid), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("base"),
            F.concat(described(b["base"], 0), described(b["wide"], 1)).alias("proposals")))))
        .select("doc_id", "held_out", "found.base", "found.proposals")
    )


def _tree_sql(text: str) -> str:
    """A fitted tree, as printed, as a nested CASE over the fields of ``f``."""
    lines = [x for x in text.split("\n") if re.search(r"If|Else|Predict", x)]

    def node() -> str:
        line = lines.pop(0)
        if "Predict" in line:
            return f"CAST({line.split(':')[1].strip()} AS DOUBLE)"
        k, bound = re.search(r"feature (\d+) <= ([-0-9.E]+)", line).groups()
        left = node()
        lines.pop(0)
        return f"CASE WHEN f.{FEATURES[int(k)]} <= {bound} THEN {left} ELSE {node()} END"

    return node()


def lower_bound(hits: float, n: float) -> float:
    """Of a share of hits among n, Wilson's."""
    share, z = hits / n, BOUND * BOUND / n
    return (share + z / 2 - (z * (share * (1 - share) + z / 4)) ** 0.5) / (1 + z)


def threshold(by_margin: list[tuple[float, float, float]]) -> float | None:
    """The lowest margin of (margin, hits, n) from which on enough pass."""
    cut, hits, n = None, 0.0, 0.0
    for margin, more, of in sorted(by_margin, reverse=True):
        hits, n = hits + more, n + of
        if lower_bound(hits, n) >= PASSING:
            cut = margin
    return cut


def fit(proposed: DataFrame) -> tuple[str, dict[int, float]] | None:
    """(margin as SQL over f, threshold by kind). The grouped table has a row per
    feature vector, whose number the feature ranges bound."""
    seen = proposed.select("held_out", F.explode("proposals").alias("p")).groupBy("held_out", "p.f", "p.valid").agg(F.count("*").alias("n"))
    rows = saved(seen.select("held_out", "f.*", F.col("valid").cast("double").alias("label"), F.col("n").cast("double").alias("weight")))
    learned = rows.filter("not held_out")
    labels = len(learned.select("label").distinct().take(2))
    if labels == 0:
        return None
    margin = "0.0D"
    if labels == 2:
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(learned)
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, weightCol="weight", seed=7).fit(vectors)
        margin = " + ".join(f"{w!r} * ({_tree_sql(t.toDebugString)})" for t, w in zip(model.trees, model.treeWeights, strict=True))
    told = rows.filter("held_out").withColumn("f", F.struct(*FEATURES)).select("f.kind", F.expr(margin).cast("double").alias("m"), "label", "weight")
    # a row per kind and sum of leaves, which the trees bound
    by_margin = [tuple(r) for r in told.groupBy("kind", "m").agg(F.sum(F.col("label") * F.col("weight")).alias("hits"), F.sum("weight").alias("n")).collect()]
    together = threshold([r[1:] for r in by_margin])
    cuts = {kind: threshold([r[1:] for r in by_margin if r[0] == kind]) for kind in range(len(KINDS))}
    few = {kind: lower_bound(n, n) < PASSING for kind in cuts for n in [sum(r[3] for r in by_margin if r[0] == kind) or 1.0]}
    cuts = {kind: together if cut is None and few[kind] else cut for kind, cut in cuts.items()}
    return margin, {kind: cut for kind, cut in cuts.items() if cut is not None}


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) per row of docs: arrays of (kind, start, end), by
    kind, then start. ``spans`` has the base spans and what the trees add."""
    proposed = saved(propose(docs))
    fitted = fit(proposed)
    if fitted is None:
        base = F.coalesce("base", F.array().cast(SPANS))
        return proposed.select("doc_id", F.sort_array(base).alias("base"), F.sort_array(base).alias("spans"))
    return chosen(proposed, *fitted)


def chosen(proposed: DataFrame, margin: str, cut: dict[int, float]) -> DataFrame:
    """(doc_id, base, spans): base spans and the proposals that pass, reach their kind's
    threshold and overlap no span of a greater margin that was taken."""
    base = F.coalesce("base", F.array().cast(SPANS))
    scored = f"transform(proposals, p -> struct(({margin.replace('f.', 'p.f.')}) AS margin, p.kind, p.start, p.end, p.valid AND p.f.wide = 1 AS open))"
    wanted = " OR ".join(f"(p.kind = {k} AND p.margin >= CAST({m!r} AS DOUBLE))" for k, m in cut.items()) or "false"
    ranked = F.sort_array(F.expr(f"filter({scored}, p -> p.open AND ({wanted}))"), asc=False)

    def clashes(p: Column, others: Column) -> Column:
        return F.exists(others, lambda o: (o["start"] < p["end"]) & (p["start"] < o["end"]))

    def take(taken: Column, p: Column) -> Column:
        span = F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end"))
        return F.when(clashes(p, taken), taken).otherwise(F.concat(taken, F.array(span)))

    spans = F.coalesce(F.aggregate(ranked, base, take), base)
    return proposed.select("doc_id", F.sort_array(base).alias("base"), F.sort_array(spans).alias("spans"))


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with each span replaced by its kind in angle brackets; spans that
    overlap one before them are skipped. doc_id must be unique in both."""
    ordered = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    text = text_of()
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = F.aggregate(ordered, start, lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(
        s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.get(names, s["kind"])).alias("out"))),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return docs.join(found.select("doc_id", "spans"), "doc_id").withColumn("text", cut).drop("spans")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = {f"n_{name}": of_kind(F.col("base"), k) for k, name in enumerate(KINDS)}
    return found.withColumns(counts).select("doc_id", *counts, sha256(written(F.col("base"), KINDS)).alias("base_sha256"), written(F.col("spans"), KINDS).alias("spans"))
