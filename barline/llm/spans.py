"""Regular-expression matches with their places, as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

SPAN = "array<struct<kind:int,start:int,end:int,match:string,before:string,after:string>>"


def matches(text: Column, pattern: str, kind: int, maybe: Column, context: int = 24) -> Column:
    """All leftmost, non-overlapping matches of a pattern: array of (kind, start,
    end, match, before, after), in code points, end exclusive; before and after
    are up to ``context`` characters beside the match. Matches and the pieces
    between them come from the same scan order, so their lengths add up to the
    places. Texts for which ``maybe`` is false are not searched."""
    none = F.array().cast(SPAN)

    def located(found: Column) -> Column:
        def by_piece(pieces: Column) -> Column:
            start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), none.alias("out"))

            def step(acc: Column, m: Column) -> Column:
                begin = acc["at"] + F.length(F.get(pieces, acc["i"]))
                span = F.struct(
                    F.lit(kind).alias("kind"), begin.alias("start"), (begin + F.length(m)).alias("end"), m.alias("match"),
                    F.right(F.get(pieces, acc["i"]), F.lit(context)).alias("before"), F.left(F.get(pieces, acc["i"] + 1), F.lit(context)).alias("after"))
                return F.struct((begin + F.length(m)).alias("at"), (acc["i"] + 1).alias("i"), F.concat(acc["out"], F.array(span)).cast(SPAN).alias("out"))

            return F.aggregate(found, start, step, lambda acc: acc["out"])

        return F.when(F.size(found) == 0, none).otherwise(let(F.split(text, pattern, -1), by_piece))

    return F.when(maybe, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)).otherwise(none)


def written(spans: Column, names: tuple[str, ...]) -> Column:
    """``kind:start:end`` of spans in their order, comma-joined."""
    kinds = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
