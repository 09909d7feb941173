"""Rolling means, deviations and sums from running sums.

A frame that slides over n rows is aggregated anew at every row: n steps a row. Here each
series has running counts, sums and sums of squares instead, which begin anew in every
block of so many rows as the longest window has; a window then is the difference of two
rows of one block, or what a row of the block before leaves to that block's end plus what
the current block has so far. Values are taken against the first value of their block, so
that sums stay as small as the moves inside a window or two, and the two parts are brought
to one origin before they are added. That a window holds one value only is told by counts,
not by sums: its deviation is exactly 0.

All series and windows of a call share one numbering and one sort by block; the columns of
a series travel as one struct, with one ``lag`` for each length of window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import ALL, KEYS, TIME, ordered


@dataclass(frozen=True)
class Moment:
    """A statistic (mean, std of a sample, or sum) of a column over the last n rows, null
    if fewer than ``least`` of them have a value."""

    column: str
    n: int
    least: int
    kind: str = "mean"


def _origins(df: DataFrame, columns: list[str], size: int, keys: tuple[str, ...], time: str) -> DataFrame:
    """df with the block of each row and, as struct ``_o_k`` of series k, its value, the
    values seen so far, those before the last change of value, and the block's origin."""
    order = ordered(keys, time)
    before, now = order.rowsBetween(ALL, -1), order.rowsBetween(ALL, 0)
    x = [F.col(c).cast("double") for c in columns]
    out = df.withColumns({"_block": F.floor((F.row_number().over(order) - 1) / size)} | {f"_n_{k}": F.count(v).over(now) for k, v in enumerate(x)} | {f"_b_{k}": F.last(v, ignorenulls=True).over(before) for k, v in enumerate(x)})
    whole = Window.partitionBy(*keys, "_block").orderBy(time).rowsBetween(ALL, Window.unboundedFollowing)
    changed = lambda k, v: F.when(v.isNotNull() & ~v.eqNullSafe(F.col(f"_b_{k}")), F.col(f"_n_{k}") - 1)
    out = out.withColumns({f"_c_{k}": F.coalesce(F.max(changed(k, v)).over(now), F.lit(0)) for k, v in enumerate(x)})
    out = out.withColumns({f"_f_{k}": F.first(v, ignorenulls=True).over(whole) for k, v in enumerate(x)})
    told = {f"_o_{k}": F.struct((v - F.col(f"_f_{k}")).alias("v"), F.col(f"_n_{k}").alias("n"), F.col(f"_c_{k}").alias("c"), F.col(f"_f_{k}").alias("f")) for k, v in enumerate(x)}
    return out.withColumns(told).drop(*[f"_{a}_{k}" for a in "nbcf" for k in range(len(x))])


def _running(df: DataFrame, n: int, keys: tuple[str, ...], time: str) -> DataFrame:
    """Struct ``_s_k`` instead of ``_o_k``: with the running sums of the block, and with what
    is left of them after the row until the block ends."""
    order = Window.partitionBy(*keys, "_block").orderBy(time)
    now, whole = order.rowsBetween(ALL, 0), order.rowsBetween(ALL, Window.unboundedFollowing)
    sums = {"a": lambda v: F.count(v), "s": lambda v: F.sum(v), "q": lambda v: F.sum(v * v)}
    zero = F.lit(0.0)
    made = {f"_{name}{end}_{k}": F.coalesce(how(F.col(f"_o_{k}.v")).over(w), zero) for k in range(n) for name, how in sums.items() for end, w in (("0", now), ("1", whole))}
    out = df.withColumns(made)
    told = {f"_s_{k}": F.struct(F.col(f"_o_{k}.n").alias("n"), F.col(f"_o_{k}.c").alias("c"), F.col(f"_o_{k}.f").alias("f"), *[F.col(f"_{name}{end}_{k}").alias(name + end) for name in sums for end in "01"]) for k in range(n)}
    return out.withColumns(told).drop(*made, *[f"_o_{k}" for k in range(n)])


def _window(k: int, n: int) -> tuple[Column, Column, Column, Column, Column]:
    """(count, origin, sum, sum of squares, whether all values are equal) of series k over
    the last n rows."""
    now, then, same = F.col(f"_s_{k}"), F.col(f"_l_{n}.s{k}"), F.col(f"_l_{n}.block") == F.col("_block")
    zero = F.lit(0.0)
    part = lambda name: F.when(same, now[name + "0"] - then[name + "0"]).otherwise(now[name + "0"])
    left = lambda name: F.when(~same, then[name + "1"] - then[name + "0"]).otherwise(zero)
    origin = F.coalesce(now["f"], then["f"])
    shift = F.coalesce(then["f"] - origin, zero)
    a, s, q = (F.coalesce(left(name), zero) for name in "asq")
    own = {name: F.coalesce(part(name), now[name + "0"]) for name in "asq"}
    return own["a"] + a, origin, own["s"] + s + a * shift, own["q"] + q + 2 * shift * s + a * shift * shift, now["c"] <= F.coalesce(then["n"], F.lit(0))


def moments(df: DataFrame, wanted: dict[str, Moment], keys: tuple[str, ...] = KEYS, time: str = TIME) -> DataFrame:
    """df with a column for each wanted moment. Equal times of a key are in any order."""
    columns = list(dict.fromkeys(m.column for m in wanted.values()))
    lengths = sorted({m.n for m in wanted.values()})
    out = _running(_origins(df, columns, lengths[-1], keys, time), len(columns), keys, time)
    by_block = Window.partitionBy(*keys).orderBy("_block", time)  # the order of time, as the sums are sorted
    packed = F.struct(F.col("_block").alias("block"), *[F.col(f"_s_{k}").alias(f"s{k}") for k in range(len(columns))])
    out = out.withColumns({f"_l_{n}": F.lag(packed, n).over(by_block) for n in lengths})

    def told(m: Moment) -> Column:
        count, origin, total, squares, one = _window(columns.index(m.column), m.n)
        spread = F.when(one, 0.0).otherwise(F.greatest(squares - total * total / count, F.lit(0.0)))
        value = {
            "mean": lambda: origin + total / count, "sum": lambda: origin * count + total,
            "std": lambda: F.when(count > 1, F.sqrt(spread / F.nullif(count - 1, F.lit(0.0)))),
        }[m.kind]()
        return F.when(count >= m.least, value)

    out = out.withColumns({name: told(m) for name, m in wanted.items()})
    return out.drop("_block", *[f"_s_{k}" for k in range(len(columns))], *[f"_l_{n}" for n in lengths])


def correlation(x: str, y: str, flat: float = float("nan")) -> Column:
    """The correlation of two columns as an aggregate, ``flat`` where one of them has no
    spread (``corr`` ends the job there: it divides by the deviations)."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    spread = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    joint = F.covar_pop(a, b)
    return F.when(joint.isNotNull(), F.coalesce(F.try_divide(joint, spread), F.lit(flat)))
