"""Links between members of buckets, and the components they form.

A bucket holds ids that may be linked. Comparing all pairs of a bucket would grow
with the square of a group of copies, so it happens in steps. First every
member is compared with one member of its bucket, the hub, and components are
formed of the links found; links inside a component cannot change it. Buckets that then
hold several components are open: only their members can have further links. In a
bucket of up to ``SMALL`` members all pairs across components are compared. The
members of larger ones, such as groups of edited copies, which may all be in each of
their buckets, get new buckets: prefixes of their token sets
under an order of their own, rare tokens first. Tokens that one copy alone has
come before all that it shares, so a copy with many edits keeps no shared token in
its prefix, or one so late that too few tokens follow (see ``enough_left``). The new
buckets are compared by hubs again, and only members outside the component of
their bucket's hub are then compared with the others of the bucket.
No link between open members is lost: linked sets share a prefix token under any
order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, tidied

Get = Callable[[str], Column]
#: Members of a bucket whose pairs are all compared: a constant number for each row.
SMALL = 24


def _nearest(edges: DataFrame) -> DataFrame:
    """(u, m): the least of each node and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _nearest(both)
    return both.filter("v > u").join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _nearest(down)
    moved = down.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").unionByName(near.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b): the least id it is linked
    with, over any number of links. Alternates large and small stars, each round
    written out, until the links are stars."""
    edges = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        heads = edges.select(F.col("v").alias("u")).distinct()
        chained = edges.join(heads, "u", "left_semi").select("u")
        doubled = edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
        with tidied(links.sparkSession):
            if not chained.unionByName(doubled).take(1):
                break
        edges = saved(_small_star(_large_star(edges)))
    heads = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(heads)


def prefixes(tokens: DataFrame, similar: int, of: int) -> DataFrame:
    """(key, id, n, pos) of token sets (id, token), distinct rows: the tokens that
    others have too among the first ``n - ceil(similar n / of) + 1`` of each set, in
    the order of rare tokens first, and their places in it."""
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    both = tokens.join(shared, "token", "left")
    sets = both.groupBy("id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("df").isNotNull(), F.struct("df", "token")))).alias("known"))
    # tokens of one set alone come first, so the others' places are counted from the end
    p = F.expr(f"cast(n - ({similar} * n + {of - 1}) div {of} + 1 - (n - size(known)) as int)")
    placed = sets.select("id", "n", F.size("known").alias("m"), F.posexplode(F.slice("known", F.lit(1), F.greatest(p, F.lit(0)))).alias("i", "t"))
    return placed.select(F.col("t.token").alias("key"), "id", "n", (F.col("n") - F.col("m") + F.col("i")).alias("pos"))


def enough_left(similar: int, of: int) -> Callable[[Get, Get], Column]:
    """At its first common token, a linked pair still has enough tokens left."""

    def fits(x: Get, y: Get) -> Column:
        return (of + similar) * F.least(x("n") - x("pos"), y("n") - y("pos")) >= similar * (x("n") + y("n"))

    return fits


def _with_hubs(rows: DataFrame, fits: Callable[[Get, Get], Column], hub_by: tuple[str, ...]) -> DataFrame:
    """(a, b): each member of a bucket with the bucket's hub, where that fits."""
    more = [c for c in rows.columns if c not in ("key", "id", *hub_by)]
    least = F.min(F.struct(*hub_by, "id", *more)).alias("hub")
    hub = rows.groupBy("key").agg(least, F.count("*").alias("n_rows")).filter("n_rows > 1").select("key", "hub")
    met = rows.join(hub, "key").filter(F.col("id") != F.col("hub.id")).filter(fits(lambda c: F.col(c), lambda c: F.col("hub")[c]))
    return met.select(F.least("hub.id", "id").alias("a"), F.greatest("hub.id", "id").alias("b")).distinct()


def _named(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _ends(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """(a, b, of_a, of_b): pairs with the components of their members."""
    of = lambda name: comps.select(F.col("id").alias(name), F.col("component").alias(f"of_{name}"))
    named = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return named.withColumns({"of_a": F.coalesce("of_a", "a"), "of_b": F.coalesce("of_b", "b")})


def _merged(comps: DataFrame, found: DataFrame) -> DataFrame:
    """Components with the links found since: only the components that these join go
    through further rounds, each as one node."""
    ends = saved(_ends(found, comps))
    joined = saved(components(ends.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))))
    alone = ends.select(F.explode(F.array("of_a", "of_b")).alias("id")).distinct().join(comps, "id", "left_anti")
    nodes = comps.unionByName(alone.select("id", F.col("id").alias("component")))
    moved = nodes.join(joined.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
    return saved(moved.select("id", F.coalesce("to", "component").alias("component")))


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose members are in different components."""
    return _ends(pairs, comps).filter("of_a <> of_b").select("a", "b")


def _across(rows: DataFrame, comps: DataFrame, fits: Callable[[Get, Get], Column], hub_by: tuple[str, ...], most: int | None = None) -> DataFrame:
    """(a, b): the members of a bucket (of ``most`` rows, where given) that are outside
    its hub's component, with the bucket's other members of other components, where
    they fit."""
    more = [c for c in rows.columns if c not in ("key", "id")]
    named = saved(_named(rows, comps))
    hub = named.groupBy("key").agg(F.min(F.struct(*hub_by, "id", "component")).alias("hub"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n_rows"))
    hub = hub.filter("lo < hi" if most is None else f"lo < hi and n_rows between 3 and {most}")
    split = named.join(hub.select("key", F.col("hub.component").alias("of_hub")), "key")
    left = split.filter("component <> of_hub").select("key", "component", F.col("id").alias("x"), *[F.col(c).alias(f"x_{c}") for c in more])
    right = split.select("key", F.col("component").alias("other"), "of_hub", F.col("id").alias("y"), *[F.col(c).alias(f"y_{c}") for c in more])
    # a pair outside the hub's component is met twice: once is enough
    apart = F.expr("component <> other and (other = of_hub or x < y)") & fits(lambda c: F.col(f"x_{c}"), lambda c: F.col(f"y_{c}"))
    return left.join(right, "key").filter(apart).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def link_buckets(rows: DataFrame, verify: Callable[[DataFrame], DataFrame], tokens_of: Callable[[DataFrame], DataFrame], similar: int, of: int, fits: Callable[[Get, Get], Column], hub_by: tuple[str, ...] = ()) -> DataFrame:
    """(id, component) of the ids that ``verify`` links, where rows (key, id and
    further columns) says which ids share a bucket. ``verify`` takes pairs (a, b)
    and returns those that are linked: whose sets have ``similar`` of ``of`` parts
    of their union in common. ``tokens_of`` takes ids and returns their sets as
    distinct rows (id, token). ``fits`` gives a condition on the further columns of
    two rows that a linked pair meets in one bucket at least; ``hub_by`` names
    columns that are least for the member which the others of a bucket are likeliest
    to be linked with."""
    tried = saved(_with_hubs(rows, fits, hub_by))
    comps = saved(components(saved(verify(tried))))

    def compared(pairs: DataFrame, comps: DataFrame, tried: DataFrame) -> tuple[DataFrame, DataFrame]:
        new = saved(pairs.join(tried, ["a", "b"], "left_anti"))
        if not new.take(1):
            return comps, tried
        found = saved(verify(new))
        return (_merged(comps, found) if found.take(1) else comps), tried.unionByName(new)

    comps, tried = compared(_across(rows, comps, fits, hub_by, SMALL), comps, tried)
    spread = _named(rows, comps).groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n_rows")).filter(f"lo < hi and n_rows > {SMALL}").select("key")
    open_ids = saved(rows.join(spread, "key", "left_semi").select("id").distinct())
    if not open_ids.take(1):
        return comps
    again, left = saved(prefixes(tokens_of(open_ids), similar, of)), enough_left(similar, of)
    comps, tried = compared(_apart(_with_hubs(again, left, ("pos",)), comps), comps, tried)
    comps, _ = compared(_across(again, comps, left, ("pos",)), comps, tried)
    return comps
