"""Questions about an edge table (src, dst and further columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.sources.paths import discard, stored


def hubs(edges: DataFrame, least: int = 2) -> DataFrame:
    """(dst, degree): nodes that at least so many different nodes point to."""
    got = edges.select("src", "dst").distinct().groupBy("dst").agg(F.count(F.lit(1)).alias("degree"))
    return got.where(F.col("degree") >= least).orderBy(F.col("degree").desc(), "dst")


def hub_sources(edges: DataFrame, least: int = 2) -> DataFrame:
    """(dst, src): who points to a hub, a row each, so that no node's sources are gathered."""
    return edges.select("src", "dst").distinct().join(hubs(edges, least).select("dst"), "dst", "left_semi").select("dst", "src")


def star_hubs(edges: DataFrame) -> DataFrame:
    return hubs(edges, 3)


def chains(edges: DataFrame, least: int = 2, most: int = 4) -> DataFrame:
    """(path, hops): directed paths of ``least`` to ``most`` hops that meet no node twice."""
    pairs = edges.select("src", "dst").where("src <> dst").distinct()
    path = pairs.select(F.array("src", "dst").alias("path"))
    out = None
    for hops in range(2, most + 1):
        step = path.join(pairs, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        path = step.select(F.array_append("path", F.col("dst")).alias("path"))
        if hops >= least:
            found = path.withColumn("hops", F.lit(hops))
            out = found if out is None else out.unionByName(found)
    return out.orderBy(F.col("hops").desc(), "path")


def weak_edges(edges: DataFrame, below: float = 0.5, column: str = "ref_integrity") -> DataFrame:
    return edges.where(F.col(column) < below).orderBy(column, "src", "dst")


def shortest_path(edges: DataFrame, start: str, goal: str, hops: int = 3, directed: bool = False) -> DataFrame:
    """(path, hops): the shortest way from start to goal, the first in order if there are several;
    empty if it is longer than ``hops``. Edges are taken in either direction; with ``directed`` only
    along them, and if there is no such way, from goal to start, given back in that order.

    A frontier keeps one way a node, and nodes seen before are left out, so it never grows beyond
    the nodes of the graph."""
    ways = edges.select("src", "dst")
    if directed:
        there = _search(ways, start, goal, hops)
        return there if there.limit(1).count() else _search(ways, goal, start, hops)
    return _search(ways.unionByName(ways.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), start, goal, hops)


def _search(ways: DataFrame, start: str, goal: str, hops: int) -> DataFrame:
    ways = ways.where("src <> dst").distinct()
    front = ways.sparkSession.createDataFrame([(start, [start])], "node string, path array<string>")
    seen = front.select("node")
    for n in range(1, hops + 1):
        step = front.join(ways, F.col("node") == F.col("src")).groupBy("dst").agg(F.min(F.array_append("path", F.col("dst"))).alias("path"))
        front = stored(step.select(F.col("dst").alias("node"), "path").join(seen, "node", "left_anti"))
        found = front.where(F.col("node") == goal)
        if found.limit(1).count():
            return found.select("path", F.lit(n).alias("hops"))
        seen = stored(seen.unionByName(front.select("node")))
    return front.limit(0).select("path", F.lit(0).alias("hops"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges in either direction.

    Alternating large-star and small-star steps until nothing changes: each is two aggregations and
    a join, and their number grows with the logarithm of the longest path, in whatever order its
    nodes are. Each round is written before the next; a node whose only edges lead to itself is a
    component of its own."""
    ends = edges.where("src is not null and dst is not null")
    nodes = stored(ends.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    now = stored(ends.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    before = None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before or mark[0] == 0:
            break
        before = mark
        # Large star: everything larger than u links to u's smallest neighbour.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = stored(both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # Small star: u and everything smaller than u link to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, now = now, stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        discard(last, large)
    return nodes.join(now, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("component"))


def cluster_labels(components_: DataFrame, sizes: DataFrame) -> DataFrame:
    """(component, label): the first name token if all members begin with the same one, else the
    largest member (of equally large ones the last in order). A single member is its own label.

    ``sizes`` has node and size. Members are reduced by aggregates, never gathered."""
    first = F.split(F.lower("node"), "_")[0]
    rows = components_.join(sizes, "node", "left").withColumn("first", first)
    largest = F.max(F.struct(F.coalesce("size", F.lit(0)).alias("s"), "node"))
    got = rows.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.min("first").alias("low"), F.max("first").alias("high"), largest.alias("m"))
    shared = (F.col("members") > 1) & (F.col("low") == F.col("high")) & (F.col("low") != "")
    return got.select("component", F.when(shared, F.col("low")).otherwise(F.col("m.node")).alias("label"))


def kin(items: DataFrame, key: str, tokens: str, least: int = 3) -> DataFrame:
    """(a, b, shared): pairs of items, a the smaller, that share at least so many tokens.

    Of two items with enough in common, both rank each other within the rarest tokens they hold: an
    item is only indexed under all but its ``least - 1`` most common tokens, so the most frequent
    ones carry no pairs of their own."""
    flat = items.select(F.col(key).alias("k"), F.explode(F.array_distinct(tokens)).alias("token")).where("token is not null")
    often = flat.groupBy("token").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    held = flat.join(often, "token")
    own = held.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("ts")).where(F.size("ts") >= least)
    sets = own.select("k", F.transform("ts", lambda t: t["token"]).alias("all"), F.explode(F.slice(F.transform("ts", lambda t: t["token"]), 1, F.size("ts") - (least - 1))).alias("probe"))
    a, b = sets.alias("a"), sets.alias("b")
    pairs = a.join(b, (F.col("a.probe") == F.col("b.probe")) & (F.col("a.k") < F.col("b.k"))).select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), F.size(F.array_intersect("a.all", "b.all")).alias("shared"))
    return pairs.where(F.col("shared") >= least).distinct()


def kin_groups(items: DataFrame, key: str, tokens: str, least: int = 3) -> DataFrame:
    """(item, leader): items taken in order, each one that is still free leads all free ones that are
    akin to it. Followers are akin to their leader, not necessarily to each other.

    Leaders are found in rounds: whoever has no smaller free kin leads, and the kin of leaders are
    taken. In the end each taken item follows the smallest leader among its kin."""
    pairs = stored(kin(items, key, tokens, least).select("a", "b"))
    free, taken = pairs, None
    while free.limit(1).count():
        lead = stored(free.select(F.col("a").alias("x")).distinct().join(free.select(F.col("b").alias("x")).distinct(), "x", "left_anti"))
        follow = stored(free.join(lead, free["a"] == lead["x"]).select(F.col("b").alias("x")).distinct())
        taken = follow if taken is None else taken.unionByName(follow)
        gone = lead.unionByName(follow)
        rest = free.join(gone.withColumnRenamed("x", "a"), "a", "left_anti").join(gone.withColumnRenamed("x", "b"), "b", "left_anti").select("a", "b")
        last, free = free, stored(rest)
        discard(lead, last if last is not pairs else None)
    # Whoever is never taken leads, with or without kin that others took later.
    leads = pairs if taken is None else pairs.join(taken.withColumnRenamed("x", "a"), "a", "left_anti")
    return leads.groupBy(F.col("b").alias("item")).agg(F.min("a").alias("leader"))
