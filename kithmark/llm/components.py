"""Group identifiers for pairwise matches: strip leaves, compress chains, solve the core, restore.

1. Vertices of degree one are removed and remember their neighbour; repeated.
2. Maximal chains of degree-two vertices are ranked by pointer doubling: each vertex learns both ends
   of its chain in a logarithmic number of joins; the chain becomes one edge between its ends.
3. When a round removes little, the reduced core is solved by alternating large-star and small-star
   steps, which end with every core vertex pointing at the smallest vertex of its component.
4. The removed vertices take their label from the vertex they point at, last removed first.
5. The label is exchanged for the smallest identifier of the component.

Everything is DataFrame joins and partial aggregates; each round is written to the shared checkpoint
folder; nothing but counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kithmark.operators.heavy_keys import skew_join
from kithmark.runtime import cut, free


def parse_links(matches: DataFrame, left: str, listed: str) -> DataFrame:
    """``left`` and untidy id lists as rows ``a, b``; b is null for a row that names nothing.

    Brackets, quotes and blanks around ids are dropped; empty entries and the words nan, none and null
    are no ids. A null list is an empty list.
    """
    ids = F.split(F.regexp_replace(F.coalesce(F.col(listed), F.lit("")), r"[\[\](){}'\"\s]+", " "), r"[,;| ]+")
    named = F.filter(F.array_distinct(ids), lambda x: (x != "") & ~F.lower(x).isin("nan", "none", "null", "na", "n/a", "-"))
    return matches.select(F.trim(left).alias("a"), F.explode_outer(named).alias("b"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _ordered(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")).distinct()


def _strip_leaves(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges without leaves, removed child -> parent). Of a lone pair the larger vertex is the leaf."""
    ends = _both_ways(edges).groupBy("u").agg(F.count(F.lit(1)).alias("deg"), F.min("v").alias("parent"))
    ones = ends.where("deg = 1").select(F.col("u").alias("child"), "parent")
    mutual = ones.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    lone = ones.join(mutual, ["child", "parent"], "left_semi").where("child < parent")
    leaves = cut(ones.join(lone, ["child", "parent"], "left_anti"))
    gone = leaves.select(F.least("child", "parent").alias("u"), F.greatest("child", "parent").alias("v"))
    return edges.join(gone, ["u", "v"], "left_anti"), leaves


def _compress_chains(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with each chain of degree-two vertices replaced by one edge, removed vertex -> end)."""
    ends = _both_ways(edges).groupBy("u").agg(F.count(F.lit(1)).alias("deg"), F.min("v").alias("a"), F.max("v").alias("b"))
    twos = cut(ends.where("deg = 2").select(F.col("u").alias("v"), "a", "b"))
    if twos.isEmpty():
        return edges, twos.select(F.col("v").alias("child"), F.col("a").alias("parent"))
    inner = twos.select(F.col("v").alias("at"), F.lit(True).alias("inner"))
    # a state is a vertex and the neighbour it was entered from; "at, since" is the state it points at
    walk = twos.selectExpr("v", "a as came", "b as at").unionByName(twos.selectExpr("v", "b as came", "a as at"))
    walk = cut(
        walk.join(inner, "at", "left").select(
            "v", "came", "at", F.col("v").alias("since"), F.coalesce("inner", F.lit(False)).alias("open"), F.col("v").alias("low")
        )
    )
    steps, states = 1, walk.count()
    while steps <= states and not walk.where("open").isEmpty():
        nxt = walk.selectExpr("v as at", "came as since", "at as at2", "since as since2", "open as open2", "low as low2")
        before, walk = walk, cut(
            walk.where("open").join(nxt, ["at", "since"]).select("v", "came", F.col("at2").alias("at"), F.col("since2").alias("since"), F.col("open2").alias("open"), F.least("low", "low2").alias("low"))
            .unionByName(walk.where("not open"))
        )
        free(before)
        steps *= 2
    chains = walk.groupBy("v").agg(
        F.min("at").alias("e1"), F.max("at").alias("e2"), F.bool_or("open").alias("ring"), F.min("low").alias("low")
    )
    chains = cut(chains)
    removed = chains.select(F.col("v").alias("child"), F.when(F.col("ring"), F.col("low")).otherwise(F.col("e1")).alias("parent")).where("child <> parent")
    new = _ordered(chains.where("not ring"), "e1", "e2")
    gone = chains.select(F.col("v"))
    rest = edges.join(gone.withColumnRenamed("v", "u"), "u", "left_anti").join(gone, "v", "left_anti").select("u", "v")
    return rest.unionByName(new).distinct(), removed


def _solve_core(edges: DataFrame) -> DataFrame:
    """``v, label`` by alternating large-star and small-star until nothing changes."""
    e, last = edges, None
    while True:
        near = _both_ways(e).groupBy("u").agg(F.min("v").alias("m"))
        near = near.select("u", F.least("u", "m").alias("m"))
        large = _both_ways(e).where("v > u").join(near, "u").selectExpr("m as x", "v as y")
        e1 = _ordered(large, "x", "y")
        # small star: every vertex and its smaller neighbours point at the smallest of them
        low = e1.groupBy("v").agg(F.min("u").alias("m"))
        small = e1.join(low, "v").select(F.col("m").alias("x"), F.col("u").alias("y")).unionByName(low.select(F.col("m").alias("x"), F.col("v").alias("y")))
        before, e = e, cut(_ordered(small, "x", "y"))
        if before is not edges:
            free(before)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return e.groupBy("v").agg(F.min("u").alias("label"))


def components(edges: DataFrame, left: str, right: str, *, core_share: float = 0.1) -> DataFrame:
    """``entity_id, group_id`` for every id in either column; group_id is the smallest id of the group.

    A null on one side makes the other a vertex without that link; rows with two nulls are ignored.
    Self links, repeated and reversed links change nothing; empty input gives an empty result; further
    columns are ignored. Rounds of stripping and compressing go on while they remove at least
    ``core_share`` of the remaining links.
    """
    links = edges.select(F.col(left).cast("string").alias("a"), F.col(right).cast("string").alias("b"))
    vertices = cut(links.select(F.col("a").alias("v")).unionByName(links.select(F.col("b").alias("v"))).where("v is not null").distinct())
    e = cut(_ordered(links.where("a is not null and b is not null"), "a", "b"))
    removed, left_over = [], e.count()
    while left_over:
        stripped, leaves = _strip_leaves(e)
        stripped = cut(stripped)
        rest, inner = _compress_chains(stripped)
        before, e = e, cut(rest)
        free(before, stripped)
        removed += [leaves, inner]
        before, left_over = left_over, e.count()
        if left_over > (1 - core_share) * before:
            break
    labels = vertices
    if removed:  # all that was removed, in one table
        gone = removed[0].select("child")
        for r in removed[1:]:
            gone = gone.unionByName(r.select("child"))
        labels = labels.join(gone.withColumnRenamed("child", "v"), "v", "left_anti")
    if left_over:
        labels = labels.join(_solve_core(e), "v", "left").select("v", F.coalesce("label", "v").alias("label"))
    else:
        labels = labels.select("v", F.col("v").alias("label"))
    labels = cut(labels)
    # each round needs the labels of what was removed after it, so the last goes first; adaptive execution splits the leaves of a hub
    for r in reversed(removed):
        back = r.join(labels.withColumnRenamed("v", "parent"), "parent").select(F.col("child").alias("v"), "label")
        before, labels = labels, cut(labels.unionByName(back))
        free(before)
    smallest = labels.groupBy("label").agg(F.min("v").alias("group_id"))
    return skew_join(labels, smallest, "label").select(F.col("v").alias("entity_id"), "group_id")
