"""Multi-route candidate generation with stop keys and a cap per primary record.

All routes are one equi-join: both sides become long tables of (country, route, key), target blocks are cut
to their first ``cap`` ids before the join, so a block of any size sends at most ``cap`` ids to a record, and
the cap over all routes is a fold over at most ``routes * cap`` ids per record.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from kithmark.functions.text import address_number, blocking_address, blocking_name


@dataclass(frozen=True)
class Caps:
    """Most rows a stop key may have on the target side before the routes that use it ignore it."""

    token1: int = 800
    token2: int = 600
    token3: int = 600
    address: int = 400


@dataclass(frozen=True)
class Route:
    number: int
    left: str
    right: str
    guard: str
    stop: str | None = None


#: Expressions over the columns of ``blocking_view``; the guard is on the primary side.
ROUTES = [
    Route(1, "name_norm", "name_norm", "length(name_norm) >= 3"),
    Route(2, "tok1", "tok1", "length(tok1) >= 3", "token1"),
    Route(3, "tok1", "tok2", "length(tok1) >= 4", "token2"),
    Route(4, "tok2", "tok1", "length(tok2) >= 4", "token1"),
    Route(5, "tok2", "tok2", "length(tok2) >= 4", "token2"),
    Route(6, "tok3", "tok3", "length(tok3) >= 4", "token3"),
    Route(7, "addr9", "addr9", "length(clean_addr) >= 9", "address"),
    Route(8, "concat(addr_num, '|', name3)", "concat(addr_num, '|', name3)", "addr_num <> '' and length(clean_name) >= 3"),
    Route(9, "name4", "name4", "length(clean_name) >= 4"),
]
PRODUCTION = tuple(range(1, 9))


def blocking_view(df: DataFrame) -> DataFrame:
    """``id, country, name_norm, clean_name, clean_addr, addr_num, tok1..3, addr9, name3, name4``; '' for nulls."""
    name = blocking_name(F.col("business_name_normalized"))
    base = df.select(
        F.col("entity_id").alias("id"), F.coalesce("country_clean", F.lit("")).alias("country"),
        F.coalesce("business_name_normalized", F.lit("")).alias("name_norm"), name.alias("clean_name"),
        blocking_address(F.col("business_address_normalized")).alias("clean_addr"),
        address_number(F.col("business_address_normalized")).alias("addr_num"),
    )
    tok = {f"tok{k}": F.split_part("clean_name", F.lit(" "), F.lit(k)) for k in (1, 2, 3)}
    return base.withColumns(tok | {"addr9": F.substring("clean_addr", 1, 9), "name3": F.substring("clean_name", 1, 3), "name4": F.substring("clean_name", 1, 4)})


def stop_keys(right: DataFrame, caps: Caps) -> DataFrame:
    """``country, kind, key``: keys with more target rows than their cap, all kinds in one aggregation."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in (("token1", "tok1"), ("token2", "tok2"), ("token3", "tok3"))],
                    F.struct(F.lit("address").alias("kind"), F.when(F.length("clean_addr") >= 9, F.col("addr9")).alias("key")))
    each = right.where("country <> ''").select("country", F.explode(kinds).alias("s")).select("country", "s.kind", "s.key").where("key is not null")
    cap = F.when(F.col("kind") == "token1", caps.token1).when(F.col("kind") == "address", caps.address).when(F.col("kind") == "token2", caps.token2).otherwise(caps.token3)
    return each.groupBy("country", "kind", "key").count().where(F.col("count") > cap).select("country", "kind", "key", "count")


def _keys(view: DataFrame, routes: list[Route], side: str) -> DataFrame:
    """``id, country, route, kind, key`` in one explode."""
    guards = lambda r: F.expr(r.guard) if side == "left" else F.lit(True)
    each = [F.when(guards(r), F.struct(F.lit(r.number).alias("route"), F.lit(r.stop).cast("string").alias("kind"), F.expr(getattr(r, side)).alias("key"))) for r in routes]
    return view.where("country <> ''").select("id", "country", F.explode(F.array_compact(F.array(*each))).alias("s")).select("id", "country", "s.*").where("key <> ''")


def route_keys(left: DataFrame, right: DataFrame, caps: Caps, routes) -> tuple[DataFrame, DataFrame]:
    """Long key tables of both sides; primary keys that are stop keys are gone."""
    use = [r for r in ROUTES if r.number in set(routes)]
    l, r = _keys(left, use, "left").distinct(), _keys(right, use, "right").drop("kind").distinct()
    stops = stop_keys(right, caps).drop("count")
    return l.join(stops, ["country", "kind", "key"], "left_anti").drop("kind"), r


def route_sizes(left: DataFrame, right: DataFrame, caps: Caps = Caps(), routes=PRODUCTION) -> DataFrame:
    """``route, s1_id, n_targets`` without forming the pairs."""
    l, r = route_keys(left, right, caps, routes)
    blocks = r.groupBy("country", "route", "key").agg(F.count_distinct("id").alias("n_targets"))
    return l.join(blocks, ["country", "route", "key"]).select("route", F.col("id").alias("s1_id"), "n_targets")


def capped_lists(left: DataFrame, right: DataFrame, caps: Caps = Caps(), routes=PRODUCTION, cap: int = 15) -> DataFrame:
    """``s1_id, targets``: at most ``cap`` targets of a record.

    The routes are folded in order. In each, the first ids of the route that fit into the remaining slots are
    taken, those included that an earlier route has brought already, whose slot is thereby lost.
    """
    return fold_blocks(left, target_blocks(right, caps, routes, cap), routes, cap)


def target_blocks(right: DataFrame, caps: Caps = Caps(), routes=PRODUCTION, cap: int = 15) -> DataFrame:
    """``country, route, key, stop, ids``: every block of the targets cut to its first ``cap`` ids; ``stop``: its key is a stop key of the route."""
    use = [r for r in ROUTES if r.number in set(routes)]
    keys = _keys(right, use, "right").distinct()
    w = Window.partitionBy("country", "route", "key").orderBy("id")
    blocks = keys.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap)
    blocks = blocks.groupBy("country", "route", "kind", "key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    stops = stop_keys(right, caps).drop("count").withColumn("stop", F.lit(True))
    return blocks.join(stops, ["country", "kind", "key"], "left").select("country", "route", "key", F.coalesce("stop", F.lit(False)).alias("stop"), "ids")


def fold_blocks(left: DataFrame, blocks: DataFrame, routes=PRODUCTION, cap: int = 15) -> DataFrame:
    """``s1_id, targets`` of primary records against prepared blocks; only the keys of the primary records are formed."""
    use = [r for r in ROUTES if r.number in set(routes)]
    l = _keys(left, use, "left").drop("kind").distinct()
    per = l.join(blocks.where("not stop").drop("stop"), ["country", "route", "key"]).groupBy("country", "id").agg(F.sort_array(F.collect_list(F.struct("route", "ids"))).alias("routes"))
    fold = F.aggregate("routes", F.array().cast("array<string>"), lambda acc, r: F.array_union(acc, F.slice(r["ids"], F.lit(1), F.lit(cap) - F.size(acc))))
    return per.select(F.col("id").alias("s1_id"), fold.alias("targets")).where(F.size("targets") > 0)


def candidate_pairs(left: DataFrame, right: DataFrame, **kw) -> DataFrame:
    return capped_lists(left, right, **kw).select("s1_id", F.explode("targets").alias("target_id"))


def all_candidates(left: DataFrame, right: DataFrame, routes=PRODUCTION) -> DataFrame:
    """``s1_id, target_id``: every pair that any route brings, without stop keys and without a cap; the exact way beside ``candidate_pairs``.

    Its size is that of the blocks multiplied; blocks of frequent keys are spread over salts, so that none is one task.
    """
    none = 2**62
    l, r = route_keys(left, right, Caps(none, none, none, none), routes)
    on = ["country", "route", "key"]
    parts = r.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / 10_000).cast("int").alias("parts")).where("parts > 1")
    salted = r.join(parts, on, "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")).select(*on, "salt", F.col("id").alias("target_id"))
    spread = l.join(parts, on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).select(*on, "salt", F.col("id").alias("s1_id"))
    return spread.join(salted, [*on, "salt"]).select("s1_id", "target_id").distinct()


def candidate_lists(left: DataFrame, right: DataFrame, **kw) -> DataFrame:
    """One row per primary record, '' where it has no candidates."""
    lists = capped_lists(left, right, **kw).select("s1_id", F.array_join(F.array_sort("targets"), ",").alias("ids"))
    ids = left.select(F.col("id").alias("s1_id")).distinct()
    return ids.join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce("ids", F.lit("")).alias("candidate_entity_ids"))


def captured(truth: DataFrame, left: DataFrame, right: DataFrame, caps: Caps = Caps(1500, 1500, 1500, 500), routes=range(1, 10)) -> DataFrame:
    """``s1_id, target_id, captured``: whether any route, uncapped, would bring a true pair.

    Only true pairs are looked at: the keys of both ends are compared, no candidates are formed.
    """
    l, r = route_keys(left, right, caps, routes)
    key = F.struct("country", "route", "key")
    pairs = truth.select("s1_id", "target_id").distinct()
    lk = l.groupBy(F.col("id").alias("s1_id")).agg(F.collect_set(key).alias("lk"))
    rk = r.join(pairs.select(F.col("target_id").alias("id")).distinct(), "id", "left_semi").groupBy(F.col("id").alias("target_id")).agg(F.collect_set(key).alias("rk"))
    both = pairs.join(lk, "s1_id", "left").join(rk, "target_id", "left")
    return both.select("s1_id", "target_id", F.coalesce(F.arrays_overlap("lk", "rk"), F.lit(False)).alias("captured"))


def recall(captured_pairs: DataFrame) -> DataFrame:
    hit = F.sum(F.col("captured").cast("long"))
    total = F.count(F.lit(1))
    return captured_pairs.agg(F.coalesce(hit, F.lit(0)).alias("captured_true_pairs"), total.alias("total_true_pairs"), F.round(hit * 100.0 / total, 2).alias("candidate_recall_pct"))
