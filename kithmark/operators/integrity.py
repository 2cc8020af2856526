"""Checks of ids, references, schemas and outputs; each gives a small table of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from kithmark.schema import RAW_COLUMNS


def prefix_violations(sources: dict[str, DataFrame]) -> DataFrame:
    """``source, n_rows, n_bad``: ids that don't start with the source's prefix."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum((~F.coalesce(F.col("entity_id").startswith(f"{s}-"), F.lit(False))).cast("long")), F.lit(0)).alias("n_bad")).select(F.lit(s).alias("source"), "n_rows", "n_bad") for s, df in sources.items()]
    return reduce(DataFrame.unionByName, parts)


def id_uniqueness(sources: dict[str, DataFrame]) -> DataFrame:
    """``source, n_rows, n_ids, n_repeated``."""
    parts = [df.agg(F.count("entity_id").alias("n_rows"), F.count_distinct("entity_id").alias("n_ids")).select(F.lit(s).alias("source"), "n_rows", "n_ids", (F.col("n_rows") - F.col("n_ids")).alias("n_repeated")) for s, df in sources.items()]
    return reduce(DataFrame.unionByName, parts)


def unknown_targets(links: DataFrame, *targets: DataFrame) -> DataFrame:
    """``n_links, n_targets, n_unknown``: distinct target ids that no source has."""
    known = reduce(DataFrame.unionByName, [t.select("entity_id") for t in targets]).distinct().select(F.col("entity_id").alias("target_id"), F.lit(1).alias("k"))
    t = links.groupBy("target_id").agg(F.count(F.lit(1)).alias("n")).join(known, "target_id", "left")
    return t.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_links"), F.count(F.lit(1)).alias("n_targets"), F.coalesce(F.sum(F.isnull("k").cast("long")), F.lit(0)).alias("n_unknown"))


def primary_as_target(links: DataFrame) -> DataFrame:
    return links.agg(F.coalesce(F.sum(F.col("target_id").contains("S1-").cast("long")), F.lit(0)).alias("n_primary_targets"))


def completeness(truth_ids: DataFrame, source: DataFrame) -> DataFrame:
    """``in_both, only_truth, only_source`` of ids, by one full join."""
    t = truth_ids.select(F.col("s1_id").alias("id")).distinct().withColumn("t", F.lit(1))
    s = source.select(F.col("entity_id").alias("id")).distinct().withColumn("s", F.lit(1))
    j = t.join(s, "id", "full")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return j.agg(n(F.col("t").isNotNull() & F.col("s").isNotNull()).alias("in_both"), n(F.col("s").isNull()).alias("only_truth"), n(F.col("t").isNull()).alias("only_source"))


def schema_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """``column_name, in_a, in_b`` for columns that only one of the tables has."""
    spark = a.sparkSession
    x, y = set(a.columns), set(b.columns)
    return spark.createDataFrame([(c, c in x, c in y) for c in sorted(x ^ y)], "column_name string, in_a boolean, in_b boolean")


def output_check(raw: DataFrame, out: DataFrame) -> DataFrame:
    """``metric, n``: rows lost or gained, changed originals, nulls in derived columns, additional duplicates."""
    keep = [c for c in RAW_COLUMNS if c in raw.columns]
    count = lambda df: df.groupBy(*keep).agg(F.count(F.lit(1)).alias("n"))
    on = reduce(lambda p, q: p & q, [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in keep])
    j = count(raw).alias("r").join(count(out).alias("o"), on, "full").select(F.coalesce("r.n", F.lit(0)).alias("nr"), F.coalesce("o.n", F.lit(0)).alias("no"))
    a = j.agg(
        F.coalesce(F.sum(F.greatest(F.col("nr") - F.col("no"), F.lit(0))), F.lit(0)).alias("rows_lost_or_changed"),
        F.coalesce(F.sum(F.greatest(F.col("no") - F.col("nr"), F.lit(0))), F.lit(0)).alias("rows_gained_or_changed"),
    )
    derived = [c for c in out.columns if c.endswith(("_clean", "_normalized"))]
    nulls = out.agg(F.coalesce(F.sum(reduce(lambda p, q: p | q, [F.col(c).isNull() for c in derived]).cast("long")), F.lit(0)).alias("nulls_in_derived"))
    both = a.crossJoin(F.broadcast(nulls))  # one row each
    once = lambda df: df.agg((F.count(F.lit(1)) - F.count_distinct(F.struct(*keep))).alias("n"))
    again = once(out).select(F.col("n").alias("no")).crossJoin(F.broadcast(once(raw).select(F.col("n").alias("nr")))).select(F.greatest(F.col("no") - F.col("nr"), F.lit(0)).alias("additional_duplicates"))
    both = both.crossJoin(F.broadcast(again))
    names = ["rows_lost_or_changed", "rows_gained_or_changed", "nulls_in_derived", "additional_duplicates"]
    return both.selectExpr("stack(4, " + ", ".join(f"'{x}', {x}" for x in names) + ") as (metric, n)")


def submission_check(lists: DataFrame) -> DataFrame:
    """``columns_right, n_rows, n_bad_ids, n_bad_targets``."""
    right = lists.columns == ["source1_entity_id", "match_entity_ids"]
    bad = ~F.coalesce(F.col("source1_entity_id").startswith("S1-"), F.lit(False))
    target = F.exists(F.split("match_entity_ids", ","), lambda x: (x != "") & ~x.rlike("^S[23]-"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return lists.agg(F.lit(right).alias("columns_right"), F.count(F.lit(1)).alias("n_rows"), n(bad).alias("n_bad_ids"), n(target).alias("n_bad_targets"))
