"""Per-key figures when a few keys hold most rows.

Heavy hitters are found with a frequency sketch that is built in the partial aggregate of one scan.
Rows of heavy keys are marked by a broadcast join with the sketch's answer, spread over salts and
aggregated in two steps; the remaining keys take the ordinary shuffle. The two results are disjoint
in their keys and are put together by a union.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Fewest and most counters of the sketch. Its error is at most 3.5 / counters of all rows; counters are chosen so that this is a tenth
#: of the share asked for, which makes every key above the share certain to be reported. Smaller shares than that allows are refused.
SKETCH_COUNTERS, MOST_COUNTERS = 8192, 1_000_000


def key_hash(keys: Sequence[str]) -> Column:
    """64-bit hash of the key columns; null and empty differ, a clash only routes a light key as heavy."""
    return F.xxhash64(*[F.col(k) for k in keys], *[F.col(k).isNull() for k in keys])


def heavy_hashes(df: DataFrame, keys: Sequence[str], share: float) -> tuple[int, list[int]]:
    """Number of rows and the hashes of all keys that may hold at least ``share`` of them.

    At most ``1.2 / share`` hashes reach the driver, whatever the size of the data.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    top, counters = int(1.2 / share) + 1, max(SKETCH_COUNTERS, math.ceil(35 / share))
    if counters > MOST_COUNTERS:
        raise ValueError(f"share must be at least {35 / MOST_COUNTERS}")
    row = df.select(key_hash(keys).alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {top}, {counters})").alias("top")
    ).first()
    n = row["n"]
    return n, [r["item"] for r in (row["top"] or []) if r["count"] >= 0.9 * share * n]


def per_key_figures(
    df: DataFrame, keys: Sequence[str], *, record: str, latest: str, share: float = 0.002, salts: int = 64
) -> DataFrame:
    """Rows, distinct records and latest time of every key: ``keys..., n_rows, n_records, latest``.

    ``share``: a key with at least this share of the rows is treated as heavy. ``salts``: parts of a
    heavy key; a record always falls into the same part, so distinct counts of the parts add up.

    Nulls in a key form a key of their own (null and '' differ); a null ``record`` isn't counted among
    the records; ``latest`` is null if all its times are. Repeated rows count as rows. An empty table
    gives an empty result. Further columns, whatever their names, are ignored.
    """
    rows = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(record).alias("r"), F.col(latest).alias("t"))
    ks = [f"k{i}" for i in range(len(keys))]
    _, heavy = heavy_hashes(rows, ks, share)
    spark = df.sparkSession
    marks = F.broadcast(spark.createDataFrame([(h,) for h in heavy], "h long"))  # at most 1.2 / share rows
    hashed = rows.withColumn("h", key_hash(ks))

    figures = [F.count(F.lit(1)).alias("n_rows"), F.count_distinct("r").alias("n_records"), F.max("t").alias("latest")]
    parts = (
        hashed.join(marks, "h", "left_semi")
        .groupBy(*ks, F.pmod(F.xxhash64("r"), F.lit(salts)).alias("salt"))
        .agg(*figures)
    )
    of_heavy = parts.groupBy(*ks).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_records").alias("n_records"), F.max("latest").alias("latest")
    )
    of_light = hashed.join(marks, "h", "left_anti").groupBy(*ks).agg(*figures)
    both = of_heavy.unionByName(of_light)
    return both.select(*[F.col(a).alias(b) for a, b in zip(ks, keys)], "n_rows", "n_records", "latest")


def keys_above(df: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """The keys that hold at least ``share`` of all rows, exactly: the sketch proposes, counting decides.

    Null is a key of its own; no rows give no keys; ties are all kept.
    """
    rows = df.select(*[F.col(k) for k in keys])
    n, heavy = heavy_hashes(rows, list(keys), share)
    marks = F.broadcast(df.sparkSession.createDataFrame([(h,) for h in heavy], "h long"))  # at most 1.2 / share rows
    counted = rows.withColumn("h", key_hash(keys)).join(marks, "h", "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.where(F.col("n_rows") >= share * n)


def skew_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", *, share: float = 0.01) -> DataFrame:
    """Joins ``big`` with ``small`` (one row per key) where a few keys may hold most of ``big``.

    The rows of ``small`` for heavy keys, at most ``1.2 / share``, are broadcast; all other keys take
    the ordinary shuffle join. ``how`` is inner or left. Null keys match nothing; with left they are kept.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    _, heavy = heavy_hashes(big, [key], share)
    if not heavy:
        return big.join(small, key, how)
    of_heavy = key_hash([key]).isin(heavy)
    few = small.where(of_heavy)
    if few.limit(len(heavy) + 1).count() > len(heavy):  # more than a row for a key: not safe to broadcast
        return big.join(small, key, how)
    hot = big.where(of_heavy).join(F.broadcast(few), key, how)
    return hot.unionByName(big.where(~of_heavy).join(small.where(~of_heavy), key, how))
