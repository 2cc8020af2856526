"""TF-IDF cosine of text pairs, fitted on both sides of all pairs, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def terms(text: Column) -> Column:
    """Words of two or more letters, digits or underscores and their neighbours as bigrams."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def tfidf_cosine(pairs: DataFrame, a: str, b: str, out: str, *, min_df: int = 2, max_features: int = 50_000) -> DataFrame:
    """``pairs`` with column ``out``: sublinear tf, idf = ln((1 + N) / (1 + df)) + 1, unit length, N = 2 * pairs.

    Each distinct text is treated once, weighted by how often it occurs. Of the terms in at least ``min_df``
    texts the ``max_features`` commonest stay, ties by term. A text without terms is unlike everything (0).
    Null is the empty text.
    """
    x, y = F.coalesce(F.col(a), F.lit("")), F.coalesce(F.col(b), F.lit(""))
    # texts are known by 64 bits of hash from here on, so that joins and aggregates move no texts
    texts = pairs.select(F.explode(F.array(x, y)).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("times"))
    each = texts.select(F.xxhash64("text").alias("text"), "times", F.explode(terms(F.col("text"))).alias("term")).groupBy("text", "times", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = texts.agg(F.sum("times").alias("n"))
    known = each.groupBy("term").agg(F.sum("times").alias("df"), F.sum(F.col("tf") * F.col("times")).alias("total")).where(F.col("df") >= min_df)
    known = known.orderBy(F.desc("total"), "term").limit(max_features)
    idf = known.crossJoin(F.broadcast(n)).select("term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))  # n is one row
    weighted = each.join(idf, "term").select("text", "term", ((1.0 + F.log("tf")) * F.col("idf")).alias("w"))
    vectors = weighted.groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    va = vectors.select(F.col("text").alias("_a"), F.col("v").alias("_va"), F.col("len").alias("_la"))
    vb = vectors.select(F.col("text").alias("_b"), F.col("v").alias("_vb"), F.col("len").alias("_lb"))
    both = pairs.withColumns({"_a": F.xxhash64(x), "_b": F.xxhash64(y)}).join(va, "_a", "left").join(vb, "_b", "left")
    shared = F.aggregate(F.map_entries("_va"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.element_at("_vb", e["key"]), F.lit(0.0)))
    cos = F.coalesce(F.try_divide(shared, F.col("_la") * F.col("_lb")), F.lit(0.0))
    return both.withColumn(out, cos).drop("_a", "_b", "_va", "_vb", "_la", "_lb")
