"""The 24 features of a candidate pair, labels, and sampling of pairs."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from kithmark.functions import similarity as S
from kithmark.functions.text import tokens
from kithmark.operators.tfidf import tfidf_cosine

FEATURES = [
    "f_name_jaccard", "f_name_overlap", "f_name_jaro_winkler", "f_name_jaro_winkler_raw", "f_name_char3gram", "f_name_char4gram",
    "f_name_len_ratio", "f_name_token_ratio", "f_name_exact_match", "f_addr_jaccard", "f_addr_overlap", "f_addr_jaro_winkler",
    "f_addr_jaro_winkler_raw", "f_addr_char3gram", "f_addr_len_ratio", "f_addr_exact_match", "f_both_addr_empty", "f_addr_missing_one",
    "f_country_match", "f_both_country_missing", "f_name_in_addr_overlap", "f_tfidf_name_cosine", "f_tfidf_addr_cosine", "f_emb_name_cosine",
]


def entity_attributes(*sources: DataFrame) -> DataFrame:
    """``id, name_norm, addr_norm, country, name_raw, addr_raw`` of all records; a record delivered twice counts once."""
    out = None
    for df in sources:
        c = lambda x: F.coalesce(F.col(x), F.lit(""))
        part = df.select(F.col("entity_id").alias("id"), c("business_name_normalized").alias("name_norm"), c("business_address_normalized").alias("addr_norm"), c("country_clean").alias("country"), c("business_name").alias("name_raw"), c("business_address").alias("addr_raw"))
        out = part if out is None else out.unionByName(part)
    rest = ["name_norm", "addr_norm", "country", "name_raw", "addr_raw"]
    return out.groupBy("id").agg(F.max(F.struct(*rest)).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in rest])


def with_attributes(pairs: DataFrame, entities: DataFrame, left: str = "s1_id", right: str = "cand_id") -> DataFrame:
    """Attributes of both ends as columns n1, a1, c1, r1, w1 and n2 ...; '' where an id isn't known."""
    for side, key in ((1, left), (2, right)):
        names = {"name_norm": f"n{side}", "addr_norm": f"a{side}", "country": f"c{side}", "name_raw": f"r{side}", "addr_raw": f"w{side}"}
        pairs = pairs.join(entities.select(F.col("id").alias(key), *[F.col(a).alias(b) for a, b in names.items()]), key, "left").na.fill("", list(names.values()))
    return pairs


def pair_features(df: DataFrame, *, jaro_winkler: bool = True, tfidf: bool = False, embeddings: tuple[str, str] | None = None) -> DataFrame:
    """Adds the features to pairs that carry attributes. Set and length features stay in one projection, the n-grams are one crossing to Python.

    Features that aren't computed are -1.
    """
    n1, n2, a1, a2, c1, c2 = (F.col(x) for x in ("n1", "n2", "a1", "a2", "c1", "c2"))
    tn1, tn2, ta1, ta2 = tokens(n1), tokens(n2), tokens(a1), tokens(a2)
    flag = lambda c: c.cast("double")
    f = {
        "f_name_jaccard": S.jaccard(tn1, tn2), "f_name_overlap": S.overlap(tn1, tn2),
        "f_name_len_ratio": S.ratio(F.length(n1), F.length(n2)), "f_name_token_ratio": S.ratio(S.word_count(n1), S.word_count(n2)),
        "f_name_exact_match": flag((n1 == n2) & (n1 != "")),
        "f_addr_jaccard": S.jaccard(ta1, ta2), "f_addr_overlap": S.overlap(ta1, ta2),
        "f_addr_len_ratio": S.ratio(F.length(a1), F.length(a2)), "f_addr_exact_match": flag((a1 == a2) & (a1 != "")),
        "f_both_addr_empty": flag((a1 == "") & (a2 == "")), "f_addr_missing_one": flag((a1 == "") != (a2 == "")),
        "f_country_match": flag((c1 == c2) & (c1 != "")), "f_both_country_missing": flag((c1 == "") & (c2 == "")),
        "f_name_in_addr_overlap": S.overlap(tn1, ta2),
    }
    df = df.withColumns(f).withColumn("_g", S.gram_jaccards(n1, n2, a1, a2))
    df = df.withColumns({"f_name_char3gram": F.col("_g.name3"), "f_name_char4gram": F.col("_g.name4"), "f_addr_char3gram": F.col("_g.addr3")}).drop("_g")
    if jaro_winkler:
        cut = lambda c: F.substring(c, 1, 128)
        df = df.withColumn("_jw", S.jaro_winkler_four(*[cut(c) for c in ("n1", "n2", "r1", "r2", "a1", "a2", "w1", "w2")]))
        df = df.withColumns({"f_name_jaro_winkler": F.col("_jw.name"), "f_name_jaro_winkler_raw": F.col("_jw.name_raw"), "f_addr_jaro_winkler": F.col("_jw.addr"), "f_addr_jaro_winkler_raw": F.col("_jw.addr_raw")}).drop("_jw")
    if tfidf:
        df = tfidf_cosine(tfidf_cosine(df, "n1", "n2", "f_tfidf_name_cosine"), "a1", "a2", "f_tfidf_addr_cosine")
    if embeddings:
        df = df.withColumn("f_emb_name_cosine", S.dot(F.col(embeddings[0]), F.col(embeddings[1])))
    return df.withColumns({c: F.lit(-1.0) for c in FEATURES if c not in df.columns})


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds ``label``: 1 if the pair (s1_id, cand_id) is in ``truth`` (s1_id, target_id)."""
    t = truth.select("s1_id", F.col("target_id").alias("cand_id")).distinct().withColumn("_hit", F.lit(1))
    return pairs.join(t, ["s1_id", "cand_id"], "left").withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_hit")


def _order(seed: int) -> Column:
    """A fixed pseudo-random order of pairs, the same in every engine that knows md5."""
    return F.md5(F.concat_ws("|", "s1_id", "cand_id", F.lit(seed)))


def _ranked(pairs: DataFrame, seed: int) -> DataFrame:
    """Adds ``_rank``, from 1, in the fixed order within each label. Ranks are made in 4096 parts of the order, so no task sorts a whole label."""
    marked = pairs.withColumn("_o", _order(seed)).withColumn("_p", F.substring("_o", 1, 3))
    before = Window.partitionBy("label").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = marked.groupBy("label", "_p").agg(F.count(F.lit(1)).alias("_n")).select("label", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("label", "_p").orderBy("_o", "s1_id", "cand_id")
    return marked.withColumn("_r", F.row_number().over(inner)).join(F.broadcast(parts), ["label", "_p"]).withColumn("_rank", F.col("_r") + F.col("_before")).drop("_o", "_p", "_r", "_before")


def downsample(pairs: DataFrame, *, neg_pos_ratio: int = 10, sample_frac: float = 1.0, seed: int = 42) -> DataFrame:
    """The share ``sample_frac`` of the positives (rounded up) and exactly ``neg_pos_ratio`` times as many negatives, or all there are, in the fixed order."""
    positives = math.ceil(sample_frac * pairs.where("label = 1").count())
    wanted = F.when(F.col("label") == 1, F.lit(positives)).otherwise(F.lit(neg_pos_ratio * positives))
    return _ranked(pairs, seed).where(F.col("_rank") <= wanted).drop("_rank")


def stratified_folds(pairs: DataFrame, k: int = 5, seed: int = 42, by_record: bool = False) -> DataFrame:
    """Adds ``fold``; sizes within a label differ by one at most. With ``by_record`` all pairs of a record share a fold."""
    if by_record:
        return pairs.withColumn("fold", F.pmod(F.xxhash64("s1_id", F.lit(seed)), F.lit(k)).cast("int"))
    return _ranked(pairs, seed).withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank")


def with_embeddings(df: DataFrame, encoder: Callable[[list[str]], Sequence[Sequence[float]]], texts: tuple[str, str] = ("n1", "n2"), out: tuple[str, str] = ("e1", "e2")) -> DataFrame:
    """Adds unit vectors of two text columns, for ``pair_features(embeddings=...)``. ``encoder`` turns a batch of texts into vectors; equal texts of a batch are encoded once."""

    @F.pandas_udf("array<float>")
    def encode(text: pd.Series) -> pd.Series:
        text = text.fillna("")
        distinct = list(dict.fromkeys(text))
        vectors = np.asarray(encoder(distinct), dtype=np.float64).reshape(len(distinct), -1)
        size = np.linalg.norm(vectors, axis=1, keepdims=True)
        unit = dict(zip(distinct, (vectors / np.where(size == 0, 1, size)).astype(np.float32)))
        return text.map(unit)

    return df.withColumns({o: encode(F.col(t)) for t, o in zip(texts, out)})


def usable_features(df: DataFrame) -> list[str]:
    """The features a table has, without those that are -1 in every row, as an embedding feature is where none was computed."""
    there = [c for c in FEATURES if c in df.columns]
    used = df.agg(*[F.max(F.col(c) != -1).alias(c) for c in there]).first()
    return [c for c in there if used[c] is not False]
