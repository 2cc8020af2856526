"""Readers and writers for the delimited and columnar tables of the pipeline.

Delimited files are read with an explicit schema, never inferred; a missing value is the empty string.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from kithmark import schema as S


def read_tsv(spark: SparkSession, path: str, schema: StructType, multi_line: bool | None = None) -> DataFrame:
    """A tab-separated file with header; quotes are doubled inside quotes, blanks are ''.

    ``multi_line``: whether records span lines, which makes every file one task. None: a scan of the lines tells; where
    each has an even number of quotes, none does, and files are split.
    """
    if multi_line is None:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        multi_line = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    df = spark.read.schema(schema).csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=multi_line, encoding="UTF-8", enforceSchema=True)
    return df.na.fill("")


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("emptyValue", "").option("nullValue", "").option("escape", '"').csv(path, sep="\t", header=True)


def read_processed(spark: SparkSession, path: str, columns: list[str] | None = None, ids: DataFrame | None = None) -> DataFrame:
    """A processed source, Parquet or tab-separated; only the wanted columns and, by semi join, the wanted ids."""
    df = read_tsv(spark, path, S.PROCESSED) if path.endswith((".tsv", ".csv")) else spark.read.parquet(path)
    if columns:
        df = df.select(*columns)
    if ids is not None:
        df = df.join(ids.select("entity_id").distinct(), "entity_id", "left_semi")
    return df


def read_available(spark: SparkSession, paths: list[str], columns: list[str] | None = None, ids: DataFrame | None = None) -> DataFrame | None:
    """Union of those tables that are there, with a warning for those that aren't; None if none is."""
    out = None
    for p in paths:
        if not _exists(spark, p):
            warnings.warn(f"no table at {p}", stacklevel=2)
            continue
        df = read_processed(spark, p, columns, ids)
        out = df if out is None else out.unionByName(df)
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """The Parquet table at ``path``, built and written first if it isn't there."""
    if not _exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def explode_ids(df: DataFrame, key: str, listed: str, key_as: str = "s1_id", id_as: str = "target_id") -> DataFrame:
    """A comma list as rows; trims, drops blanks; rows whose list is empty vanish."""
    each = df.select(F.col(key).alias(key_as), F.explode(F.split(F.coalesce(F.col(listed), F.lit("")), ",")).alias("_id"))
    return each.select(key_as, F.trim("_id").alias(id_as)).where(F.col(id_as) != "")


def read_ground_truth(spark: SparkSession, path: str, listed: str = "matched_entity_ids") -> DataFrame:
    """``s1_id, target_id``, each link once; raises FileNotFoundError if there is no file."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    df = read_tsv(spark, path, S.GROUND_TRUTH) if path.endswith((".tsv", ".csv")) else spark.read.parquet(path)
    return explode_ids(df, "source1_entity_id", listed).distinct()


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return explode_ids(read_tsv(spark, path, S.CANDIDATES), "source1_entity_id", "candidate_entity_ids", id_as="cand_id")


def hashed_sample(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a hash of their keys: the same rows on every run and every cluster."""
    return df.orderBy(F.md5(F.concat_ws("|", *keys, F.lit(seed))), *keys).limit(n)


def head_columns_match(df: DataFrame, expected: list[str] | None = None) -> bool:
    return df.columns[: len(expected or S.PROCESSED_COLUMNS)] == (expected or S.PROCESSED_COLUMNS)
