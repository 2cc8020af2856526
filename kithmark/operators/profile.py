"""Profiles of sources and of ground truth: every report is one pass of conditional aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kithmark.functions.text import is_lower, is_title, is_upper, parse_match_ids

#: White space of all scripts, and the edges of a word in letters and digits of all scripts; understood alike by Java and RE2.
_WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _word(p: str) -> str:
    return rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{p})(?:$|[^\p{{L}}\p{{N}}_])"


# Patterns of the reports; words are looked for in any case.
NAME_FLAGS = {
    "ampersand": r"&", "slash": r"/", "period": r"\.", "comma": r",", "parenthesis": r"[()]", "non_ascii": r"[^\x00-\x7F]",
    "repeated_space": _WS + "{2,}", "leading_dash": r"^-", "leading_angle": r"^<", "and_word": _word("and"),
}
ADDRESS_FLAGS = {
    "comma": r",", "dash": r"-", "slash": r"/", "hash": r"#", "non_ascii": r"[^\x00-\x7F]", "repeated_space": _WS + "{2,}",
    "null_word": _word("null"), "blank": r"^" + _WS + r"*$",
}
LEGAL_SUFFIXES = {
    "ltd": _word("ltd|limited"), "pvt": _word("pvt|private"), "corp": _word("corp|corporation"), "inc": _word("inc|incorporated"), "llc": _word("llc"),
    "llp": _word("llp"), "co": _word("co|company"), "pvt_ltd": r"pvt\.?" + _WS + r"*ltd\.?", "sarl": _word("sarl"), "sas": _word(r"s\.?a\.?s"), "sci": _word("sci"),
}
POSTAL = {"six_digits": _word(r"\p{Nd}{6}"), "five_digits": _word(r"\p{Nd}{5}"), "five_four": _word(r"\p{Nd}{5}-\p{Nd}{4}")}
COMPONENTS = {
    "street": _word("st|street"), "road": _word("rd|road"), "avenue": _word("ave|avenue"), "blvd": _word("blvd"), "drive": _word("dr|drive"),
    "nagar": _word("nagar"), "marg": _word("marg"), "colony": _word("colony"), "ganj": _word("ganj"), "rue": _word("rue"),
    "boulevard": _word("boulevard"), "vihar": _word("vihar"), "po_box": _word("po" + _WS + "*box"),
}


def _n(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("long")), F.lit(0))


def _long(df: DataFrame, names: list[str], key: str = "metric", value: str = "n") -> DataFrame:
    """One row of counts as one row per count."""
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return df.selectExpr(f"stack({len(names)}, {pairs}) as ({key}, {value})")


def flag_counts(df: DataFrame, column: str, patterns: dict[str, str]) -> DataFrame:
    """``metric, n``: rows of ``column`` that match each pattern in any case; null is the empty text."""
    v = F.coalesce(F.col(column), F.lit(""))
    return _long(df.agg(*[_n(v.rlike("(?iu)" + p)).alias(k) for k, p in patterns.items()]), list(patterns))


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, n_missing, pct``: null or blank values."""
    blank = {c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "") for c in columns}
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[_n(b).alias(c) for c, b in blank.items()])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return counts.selectExpr("_n", f"stack({len(columns)}, {pairs}) as (column_name, n_missing)").select(
        "column_name", "n_missing", F.round(F.try_divide(F.col("n_missing") * 100.0, F.col("_n")), 4).alias("pct")
    )


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, n_distinct`` without nulls; each value is counted in its own long row, so no column is expanded."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns]))
    long = df.select(each.alias("e")).select("e.*").where("v is not null").distinct()
    return long.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))


def duplicates(df: DataFrame, key: str, rest: list[str]) -> DataFrame:
    """``n_rows, duplicate_rows, duplicate_ids`` over the named columns."""
    per_row = df.groupBy(key, *rest).agg(F.count(F.lit(1)).alias("n"))
    per_id = per_row.groupBy(key).agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("again"))
    return per_id.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("again"), F.lit(0)).alias("duplicate_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_ids"))


def length_stats(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``field, min_v, max_v, mean_v, median_v`` of numeric expressions."""
    parts = [
        df.select(F.lit(k).alias("field"), v.cast("double").alias("v")).groupBy("field").agg(F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.round(F.avg("v"), 6).alias("mean_v"), F.median("v").alias("median_v"))
        for k, v in columns.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``value, n, pct``; null is a value."""
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("_t"))
    return counted.crossJoin(F.broadcast(total)).select("value", "n", F.round(F.col("n") * 100.0 / F.col("_t"), 4).alias("pct"))  # one row


def casing(df: DataFrame, column: str) -> DataFrame:
    """``metric, n`` for upper, lower, title and mixed; mixed is what is left of the non-empty."""
    v = F.coalesce(F.col(column), F.lit(""))
    c = df.agg(_n(is_upper(v)).alias("upper"), _n(is_lower(v)).alias("lower"), _n(is_title(v)).alias("title"), _n(v != "").alias("_all"))
    c = c.withColumn("mixed", F.col("_all") - F.col("upper") - F.col("lower") - F.col("title"))
    return _long(c, ["upper", "lower", "title", "mixed"])


def rows_with_capital_word(df: DataFrame, column: str) -> Column:
    """Whether a text has a word of two or more characters written in capitals."""
    return F.exists(F.split(F.coalesce(F.col(column), F.lit("")), r"\s+"), lambda w: (F.length(w) >= 2) & is_upper(w))


def top_values(df: DataFrame, column: str, k: int = 10, least: int = 2) -> DataFrame:
    """The ``k`` commonest values that occur at least ``least`` times; ties by value."""
    return df.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "value").limit(k)


def ambiguous_values(df: DataFrame, column: str) -> DataFrame:
    """``n_ambiguous, n_rows``: values (lower case, stripped) that several rows share."""
    v = df.groupBy(F.lower(F.trim(F.col(column))).alias("v")).agg(F.count(F.lit(1)).alias("n")).where("v is not null and v <> '' and n > 1")
    return v.agg(F.count(F.lit(1)).alias("n_ambiguous"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


def non_ascii_by_country(df: DataFrame, k: int = 5) -> DataFrame:
    g = df.groupBy("country_clean").agg(F.count(F.lit(1)).alias("n"), _n(F.coalesce(F.col("business_name"), F.lit("")).rlike(r"[^\x00-\x7F]")).alias("n_non_ascii"))
    return g.where("country_clean <> ''").orderBy(F.desc("n"), "country_clean").limit(k).select("country_clean", "n", "n_non_ascii", F.round(F.col("n_non_ascii") * 100.0 / F.col("n"), 4).alias("pct"))


def name_overlap(sources: dict[str, DataFrame], column: str = "business_name") -> DataFrame:
    """``combination, n``: distinct names (lower case, stripped) that sources share; one grouping instead of pairwise intersections."""
    parts = [df.select(F.lower(F.trim(F.col(column))).alias("v"), F.lit(s).alias("s")) for s, df in sources.items()]
    seen = reduce(DataFrame.unionByName, parts).where("v is not null and v <> ''").groupBy("v").agg(F.sort_array(F.collect_set("s")).alias("s"))
    names = sorted(sources)
    combos = [[a, b] for i, a in enumerate(names) for b in names[i + 1 :]] + ([names] if len(names) > 2 else [])
    has = lambda c: reduce(lambda x, y: x & y, [F.array_contains("s", n) for n in c])
    return _long(seen.agg(*[_n(has(c)).alias("_".join(c)) for c in combos]), ["_".join(c) for c in combos], "combination")


def cleaning_effect(df: DataFrame) -> DataFrame:
    """``metric, n``: rows that cleaning and normalising changed."""
    c = lambda x: F.coalesce(F.col(x), F.lit(""))
    out = df.agg(
        _n(c("business_name") != F.col("business_name_clean")).alias("name_cleaned"),
        _n(F.lower(c("business_name")) != F.col("business_name_normalized")).alias("name_normalized"),
        _n(c("business_address") != F.col("business_address_clean")).alias("address_cleaned"),
    )
    return _long(out, ["name_cleaned", "name_normalized", "address_cleaned"])


def match_lists_of(df: DataFrame, key: str, listed: str) -> DataFrame:
    return df.select(F.col(key).alias("s1_id"), parse_match_ids(F.col(listed)).alias("ids"))


def match_stats(lists: DataFrame) -> DataFrame:
    """``n_rows, n0, n1, n2, n3, n2_or_more, most, mean, singleton_rate, rows_with_repeats`` of match lists."""
    n = F.size("ids")
    return lists.agg(
        F.count(F.lit(1)).alias("n_rows"), _n(n == 0).alias("n0"), _n(n == 1).alias("n1"), _n(n == 2).alias("n2"), _n(n == 3).alias("n3"), _n(n >= 2).alias("n2_or_more"),
        F.max(n).alias("most"), F.round(F.avg(n), 6).alias("mean"), F.round(F.avg((n == 0).cast("double")), 6).alias("singleton_rate"), _n(n != F.size(F.array_distinct("ids"))).alias("rows_with_repeats"),
    )


def match_histogram(lists: DataFrame) -> DataFrame:
    return lists.groupBy(F.size("ids").alias("n_matches")).agg(F.count(F.lit(1)).alias("n_rows"))


def match_sources(lists: DataFrame) -> DataFrame:
    """``source, n``: ids by the source their prefix names."""
    prefix = F.split_part("id", F.lit("-"), F.lit(1))
    return lists.select(F.explode("ids").alias("id")).groupBy(F.when(prefix.isin("S1", "S2", "S3"), prefix).otherwise("other").alias("source")).agg(F.count(F.lit(1)).alias("n"))
