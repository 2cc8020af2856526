"""Normalisation of names, addresses and countries as column expressions.

Regular expressions are written for Java with explicit classes where Java, Python and RE2 differ: white
space takes in the separators U+001C to U+001F, and a word boundary looks at letters and digits of all scripts.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

SPACE = r"(?U)[\s\x1C-\x1F]+"
NOT_SPACE = r"(?U)[^\s\x1C-\x1F]+"
_B = r"(?<![\p{L}\p{N}_])"
_E = r"(?![\p{L}\p{N}_])"

# Rewriting rules in their order (pattern, replacement).
NAME_PUNCTUATION = [
    (r"(?U)^[-<>=*#!@~`|]+[\s\x1C-\x1F]*", ""),
    (r"(?U)[\s\x1C-\x1F]*&[\s\x1C-\x1F]*", " and "),
    (r"([a-z])\.(?=[a-z])", "$1"),
    (r"([a-z])\.$", "$1"),
    (r"(?U)([a-z])\.[\s\x1C-\x1F]", "$1 "),
    (r",", " "),
    (r"-{2,}", " "),
]
NAME_LEGAL_FORMS = [
    (r"(?U)pvt\.?[\s\x1C-\x1F]*ltd\.?", "pvt ltd"),
    (r"(?U)private[\s\x1C-\x1F]+limited", "pvt ltd"),
    (_B + "limited" + _E, "ltd"),
    (_B + "corporation" + _E, "corp"),
    (_B + "incorporated" + _E, "inc"),
]
ADDRESS_RULES = [
    (r"[,;]", " "),
    (r"(?U)[\s\x1C-\x1F]/[\s\x1C-\x1F]", " "),
    (r"(?U)[\s\x1C-\x1F]+-[\s\x1C-\x1F]+", " "),
    (_B + "st" + _E, "street"),
    (_B + "rd" + _E, "road"),
    (_B + "ave" + _E, "avenue"),
    (_B + "blvd" + _E, "boulevard"),
    (_B + "dr" + _E, "drive"),
    (_B + "apt" + _E, "apartment"),
    (_B + "no" + _E + r"\.?", "number"),
    (_B + "fl" + _E, "floor"),
]
NAME_LEADERS = r"^(the|a|an|hotel|shree|sri|shri|dr|m/s|ms|pvt|private|ltd|limited|llc|inc|corp|co)\s+"
ADDRESS_LEADERS = r"^(h\.?number|flat number|door number|door no|plot no|flat no|house no|old number|new number|number|no\.?)\s*"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


def nfkc(c: Column) -> Column:
    """Compatibility composition; the only step without a built-in."""
    return _nfkc(c)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def clean(c: Column) -> Column:
    """NFKC, white space collapsed and stripped; null becomes ''."""
    return collapse(nfkc(F.coalesce(c, F.lit(""))))


def clean_ascii(c: Column) -> Column:
    """The same for text that is known to be in composed form: nothing leaves the JVM."""
    return collapse(F.coalesce(c, F.lit("")))


def _apply(c: Column, rules) -> Column:
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


def name_normalized(cleaned: Column) -> Column:
    return collapse(_apply(F.lower(cleaned), NAME_PUNCTUATION + NAME_LEGAL_FORMS))


def address_normalized(cleaned: Column) -> Column:
    return collapse(_apply(F.lower(cleaned), ADDRESS_RULES))


def char_length(raw: Column) -> Column:
    return F.length(F.coalesce(raw, F.lit("")))


def token_count(raw: Column) -> Column:
    return F.regexp_count(F.coalesce(raw, F.lit("")), F.lit(NOT_SPACE))


def processed(df: DataFrame, composed: bool = False) -> DataFrame:
    """Adds the nine derived columns to a raw source; originals and rows stay as they are.

    ``composed``: the text is known to be in compatibility form already, so the Python step is left out.
    Null and empty values give '' and 0. Columns that aren't there are skipped.
    """
    cl = clean_ascii if composed else clean
    out = {}
    for field, normal in (("business_name", name_normalized), ("business_address", address_normalized)):
        if field in df.columns:
            out[f"{field}_clean"] = cl(F.col(field))
    df = df.withColumns(out)
    out = {}
    for field, normal in (("business_name", name_normalized), ("business_address", address_normalized)):
        if field in df.columns:
            out[f"{field}_normalized"] = normal(F.col(f"{field}_clean"))
            out[f"{field}_length"] = char_length(F.col(field))
            out[f"{field}_token_count"] = token_count(F.col(field))
    if "country" in df.columns:
        out["country_clean"] = cl(F.col("country"))
    df = df.withColumns(out)
    from kithmark.schema import PROCESSED_COLUMNS

    first = [c for c in PROCESSED_COLUMNS if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def blocking_name(normalized: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(normalized, F.lit("")), r"^[.\-\s#/]+", ""), NAME_LEADERS, "")


def blocking_address(normalized: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(normalized, F.lit("")), r"^[.\-\s#/]+", ""), ADDRESS_LEADERS, "")


def address_number(normalized: Column) -> Column:
    return F.regexp_extract(F.coalesce(normalized, F.lit("")), r"([0-9]{2,6})", 1)


def tokens(c: Column) -> Column:
    """Set of words of a text."""
    return F.array_remove(F.array_distinct(F.split(c, " ")), "")


def without_legal_forms(raw: Column) -> Column:
    """Lower-case compatibility form without legal forms; kept for callers that compare bare names."""
    forms = r"(?i)" + _B + r"(pvt\.?\s*ltd\.?|private\s+limited|llc|inc\.?|corp\.?|ltd\.?|limited|s\.?a\.?s\.?|sarl|gmbh|co\.?)" + _E
    return collapse(F.regexp_replace(F.lower(nfkc(F.coalesce(raw, F.lit("")))), forms, ""))


def parse_match_ids(c: Column) -> Column:
    """An untidy id list as an array: brackets, quotes and blanks go; nan, none and null mean nothing."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\[\]'\"]", "")
    parts = F.transform(F.split(bare, ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: (x != "") & ~F.lower(x).isin("nan", "none", "null"))


_CASED = r"[\p{Lu}\p{Ll}\p{Lt}]"


def is_upper(c: Column) -> Column:
    return c.rlike(_CASED) & (F.upper(c) == c) & ~c.rlike(r"[\p{Ll}\p{Lt}]")


def is_lower(c: Column) -> Column:
    return c.rlike(_CASED) & (F.lower(c) == c) & ~c.rlike(r"[\p{Lu}\p{Lt}]")


def is_title(c: Column) -> Column:
    bad = r"[\p{Lu}\p{Ll}\p{Lt}][\p{Lu}\p{Lt}]|(?<![\p{Lu}\p{Ll}\p{Lt}])\p{Ll}"
    return c.rlike(_CASED) & ~c.rlike(bad)
