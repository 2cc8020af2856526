import re
import unicodedata

import pytest
from hypothesis import given, settings, strategies as st

from kithmark.functions import text
from kithmark.functions.similarity import jaro_winkler_of
from kithmark.schema import PROCESSED_COLUMNS

NAMES = [None, "", "  ", "-- P.V.T. Ltd.", "A & B,C", "Ｆｕｌｌ　Width", "Acme Private Limited", "O'Neil--Smith Corporation", "Shree. Ganesh\x1cTraders", "x" * 4000, "Limited Incorporated", "मेडिकल ltd."]
ADDRESSES = [None, "", "12, Main St; Delhi", "5 / 6 MG Rd", "A - B, Apt. 4", "No. 7 Fl 2", "Dr Lane Drive", "state st.", "KH NO. -570/13, New Delhi"]


def reference_clean(s):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", s or "")).strip()


def test_clean_keeps_rows_and_equals_python(spark):
    df = spark.createDataFrame([(str(i), n, a, "India ", "extra") for i, (n, a) in enumerate(zip(NAMES, ADDRESSES + [None] * 3))], "entity_id string, business_name string, business_address string, country string, business_name_note string")
    out = text.processed(df)
    assert out.columns == [*PROCESSED_COLUMNS, "business_name_note"]
    got = {r["entity_id"]: r for r in out.collect()}
    assert len(got) == len(NAMES)
    for i, n in enumerate(NAMES):
        assert got[str(i)]["business_name_clean"] == reference_clean(n)
        assert got[str(i)]["business_name_length"] == len(n or "")
        assert got[str(i)]["business_name_token_count"] == len((n or "").split())


@pytest.mark.parametrize("raw, want", [("P.V.T. Ltd.", "pvt ltd"), ("A & B,C", "a and b c"), ("Acme Private Limited", "acme pvt ltd"), ("<< Foo -- Corporation", "foo corp"), ("acme private ltd", "acme private ltd")])
def test_names(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "s string")
    assert df.select(text.name_normalized(text.clean("s" and df["s"])).alias("o")).first()["o"] == want


@pytest.mark.parametrize("raw, want", [("12, Main St; Delhi", "12 main street delhi"), ("KH NO. -570/13, New Delhi", "kh number -570/13 new delhi"), ("5 / 6 MG Rd", "5 6 mg road"), ("A - B Apt 4", "a b apartment 4")])
def test_addresses(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "s string")
    assert df.select(text.address_normalized(text.clean(df["s"])).alias("o")).first()["o"] == want


@pytest.mark.parametrize("raw, want", [("['S2-1', \"S3-2\"]", ["S2-1", "S3-2"]), ("nan", []), (None, []), ("[]", []), (" S2-1 ,None,", ["S2-1"])])
def test_match_ids(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "s string").select(text.parse_match_ids("s" and text.F.col("s")).alias("o")).first()["o"] == want


def test_casing(spark):
    words = ["ABC", "abc", "Abc Def", "aBc", "O'Neil", "A", "", "12", "É", "élan", "McDonald"]
    got = spark.createDataFrame([(w,) for w in words], "s string").select("s", text.is_upper(text.F.col("s")), text.is_lower(text.F.col("s")), text.is_title(text.F.col("s"))).collect()
    for w, u, l, t in got:
        assert (u, l, t) == (w.isupper(), w.islower(), w.istitle()), w


def naive_jw(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, pairs = set(), []
    for i, c in enumerate(a):
        js = [j for j in range(len(b)) if abs(i - j) <= reach and j not in used and b[j] == c]
        if js:
            used.add(js[0])
            pairs.append((i, js[0]))
    if not pairs:
        return 0.0
    m = len(pairs)
    t = sum(a[i] != b[j] for (i, _), j in zip(pairs, sorted(j for _, j in pairs))) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    k = next((k for k in range(4) if k >= min(len(a), len(b)) or a[k] != b[k]), 4)
    return jaro + 0.1 * k * (1 - jaro)


@settings(max_examples=300, deadline=None)
@given(st.text("abcde ", max_size=12), st.text("abcde ", max_size=12))
def test_jaro_winkler(a, b):
    assert jaro_winkler_of(a, b) == pytest.approx(naive_jw(a, b))
