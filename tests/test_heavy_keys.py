import datetime as dt

import pytest

from kithmark.operators.heavy_keys import keys_above, per_key_figures, skew_join

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "a string, b string, id string, at timestamp, n_rows int, latest string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute(rows):
    out = {}
    for a, b, i, t, *_ in rows:
        n, ids, last = out.setdefault((a, b), [0, set(), None])
        out[a, b] = [n + 1, ids | ({i} - {None}), t if last is None or (t and t > last) else last]
    return {k: (n, len(s), t) for k, (n, s, t) in out.items()}


def rows_of(n):
    out = [("x", "hot", f"i{i % 300}", T0 + dt.timedelta(minutes=i), 1, "clash") for i in range(n)]
    out += [(None, "", f"j{i}", None, 2, None) for i in range(5)] + [("x", None, None, T0, 3, "z"), ("y", "é" * 5000, "k", T0, 4, "")]
    return out + [(f"c{i % 40}", "w", f"m{i}", T0, 0, "q") for i in range(200)]


def figures(df):
    return {(r["a"], r["b"]): (r["n_rows"], r["n_records"], r["latest"]) for r in per_key_figures(df, ["a", "b"], record="id", latest="at").collect()}


def test_figures_equal_brute_force(spark):
    rows = rows_of(900)
    assert figures(frame(spark, rows)) == brute(rows)


def test_figures_of_repeated_rows_and_empty(spark):
    rows = rows_of(50) * 2
    assert figures(frame(spark, rows)) == brute(rows)
    assert figures(frame(spark, [])) == {}


def test_keys_above(spark):
    rows = rows_of(900)
    got = {(r["a"], r["b"]) for r in keys_above(frame(spark, rows), ["a", "b"], 0.004).collect()}
    assert got == {k for k, (n, *_) in brute(rows).items() if n >= 0.004 * len(rows)}
    assert keys_above(frame(spark, []), ["a", "b"], 0.01).count() == 0
    with pytest.raises(ValueError):
        keys_above(frame(spark, rows), ["a"], 0)


def test_skew_join_equals_join(spark):
    big = spark.createDataFrame([("h", i) for i in range(500)] + [(f"k{i}", i) for i in range(50)] + [(None, 7)], "key string, v int")
    small = spark.createDataFrame([("h", "H"), ("k1", "one"), ("k2", "two"), (None, "null")], "key string, name string")
    for how in ("inner", "left"):
        assert sorted(map(str, skew_join(big, small, "key", how).collect())) == sorted(map(str, big.join(small, "key", how).collect()))
    assert skew_join(big.where("false"), small, "key").count() == 0
