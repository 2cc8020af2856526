import pytest

from kithmark import schema
from kithmark.sources import files


def test_tsv_round_trip(spark, tmp_path):
    rows = [("S1-1", 'say "hi"', "a\tb", ""), ("S1-2", "", "line\nbreak", "India"), ("S1-3", "null", "é", "FR")]
    df = spark.createDataFrame(rows, schema.RAW)
    files.write_tsv(df, str(tmp_path / "t"))
    assert sorted(map(tuple, files.read_tsv(spark, str(tmp_path / "t"), schema.RAW).collect())) == sorted(rows)


def test_missing_tables(spark, tmp_path):
    assert files.read_available(spark, [str(tmp_path / "none")]) is None
    with pytest.raises(FileNotFoundError):
        files.read_ground_truth(spark, str(tmp_path / "none.tsv"))


def test_ground_truth_and_cache(spark, tmp_path):
    p = str(tmp_path / "gt")
    spark.createDataFrame([("S1-1", "S2-1, S3-2,,S2-1"), ("S1-2", ""), ("S1-3", None)], schema.GROUND_TRUTH).write.parquet(p)
    assert {tuple(r) for r in files.read_ground_truth(spark, p).collect()} == {("S1-1", "S2-1"), ("S1-1", "S3-2")}
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert files.cached(spark, str(tmp_path / "c"), build).count() == 3
    assert calls == [1]


def test_sample_is_the_same_each_time(spark):
    df = spark.range(1000).selectExpr("cast(id as string) entity_id")
    a, b = (sorted(r[0] for r in files.hashed_sample(df.repartition(n), ["entity_id"], 20).collect()) for n in (2, 5))
    assert a == b and len(a) == 20


def test_plain_lines_are_split(spark, tmp_path):
    rows = [(f"S1-{i}", 'say "hi"', "a\tb", "") for i in range(50)]
    files.write_tsv(spark.createDataFrame(rows, schema.RAW), str(tmp_path / "t"))
    for multi_line in (None, False, True):
        assert sorted(map(tuple, files.read_tsv(spark, str(tmp_path / "t"), schema.RAW, multi_line).collect())) == sorted(rows)
