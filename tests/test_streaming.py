import datetime as dt

from kithmark.operators.blocking import blocking_view, candidate_pairs
from kithmark.streaming import arrivals

COLUMNS = "entity_id string, business_name_normalized string, business_address_normalized string, country_clean string, received_at timestamp"


def test_arrivals_are_matched_like_a_batch(spark, tmp_path):
    t = dt.datetime(2024, 5, 1)
    rows = [(f"S1-{i}", f"acme trading {i % 3}", f"{i} main street", "US", t + dt.timedelta(minutes=i)) for i in range(6)]
    new = spark.createDataFrame(rows, COLUMNS)
    new.write.parquet(str(tmp_path / "in"))
    targets = spark.createDataFrame([(f"S2-{i}", f"acme trading {i % 4}", f"{i} main street", "US", t) for i in range(8)], COLUMNS)
    q = arrivals.match_arrivals(arrivals.read_arrivals(spark, str(tmp_path / "in"), new.schema), targets, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = {(r["s1_id"], x) for r in spark.read.parquet(str(tmp_path / "out")).collect() for x in r["targets"]}
    assert got == {tuple(r) for r in candidate_pairs(blocking_view(new), blocking_view(targets)).collect()}
