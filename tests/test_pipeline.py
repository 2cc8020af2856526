from kithmark import schema
from kithmark.plans.pipeline import Pipeline
from kithmark.sources.files import write_tsv


def test_raw_files_to_submission(spark, tmp_path):
    names = ["acme trading", "blue mill bakery", "north star foods", "global tea house", "river stone works", "golden gate motors"]
    raw = tmp_path / "raw"
    for split in ("train", "test"):
        for n in (1, 2, 3):
            rows = [(f"S{n}-{i:03d}", f"{names[i % 6]} no{i // 6}" + (" Ltd." if n > 1 else ""), f"{10 + i} main st, town {i % 4}", "US") for i in range(36)]
            write_tsv(spark.createDataFrame(rows, schema.RAW).coalesce(1), str(raw / f"{split}_source{n}.tsv"))
    truth = [(f"S1-{i:03d}", f"S2-{i:03d},S3-{i:03d}" if i % 5 else "") for i in range(36)]
    write_tsv(spark.createDataFrame(truth, schema.GROUND_TRUTH).coalesce(1), str(raw / "train_ground_truth.tsv"))
    p = Pipeline(spark, str(tmp_path / "work"), str(raw))
    found = p.preprocess().where("metric in ('rows_lost_or_changed', 'nulls_in_derived')")
    assert found.count() == 12 and found.where("n <> 0").count() == 0
    for split in ("train", "test"):
        assert p.block(split).count() == 36
    assert p.block("train", sample=10).count() == 10
    p.block("train")
    assert p.recall().first()["candidate_recall_pct"] == 100.0
    m = p.train(forest=True)
    assert 0 < m.threshold < 1 and p.sweep().count() == 17
    out = p.predict(all_records=True)
    assert out.count() == 36 and out.columns == ["source1_entity_id", "match_entity_ids"]
    assert out.where("match_entity_ids like '%S2-%'").count() > 20
