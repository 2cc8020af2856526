import numpy as np
import pytest

from kithmark.operators import features as X, matching as M


def test_sweep_equals_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(f"a{i}", f"b{i}", float(s), int(y)) for i, (s, y) in enumerate(zip(rng.random(300).round(3), rng.random(300) < 0.3))]
    df = spark.createDataFrame(rows, "s1_id string, cand_id string, score double, label int")
    for r in M.threshold_sweep(df, M.GRID).collect():
        tp = sum(s >= r["threshold"] and y for _, _, s, y in rows)
        fp = sum(s >= r["threshold"] and not y for _, _, s, y in rows)
        assert (r["tp"], r["fp"], r["fn"]) == (tp, fp, sum(y for *_, y in rows) - tp)


def test_best_threshold_without_hits(spark):
    df = spark.createDataFrame([("a", "b", 0.9, 0)], "s1_id string, cand_id string, score double, label int")
    assert M.best_threshold(M.threshold_sweep(df, M.GRID)).first()["threshold"] == 0.5


def test_match_lists_with_universe(spark):
    df = spark.createDataFrame([("a", "y", 0.9), ("a", "x", 0.8), ("b", "z", 0.1)], "s1_id string, cand_id string, score double")
    u = spark.createDataFrame([("a",), ("b",), ("c",)], "s1_id string")
    assert {tuple(r) for r in M.match_lists(df, 0.5, universe=u).collect()} == {("a", "x,y"), ("b", ""), ("c", "")}


def test_downsample_and_folds(spark):
    rows = [(f"a{i % 50}", f"b{i}", int(i % 20 == 0)) for i in range(2000)]
    df = spark.createDataFrame(rows, "s1_id string, cand_id string, label int")
    d = X.downsample(df, neg_pos_ratio=3)
    n = {r["label"]: r["count"] for r in d.groupBy("label").count().collect()}
    assert n == {0: 300, 1: 100}
    assert {r["label"]: r["count"] for r in X.downsample(df, neg_pos_ratio=3, sample_frac=0.5).groupBy("label").count().collect()} == {0: 150, 1: 50}
    assert X.downsample(df.where("label = 0")).count() == 0
    sizes = [r["count"] for r in X.stratified_folds(df, 5).where("label = 1").groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_model_round_trip(spark, tmp_path):
    rows = [(f"a{i}", f"b{i}", int(i % 2), float(i % 2), 0.5) for i in range(80)]
    df = spark.createDataFrame(rows, "s1_id string, cand_id string, label int, f_x double, f_y double")
    m = M.Matcher(features=("f_x", "f_y"), trees=3, depth=2).fit(df)
    m.save(str(tmp_path), spark)
    back = M.Matcher.load(str(tmp_path), spark)
    assert back.threshold == m.threshold and m.importances()[0][0] == "f_x"
    assert back.score(df).where("score >= 0.5 and label = 0").count() == 0
    assert m.threshold == pytest.approx(back.threshold)


def test_features_that_say_nothing_are_dropped(spark):
    cols = [c for c in X.FEATURES if c != "f_addr_jaccard"]
    df = spark.createDataFrame([tuple(-1.0 if c == "f_emb_name_cosine" else float(i) for c in cols) for i in range(3)], ", ".join(f"{c} double" for c in cols))
    assert X.usable_features(df) == [c for c in cols if c != "f_emb_name_cosine"]
    assert M.Matcher("nothing").kind == "gbt" and M.Matcher.original("forest").trees == 300
    with pytest.raises(ValueError):
        M.Matcher("nothing", force=True)


def test_embedding_feature(spark):
    df = spark.createDataFrame([("a", "b", "red shoes", "red shoes"), ("a", "c", "red shoes", "green tea"), ("a", "d", "", None)], "s1_id string, cand_id string, n1 string, n2 string")
    words = ["red", "shoes", "green", "tea"]
    with_vectors = X.with_embeddings(df, lambda texts: [[float(w in t) for w in words] for t in texts])
    full = with_vectors.selectExpr("*", "'' as a1", "'' as a2", "'' as c1", "'' as c2")
    got = {r["cand_id"]: r["f_emb_name_cosine"] for r in X.pair_features(full, jaro_winkler=False, embeddings=("e1", "e2")).collect()}
    assert got["b"] == pytest.approx(1) and got["c"] == 0 and got["d"] == 0
