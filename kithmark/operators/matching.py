"""Classifier, thresholds and match lists."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from kithmark.operators.features import stratified_folds, usable_features

GRID = [round(0.05 + 0.01 * i, 2) for i in range(91)]
SWEEP = [round(0.10 + 0.05 * i, 2) for i in range(17)]


def f05(precision: Column, recall: Column) -> Column:
    """1.25 P R / (0.25 P + R); 0 where both are 0."""
    return F.when(0.25 * precision + recall > 0, 1.25 * precision * recall / (0.25 * precision + recall)).otherwise(0.0)


def _metrics(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return [p.alias("precision"), r.alias("recall"), f05(p, r).alias("f05")]


def metrics_at(scored: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    m, y = F.col(score) >= threshold, F.col("label") == 1
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    c = scored.agg(n(m & y).alias("tp"), n(m & ~y).alias("fp"), n(~m & y).alias("fn"))
    return c.select("tp", "fp", "fn", *_metrics(F.col("tp"), F.col("fp"), F.col("fn")))


def threshold_sweep(scored: DataFrame, grid: list[float] = SWEEP, score: str = "score") -> DataFrame:
    """``threshold, tp, fp, fn, precision, recall, f05`` of every threshold in one pass over the pairs.

    A pair is counted at the largest threshold its score reaches; sums from above give the rest.
    """
    spark = scored.sparkSession
    level = F.lit(-1)
    for i, t in enumerate(grid):
        level = F.when(F.col(score) >= t, i).otherwise(level)
    y = (F.col("label") == 1).cast("long")
    counts = scored.select(level.alias("level"), y.alias("y")).groupBy("level").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    steps = spark.createDataFrame([(i, t) for i, t in enumerate(grid)], "level int, threshold double")
    everything = counts.join(steps, "level", "full").select("level", "threshold", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("neg", F.lit(0)).alias("neg"))
    up = Window.partitionBy(F.lit(0)).orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)  # one row per threshold
    whole = Window.partitionBy(F.lit(0))
    sums = everything.select("level", "threshold", F.sum("pos").over(up).alias("tp"), F.sum("neg").over(up).alias("fp"), F.sum("pos").over(whole).alias("all_pos")).where("level >= 0")
    sums = sums.withColumn("fn", F.col("all_pos") - F.col("tp"))
    return sums.select("threshold", "tp", "fp", "fn", *_metrics(F.col("tp"), F.col("fp"), F.col("fn")))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Highest F0.5, the lowest threshold of equals; 0.5 if nothing is found at all."""
    best = sweep.orderBy(F.desc(F.round("f05", 12)), "threshold").limit(1)
    return best.select(F.when(F.col("f05") > 0, F.col("threshold")).otherwise(0.5).alias("threshold"), "precision", "recall", "f05")


#: Trees, depth and step of each kind: the defaults, and the sizes of the original pipeline, whose boosting takes hours here, since
#: Spark grows its trees one after the other, each in several jobs.
SIZES = {"gbt": (40, 5, 0.1), "forest": (100, 10, 0.0)}
ORIGINAL_SIZES = {"gbt": (500, 8, 0.05), "forest": (300, 12, 0.0)}


@dataclass
class Matcher:
    """Feature assembly and a classifier, boosted trees or a forest, behind one threshold.

    ``trees, depth, step``: None takes SIZES; ``original()`` gives the sizes of the original pipeline. ``positive_weight``: of a match in
    boosting; a forest is balanced, both labels weigh the same in all. ``features``: None takes those that the training table has and
    that aren't -1 throughout. An unknown ``kind`` falls back to boosting, unless ``force`` is set.
    """

    kind: str = "gbt"
    positive_weight: float = 10.0
    seed: int = 42
    features: tuple[str, ...] | None = None
    trees: int | None = None
    depth: int | None = None
    step: float | None = None
    force: bool = False
    model: object = None
    threshold: float = 0.5

    def __post_init__(self):
        if self.kind not in SIZES:
            if self.force:
                raise ValueError(f"no classifier {self.kind}")
            self.kind = "gbt"
        sizes = SIZES[self.kind]
        self.trees, self.depth, self.step = (own if own is not None else s for own, s in zip((self.trees, self.depth, self.step), sizes))

    @classmethod
    def original(cls, kind: str = "gbt", **kw) -> Matcher:
        trees, depth, step = ORIGINAL_SIZES[kind]
        return cls(kind, trees=trees, depth=depth, step=step, **kw)

    def _pipeline(self) -> Pipeline:
        assembler = VectorAssembler(inputCols=list(self.features), outputCol="features")
        if self.kind == "forest":
            c = RandomForestClassifier(numTrees=self.trees, maxDepth=self.depth, minInstancesPerNode=5, featureSubsetStrategy="sqrt", weightCol="weight", seed=self.seed)
        else:
            c = GBTClassifier(maxIter=self.trees, stepSize=self.step, maxDepth=self.depth, minInstancesPerNode=20, subsamplingRate=0.8, featureSubsetStrategy="0.8", weightCol="weight", seed=self.seed)
        return Pipeline(stages=[assembler, c])

    def _ready(self, df: DataFrame) -> DataFrame:
        return df.na.fill(0.0, list(self.features))

    def fit(self, train: DataFrame, tune: bool = True) -> Matcher:
        self.features = self.features or tuple(usable_features(train))
        weight = self.positive_weight
        if self.kind == "forest":
            n = train.agg(F.sum(F.col("label")).alias("p"), F.count(F.lit(1)).alias("n")).first()
            weight = (n["n"] - n["p"]) / n["p"] if n["p"] else 1.0
        data = self._ready(train).withColumn("weight", F.when(F.col("label") == 1, float(weight)).otherwise(1.0)).withColumn("label", F.col("label").cast("double"))
        self.model = self._pipeline().fit(data)
        if tune:
            self.threshold = best_threshold(threshold_sweep(self.score(train), GRID)).first()["threshold"]
        return self

    def score(self, df: DataFrame) -> DataFrame:
        drop = {"features", "rawPrediction", "probability", "prediction"}
        out = self.model.transform(self._ready(df)).withColumn("score", vector_to_array("probability")[1])
        return out.drop(*drop)

    def cross_validate(self, df: DataFrame, k: int = 5, by_record: bool = False) -> DataFrame:
        """``fold, threshold, precision, recall, f05``; the threshold is tuned on each held-out fold."""
        folded = stratified_folds(df, k, self.seed, by_record)
        rows = []
        for i in range(k):
            part = replace(self, model=None).fit(folded.where(F.col("fold") != i), tune=False)
            b = best_threshold(threshold_sweep(part.score(folded.where(F.col("fold") == i)), GRID)).first()
            rows.append((i, b["threshold"], b["precision"], b["recall"], b["f05"]))
        return df.sparkSession.createDataFrame(rows, "fold int, threshold double, precision double, recall double, f05 double")

    def importances(self) -> list[tuple[str, float]]:
        return sorted(zip(self.features, map(float, self.model.stages[-1].featureImportances.toArray())), key=lambda x: (-x[1], x[0]))

    def save(self, path: str, spark) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        spark.createDataFrame([(self.threshold, self.kind, list(self.features))], "threshold double, kind string, features array<string>").write.mode("overwrite").json(f"{path}/threshold")

    @staticmethod
    def load(path: str, spark) -> Matcher:
        from pyspark.ml import PipelineModel

        t = spark.read.json(f"{path}/threshold").first()
        return Matcher(kind=t["kind"], features=tuple(t["features"]), model=PipelineModel.load(f"{path}/model"), threshold=t["threshold"])


def match_lists(scored: DataFrame, threshold: float, score: str = "score", universe: DataFrame | None = None) -> DataFrame:
    """``source1_entity_id, match_entity_ids``: sorted comma list, '' for none; records of ``universe`` (s1_id) are added."""
    hit = F.when(F.col(score) >= threshold, F.col("cand_id"))
    out = scored.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_list(hit)), ",").alias("match_entity_ids"))
    if universe is not None:
        out = universe.select("s1_id").distinct().join(out, "s1_id", "left").select("s1_id", F.coalesce("match_entity_ids", F.lit("")).alias("match_entity_ids"))
    return out.withColumnRenamed("s1_id", "source1_entity_id")


def submission_summary(lists: DataFrame) -> DataFrame:
    has = (F.col("match_entity_ids") != "").cast("long")
    return lists.agg(F.count(F.lit(1)).alias("total"), F.sum(has).alias("with_match"), F.sum(1 - has).alias("singletons"), F.round(F.avg(has.cast("double")), 6).alias("match_rate"))
