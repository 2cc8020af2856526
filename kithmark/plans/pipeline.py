"""The whole pipeline from raw files to a submission, and its command line.

    python -m kithmark.plans.pipeline preprocess --raw DIR --work DIR
    python -m kithmark.plans.pipeline block --work DIR [--split train|test] [--sample N] [--routes 1,2,...]
    python -m kithmark.plans.pipeline features --work DIR [--split train|test] [--neg-pos-ratio 10] [--fraction 1.0]
    python -m kithmark.plans.pipeline cv_only|train|predict|train_and_predict|sweep --work DIR [--threshold T] [--forest] [--original-sizes] [--no-cv] [--all-records]

Raw files are ``{split}_source{1,2,3}.tsv`` and ``train_ground_truth.tsv``. Every stage reads what the
one before has written; intermediate tables are Parquet, tab-separated files stand only at the edges.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from kithmark import schema as S
from kithmark.functions.text import processed
from kithmark.operators import blocking as B, features as X, integrity as I, matching as M, profile as P
from kithmark.runtime import get_session
from kithmark.sources.files import cached, explode_ids, hashed_sample, head_columns_match, read_tsv, write_tsv

SPLITS = {"train": (1, 2, 3), "test": (1, 2, 3)}


@dataclass
class Pipeline:
    """Stages over a working folder."""

    spark: SparkSession
    work: str
    raw: str = ""

    def _path(self, name: str) -> str:
        return f"{self.work}/{name}"

    def source(self, split: str, n: int) -> DataFrame:
        return self.spark.read.parquet(self._path(f"processed/{split}_source{n}"))

    def targets(self, split: str) -> DataFrame:
        return self.source(split, 2).unionByName(self.source(split, 3))

    def truth(self) -> DataFrame:
        df = self.spark.read.parquet(self._path("processed/train_ground_truth"))
        return explode_ids(df, "source1_entity_id", df.columns[1]).distinct()

    def preprocess(self, profile: bool = True) -> DataFrame:
        """Normalises all sources, copies the ground truth, and returns the findings ``dataset, metric, n``."""
        findings = []
        for split, numbers in SPLITS.items():
            for n in numbers:
                raw = read_tsv(self.spark, f"{self.raw}/{split}_source{n}.tsv", S.RAW)
                path = self._path(f"processed/{split}_source{n}")
                processed(raw).write.mode("overwrite").parquet(path)
                out = self.spark.read.parquet(path)
                if not head_columns_match(out):
                    raise ValueError(f"columns of {path} are {out.columns}")
                write_tsv(out, self._path(f"tsv/{split}_source{n}_processed"))
                checks = [I.output_check(raw, out)]
                if profile:
                    checks += [P.missing(out, S.RAW_COLUMNS).select(F.concat(F.lit("missing_"), "column_name").alias("metric"), F.col("n_missing").alias("n")), P.casing(out, "business_name"), P.cleaning_effect(out)]
                    checks += [P.flag_counts(out, c, p) for c, p in (("business_name", P.NAME_FLAGS), ("business_name", P.LEGAL_SUFFIXES), ("business_address", P.ADDRESS_FLAGS), ("business_address", P.COMPONENTS))]
                for c in checks:
                    findings.append(c.select(F.lit(f"{split}_source{n}").alias("dataset"), "metric", F.col("n").cast("long").alias("n")))
        read_tsv(self.spark, f"{self.raw}/train_ground_truth.tsv", S.GROUND_TRUTH).write.mode("overwrite").parquet(self._path("processed/train_ground_truth"))
        out = findings[0]
        for f in findings[1:]:
            out = out.unionByName(f)
        out.write.mode("overwrite").parquet(self._path("reports/preprocess"))
        return self.spark.read.parquet(self._path("reports/preprocess"))

    def block(self, split: str = "train", sample: int | None = None, routes=B.PRODUCTION, caps: B.Caps = B.Caps(), cap: int = 15) -> DataFrame:
        """Candidate lists, in Parquet and tab-separated; ``sample``: only so many primary records, in hash order."""
        left = self.source(split, 1)
        if sample is not None:
            left = left.join(hashed_sample(left.select("entity_id").distinct(), ["entity_id"], sample), "entity_id", "left_semi")
        lists = B.candidate_lists(B.blocking_view(left), B.blocking_view(self.targets(split)), caps=caps, routes=routes, cap=cap)
        lists.write.mode("overwrite").parquet(self._path(f"candidates/{split}"))
        out = self.spark.read.parquet(self._path(f"candidates/{split}"))
        write_tsv(out.orderBy("source1_entity_id"), self._path(f"tsv/{split}_candidate_pairs"))
        return out

    def recall(self, split: str = "train") -> DataFrame:
        return B.recall(B.captured(self.truth(), B.blocking_view(self.source(split, 1)), B.blocking_view(self.targets(split))))

    def _pairs(self, split: str) -> DataFrame:
        return explode_ids(self.spark.read.parquet(self._path(f"candidates/{split}")), "source1_entity_id", "candidate_entity_ids", id_as="cand_id")

    def features(self, split: str = "train", neg_pos_ratio: int = 10, fraction: float = 1.0, fresh: bool = False) -> DataFrame:
        """The feature table, built once; of the training pairs those of covered records, labelled and down-sampled."""

        def build() -> DataFrame:
            pairs, keep = self._pairs(split), ["s1_id", "cand_id"]
            if split == "train":
                ids = self.spark.read.parquet(self._path("processed/train_ground_truth")).select(F.col("source1_entity_id").alias("s1_id")).distinct()
                pairs = X.downsample(X.labelled(pairs.join(ids, "s1_id", "left_semi"), self.truth()), neg_pos_ratio=neg_pos_ratio, sample_frac=fraction)
                keep.append("label")
            entities = X.entity_attributes(self.source(split, 1), self.targets(split))
            return X.pair_features(X.with_attributes(pairs, entities), tfidf=True).select(*keep, *X.FEATURES)

        path = self._path(f"features/{split}")
        if fresh:
            build().write.mode("overwrite").parquet(path)
        return cached(self.spark, path, build)

    def _matcher(self, forest: bool, original: bool) -> M.Matcher:
        kind = "forest" if forest else "gbt"
        return M.Matcher.original(kind) if original else M.Matcher(kind)

    def cross_validate(self, forest: bool = False, k: int = 5, by_record: bool = False, original: bool = False) -> DataFrame:
        return self._matcher(forest, original).cross_validate(self.features("train"), k, by_record)

    def train(self, forest: bool = False, original: bool = False) -> M.Matcher:
        m = self._matcher(forest, original).fit(self.features("train"))
        m.save(self._path("model"), self.spark)
        return m

    def sweep(self) -> DataFrame:
        return M.threshold_sweep(M.Matcher.load(self._path("model"), self.spark).score(self.features("train")))

    def predict(self, threshold: float | None = None, all_records: bool = False) -> DataFrame:
        """The submission; ``all_records`` adds primary records without candidates."""
        m = M.Matcher.load(self._path("model"), self.spark)
        universe = self.source("test", 1).select(F.col("entity_id").alias("s1_id")) if all_records else None
        lists = M.match_lists(m.score(self.features("test")), m.threshold if threshold is None else threshold, universe=universe)
        lists.write.mode("overwrite").parquet(self._path("submission"))
        out = self.spark.read.parquet(self._path("submission"))
        write_tsv(out.orderBy("source1_entity_id"), self._path("tsv/matching_results"))
        return out


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    a.add_argument("stage", choices=["preprocess", "block", "recall", "features", "cv_only", "train", "predict", "train_and_predict", "sweep"])
    a.add_argument("--raw", default="")
    a.add_argument("--work", required=True)
    a.add_argument("--split", default="train", choices=list(SPLITS))
    a.add_argument("--sample", type=int)
    a.add_argument("--routes", default=",".join(map(str, B.PRODUCTION)))
    a.add_argument("--neg-pos-ratio", type=int, default=10)
    a.add_argument("--fraction", type=float, default=1.0)
    a.add_argument("--threshold", type=float)
    for flag in ("--forest", "--no-cv", "--all-records", "--no-profile", "--by-record", "--original-sizes"):
        a.add_argument(flag, action="store_true")
    o = a.parse_args(argv)
    p = Pipeline(get_session("pipeline"), o.work, o.raw)
    if o.stage == "preprocess":
        p.preprocess(not o.no_profile).show(500, False)
    elif o.stage == "block":
        p.block(o.split, o.sample, [int(r) for r in o.routes.split(",")]).show(5, False)
    elif o.stage == "recall":
        p.recall().show()
    elif o.stage == "features":
        p.features(o.split, o.neg_pos_ratio, o.fraction, fresh=True).show(5)
    elif o.stage == "sweep":
        p.sweep().orderBy("threshold").show(50)
    else:
        if o.stage == "cv_only" or (o.stage.startswith("train") and not o.no_cv):
            p.cross_validate(o.forest, by_record=o.by_record, original=o.original_sizes).show()
        if o.stage.startswith("train"):
            m = p.train(o.forest, o.original_sizes)
            print("threshold", m.threshold, *m.importances()[:15], sep="\n")
        if o.stage.endswith("predict"):
            M.submission_summary(p.predict(o.threshold, o.all_records)).show()


if __name__ == "__main__":
    main()
