"""Command line: ``spark-submit -m subscope`` or ``python -m subscope <job> ...``."""

from __future__ import annotations

import argparse

from subscope.operators import churn, drift, recommend, segments
from subscope.operators.quality import split_valid, validate_features
from subscope.plans import jobs, scoring
from subscope.session import clear_stage, session
from subscope.sources import files, generate


def _arguments() -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="subscope")
    job = parser.add_subparsers(dest="job", required=True)
    make = job.add_parser("generate", help="write synthetic raw files")
    make.add_argument("out")
    make.add_argument("--customers", type=int, default=5000)
    make.add_argument("--months", type=int, default=12)
    make.add_argument("--seed", type=int, default=42)
    train = job.add_parser("train", help="train all models from raw files")
    train.add_argument("raw")
    train.add_argument("out")
    load = job.add_parser("star", help="build the star schema from raw files")
    load.add_argument("raw")
    load.add_argument("out")
    load.add_argument("--valid-from", required=True)
    for name in ("score-churn", "score-segment", "score-recommend"):
        score = job.add_parser(name, help="score a parquet table of requests")
        score.add_argument("models")
        score.add_argument("requests")
        score.add_argument("out")
    compare = job.add_parser("drift", help="compare two parquet tables")
    compare.add_argument("reference")
    compare.add_argument("current")
    compare.add_argument("out")
    return parser.parse_args()


def main() -> None:
    a = _arguments()
    spark = session(f"subscope-{a.job}")
    if a.job == "generate":
        print(generate.save_all(spark, a.out, a.customers, a.months, a.seed))
    elif a.job == "train":
        print(jobs.train_all(spark, a.raw, a.out))
    elif a.job == "star":
        jobs.load_star(spark, a.raw, a.out, a.valid_from)
    elif a.job == "drift":
        report = drift.drift_report(spark.read.parquet(a.reference), spark.read.parquet(a.current))
        files.write_csv(report, a.out)
    else:
        requests = spark.read.parquet(a.requests)
        if a.job == "score-churn":
            valid, rejected = split_valid(validate_features(requests))
            churn.ChurnModel.load(f"{a.models}/churn_best").score(valid).write.mode("overwrite").parquet(a.out)
            rejected.write.mode("overwrite").parquet(f"{a.out}_rejected")
        elif a.job == "score-segment":
            names = spark.read.parquet(f"{a.models}/segment_names")
            labels = segments.Segmenter.load(f"{a.models}/segmenter").predict(requests)
            segments.with_names(labels, names).write.mode("overwrite").parquet(a.out)
        else:
            fitted = recommend.Recommender.load(spark, f"{a.models}/recommender")
            scoring.score_recommendations(fitted, requests).write.mode("overwrite").parquet(a.out)
    clear_stage(spark)


if __name__ == "__main__":
    main()
