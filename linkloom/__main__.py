"""Command line: train, predict, evaluate and validate, from tab-separated files to result files.

On a cluster the package goes along with the job (`spark-submit --py-files linkloom.zip`, or an installed wheel):
workers import it for the edit ratios.
"""

from __future__ import annotations

import argparse
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import blocking as B
from .operators import metrics as M
from .operators import validate as Q
from .operators.prepare import prepare
from .plans import runs
from .session import build
from .sources import tsv


def _others(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [tsv.read_source(spark, p) for p in args.others])


def _sides(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    a, b = prepare(tsv.read_source(spark, args.references)), prepare(_others(spark, args))
    return a, B.sample(b, args.sample_others) if args.sample_others else b


def train(spark: SparkSession, args: argparse.Namespace) -> int:
    a, b = _sides(spark, args)
    truth = tsv.truth_lists(tsv.read_ground_truth(spark, args.truth))
    base = runs.train_baseline(a, b, truth)
    better = runs.train_reranker(base, a, b, truth, args.rerank) if args.rerank else None
    runs.save(spark, args.model, base, better)
    if better:
        runs.report(base, better, truth).show(truncate=False)
    else:
        print(f"threshold {base.threshold}, margin {base.margin}")
    return 0


def predict(spark: SparkSession, args: argparse.Namespace) -> int:
    a, b = _sides(spark, args)
    found, matches = runs.predict_matches(runs.load_baseline(spark, args.model), a, b, runs.load_reranker(spark, args.model) if args.rerank else None)
    ids = a.select(F.col("entity_id").alias("s1_id"))
    write, end = (tsv.write_id_file, ".tsv") if args.one_file else (tsv.write_id_lists, "")
    write(tsv.matching_results(ids, matches), f"{args.out}/matching_results{end}")
    write(tsv.candidate_pairs(ids, found), f"{args.out}/candidate_pairs{end}")
    return 0


def evaluate(spark: SparkSession, args: argparse.Namespace) -> int:
    truth = tsv.truth_lists(tsv.read_ground_truth(spark, args.truth))
    matches = tsv.truth_pairs(tsv.read_ground_truth(spark, args.matching))
    M.full_metrics(truth, matches).show(truncate=False)
    return 0


def validate(spark: SparkSession, args: argparse.Namespace) -> int:
    """1 if there is a violation; the first ones by file and rule are printed, all are counted."""
    ids, others = tsv.raw_ids(tsv.read_source(spark, args.references)), tsv.raw_ids(_others(spark, args))
    found = Q.validate_files(spark, args.matching, args.candidate, ids, others).cache()
    try:
        if Q.passes(found):
            print("passed")
            return 0
        found.groupBy("file", "rule").agg(F.count("*").alias("violations")).orderBy("file", "rule").show(truncate=False)
        found.orderBy("file", "rule", "at", "detail").show(args.show, truncate=False)
        return 1
    finally:
        found.unpersist()  # files of the same names may hold something else the next time


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="linkloom", description=__doc__.splitlines()[0])
    top.add_argument("--master", help="Spark master; else the session's own setting")
    commands = top.add_subparsers(dest="command", required=True)
    sources = argparse.ArgumentParser(add_help=False)
    sources.add_argument("--references", required=True, help="file or folder of reference records")
    sources.add_argument("--others", required=True, nargs="+", help="files or folders of the records to match")
    made = argparse.ArgumentParser(add_help=False, parents=[sources])
    made.add_argument("--model", required=True, help="folder of models and thresholds")
    made.add_argument("--sample-others", type=int, help="only this many of the records to match, the same ones on every run")
    one = commands.add_parser("train", parents=[made])
    one.add_argument("--truth", required=True)
    one.add_argument("--rerank", choices=("trees", "logistic"), help="train a reranker too, of this kind")
    one.set_defaults(run=train)
    one = commands.add_parser("predict", parents=[made])
    one.add_argument("--rerank", action="store_true", help="with the stored reranker")
    one.add_argument("--out", required=True)
    one.add_argument("--one-file", action="store_true", help="a file with one header for each result instead of a folder")
    one.set_defaults(run=predict)
    one = commands.add_parser("evaluate")
    one.add_argument("--truth", required=True)
    one.add_argument("--matching", required=True)
    one.set_defaults(run=evaluate)
    one = commands.add_parser("validate", parents=[sources])
    one.add_argument("--matching", required=True)
    one.add_argument("--candidate", required=True)
    one.add_argument("--show", type=int, default=20, help="violations to print")
    one.set_defaults(run=validate)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(build(args.master), args)


if __name__ == "__main__":
    sys.exit(main())
