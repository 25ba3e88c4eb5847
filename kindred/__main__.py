"""Command line: match, prune, evaluate and validate result files."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import metrics, selection, validation
from .plans import engine
from .plans.profiles import PROFILES
from .sources import io


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="kindred")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("match", help="records in, matches and candidates out")
    p.add_argument("records", nargs="+", help="tab-separated files of all sources")
    p.add_argument("--profile", choices=sorted(PROFILES), default="v13")
    p.add_argument("--output-dir", required=True)
    p = sub.add_parser("prune", help="keep the first ids of each source")
    p.add_argument("matching")
    p.add_argument("--top", type=int, default=1)
    p.add_argument("--output", required=True)
    p.add_argument("--backup", action="store_true", help="copy an existing input beside itself once")
    p = sub.add_parser("evaluate", help="both averages of F0.5")
    p.add_argument("matching")
    p.add_argument("truth")
    p = sub.add_parser("validate", help="check result files; exit status 1 if an error is found")
    p.add_argument("-m", "--matching", required=True)
    p.add_argument("-c", "--candidate")
    p.add_argument("-t", "--source1", required=True)
    p.add_argument("--check-ids", nargs="*", default=[], metavar="TARGETS")
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("kindred").getOrCreate()
    if args.command == "match":
        records = io.read_records(spark, *args.records)
        io.write_lists(engine.match(records, args.profile), f"{args.output_dir.rstrip('/')}/matching_results")
        io.write_lists(engine.candidate_lists(records, args.profile), f"{args.output_dir.rstrip('/')}/candidate_pairs", "candidate_entity_ids")
    elif args.command == "prune":
        if args.backup:
            io.backup(spark, args.matching)
        before = io.read_lists(spark, args.matching)
        after = selection.prune(before, args.top)
        io.write_lists(after, args.output)
        print(json.dumps(selection.prune_totals(before, after).first().asDict()))
    elif args.command == "evaluate":
        lists = lambda path: io.read_lists(spark, path).select(F.col("source1_entity_id").alias("id"), F.col("matched_entity_ids").alias("ids"))
        counts = metrics.per_entity(lists(args.matching), lists(args.truth))
        print(json.dumps({"included": metrics.included_f(counts).first().asDict(), "official": metrics.official_f(counts).first().asDict(), "totals": metrics.totals(counts).first().asDict()}))
    else:
        report = validation.validate(spark, args.matching, args.source1, args.candidate, args.check_ids)
        for kind, found in (("error", report.errors), ("warning", report.warnings)):
            for line in found:
                print(f"{kind}: {line}")
        return 1 if report.errors else 0
    return 0


if __name__ == "__main__":
    sys.exit(main())
