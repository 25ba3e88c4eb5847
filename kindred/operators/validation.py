"""Conformance of a results table: every breach as (rule, offender), found by aggregates and anti-joins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import io

EXAMPLES = 5


def breaches(results: DataFrame, required: DataFrame, known: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """results: (source1_entity_id, matched_entity_ids array); required: (id); known: (id) of targets;
    candidates: (source1_entity_id, candidate_entity_ids), whose rule 'warning_not_candidate' never fails a file."""
    rid = F.col("source1_entity_id")
    ids = results.select(rid, F.explode("matched_entity_ids").alias("m"))
    rule = lambda df, name, col: df.select(F.lit(name).alias("rule"), F.col(col).alias("offender")).distinct()
    out = [
        rule(results.groupBy(rid).count().where("count > 1"), "duplicate_row", "source1_entity_id"),
        rule(results.where("size(matched_entity_ids) > size(array_distinct(matched_entity_ids))"), "repeated_id", "source1_entity_id"),
        rule(ids.where("m like 'S1-%'"), "self_match", "m"),
        rule(ids.where("not m rlike '^S[123]-'"), "wrong_prefix", "m"),
        rule(required.join(results, required["id"] == rid, "left_anti"), "missing_row", "id"),
        rule(results.join(required, rid == required["id"], "left_anti"), "extra_row", "source1_entity_id"),
    ]
    if known is not None:
        out.append(rule(ids.where("m rlike '^S[23]-'").join(known, F.col("m") == known["id"], "left_anti"), "unknown_id", "m"))
    if candidates is not None:
        c = candidates.select(rid, F.explode("candidate_entity_ids").alias("m"))
        out.append(rule(ids.join(c, ["source1_entity_id", "m"], "left_anti"), "warning_not_candidate", "source1_entity_id"))
    df = out[0]
    for o in out[1:]:
        df = df.unionAll(o)
    return df


def summary(found: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """rule, n, examples (the first offenders in order; a rule's others are counted only)."""
    first = Window.partitionBy("rule").orderBy("offender")
    shown = found.withColumn("k", F.row_number().over(first)).where(F.col("k") <= examples)
    shown = shown.groupBy("rule").agg(F.array_sort(F.collect_list("offender")).alias("examples"))
    return found.groupBy("rule").agg(F.count("*").alias("n")).join(shown, "rule")


@dataclass
class Report:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def validate(spark: SparkSession, matching: str, source1: str, candidate: str | None = None, targets: list[str] | None = None) -> Report:
    """The file checks: fatal faults of a header or a line, then the rules of ``breaches`` with counts and examples.
    targets: files of the ids that may be matched (without them ids aren't looked up)."""
    report, read = Report(), {}
    required = io.read_ids(spark, source1)
    known = None
    for path in targets or []:
        known = io.read_ids(spark, path) if known is None else known.unionAll(io.read_ids(spark, path))
    if known is None:
        report.warnings.append("ids of targets are not checked")
    for what, path in (("matched", matching), ("candidate", candidate)):
        if not path:
            report.warnings.append("no candidate file")
            continue
        fault = io.header_fault(spark, path, ["source1_entity_id", f"{what}_entity_ids"])
        if fault:
            report.errors.append(f"{what}: {fault}")
            continue
        rows = io.read_results(spark, path)
        bad = rows.where("malformed").select("source1_entity_id").limit(EXAMPLES).collect()
        if bad:
            report.errors.append(f"{what}: malformed rows, e.g. {', '.join(r[0] for r in bad)}")
        read[what] = rows.where("not malformed").select("source1_entity_id", F.col("ids").alias(f"{what}_entity_ids"))
    for what, rows in read.items():
        found = breaches(rows.withColumnRenamed("candidate_entity_ids", "matched_entity_ids"), required, known, read.get("candidate") if what == "matched" else None)
        for r in summary(found).orderBy("rule").collect():
            text = f"{what}: {r['rule']}: {r['n']}, e.g. {', '.join(r['examples'])}"
            (report.warnings if r["rule"].startswith("warning") else report.errors).append(text)
    return report
