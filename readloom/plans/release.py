"""A whole run: checked reads to a published folder of summary.json, provenance.json and _SUCCESS."""

from __future__ import annotations

import os
import platform
import time
import uuid

import pyspark
from pyspark.sql import DataFrame, SparkSession

import readloom
from readloom.errors import LoomError
from readloom.operators import cigar, counters, coverage, intervals, targeted, validation
from readloom.plans.texts import available, canonical_json, unavailable

VERSIONS = {"summary": "1.1.0", "provenance": "1.0.0"}


def check(spark: SparkSession, reads: DataFrame, refs: DataFrame) -> None:
    """Raise for the first category of broken rules; sums must overflow loudly, so ANSI mode has to be on."""
    if spark.conf.get("spark.sql.ansi.enabled") != "true":
        raise LoomError("configuration", "spark.sql.ansi.enabled must be true")
    broken = validation.violations(reads, refs).orderBy("category", "rule").first()  # a row a rule at most
    if broken:
        raise LoomError(broken["category"], f"{broken['records']} records break {broken['rule']}")
    if "rec_index" in reads.columns:
        first = validation.order_violations(reads).orderBy("rec_index").first()
        if first:
            raise LoomError("input_unsorted", "alignment coordinates regress", f"record {first['rec_index']}")


#: What the numbers of the summary mean: unit and description.
DEFINITIONS = {
    "alignment.total": ("records", "Decoded alignment records"),
    "alignment.primary": ("records", "Records that are neither secondary nor supplementary; secondary comes first where both flags are set"),
    "covered_reference_bases": ("bases", "Reference places with a depth of one or more"),
    "depth_histogram": ("bases", "Reference places by exact depth"),
    "mean_depth": ("bases per place", "Accepted bases over the contig's length, six decimals, half up"),
    "threshold_bases": ("bases", "Reference places with at least the depth"),
    "threshold_percentages": ("percent", "threshold_bases over all reference places, six decimals, half up"),
    "total_accepted_aligned_bases": ("bases", "Bases of M, = and X operations of accepted records"),
    "uncovered_reference_bases": ("bases", "Reference places with depth 0"),
}
TARGET_DEFINITIONS = {
    "enrichment": ("ratio", "Share of accepted bases on targets over the targets' share of the reference"),
    "uniformity_penalty_80": ("ratio", "Mean depth of the targets' union over its depth at the 20th percentile"),
    "dropout_targets": ("targets", "Targets with a length that hold a place of depth 0"),
}
POLICY = {"name": "readloom-1", "include_duplicates": False, "include_qc_fail": False, "include_secondary": False, "include_supplementary": False, "mate_overlap_correction": False, "minimum_mapq": 0}
#: The totals that a summary names.
TOTALS = ("total", "mapped", "unmapped", "duplicate", "secondary", "supplementary", "primary", "paired", "read1", "read2", "proper_pair", "mate_unmapped", "singleton", "mate_mapped")


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def application() -> dict:
    return {"version": readloom.__version__, "git_commit": unavailable("build revision was not embedded")}


def sorted_warnings(found: list[tuple[str, str]]) -> list[dict]:
    """Warnings by code, then message, each once."""
    return [{"code": code, "message": message} for code, message in sorted(set(found))]


def summary(
    spark: SparkSession, reads: DataFrame, refs: DataFrame, targets: DataFrame | None = None, depths: tuple[int, ...] = (1, 10, 20, 30), near: int = targeted.NEAR, warnings: list[tuple[str, str]] | None = None
) -> dict:
    """The summary document. Only small aggregates are collected: a row for each contig, target and depth."""
    flags = {r["qc"]: r for r in _rows(counters.flag_counters(reads))}
    contigs = sorted((r for r in _rows(counters.contig_counts(reads, refs)) if r["ref_id"] >= 0), key=lambda r: r["ref_id"])
    runs = coverage.depth_runs(reads, refs).persist()
    try:
        accepted = cigar.spans(reads).select("accepted_bases")
        if not _rows(coverage.invariants(runs, refs, accepted))[0]["holds"]:
            raise LoomError("internal_invariant", "depth does not add up to the accepted bases")
        histogram = coverage.depth_histogram(runs)
        levels = sorted(_rows(coverage.thresholds(histogram, list(depths))), key=lambda r: r["threshold"])
        each = sorted(_rows(coverage.coverage_by_contig(runs, refs)), key=lambda r: r["ref_id"])
        covered = {
            "policy": POLICY,
            "depth_histogram": {str(r["depth"]): r["bases"] for r in _rows(histogram)},
            "per_reference": [
                {"name": r["name"], "length": r["length"], "accepted_aligned_bases": r["accepted_bases"], "covered_reference_bases": r["covered"], "uncovered_reference_bases": r["uncovered"], "mean_depth": r["mean_depth"]}
                for r in each
            ],
            "threshold_bases": {str(r["threshold"]): r["bases"] for r in levels},
            "threshold_percentages": {str(r["threshold"]): r["percent"] for r in levels},
            "total_accepted_aligned_bases": sum(r["accepted_bases"] for r in each), "covered_reference_bases": sum(r["covered"] for r in each), "uncovered_reference_bases": sum(r["uncovered"] for r in each),
            "targeted": available(_targeted(runs, refs, targets, depths, near)) if targets is not None else unavailable("target_bed_not_supplied"),
        }
    finally:
        runs.unpersist()
    defined = DEFINITIONS | (TARGET_DEFINITIONS if targets is not None else {})
    totals = {c: flags["pass"][c] + flags["fail"][c] for c in TOTALS} | {"qc_pass": flags["pass"]["total"], "qc_fail": flags["fail"]["total"]}
    return {
        "schema_version": VERSIONS["summary"],
        "application": application(),
        "metric_definitions": {name: {"unit": unit, "description": text} for name, (unit, text) in defined.items()},
        "alignment_counters": available(totals),
        "per_reference_counters": available([{"name": r["name"], "length": r["length"], "mapped": r["mapped"], "unmapped": available(r["unmapped"])} for r in contigs]),
        "coverage": available(covered),
        "warnings": sorted_warnings(warnings or []),
    }


def _targeted(runs: DataFrame, refs: DataFrame, targets: DataFrame, depths: tuple[int, ...], near: int) -> dict:
    swept = targeted.territory_of_runs(runs, refs, targets, near).persist()  # a row for each label and depth
    part = targeted.sums(swept)
    row = _rows(part)[0]
    status = lambda r: available(r["value"]) if r["status"] == "available" else unavailable(r["reason"])
    each = _rows(targeted.each_target(runs, targets, list(depths)))
    value = {
        "partition": {k: v for k, v in row.items() if k != "d20"}, "histogram": {str(r["depth"]): r["bases"] for r in _rows(targeted.swept_histogram(swept))}, "enrichment": status(_rows(targeted.enrichment(part))[0]), "d20": row["d20"],
        "uniformity_penalty_80": status(_rows(targeted.uniformity_of(part))[0]), "dropout_targets": sum(t["length"] > 0 and t["uncovered"] > 0 for t in each),
        "targets": [t | {c: status(t[c]) for c in ("mean_depth", "covered_percent")} for t in sorted(each, key=lambda t: t["source_index"])],
    }
    swept.unpersist()
    return value


def normalization_actions(targets: DataFrame | None, refs: DataFrame, near: int) -> list[str]:
    """What was done to the targets before they were used, sorted, each once; `selected:` for the widened ones."""
    found = set()
    if targets is not None:
        for prefix, flank in (("", 0), ("selected:", near)):
            report = _rows(intervals.merge_report(targets, refs, flank))[0]
            found |= {f"{prefix}{name}={report[name]}" for name in ("empty_inputs", "left_clips", "right_clips", "overlap_merges", "adjacent_merges") if report[name]}
        found |= {f"reordered={r['moved']}" for r in _rows(intervals.reordered(targets)) if r["moved"]}
    return sorted(found)


def provenance(
    spark: SparkSession, timings: dict[str, int], settings: dict, path: str | None = None, identity: str | None = None, actions: list[str] | None = None, warnings: list[tuple[str, str]] | None = None
) -> dict:
    """The provenance document: how the summary came to be. timings: nanoseconds by stage."""
    size = os.path.getsize(path) if path and os.path.isfile(path) else None
    return {
        "schema_version": VERSIONS["provenance"],
        "application": application(),
        "resolved_config": {k: list(v) if isinstance(v, tuple) else v for k, v in settings.items()},
        "input": {"path": path, "size_bytes": available(size) if size is not None else unavailable("input_is_not_one_local_file"), "checksum": unavailable("checksum_not_requested")},
        "header_identity": available(identity) if identity else unavailable("header_not_supplied"),
        "backend_versions": {"pyspark": pyspark.__version__, "python": platform.python_version()},
        "analysis_plan": {"checks": "all_rules_before_metrics", "depth": "exact_running_sums_by_chunk", "order": "checked_where_record_indices_are_there"},
        "resource_limits": {name: spark.conf.get(name) for name in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes")},
        "stage_timings_ns": timings,
        "normalization_actions": sorted(set(actions or [])),
        "compatibility_profiles": ["flagstat", "idxstats"],
        "warnings": sorted_warnings(warnings or []),
        "errors": [],
        "system": {"architecture": platform.machine(), "os": platform.system().lower(), "logical_cpus": available(os.cpu_count()) if os.cpu_count() else unavailable("not_reported")},
    }


def publish(folder: str, files: dict[str, str], keep_failed: bool = False) -> None:
    """Write files next to the destination, mark them complete and move them there at once; never over something."""
    folder = os.path.abspath(folder)
    if os.path.lexists(folder):
        raise LoomError("output_exists", "the output folder exists", folder)
    staging = f"{folder}.staging-{uuid.uuid4().hex}"
    try:
        os.makedirs(staging)
        for name, text in [*files.items(), ("_SUCCESS", "")]:
            with open(os.path.join(staging, name), "w", encoding="utf-8") as out:
                out.write(text)
                out.flush()
                os.fsync(out.fileno())
        if os.path.lexists(folder):
            raise LoomError("output_exists", "the output folder exists", folder)
        os.rename(staging, folder)
    except OSError as e:
        if keep_failed and os.path.isdir(staging):
            os.rename(staging, f"{folder}._FAILED")
        elif os.path.isdir(staging):
            for name in os.listdir(staging):
                os.unlink(os.path.join(staging, name))
            os.rmdir(staging)
        raise LoomError("output_io", "the output can't be written", folder) from e


def release(
    spark: SparkSession, reads: DataFrame, refs: DataFrame, folder: str, targets: DataFrame | None = None, keep_failed: bool = False,
    path: str | None = None, identity: str | None = None, warnings: list[tuple[str, str]] | None = None, **options,
) -> dict:
    """Check, compute and publish; nothing is published unless everything has been computed. keep_failed: keep what a failed write left.

    path and identity (of the header) are told in the provenance, warnings (code, message) in both documents.
    """
    if os.path.lexists(folder):
        raise LoomError("output_exists", "the output folder exists", folder)
    began, timings = time.monotonic_ns(), {}
    reads = reads.persist()
    try:
        check(spark, reads, refs)
        timings["checks"] = time.monotonic_ns() - began
        document = summary(spark, reads, refs, targets, warnings=warnings, **options)
        timings["metrics"] = time.monotonic_ns() - began - timings["checks"]
    finally:
        reads.unpersist()
    actions = normalization_actions(targets, refs, options.get("near", targeted.NEAR))
    timings["total"] = time.monotonic_ns() - began
    told = provenance(spark, timings, {"keep_failed": keep_failed} | options, path, identity, actions, warnings)
    publish(folder, {"summary.json": canonical_json(document), "provenance.json": canonical_json(told)}, keep_failed)
    return document
