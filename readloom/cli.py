"""Command line: python -m readloom.cli qc --input X (--output D [--targets B] | --format F)."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from readloom.errors import LoomError
from readloom.functions.settings import DEFAULTS, memory_size, resolve
from readloom.operators import alignment_metrics, counters, summary_stats
from readloom.plans import release, texts
from readloom.sources import bam, bed

FORMATS = ("json", "human", "flagstat", "idxstats", "stats", "alignment-summary", "insert-size")


#: Columns that the checks and most reports read; flagstat and idxstats decode no bases, qualities or tags.
PLACES = ["rec_index", "flag", "ref_id", "pos", "mapq", "mate_ref_id", "mate_pos", "tlen", "cigar", "seq_length"]
COLUMNS = {"flagstat": PLACES, "idxstats": PLACES, "human": PLACES, "json": PLACES, "insert-size": PLACES, "stats": [*PLACES, "qname", "seq", "qual", "nm"], "alignment-summary": [*PLACES, "qname", "seq", "nm", "xn"]}


def open_input(spark: SparkSession, path: str, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame, bam.Header]:
    """Reads, contigs and header of a BAM file, or of a folder of them."""
    header = bam.read_header(path)
    reads = bam.read_bam(spark, path, columns)
    refs = spark.createDataFrame([(i, n, length) for i, (n, length) in enumerate(header.contigs)], "ref_id int, name string, length bigint")
    return reads, refs, header


def rendered(spark: SparkSession, path: str, form: str) -> str:
    """One report as text."""
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    reads, refs, _ = open_input(spark, path, COLUMNS[form])
    reads = reads.persist()
    release.check(spark, reads, refs)
    if form == "idxstats":
        return texts.idxstats_text(rows(counters.contig_counts(reads, refs)))
    if form == "stats":
        counts = summary_stats.insert_counts(reads)
        return texts.stats_text(rows(summary_stats.summary_numbers(reads))[0], rows(summary_stats.insert_table(counts)), rows(summary_stats.insert_totals(counts))[0], notes=True)
    if form == "alignment-summary":
        return texts.alignment_summary_text(rows(alignment_metrics.alignment_summary(reads)))
    if form == "insert-size":
        bins = alignment_metrics.insert_bins(reads).persist()
        alignment_metrics.refuse_split_pairs(bins)
        return texts.insert_size_text(rows(alignment_metrics.insert_metrics(bins)), rows(alignment_metrics.insert_widths(bins)), rows(alignment_metrics.insert_histogram(bins)))
    flags = {r["qc"]: r for r in rows(counters.flag_counters(reads))}
    if form == "flagstat":
        return texts.flagstat_text(flags)
    if form == "human":
        return texts.human_text(flags, rows(counters.contig_counts(reads, refs)))
    return texts.canonical_json({c: flags["pass"][c] + flags["fail"][c] for c in counters.FLAG_COLUMNS})


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="readloom")
    parser.add_argument("command", choices=["qc"])
    for name in ("--input", "--output", "--targets", "--reference", "--config", "--thresholds", "--near-distance"):
        parser.add_argument(name)
    parser.add_argument("--format", choices=FORMATS)
    a = parser.parse_args(argv)
    try:
        if not a.input or bool(a.output) == bool(a.format):
            raise LoomError("usage", "give --input and one of --output and --format")
        file_text = open(a.config, encoding="utf-8").read() if a.config else None  # noqa: SIM115
        settings = resolve(file_text, {"thresholds": a.thresholds, "near_distance": a.near_distance})
        spark = SparkSession.builder.appName("readloom").getOrCreate()
        if a.format:
            sys.stdout.write(rendered(spark, a.input, a.format))
            return 0
        reads, refs, header = open_input(spark, a.input, [*PLACES, "qname", "nm"])
        if a.reference:
            bed.check_reference(header.contigs, header.md5, bed.fasta_contigs(a.reference))
        targets = bed.read_bed(spark, a.targets, header.contigs)[0] if a.targets else None
        warnings = []
        if settings["memory_limit"] != memory_size(DEFAULTS["memory_limit"]):
            warnings.append(("memory_limit_left_to_spark", f"memory_limit={settings['memory_limit']} is recorded; executors' memory is set by spark.executor.memory"))
        told = {"path": a.input, "identity": header.identity, "warnings": warnings}
        release.release(spark, reads, refs, a.output, targets, depths=tuple(settings["thresholds"]), near=settings["near_distance"], keep_failed=settings["keep_failed"], **told)
        return 0
    except LoomError as e:
        print(e.text(), file=sys.stderr)
        return e.exit_code


if __name__ == "__main__":
    sys.exit(main())
