"""Reports as text and canonical JSON, finished on the driver from small collected aggregates."""

from __future__ import annotations

import json

import numpy as np

from readloom.functions.numbers import percent_two, plain_float, single, whole_text


def canonical_json(document) -> str:
    """Sorted keys, two spaces, a final newline, and no floats."""

    def check(x):
        if isinstance(x, float):
            raise TypeError("canonical documents hold no floats")
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            check(y)

    check(document)
    return json.dumps(document, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def available(value) -> dict:
    return {"status": "available", "value": value}


def unavailable(reason: str) -> dict:
    if not reason:
        raise ValueError("an unavailable value needs a reason")
    return {"status": "unavailable", "reason": reason}


def flagstat_text(rows: dict[str, dict]) -> str:
    """Sixteen lines; rows: the flag counters by 'pass' and 'fail'."""
    p, f = rows["pass"], rows["fail"]
    share = lambda r, part, whole: percent_two(r[part], r[whole])
    both = lambda part, whole: f" ({share(p, part, whole)} : {share(f, part, whole)})"
    # Labels and their counters.
    lines = [
        ("total", "in total (QC-passed reads + QC-failed reads)", ""), ("primary", "primary", ""), ("secondary", "secondary", ""), ("supplementary", "supplementary", ""), ("duplicate", "duplicates", ""),
        ("primary_duplicate", "primary duplicates", ""), ("mapped", "mapped", both("mapped", "total")), ("primary_mapped", "primary mapped", both("primary_mapped", "primary")), ("paired", "paired in sequencing", ""),
        ("read1", "read1", ""), ("read2", "read2", ""), ("proper_pair", "properly paired", both("proper_pair", "paired")), ("both_mapped", "with itself and mate mapped", ""), ("singleton", "singletons", both("singleton", "paired")),
        ("mate_different_reference", "with mate mapped to a different chr", ""), ("mate_different_reference_mapq5", "with mate mapped to a different chr (mapQ>=5)", ""),
    ]
    return "".join(f"{p[c]} + {f[c]} {label}{more}\n" for c, label, more in lines)


def idxstats_text(rows: list[dict]) -> str:
    """Contigs in header order, then '*'."""
    ordered = sorted(rows, key=lambda r: (r["ref_id"] < 0, r["ref_id"]))
    return "".join(f"{r['name']}\t{r['length']}\t{r['mapped']}\t{r['unmapped']}\n" for r in ordered)


def human_text(flags: dict[str, dict], contigs: list[dict]) -> str:
    """Totals by name, then contigs in header order and '*'; flags: the flag counters by 'pass' and 'fail'."""
    p, f = flags["pass"], flags["fail"]
    # Names of the totals, in order.
    names = ("primary", "secondary", "supplementary", "mapped", "unmapped", "paired", "proper_pair", "read1", "read2", "mate_mapped", "mate_unmapped", "duplicate", "singleton")
    totals = [("total", p["total"] + f["total"]), ("qc_pass", p["total"]), ("qc_fail", f["total"]), *((c, p[c] + f[c]) for c in names)]
    return "".join(f"{name}\t{n}\n" for name, n in totals) + "per_reference\n" + idxstats_text(contigs)


def insert_summary(table: list[dict]) -> tuple[float, float]:
    """Mean and deviation over the table's rows; the deviation's sum begins at size 1 and leaves out the last row."""
    rows = sorted(table, key=lambda r: r["size"])
    count = sum(r["pairs"] for r in rows)
    if not count:
        return 0.0, 0.0
    mean = sum(float(r["size"] * r["pairs"]) for r in rows) / count
    return mean, (sum((r["size"] - mean) ** 2 * r["pairs"] for r in rows[1:-1]) / count) ** 0.5


# Comment lines of the format and remarks behind its summary numbers.
STATS_HEAD = (
    "# This file was produced by samtools stats (1.24+htslib-1.24) and can be plotted using plot-bamstats\n"
    "# Summary Numbers. Use `grep ^SN | cut -f 2-` to extract this part.\n"
)
STATS_INSERTS = "# Insert sizes. Use `grep ^IS | cut -f 2-` to extract this part. The columns are: insert size, pairs total, inward oriented pairs, outward oriented pairs, other pairs\n"
STATS_REMARKS = {
    "raw total sequences": "excluding supplementary and secondary reads", "is sorted": "sorted by coordinate", "reads mapped and paired": "paired-end technology bit set + both mates mapped", "reads properly paired": "proper-pair bit set",
    "reads paired": "paired-end technology bit set", "reads duplicated": "PCR or optical duplicate bit set", "reads MQ0": "mapped and MQ=0", "total length": "ignores clipping", "total first fragment length": "ignores clipping",
    "total last fragment length": "ignores clipping", "bases mapped": "ignores clipping", "bases mapped (cigar)": "more accurate", "mismatches": "from NM fields", "error rate": "mismatches / bases mapped (cigar)",
}


def stats_text(n: dict, table: list[dict], ways: dict, notes: bool = False) -> str:
    """SN and IS sections; notes: with the format's comment lines and remarks. Input is sorted, as others are refused."""
    mean, deviation = insert_summary(table)
    error = float(single(n["mismatches"], n["bases_mapped_cigar"]))
    proper = float(np.float32(100.0 * n["reads_properly_paired"]) / np.float32(n["sequences"])) if n["sequences"] else 0.0
    quality = float(single(n["quality_sum"], n["total_length"]))
    # Labels of the summary numbers, in order.
    lines = [
        ("raw total sequences", n["sequences"]), ("filtered sequences", 0), ("sequences", n["sequences"]), ("is sorted", 1), ("1st fragments", n["first_fragments"]), ("last fragments", n["last_fragments"]),
        ("reads mapped", n["reads_mapped"]), ("reads mapped and paired", n["reads_mapped_and_paired"]), ("reads unmapped", n["reads_unmapped"]), ("reads properly paired", n["reads_properly_paired"]), ("reads paired", n["reads_paired"]),
        ("reads duplicated", n["reads_duplicated"]), ("reads MQ0", n["reads_mq0"]), ("reads QC failed", n["reads_qc_failed"]), ("non-primary alignments", n["non_primary"]), ("supplementary alignments", n["supplementary"]),
        ("total length", n["total_length"]), ("total first fragment length", n["first_length"]), ("total last fragment length", n["last_length"]), ("bases mapped", n["bases_mapped"]), ("bases mapped (cigar)", n["bases_mapped_cigar"]),
        ("bases trimmed", 0), ("bases duplicated", n["bases_duplicated"]), ("mismatches", n["mismatches"]), ("error rate", f"{error:.6e}"), ("average length", whole_text(n["total_length"], n["sequences"])),
        ("average first fragment length", whole_text(n["first_length"], n["first_fragments"])), ("average last fragment length", whole_text(n["last_length"], n["last_fragments"])), ("maximum length", n["max_length"]),
        ("maximum first fragment length", n["max_first_length"]), ("maximum last fragment length", n["max_last_length"]), ("average quality", f"{quality:.1f}"), ("insert size average", f"{mean:.1f}"),
        ("insert size standard deviation", f"{deviation:.1f}"), ("inward oriented pairs", ways["inward"]), ("outward oriented pairs", ways["outward"]), ("pairs with other orientation", ways["other"]),
        ("pairs on different chromosomes", n["different_chromosomes"]), ("percentage of properly paired reads (%)", f"{proper:.1f}"),
    ]
    rows = "".join(f"IS\t{r['size']}\t{r['pairs']}\t{r['inward']}\t{r['outward']}\t{r['other']}\n" for r in sorted(table, key=lambda r: r["size"]))
    if not notes:
        return "".join(f"SN\t{label}:\t{value}\n" for label, value in lines) + rows
    remark = lambda label: f"\t# {STATS_REMARKS[label]}" if label in STATS_REMARKS else ""
    return STATS_HEAD + "".join(f"SN\t{label}:\t{value}{remark(label)}\n" for label, value in lines) + STATS_INSERTS + rows


METRICS_HEAD = "## htsjdk.samtools.metrics.StringHeader\n\n## METRICS CLASS\tpicard.analysis."  # fixed value


def alignment_summary_text(rows: list[dict]) -> str:
    # Columns of the format and the order of its rows.
    columns = ("CATEGORY", "TOTAL_READS", "PF_READS", "PCT_PF_READS", "PF_NOISE_READS", "PCT_ADAPTER", "MEAN_READ_LENGTH", "SD_READ_LENGTH", "MEDIAN_READ_LENGTH", "MAD_READ_LENGTH", "MIN_READ_LENGTH", "MAX_READ_LENGTH", "BAD_CYCLES")
    order = {c: i for i, c in enumerate(("FIRST_OF_PAIR", "SECOND_OF_PAIR", "PAIR", "UNPAIRED"))}
    out = METRICS_HEAD + "AlignmentSummaryMetrics\n" + "\t".join(columns) + "\n"
    for r in sorted(rows, key=lambda r: order[r["category"]]):
        part = lambda a, b: plain_float(a / b if b else 0.0)
        values = [r["category"], r["total_reads"], r["pf_reads"], part(r["pf_reads"], r["total_reads"]), r["pf_noise_reads"], part(r["adapter_reads"], r["pf_reads"]), plain_float(r["mean"]), plain_float(r["deviation"]), plain_float(r["median"]), plain_float(r["mad"]), r["least"], r["most"], r["bad_cycles"]]
        out += "\t".join(map(str, values)) + "\n"
    return out


def insert_size_text(metrics: list[dict], widths: list[dict], histogram: list[dict]) -> str:
    """Metrics of all reads and the trimmed histogram by orientation; an empty text where there are no pairs.

    A size that an orientation lacks is an empty cell, and so are sample, library and read group.
    """
    if not metrics:
        return ""
    order = [o for o in ("FR", "RF", "TANDEM") if any(m["orientation"] == o for m in metrics)]
    wide = {(w["orientation"], round(w["share"] * 100)): w["width"] for w in widths}
    # Widths and columns of the format.
    shares = (10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 99)
    columns = ["MEDIAN_INSERT_SIZE", "MODE_INSERT_SIZE", "MEDIAN_ABSOLUTE_DEVIATION", "MIN_INSERT_SIZE", "MAX_INSERT_SIZE", "MEAN_INSERT_SIZE", "STANDARD_DEVIATION", "READ_PAIRS", "PAIR_ORIENTATION", *(f"WIDTH_OF_{s}_PERCENT" for s in shares), "SAMPLE", "LIBRARY", "READ_GROUP"]
    out = METRICS_HEAD + "InsertSizeMetrics\n" + "\t".join(columns) + "\n"
    for m in sorted(metrics, key=lambda m: order.index(m["orientation"])):
        values = [plain_float(m["median"]), m["mode"], plain_float(m["mad"]), m["least"], m["most"], plain_float(m["mean"]), plain_float(m["deviation"]), m["read_pairs"], m["orientation"], *(wide[m["orientation"], s] for s in shares), "", "", ""]
        out += "\t".join(map(str, values)) + "\n"
    sizes: dict[int, dict] = {}
    for h in histogram:
        sizes.setdefault(h["size"], {})[h["orientation"]] = h["n"]
    out += "\n## HISTOGRAM\tjava.lang.Integer\n" + "\t".join(["insert_size", *(f"All_Reads.{o.lower()}_count" for o in order)]) + "\n"
    return out + "".join("\t".join(map(str, [s, *(sizes[s].get(o, "") for o in order)])) + "\n" for s in sorted(sizes))
