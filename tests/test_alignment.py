import json
import random

import pytest
from pyspark.sql import functions as F

from readloom.errors import LoomError
from readloom.functions import numbers, settings
from readloom.operators import alignment_metrics as am
from readloom.operators import cigar, counters, coverage, intervals, overlap, targeted, validation
from readloom.operators import summary_stats as ss
from readloom.plans import release, texts
from readloom.sources import bam, bed, view
from tests import rows as R


def dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_flag_counters(spark):
    by = {r["qc"]: r for r in dicts(counters.flag_counters(R.frame(spark, R.FLAGS)))}
    total = {c: by["pass"][c] + by["fail"][c] for c in counters.FLAG_COLUMNS}
    want = {"total": 9, "primary": 6, "secondary": 2, "supplementary": 1, "mapped": 9, "unmapped": 0, "paired": 4, "proper_pair": 2, "read1": 3, "read2": 1, "mate_mapped": 3, "mate_unmapped": 1, "duplicate": 1, "singleton": 1}
    assert {c: total[c] for c in want} == want
    assert (by["pass"]["total"], by["fail"]["total"]) == (8, 1)
    assert [by["pass"][c] for c in ("both_mapped", "mate_different_reference", "mate_different_reference_mapq5")] == [3, 1, 1]
    text = texts.flagstat_text(by)
    assert text.count("\n") == 16 and text.startswith("8 + 1 in total")
    human = texts.human_text(by, dicts(counters.contig_counts(R.frame(spark, R.BASIC), R.refs(spark)))).splitlines()
    assert human[:4] == ["total\t9", "qc_pass\t8", "qc_fail\t1", "primary\t6"] and human[15:18] == ["singleton\t1", "per_reference", "chr1\t1000000\t1\t0"] and human[-1] == "*\t0\t0\t1"
    empty = dicts(counters.flag_counters(R.frame(spark, [])))
    assert len(empty) == 2 and all(r["total"] == 0 for r in empty)


def test_contig_counts(spark):
    got = dicts(counters.contig_counts(R.frame(spark, R.BASIC), R.refs(spark)))
    assert texts.idxstats_text(got) == "chr1\t1000000\t1\t0\nchr2\t1000000\t1\t0\n*\t0\t0\t1\n"


@pytest.mark.parametrize("name,want", [("BASIC", 19), ("CIGARS", 6), ("FLAGS", 30), ("CHUNKS", 28)])
def test_accepted_bases(spark, name, want):
    assert cigar.spans(R.frame(spark, getattr(R, name))).first()["accepted_bases"] == want


def test_blocks_short_and_long(spark):
    reads = R.frame(spark, R.CIGARS)
    assert sorted(map(tuple, cigar.blocks(reads).collect())) == [(0, 500, 503), (0, 503, 505), (0, 505, 506)]
    long = R.frame(spark, [R.read("long", 0, 0, 1000, [(1, 0)] * 1500, "A" * 1500)])
    assert cigar.blocks(long).agg(F.sum(F.col("stop") - F.col("start"))).first()[0] == 1500
    histogram = {r["depth"]: r["bases"] for r in dicts(coverage.depth_histogram(coverage.depth_runs(long, R.refs(spark))))}
    assert histogram == {0: 1_998_500, 1: 1500}


@pytest.mark.parametrize("chunk", [7, 64, 65536, 1 << 20])
def test_depth_does_not_depend_on_chunks(spark, chunk):
    refs = R.refs(spark, [(0, "a", 70_000), (1, "empty", 0)])
    runs = coverage.depth_runs(R.frame(spark, R.CHUNKS), refs, chunk)
    assert {r["depth"]: r["bases"] for r in dicts(coverage.depth_histogram(runs))} == {0: 69_976, 1: 20, 2: 4}
    by = {r["name"]: r for r in dicts(coverage.coverage_by_contig(runs, refs))}
    assert by["empty"]["mean_depth"] == "0.000000" and by["a"]["accepted_bases"] == 28 and by["a"]["covered"] == 24


def test_depth_of_duplicates_and_failures(spark):
    reads = R.frame(spark, [R.read("dup", 0x400, 0, 70000, "10M"), R.read("qc", 0x200, 0, 70005, "10M"), R.read("kept", 0, 0, 70010, "10M")])
    assert {r["depth"]: r["bases"] for r in dicts(coverage.depth_histogram(coverage.depth_runs(reads, R.refs(spark))))} == {0: 1_999_990, 1: 10}
    row = coverage.invariants(coverage.depth_runs(reads, R.refs(spark)), R.refs(spark), cigar.spans(reads).select("accepted_bases")).first()
    assert row["holds"]


def test_targets(spark):
    refs, reads = R.refs(spark), R.frame(spark, R.CHUNKS)
    targets = R.targets(spark, [(0, 65534, 65542), (0, 65540, 65544), (0, 65550, 65562), (0, 70000, 70000)])
    runs = coverage.depth_runs(reads, refs).cache()
    part = targeted.partition(runs, refs, targets, 5)
    row = part.first()
    assert (row["target_territory"], row["near_territory"], row["on_bases"], row["near_bases"], row["off_bases"]) == (22, 16, 16, 12, 0)
    inner = targeted.target_histogram(runs, targeted.union_of(targets, refs))
    assert {r["depth"]: r["bases"] for r in dicts(inner)} == {0: 10, 1: 8, 2: 4}
    thresholds = {r["threshold"]: (r["bases"], r["percent"]) for r in dicts(coverage.thresholds(inner, [2, 1, 1]))}
    assert thresholds == {1: (12, "54.545455"), 2: (4, "18.181818")}
    each = {r["source_index"]: r for r in dicts(targeted.each_target(runs, targets, [1, 2]))}
    assert [(each[i]["depth_sum"], each[i]["mean_depth"]["value"]) for i in range(3)] == [(12, "1.500000"), (4, "1.000000"), (2, "0.166667")]
    assert each[3]["mean_depth"] == {"status": "unavailable", "value": None, "reason": "zero_length_target"}
    assert targeted.dropout(targeted.each_target(runs, targets, [1])).first()[0] == 1
    assert [tuple(r) for r in targeted.zero_runs(runs, targets).collect()] == [(2, 65550, 65560)]
    assert targeted.enrichment(part).first()["value"] == "51948.051948"
    assert targeted.d20(inner).first()["d20"] == 0
    assert targeted.uniformity(part, targeted.d20(inner)).first()["reason"] == "target_depth_20th_percentile_is_zero"
    none = R.frame(spark, [])
    assert targeted.enrichment(targeted.partition(coverage.depth_runs(none, refs), refs, targets)).first()["reason"] == "no_accepted_aligned_bases"


def test_percentile(spark):
    make = lambda pairs: spark.createDataFrame(pairs, "depth bigint, bases bigint")
    assert targeted.d20(make([(0, 2), (1, 3), (7, 5)])).first()["d20"] == 0
    assert targeted.d20(make([(0, 1), (1, 4), (7, 5)])).first()["d20"] == 1
    assert targeted.d20(make([(0, 0)])).first()["d20"] is None


def test_merge_order_adjacency_flanks(spark):
    refs = R.refs(spark, [(0, "chr1", 100), (1, "chr2", 80)])
    given = R.targets(spark, [(1, 10, 20), (0, 20, 30), (0, 10, 20), (0, 15, 25)])
    got = sorted((r["ref_id"], r["start"], r["stop"], r["sources"]) for r in targeted.union_of(given, refs).collect())
    assert got == [(0, 10, 30, [1, 2, 3]), (1, 10, 20, [0])]
    report = intervals.merge_report(given, refs, 0).first()
    assert (report["overlap_merges"], report["adjacent_merges"], report["territory"]) == (2, 0, 30)
    assert intervals.reordered(given).first()["moved"] == 4
    assert intervals.merge_report(R.targets(spark, [(0, 10, 20), (0, 20, 30)]), refs, 0).first()["adjacent_merges"] == 1
    flanked = R.targets(spark, [(0, 2, 10), (0, 90, 99)])
    assert sorted((r["start"], r["stop"]) for r in targeted.union_of(flanked, refs, 5).collect()) == [(0, 15), (85, 100)]
    report = intervals.merge_report(flanked, refs, 5).first()
    assert (report["left_clips"], report["right_clips"]) == (1, 1)
    assert targeted.union_of(R.targets(spark, [(0, 5, 5)]), refs, 20).count() == 0
    assert intervals.uncontained(given, targeted.union_of(given, refs, 5)).count() == 0


@pytest.mark.parametrize("chunk", [1, 16, 1 << 20])
def test_merge_does_not_depend_on_chunks(spark, chunk):
    """One contig with nested, touching, repeated and long intervals, against a walk over the sorted list."""
    rng = random.Random(chunk)
    rows = [(i, 0, a := rng.randrange(900), a + rng.choice([1, 3, 9, 40])) for i in range(90)] + [(90, 0, 300, 480), (91, 0, 300, 480), (92, 1, 5, 6), (93, 0, 950, 960), (94, 0, 960, 961)]
    want = []
    for i, ref, a, b in sorted(rows, key=lambda r: (r[1], r[2], r[3], r[0])):
        if want and want[-1][0] == ref and a <= want[-1][2]:
            want[-1][2] = max(want[-1][2], b)
            want[-1][3].append(i)
        else:
            want.append([ref, a, b, [i]])
    given = spark.createDataFrame(rows, "source_index bigint, ref_id int, start bigint, stop bigint")
    got = sorted([r["ref_id"], r["start"], r["stop"], r["sources"]] for r in intervals.merge(given, chunk).collect())
    assert got == sorted([r, a, b, sorted(s)] for r, a, b, s in want)
    assert sorted(map(tuple, intervals.sources(given, chunk).collect())) == sorted((i, r, a) for r, a, _, s in want for i in s)
    assert intervals.merge(given.limit(0), chunk).count() == 0


def test_overlap_join_across_bins(spark):
    runs = spark.createDataFrame([(0, 0, 100, 1), (0, 100, 250, 2)], "ref_id int, start bigint, stop bigint, depth bigint")
    wide = R.targets(spark, [(0, 5, 245), (0, 90, 110)])
    for size in (8, 64, 1 << 14):
        got = sorted((r["source_index"], r["depth"], r["low"], r["high"]) for r in intervals.overlaps(runs, wide, size).collect())
        assert got == [(0, 1, 5, 100), (0, 2, 100, 245), (1, 1, 90, 100), (1, 2, 100, 110)]


def test_summary_numbers(spark):
    reads = R.frame(spark, R.FLAGS)
    n = ss.summary_numbers(reads).first().asDict()
    want = {"sequences": 6, "first_fragments": 5, "last_fragments": 1, "reads_mapped": 6, "reads_mapped_and_paired": 3, "reads_properly_paired": 2, "reads_paired": 4, "reads_duplicated": 1, "reads_mq0": 0, "reads_qc_failed": 1, "non_primary": 2, "supplementary": 1,
            "total_length": 40, "first_length": 30, "last_length": 10, "bases_mapped": 40, "bases_mapped_cigar": 45, "bases_duplicated": 5, "max_length": 10, "max_first_length": 10, "max_last_length": 10, "different_chromosomes": 0}
    assert {k: n[k] for k in want} == want
    counts = ss.insert_counts(reads)
    table = dicts(ss.insert_table(counts))
    text = texts.stats_text(n, table, ss.insert_totals(counts).first().asDict())
    for line in ("error rate:\t0.000000e+00", "average length:\t7", "average first fragment length:\t6", "average quality:\t30.0", "insert size average:\t70.0", "insert size standard deviation:\t0.0", "pairs with other orientation:\t1", "percentage of properly paired reads (%):\t33.3"):
        assert f"SN\t{line}\n" in text
    assert text.count("\nIS\t") == 71 and text.endswith("IS\t70\t1\t0\t0\t1\n") and text.count("SN\t") == 39
    noted = texts.stats_text(n, table, ss.insert_totals(counts).first().asDict(), notes=True).splitlines()
    plain = [line.split("\t# ")[0] for line in noted if not line.startswith("#")]
    assert plain == text.splitlines() and sum("\t# " in line for line in noted) == 14
    assert [k for k, line in enumerate(noted) if line.startswith("# ")] == [0, 1, 41]
    assert "SN\terror rate:\t0.000000e+00\t# mismatches / bases mapped (cigar)" in noted and "SN\tis sorted:\t1\t# sorted by coordinate" in noted
    basic = R.frame(spark, R.BASIC)
    n = ss.summary_numbers(basic).first()
    assert (n["sequences"], n["reads_mapped"], n["reads_unmapped"], n["total_length"], n["bases_mapped"], n["bases_mapped_cigar"], n["max_length"]) == (3, 2, 1, 24, 20, 20, 10)
    assert ss.insert_table(ss.insert_counts(basic)).count() == 0


def test_alignment_summary(spark):
    got = {r["category"]: r for r in dicts(am.alignment_summary(R.frame(spark, R.ALIGNMENT_EDGE)))}
    keys = ("total_reads", "pf_reads", "pf_noise_reads", "adapter_reads", "mean", "median", "mad", "bad_cycles")
    assert [got["FIRST_OF_PAIR"][k] for k in keys] == [1, 1, 0, 1, 16, 16, 0, 0] and got["FIRST_OF_PAIR"]["deviation"] is None
    assert [got["PAIR"][k] for k in keys] == [2, 2, 0, 2, 16, 16, 0, 0] and got["PAIR"]["deviation"] == 0
    assert [got["UNPAIRED"][k] for k in keys] == [5, 5, 1, 0, 4, 4, 0, 1]
    text = texts.alignment_summary_text(list(got.values()))
    assert "\nFIRST_OF_PAIR\t1\t1\t1\t0\t1\t16\t?\t16\t0\t16\t16\t0\n" in text
    assert text.startswith("## htsjdk.samtools.metrics.StringHeader\n\n## METRICS CLASS\tpicard.analysis.AlignmentSummaryMetrics\nCATEGORY\tTOTAL_READS\t")
    assert [r["category"] for r in dicts(am.alignment_summary(R.frame(spark, [])))] == ["UNPAIRED"]


def test_insert_metrics(spark):
    bins, histogram = am.insert_bins(R.frame(spark, R.insert_edge())).cache(), am.insert_histogram(am.insert_bins(R.frame(spark, R.insert_edge())))
    assert {(r["orientation"], r["size"]): r["n"] for r in dicts(histogram)} == {("FR", 100): 10, ("FR", 101): 10, ("FR", 102): 8, ("FR", 103): 8}
    (m,) = dicts(am.insert_metrics(bins))
    assert [m[k] for k in ("median", "mode", "mad", "least", "most", "read_pairs")] == [101, 100, 1, 100, 1000, 37]
    assert numbers.plain_float(m["mean"]) == "101.388889" and f"{m['deviation']:.5f}" == "1.12828"
    widths = dicts(am.insert_widths(bins))
    assert {round(w["share"] * 100): w["width"] for w in widths} == {10: 1, 20: 1, 30: 3, 40: 3, 50: 3, 60: 3, 70: 3, 80: 5, 90: 5, 95: 5, 99: 1799}
    assert "\n100\t10\n" in texts.insert_size_text([m], widths, dicts(histogram)) and texts.insert_size_text([], [], []) == ""
    lines = texts.insert_size_text([m, m | {"orientation": "RF"}], widths + [w | {"orientation": "RF"} for w in widths], dicts(histogram) + [{"orientation": "RF", "size": 99, "n": 3}]).splitlines()
    assert lines[:3] == ["## htsjdk.samtools.metrics.StringHeader", "", "## METRICS CLASS\tpicard.analysis.InsertSizeMetrics"] and all(len(row.split("\t")) == 23 for row in lines[3:6])
    assert lines[6:11] == ["", "## HISTOGRAM\tjava.lang.Integer", "insert_size\tAll_Reads.fr_count\tAll_Reads.rf_count", "99\t\t3", "100\t10\t"]


def test_overlap(spark):
    reads = R.frame(spark, R.OVERLAP)
    quality = F.conv(F.hex(F.substring(F.col("qual"), (F.col("query_at") + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    base = F.substring(F.col("seq"), (F.col("query_at") + 1).cast("int"), F.lit(1))
    row = overlap.base_partition(overlap.genome_candidates(reads), ["qual", "seq"], quality, base).first()
    assert tuple(row) == (135, 10, 35)
    assert overlap.target_clip(reads).first()[0] == 64
    assert overlap.crowded_loci(reads, 2).count() > 0 and overlap.crowded_loci(reads).count() == 0


def test_depth_of_blocks_cut_at_chunks(spark):
    """Depth from chunks of any size, with CIGARs walked in arrays and by rows, equals a count of each base."""
    rng = random.Random(3)
    rows, depth = [], {0: [0] * 211, 1: [0] * 64}
    for _ in range(120):
        ref = rng.randrange(2)
        pos, ops = rng.randrange(60), [(rng.randrange(1, 20), rng.choice([0, 1, 2, 3, 4, 7, 8])) for _ in range(rng.randrange(1, 6))]
        rows.append((0, ref, pos, [{"len": n, "op": o} for n, o in ops]))
        at = pos
        for n, o in ops:
            if o in (0, 7, 8):
                for p in range(at, min(at + n, len(depth[ref]))):
                    depth[ref][p] += 1
            at += n if o in (0, 2, 3, 7, 8) else 0
    reads = spark.createDataFrame(rows, "flag int, ref_id int, pos bigint, cigar array<struct<len: int, op: int>>")
    refs = spark.createDataFrame([(0, "a", 211), (1, "b", 64), (2, "c", 0)], "ref_id int, name string, length bigint")
    for chunk, long in [(7, True), (64, False), (1 << 20, True)]:
        got = {0: [None] * 211, 1: [None] * 64}
        for r in coverage.depth_runs(reads, refs, chunk, long).collect():
            assert r["start"] // chunk == (r["stop"] - 1) // chunk
            for p in range(r["start"], r["stop"]):
                assert got[r["ref_id"]][p] is None
                got[r["ref_id"]][p] = r["depth"]
        assert got == depth


def test_locus_cap_refuses_one_more(spark):
    """At the cap all goes on; one more candidate at one place is refused, whatever the names."""
    one = lambda pos: F.array(F.struct(F.lit(5).alias("len"), F.lit(0).alias("op"))).alias("cigar")
    at = lambda n, pos: spark.range(n).select(F.lit(0).alias("ref_id"), F.lit(pos).cast("bigint").alias("pos"), one(pos))
    full = at(60_000, 10).union(at(40_000, 14)).union(at(60_000, (1 << 20) - 2))
    overlap.refuse_crowded(full)
    with pytest.raises(LoomError, match="resource_limit") as refused:
        overlap.refuse_crowded(full.union(at(1, 12)))
    assert "place 14" in refused.value.text(sensitive=True)
    assert [tuple(r) for r in overlap.crowded_runs(full, 59_999).orderBy("start").collect()] == [(0, 10, 14, 60_000), (0, 14, 15, 100_000), (0, (1 << 20) - 2, 1 << 20, 60_000), (0, 1 << 20, (1 << 20) + 3, 60_000)]


def test_violations(spark):
    good = R.BASIC
    assert validation.violations(R.frame(spark, good), R.refs(spark)).count() == 0
    bad = {"unknown_reference": R.read("x", 0, 7, 10, "5M"), "reserved_flag": R.read("x", 0x1000, 0, 10, "5M"), "proper_without_pair": R.read("x", 2, 0, 10, "5M"), "beyond_reference": R.read("x", 0, 0, 999_998, "5M"), "query_span": R.read("x", 0, 0, 10, "5M", "ACG"), "mapped_without_cigar": R.read("x", 0, 0, 10, "")}
    for rule, row in bad.items():
        assert rule in [r["rule"] for r in validation.violations(R.frame(spark, [*good, row]), R.refs(spark)).collect()]
    assert [r[0] for r in validation.order_violations(R.frame(spark, [R.read("a", 0, 0, 900, "5M"), R.read("b", 0, 0, 800, "5M")]), 1).collect()] == [1]
    assert validation.order_violations(R.frame(spark, [R.read("a", 0, 0, 950, "5M"), R.read("b", 4, -1, -1, "", "A", mapq=0)])).count() == 0


def test_violations_of_runs_equal_those_of_single_operations(spark, monkeypatch, tmp_path):
    """Operations with `times` count and add up as if each stood so often, up to a million; the view has no array of a million."""
    rng = random.Random(7)
    rows = []
    for i in range(300):
        runs = [(rng.choice((0, 1, 3, 7)), rng.choice((*range(9), 9, -1)) if rng.random() < 0.1 else rng.choice((0, 1, 2, 4, 5)), rng.choice((1, 1, 2, 5))) for _ in range(rng.randrange(5))]
        bases = sum(n * t for n, o, t in runs if o in (0, 1, 4, 7, 8)) + (rng.random() < 0.2)
        rows.append((i, 0, 0, rng.choice((10, 999_960)), -1, -1, bases, runs))
    start = "rec_index long, flag int, ref_id int, pos long, mate_ref_id int, mate_pos long, seq_length long, cigar array<struct<len: int, op: int"
    told = lambda cigars, more: sorted(map(tuple, validation.violations(spark.createDataFrame([(*r[:-1], c) for r, c in zip(rows, cigars, strict=True)], f"{start}{more}>>"), R.refs(spark)).collect()))
    monkeypatch.setattr(validation, "MAX_OPERATIONS", 9)
    plain = told([[(n, o) for n, o, t in r[-1] for _ in range(t)] for r in rows], "")
    assert told([r[-1] for r in rows], ", times: int") == plain
    assert {rule for rule, _, _ in plain} == {"zero_length_operation", "unknown_operation", "query_span", "mapped_without_cigar", "beyond_reference", "operation_limit"}
    monkeypatch.undo()
    rows[:] = [(0, 0, 0, 10, -1, -1, 5, [(5, 0, 1), (1, 5, 999_999)]), (1, 0, 0, 10, -1, -1, 5, [(5, 0, 1), (1, 5, 1_000_000)])]
    assert told([r[-1] for r in rows], ", times: int") == [("operation_limit", "resource_limit", 1)]
    line = spark.createDataFrame([(k, 1, 1, 1, 20.0, 0.05, 0.02) for k in range(1, 10_008)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double")
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 3)], "s_suppkey long, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    longest = view.broken_reads(spark, str(tmp_path)).selectExpr("max(size(cigar))", "max(aggregate(cigar, 0, (a, o) -> a + o.times))").first()
    assert longest[0] <= 6 and longest[1] >= 1_000_000


def test_read_groups(spark):
    reads = R.frame(spark, [R.read("a", 0, 0, 700, "5M", rg="known"), R.read("b", 0, 0, 710, "5M"), R.read("c", 0, 0, 720, "5M", rg="not-declared"), R.read("d", 0, 0, 730, "5M", rg="twice")])
    groups = spark.createDataFrame([("known",), ("twice",), ("twice",)], "id string")
    assert {r["state"]: r["records"] for r in dicts(counters.read_group_states(reads, groups))} == {"known": 1, "missing": 1, "unknown": 1, "ambiguous": 1}


def test_numbers_and_settings():
    assert [numbers.ratio_six(1, 3), numbers.ratio_six(2, 3), numbers.ratio_six(0, 0), numbers.percent_six(1, 4)] == ["0.333333", "0.666667", "0.000000", "25.000000"]
    assert numbers.percent_two(1, 3) == "33.33%" and numbers.percent_two(0, 0) == "N/A" and numbers.plain_float(-0.0000001) == "0"
    assert settings.memory_size("4GiB") == 4 << 30 and settings.threshold_list("30,1,10,10,20") == [1, 10, 20, 30]
    for text in ("4GB", "0B"):
        with pytest.raises(LoomError):
            settings.memory_size(text)
    assert settings.resolve('schema_version = 1\nthresholds = "5,2"', {"near_distance": "7"}, {})["thresholds"] == [2, 5]
    with pytest.raises(LoomError):
        settings.parse_settings("schema_version = 1\nnothing = 2")


def test_fixed_columns(spark):
    df = spark.createDataFrame([(1, 3), (2, 3), (5, 0), (1, 1)], "n bigint, d bigint").select(numbers.fixed(F.col("n"), F.col("d")).alias("x"))
    assert [r["x"] for r in df.collect()] == ["0.333333", "0.666667", "0.000000", "1.000000"]


def test_bed():
    contigs = [("chr1", 120), ("chr2", 80)]
    got = bed.parse_bed(b"# note\r\ntrack x\nchr1\t10\t20\ta\nchr2\t5\t5\tb\n", contigs)
    assert [(r[0], r[1], r[2], r[5], r[6], r[7]) for r in got.rows] == [(0, 3, 0, 10, 20, "a"), (1, 4, 1, 5, 5, "b")] and got.crlf_lines == 1
    for text, category in ((b"chr9 1 2", "target_contig"), (b"chr1 5 2", "target_format"), (b"chr1 1 200", "target_format"), (b"chr1\t\t1\t2", "target_format"), (b"\xff", "target_format"), (b"chr1 1 2\nchr1 1 2 x", "target_format")):
        with pytest.raises(LoomError) as e:
            bed.parse_bed(text, contigs)
        assert e.value.category == category


def test_bam_round_trip_and_release(spark, tmp_path):
    path = str(tmp_path / "flags.bam")
    contigs = [("chr1", 1_000_000), ("chr2", 1_000_000)]
    bam.write_bam(path, contigs, R.FLAGS, block=100)
    from readloom.cli import open_input, rendered

    reads, refs, header = open_input(spark, path)
    assert header.contigs == contigs
    assert dicts(counters.flag_counters(reads)) == dicts(counters.flag_counters(R.frame(spark, R.FLAGS)))
    few = open_input(spark, path, ["flag", "ref_id"])[0]
    assert few.columns == ["flag", "ref_id"] and few.where("flag IS NOT NULL").count() == 9
    assert "9 + 0" not in rendered(spark, path, "flagstat") and rendered(spark, path, "idxstats").startswith("chr1\t1000000\t9\t0")
    out = str(tmp_path / "out")
    document = release.release(spark, reads, refs, out, R.targets(spark, [(0, 100, 170)]))
    assert set(document) == {"alignment_counters", "application", "coverage", "metric_definitions", "per_reference_counters", "schema_version", "warnings"}
    covered, totals = document["coverage"]["value"], document["alignment_counters"]["value"]
    assert set(covered) == {"covered_reference_bases", "depth_histogram", "per_reference", "policy", "targeted", "threshold_bases", "threshold_percentages", "total_accepted_aligned_bases", "uncovered_reference_bases"}
    assert len(totals) == 16 and (totals["total"], totals["qc_pass"], totals["qc_fail"]) == (9, 8, 1)
    assert set(covered["per_reference"][0]) == {"accepted_aligned_bases", "covered_reference_bases", "length", "mean_depth", "name", "uncovered_reference_bases"}
    assert covered["covered_reference_bases"] + covered["uncovered_reference_bases"] == 2_000_000 and [r["name"] for r in document["per_reference_counters"]["value"]] == ["chr1", "chr2"]
    told = json.loads((tmp_path / "out" / "provenance.json").read_text())
    assert set(told) == {
        "analysis_plan", "application", "backend_versions", "compatibility_profiles", "errors", "header_identity", "input", "normalization_actions", "resolved_config", "resource_limits", "schema_version", "stage_timings_ns", "system", "warnings",
    }
    assert json.loads((tmp_path / "out" / "summary.json").read_text()) == document and told["stage_timings_ns"]["total"] >= told["stage_timings_ns"]["checks"]
    assert covered["depth_histogram"]["1"] == 30 and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["_SUCCESS", "provenance.json", "summary.json"]
    with pytest.raises(LoomError) as e:
        release.release(spark, reads, refs, out)
    assert e.value.category == "output_exists"
    broken = R.frame(spark, [R.read("x", 0, 7, 10, "5M")])
    with pytest.raises(LoomError):
        release.release(spark, broken, refs, str(tmp_path / "never"))
    assert not (tmp_path / "never").exists()


def test_bad_bytes(tmp_path):
    path = tmp_path / "x.bam"
    bam.write_bam(str(path), [("chr1", 1000)], [R.read("a", 0, 0, 10, "5M")])
    whole = path.read_bytes()
    path.write_bytes(whole[: len(whole) // 2])
    with pytest.raises(LoomError) as e:
        list(bam.records(str(path), ["flag"]))
    assert e.value.category == "input_corrupt"
    path.write_bytes(b"CRAM....")
    with pytest.raises(LoomError) as e:
        bam.sniff(str(path))
    assert e.value.category == "input_format"


def test_reference(tmp_path):
    path = tmp_path / "r.fa"
    path.write_bytes(b">chr1 x\nACgt\nNN\n>chr2\n")
    found = bed.fasta_contigs(str(path))
    assert found["chr1"][0] == 6 and found["chr2"][0] == 0
    bed.check_reference([("chr1", 6)], {}, found)
    with pytest.raises(LoomError):
        bed.check_reference([("chr1", 5)], {}, found)


def test_stream(spark, tmp_path):
    from readloom.streaming.counters import start_counting, totals

    R.frame(spark, R.FLAGS).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(R.frame(spark, []).schema).parquet(str(tmp_path / "in"))
    start_counting(stream, str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination(60)
    assert {r["qc"]: r["total"] for r in dicts(totals(spark, str(tmp_path / "table")))} == {"pass": 8, "fail": 1}


def test_metric_diff(spark):
    make = lambda rows: spark.createDataFrame(rows, "metric string, value string")
    got = validation.metric_diff(make([("a", "1"), ("b", "2"), ("c", "3")]), make([("a", "1"), ("b", "9"), ("d", "4")]))
    assert {r["metric"]: r["status"] for r in dicts(got)} == {"a": "equal", "b": "different", "c": "missing", "d": "unexpected"}


def test_pairs_on_two_contigs_are_refused(spark):
    rows = R.insert_edge()
    both = R.frame(spark, rows).withColumn("mate_ref_id", F.when(F.abs("tlen") == 103, F.lit(1)).otherwise(F.col("mate_ref_id")))
    bins = am.insert_bins(both)
    assert bins.where("orientation IS NULL").count() == 1
    with pytest.raises(LoomError, match="two contigs"):
        am.refuse_split_pairs(bins)
    am.refuse_split_pairs(am.insert_bins(R.frame(spark, rows)))


def test_unsorted_reads_and_low_mates_are_refused(spark):
    rows = R.frame(spark, [R.read("a", 0, 0, 50, "5M"), R.read("b", 0, 0, 10, "5M")])
    numbered = rows.withColumn("rec_index", F.when(F.col("qname") == "a", F.lit(0)).otherwise(F.lit(3 << 40)).cast("long"))
    spark.conf.set("spark.sql.ansi.enabled", "true")
    with pytest.raises(LoomError, match="input_unsorted"):
        release.check(spark, numbered, R.refs(spark))
    release.check(spark, numbered.withColumn("rec_index", -F.col("rec_index")), R.refs(spark))
    low = rows.withColumn("mate_pos", F.lit(-2).cast("bigint"))
    assert "mate_below_sentinel" in {r["rule"] for r in dicts(validation.violations(low, R.refs(spark)))}
    bare = rows.withColumn("seq", F.lit(None).cast("string"))
    assert "query_span" in {r["rule"] for r in dicts(validation.violations(bare, R.refs(spark)))}


@pytest.mark.parametrize(
    ("text", "places", "want"),
    [
        ("1.25", 1, 13), ("-1.25", 1, -13), ("1.2499999999999999999", 1, 12), ("+7", 3, 7000), ("-0.004", 2, 0), ("0.005", 2, 1), ("2.", 0, 2), ("9.5", 0, 10), ("0007.10", 1, 71),
        ("1.000000000000000000499", 18, 10**18), ("1.0000000000000000005", 18, 10**18 + 1), ("99999999999999999999.9", 0, 10**20),
    ],
)
def test_scaled_decimal(spark, text, places, want):
    made = spark.createDataFrame([(text, places)], "t string, p int").select(validation.scaled_decimal(F.col("t"), F.col("p")).alias("x"))
    assert int(made.first()["x"]) == want


def _expected(spark, rows):
    return spark.createDataFrame(rows, "metric string, metric_type string, expected string, decimals int, note string")


def _actual(spark, rows):
    return spark.createDataFrame(rows, "metric string, metric_type string, actual string")


def test_typed_diff(spark):
    expected = [
        ("reads", "integer", "10", None, None), ("pairs", "integer", "007", None, "leading zeros"), ("mean", "decimal", "1.005", 2, None), ("rate", "decimal", "0.5", 3, "three places"),
        ("name", "text", "a", None, None), ("case", "text", "A", None, None), ("kind", "integer", "1", None, None), ("gone", "text", "x", None, "kept"),
    ]
    actual = [("reads", "integer", "11"), ("pairs", "integer", "+7"), ("mean", "decimal", "1.0149"), ("rate", "decimal", "0.5005"), ("name", "text", "a"), ("case", "text", "a"), ("kind", "decimal", "1"), ("new", "integer", "3")]
    got = {r["metric"]: (r["metric_type"], r["status"], r["note"]) for r in dicts(validation.typed_diff(_expected(spark, expected), _actual(spark, actual)))}
    assert got == {
        "reads": ("integer", "value mismatch", None), "pairs": ("integer", "equal", "leading zeros"), "mean": ("decimal", "equal", None), "rate": ("decimal", "value mismatch", "three places"),
        "name": ("text", "equal", None), "case": ("text", "value mismatch", None), "kind": ("integer", "type mismatch", None), "gone": ("text", "missing actual metric", "kept"), "new": ("integer", "unexpected actual metric", None),
    }
    assert validation.typed_diff(_expected(spark, []), _actual(spark, [])).count() == 0


@pytest.mark.parametrize(
    ("expected", "actual", "message"),
    [
        ([("a", "integer", "1.5", None, None)], [("a", "integer", "1")], "no integer"),
        ([("a", "integer", "1", None, None)], [("a", "integer", "x")], "no integer"),
        ([("a", "decimal", "1e3", 2, None)], [("a", "decimal", "1")], "no decimal"),
        ([("a", "decimal", "1", 19, None)], [("a", "decimal", "1")], "no decimal"),
        ([("a", "decimal", "1", None, None)], [("a", "decimal", "1")], "places are declared"),
        ([("a", "text", "1", 2, None)], [("a", "text", "1")], "places are declared"),
        ([("a", "text", "1", None, None)] * 2, [("a", "text", "1")], "repeated metric"),
        ([("a", "text", "1", None, None)], [("a", "text", "1"), ("a", "text", "2")], "repeated metric"),
        ([("a", "number", "1", None, None)], [], "unknown type"),
        ([("a", "text", "-", None, None)], [], "is missing"),
        ([], [("", "text", "1")], "is missing"),
    ],
)
def test_typed_diff_refuses(spark, expected, actual, message):
    with pytest.raises(Exception, match=message):
        validation.typed_diff(_expected(spark, expected), _actual(spark, actual)).collect()


@pytest.mark.parametrize("chunk", [7, 64, 1 << 20])
def test_territory_equals_a_walk_over_bases(spark, chunk):
    """Targets that touch, nest, repeat, are empty, cross chunks and lie at both ends of a contig; a contig without targets and an empty one."""
    random.seed(chunk)
    lengths = {0: 200, 1: 90, 2: 0}
    refs = spark.createDataFrame([(i, f"c{i}", n) for i, n in lengths.items()], "ref_id int, name string, length bigint")
    rows = [(0, s, min(200, s + random.randint(0, 25))) for s in (random.randint(0, 199) for _ in range(12))] + [(0, 0, 4), (0, 0, 4), (0, 190, 200), (0, 60, 60), (0, 70, 75), (0, 75, 80)]
    targets = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "source_index bigint, ref_id int, start bigint, stop bigint")
    ends = [(r, s, min(lengths[r], s + random.randint(1, 30))) for r, s in ((random.choice([0, 0, 1]), random.randint(0, 80)) for _ in range(40))] + [(0, 150, 200)]
    blocks = spark.createDataFrame(ends, "ref_id int, start bigint, stop bigint")
    want: dict = {}
    for ref, length in lengths.items():
        for at in range(length):
            inside = lambda flank, ref=ref, at=at: any(r == ref and s < e and s - flank <= at < e + flank for r, s, e in rows)
            key = ("on" if inside(0) else "near" if inside(6) else "off", sum(r == ref and s <= at < e for r, s, e in ends))
            want[key] = want.get(key, 0) + 1
    swept = targeted.territory(cigar.events(blocks, chunk), refs, targets, 6, chunk)
    assert {(r["label"], r["depth"]): r["bases"] for r in dicts(swept)} == want
    row = targeted.sums(swept).first()
    on = sorted(d for (label, d), n in want.items() if label == "on" for _ in range(n))
    assert row["on_bases"] == sum(on) and row["target_territory"] == len(on) and row["d20"] == on[-(-len(on) // 5) - 1]
    assert row["accepted_bases"] == sum(d * n for (_, d), n in want.items()) and row["genome_territory"] == 290
    none = targeted.sums(targeted.territory(cigar.events(blocks, chunk), refs, targets.where("false"), 6, chunk)).first()
    assert (none["on_bases"], none["target_territory"], none["near_territory"], none["d20"], none["genome_territory"]) == (0, 0, 0, None, 290)


def test_warnings_and_actions_are_sorted_and_told_once(spark):
    assert release.sorted_warnings([("b", "x"), ("a", "z"), ("a", "y"), ("b", "x")]) == [{"code": "a", "message": "y"}, {"code": "a", "message": "z"}, {"code": "b", "message": "x"}]
    targets = R.targets(spark, [(0, 50, 60), (0, 10, 20), (0, 15, 30), (0, 30, 40), (0, 5, 5)])
    assert release.normalization_actions(targets, R.refs(spark), 7) == sorted(["empty_inputs=1", "overlap_merges=1", "adjacent_merges=1", "reordered=2", "selected:empty_inputs=1", "selected:overlap_merges=3"])
    assert release.normalization_actions(None, R.refs(spark), 7) == []


def test_command_line_publishes_without_reading_bases(spark, tmp_path, capsys):
    from readloom import cli

    path, beds, out = (str(tmp_path / n) for n in ("x.bam", "t.bed", "out"))
    bam.write_bam(path, [("chr1", 1_000_000), ("chr2", 1_000_000)], R.FLAGS, block=100)
    (tmp_path / "t.bed").write_text("chr1\t120\t130\nchr1\t50\t125\n")
    assert cli.main(["qc", "--input", path, "--output", out, "--targets", beds]) == 0
    told = json.loads((tmp_path / "out" / "provenance.json").read_text())
    assert told["normalization_actions"] == ["overlap_merges=1", "reordered=2", "selected:left_clips=2", "selected:overlap_merges=1"]
    assert told["input"]["path"] == path and told["header_identity"]["status"] == "available" and told["resolved_config"]["near"] == 250
    summary = json.loads((tmp_path / "out" / "summary.json").read_text())
    assert summary["coverage"]["value"]["targeted"]["value"]["partition"]["target_territory"] == 80
    assert cli.main(["qc", "--input", path, "--output", out]) != 0 and "output_exists" in capsys.readouterr().err
