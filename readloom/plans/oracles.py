"""The alignment queries in DuckDB's SQL, written from per-base tables rather than from events and runs."""

from __future__ import annotations

from readloom.operators.alignment_metrics import adapter_pieces
from readloom.sources.view import BROKEN, REFS_SQL, TARGETS_SQL, reads_sql

_READS = f"reads AS ({reads_sql()}), refs AS ({REFS_SQL}), targets AS ({TARGETS_SQL})"
_BASES = """
covering AS (SELECT * FROM reads WHERE flag & 3844 = 0 AND ref_id >= 0),
covered AS (
  SELECT ref_id, unnest(range(pos, pos + m1)) AS spot FROM covering
  UNION ALL SELECT ref_id, unnest(range(pos + m1 + del_len, pos + m1 + del_len + m2)) AS spot FROM covering
),
counted AS (SELECT ref_id, spot, count(*) AS depth FROM covered GROUP BY ref_id, spot),
place AS (SELECT ref_id, unnest(range(0, length)) AS spot FROM refs),
depth AS (SELECT p.ref_id, p.spot, coalesce(c.depth, 0) AS depth FROM place p LEFT JOIN counted c USING (ref_id, spot))
"""


def _six(n: str, d: str, scale: int = 1) -> str:
    """Six decimals, half up, of scale * n / d."""
    q = f"((2 * {n}::HUGEINT * {scale * 1000000} + {d}) // (2 * {d}))"
    return f"CASE WHEN {d} = 0 THEN '0.000000' ELSE concat(({q} // 1000000)::BIGINT::VARCHAR, '.', lpad(({q} % 1000000)::BIGINT::VARCHAR, 6, '0')) END"


def _merged(flank: int) -> str:
    return f"""
wide AS (SELECT t.source_index, t.ref_id, greatest(t.start - {flank}, 0) AS start, least(t.stop + {flank}, r.length) AS stop, t.start - {flank} < 0 AS cl, t.stop + {flank} > r.length AS cr
  FROM targets t JOIN refs r USING (ref_id) WHERE t.stop > t.start),
reached AS (SELECT *, max(stop) OVER (PARTITION BY ref_id ORDER BY start, stop, source_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM wide),
island AS (SELECT *, sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY ref_id ORDER BY start, stop, source_index ROWS UNBOUNDED PRECEDING) AS k FROM reached),
merged AS (SELECT ref_id, min(start) AS start, max(stop) AS stop, string_agg(source_index::VARCHAR, ',' ORDER BY source_index) AS sources FROM island GROUP BY ref_id, k)
"""


_ON = "inside AS (SELECT DISTINCT ref_id, unnest(range(start, stop)) AS spot FROM targets WHERE stop > start)"
_NEAR = "around AS (SELECT DISTINCT t.ref_id, unnest(range(greatest(t.start - 250, 0), least(t.stop + 250, r.length))) AS spot FROM targets t JOIN refs r USING (ref_id) WHERE t.stop > t.start)"
_PARTITION = f"""
{_ON}, {_NEAR},
sums AS (SELECT
  (SELECT coalesce(sum(depth), 0)::BIGINT FROM depth JOIN inside USING (ref_id, spot)) AS on_bases,
  (SELECT coalesce(sum(depth), 0)::BIGINT FROM depth JOIN around USING (ref_id, spot)) AS selected_bases,
  (SELECT coalesce(sum(depth), 0)::BIGINT FROM depth) AS accepted_bases,
  (SELECT count(*) FROM inside) AS target_territory, (SELECT count(*) FROM around) AS selected_territory,
  (SELECT sum(length)::BIGINT FROM refs) AS genome_territory)
"""
_D20 = """
hist AS (SELECT depth, count(*) AS bases FROM depth JOIN inside USING (ref_id, spot) GROUP BY depth),
ranked AS (SELECT depth, sum(bases) OVER (ORDER BY depth) AS up, sum(bases) OVER () AS n FROM hist),
twenty AS (SELECT min(depth) AS d20 FROM ranked WHERE up * 5 >= n)
"""
_PAIR = "(flag & 2304) = 0 AND seq_len > 0 AND (flag & 4) = 0 AND (flag & 1) = 1 AND (flag & 8) = 0"
_WAY = """CASE WHEN (CASE WHEN flag & 16 > 0 THEN -1 ELSE 1 END) * (CASE WHEN flag & 32 > 0 THEN -1 ELSE 1 END) > 0 THEN 'other'
  WHEN (CASE WHEN flag & 64 > 0 THEN 1 ELSE -1 END) * (mate_pos - pos) > 0 THEN CASE WHEN (flag & 64 > 0) = (flag & 16 = 0) THEN 'inward' ELSE 'outward' END
  WHEN (CASE WHEN flag & 64 > 0 THEN 1 ELSE -1 END) * (mate_pos - pos) < 0 THEN CASE WHEN (flag & 64 > 0) = (flag & 16 = 0) THEN 'outward' ELSE 'inward' END
  ELSE 'inward' END"""
_INSERTS = f"""
seen AS (SELECT least(abs(tlen), 8000) AS size, {_WAY} AS way FROM reads WHERE {_PAIR} AND NOT (tlen = 0 AND ref_id <> mate_ref_id)),
cells AS (SELECT size, count(*) FILTER (WHERE way = 'inward') // 2 AS inward, count(*) FILTER (WHERE way = 'outward') // 2 AS outward, count(*) FILTER (WHERE way = 'other') // 2 AS other FROM seen GROUP BY size)
"""
_PICARD = """
pairs AS (SELECT *, CASE WHEN (flag & 16 > 0) = (flag & 32 > 0) THEN 'TANDEM'
  WHEN (CASE WHEN flag & 16 > 0 THEN mate_pos + 1 ELSE pos + 1 END) < (CASE WHEN flag & 16 > 0 THEN pos + m1 + del_len + m2 ELSE pos + 1 + tlen END) THEN 'FR' ELSE 'RF' END AS orientation, abs(tlen) AS size
  FROM reads WHERE flag & 1 = 1 AND flag & (4 + 8 + 64 + 256 + 1024 + 2048) = 0 AND tlen <> 0),
large AS (SELECT orientation FROM pairs GROUP BY orientation HAVING count(*) >= (SELECT count(*) FROM pairs) * 0.05000000074505806),
kept AS (SELECT orientation, size FROM pairs WHERE orientation IN (SELECT orientation FROM large))
"""
_COMPLEMENT = "translate(reverse(seq), 'ACGTN', 'TGCAN')"
_ORIENTED = f"CASE WHEN flag & 4 = 0 AND flag & 16 > 0 THEN {_COMPLEMENT} ELSE seq END"
_DIFFERING = " + ".join(f"(substr(head, {i}, 1) <> substr(piece, {i}, 1))::INT" for i in range(1, 17))
_ADAPTERS = f"""
pieces AS (SELECT unnest([{", ".join(f"'{p}'" for p in adapter_pieces())}]) AS piece),
heads AS (SELECT DISTINCT substr({_ORIENTED}, 1, 16) AS head FROM reads WHERE mapq = 0 OR flag & 4 > 0),
near AS (SELECT DISTINCT head FROM heads, pieces WHERE {_DIFFERING} <= 1),
marked AS (SELECT *, (flag & 4 > 0 OR mapq = 0) AND substr({_ORIENTED}, 1, 16) IN (SELECT head FROM near) AS adapter FROM reads)
"""
_CATEGORIES = """
split AS (SELECT *, CASE WHEN flag & 1 = 0 THEN 'UNPAIRED' WHEN flag & 64 > 0 THEN 'FIRST_OF_PAIR' ELSE 'SECOND_OF_PAIR' END AS category FROM marked WHERE flag & 2304 = 0)
"""
_FLAGS = {
    "total": "true", "mapped": "flag & 4 = 0", "unmapped": "flag & 4 > 0", "duplicate": "flag & 1024 > 0", "secondary": "flag & 256 > 0", "supplementary": "flag & 2304 = 2048", "primary": "flag & 2304 = 0",
    "primary_mapped": "flag & 2308 = 0", "primary_duplicate": "flag & 3328 = 1024", "paired": "flag & 2305 = 1", "read1": "flag & 2369 = 65", "read2": "flag & 2433 = 129", "proper_pair": "flag & 2311 = 3",
    "mate_unmapped": "flag & 2313 = 9", "singleton": "flag & 2317 = 9", "mate_mapped": "flag & 2313 = 1", "both_mapped": "flag & 2317 = 1", "mate_different_reference": "flag & 2317 = 1 AND ref_id <> mate_ref_id",
    "mate_different_reference_mapq5": "flag & 2317 = 1 AND ref_id <> mate_ref_id AND mapq >= 5",
}


def _with(*parts: str) -> str:
    return "WITH " + ", ".join([_READS, *parts]) + " "


def _stats() -> str:
    kinds = {"there": "flag & 256 = 0 AND seq_len > 0", "original": "flag & 2304 = 0 AND seq_len > 0"}
    mapped = "flag & 4 = 0"
    first, last = (f"({kinds['original']} AND ({t}))" for t in ("flag & 1 = 0 OR flag & 192 = 64", "flag & 1 = 1 AND flag & 192 = 128"))
    first_any, last_any = (f"({kinds['there']} AND ({t}))" for t in ("flag & 1 = 0 OR flag & 192 = 64", "flag & 1 = 1 AND flag & 192 = 128"))
    count = lambda t: f"count(*) FILTER (WHERE {t})"
    total = lambda t, x: f"coalesce(sum({x}) FILTER (WHERE {t}), 0)::BIGINT"
    top = lambda t: f"coalesce(max(seq_len) FILTER (WHERE {t}), 0)"
    other = f"{kinds['original']} AND flag & 1 = 1 AND flag & 192 IN (0, 192)"
    aligned = "CASE WHEN unm THEN 0 ELSE m1 + ins_len + m2 END"
    columns = {
        "first_fragments": count(first), "last_fragments": count(last), "other_fragments": count(other), "reads_mapped": count(f"{kinds['original']} AND {mapped}"), "reads_mapped_and_paired": count(_PAIR),
        "reads_unmapped": count(f"{kinds['original']} AND flag & 4 > 0"), "reads_properly_paired": count(f"{_PAIR} AND flag & 2 > 0"), "reads_paired": count(f"{kinds['original']} AND flag & 1 = 1"),
        "reads_duplicated": count(f"{kinds['there']} AND flag & 1024 > 0"), "reads_mq0": count(f"{kinds['original']} AND {mapped} AND mapq = 0"), "reads_qc_failed": count(f"{kinds['original']} AND flag & 512 > 0"),
        "non_primary": count("flag & 256 > 0"), "supplementary": count("flag & 2304 = 2048"), "total_length": total(kinds["original"], "seq_len"), "first_length": total(first, "seq_len"), "last_length": total(last, "seq_len"),
        "bases_mapped": total(f"{kinds['original']} AND {mapped}", "seq_len"), "bases_mapped_cigar": total(f"{kinds['there']} AND {mapped}", aligned), "bases_duplicated": total(f"{kinds['there']} AND flag & 1024 > 0", "seq_len"),
        "mismatches": total(f"{kinds['there']} AND {mapped}", "coalesce(nm, 0)"), "max_length": top(kinds["there"]), "max_first_length": top(first_any), "max_last_length": top(last_any),
        "quality_sum": total(f"{first} OR {last}", "list_sum(list_transform(range(0, seq_len), lambda i: (h + 7 * i) % 42))"), "different_chromosomes": count(f"{_PAIR} AND ref_id <> mate_ref_id") + " // 2",
        "sequences": count(f"{kinds['original']}"),
    }
    return _with() + "SELECT " + ", ".join(f"({e})::BIGINT AS {c}" for c, e in columns.items()) + " FROM reads"


def _violations() -> str:
    end = "CASE WHEN unm THEN 0 ELSE m1 + del_len + m2 END"
    rules = {
        ("reserved_flag", "unsupported_record"): "flag2 > 4095",
        ("beyond_reference", "input_corrupt"): f"flag2 & 4 = 0 AND r.ref_id >= 0 AND pos2 + {end} > length",
        ("half_coordinate", "input_corrupt"): "(r.ref_id = -1) <> (pos2 = -1)",
    }
    table = "bad AS (SELECT *, CASE WHEN h % 101 = 0 THEN pos + 30000 ELSE pos END AS pos2, CASE WHEN h % 103 = 0 THEN flag | 4096 ELSE flag END AS flag2 FROM reads)"
    parts = [f"SELECT '{rule}' AS rule, '{category}' AS category, count(*) AS records FROM bad r LEFT JOIN refs USING (ref_id) WHERE {test}" for (rule, category), test in rules.items()]
    return _with(table) + "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE records > 0"


def _broken_rules() -> str:
    """Counts of the rules over a row for each CIGAR operation; 0 1 2 3 4 5 6 7 8 are M I D N S H P = X."""
    mapped, paired = "flag & 4 = 0", "flag & 1 = 1"
    rules = {
        "unsupported_record": {"reserved_flag": "flag > 4095 OR flag < 0"},
        "input_corrupt": {
            "proper_without_pair": f"flag & 2 = 2 AND NOT ({paired})",
            "read_number_without_pair": f"flag & 192 > 0 AND NOT ({paired})",
            "both_read_numbers": "flag & 192 = 192",
            "coordinate_below_sentinel": "least(ref_id, pos) < -1",
            "mate_below_sentinel": "least(mate_ref_id, mate_pos) < -1",
            "half_coordinate": "(ref_id = -1 AND pos <> -1) OR (ref_id <> -1 AND pos = -1)",
            "mapped_without_coordinate": f"{mapped} AND ref_id = -1",
            "unknown_reference": "ref_id >= 0 AND ref_id NOT IN (SELECT ref_id FROM refs)",
            "mate_half_coordinate": f"{paired} AND ((mate_ref_id = -1 AND mate_pos <> -1) OR (mate_ref_id <> -1 AND mate_pos = -1))",
            "mapped_mate_without_coordinate": f"{paired} AND flag & 8 = 0 AND mate_ref_id = -1 AND mate_pos = -1",
            "mate_unknown_reference": f"{paired} AND mate_ref_id >= 0 AND mate_ref_id NOT IN (SELECT ref_id FROM refs)",
            "mate_beyond_reference": f"{paired} AND EXISTS (SELECT 1 FROM refs m WHERE m.ref_id = w.mate_ref_id AND w.mate_pos >= m.length)",
            "zero_length_operation": "least_len = 0",
            "unknown_operation": "greatest_op > 8",
            "query_span": "operations > 0 AND in_query <> seq_length",
            "mapped_without_cigar": f"{mapped} AND operations = 0",
            "beyond_reference": f"{mapped} AND EXISTS (SELECT 1 FROM refs m WHERE m.ref_id = w.ref_id AND w.pos + w.in_reference > m.length)",
            "negative_mismatches": "nm < 0",
        },
        "resource_limit": {"name_limit": "length(qname) > 1024 * 1024", "sequence_limit": "seq_length > 100000000", "operation_limit": "operations > 1000000"},
    }
    parts = (("m1", 0), ("ins_len", 1), ("del_len", 2), ("m2", 0), ("soft_len", 4))
    own = " UNION ALL ".join(f"SELECT row_no, {c} AS len, {op} AS op FROM made WHERE NOT bare AND {c} > 0" for c, op in parts)
    tables = [
        # Record numbers may repeat, so rows get their own.
        f"made AS (SELECT row_number() OVER (ORDER BY rec, h, m1, m2, ins_len, del_len, soft_len, seq) AS row_no, h, m1, ins_len, del_len, m2, soft_len, {', '.join(f'{e} AS {c}' for c, e in BROKEN.items())} FROM reads)",
        f"ops AS ({own} UNION ALL SELECT row_no, extra_len, extra_op FROM (SELECT *, unnest(range(0, extra_ops)) AS i FROM made))",
        "sums AS (SELECT row_no, count(*) AS operations, min(len) AS least_len, max(op) AS greatest_op, coalesce(sum(len) FILTER (WHERE op IN (0, 1, 4, 7, 8)), 0) AS in_query,"
        " coalesce(sum(len) FILTER (WHERE op IN (0, 2, 3, 7, 8)), 0) AS in_reference FROM ops GROUP BY row_no)",
        "w AS (SELECT made.*, coalesce(operations, 0) AS operations, least_len, greatest_op, coalesce(in_query, 0) AS in_query, coalesce(in_reference, 0) AS in_reference FROM made LEFT JOIN sums USING (row_no))",
    ]
    each = [f"SELECT '{rule}' AS rule, '{category}' AS category, count(*) AS records FROM w WHERE {test}" for category, named in rules.items() for rule, test in named.items()]
    return _with(*tables) + "SELECT * FROM (" + " UNION ALL ".join(each) + ") WHERE records > 0"


def _typed_metric_diff() -> str:
    """Values as numbers of their own from the start; texts are made last."""
    tables = [
        "n AS (SELECT f.ref_id, f.name, f.length, count(*) FILTER (WHERE r.flag & 4 = 0) AS n FROM refs f LEFT JOIN reads r ON r.ref_id = f.ref_id GROUP BY f.ref_id, f.name, f.length)",
        f"s AS (SELECT *, {_six('n', 'length')} AS share, {_six('(n * 1000 + 3 * length)', '(length * 1000)')} AS share2 FROM n)",
        "k AS (SELECT unnest(['mapped', 'share', 'label']) AS kind)",
        "e AS (SELECT concat(kind, '.', name) AS metric, ref_id, kind, CASE kind WHEN 'mapped' THEN concat(CASE WHEN ref_id % 4 = 1 THEN '+00' ELSE '' END, n) WHEN 'share' THEN share ELSE name END AS expected,"
        " CASE kind WHEN 'mapped' THEN n::DECIMAL(18, 2) WHEN 'share' THEN round(share::DECIMAL(18, 6), 2) END AS number FROM s, k WHERE ref_id < 20)",
        "a AS (SELECT concat(kind, '.', name) AS metric, ref_id, kind, CASE kind WHEN 'mapped' THEN concat(n - (ref_id % 3 = 0)::INT) WHEN 'share' THEN share2 WHEN 'label' THEN CASE WHEN ref_id % 5 = 0 THEN lower(name) ELSE name END END AS actual,"
        " CASE kind WHEN 'mapped' THEN (n - (ref_id % 3 = 0)::INT)::DECIMAL(18, 2) WHEN 'share' THEN round(share2::DECIMAL(18, 6), 2) END AS number FROM s, k WHERE ref_id >= 3 AND n > 0)",
    ]
    kinds = "CASE coalesce(e.kind, a.kind) WHEN 'share' THEN 'decimal' WHEN 'label' THEN 'text' ELSE CASE WHEN e.kind IS NULL AND a.ref_id = 7 THEN 'text' ELSE 'integer' END END"
    status = (
        "CASE WHEN a.metric IS NULL THEN 'missing actual metric' WHEN e.metric IS NULL THEN 'unexpected actual metric' WHEN e.kind = 'mapped' AND e.ref_id = 7 THEN 'type mismatch'"
        " WHEN e.number = a.number OR (e.kind = 'label' AND e.expected = a.actual) THEN 'equal' ELSE 'value mismatch' END"
    )
    return _with(*tables) + f"SELECT coalesce(e.metric, a.metric) AS metric, {kinds} AS metric_type, expected, actual, CASE WHEN e.kind = 'share' THEN 'two places' END AS note, {status} AS status FROM e FULL JOIN a USING (metric)"


_WIDTH_SHARES = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]"


def oracle_sql() -> dict[str, str]:
    out = {
        "flagstat": _with() + "SELECT q.qc, " + ", ".join(f"count(*) FILTER (WHERE h IS NOT NULL AND {t}) AS {c}" for c, t in _FLAGS.items()) + " FROM (VALUES ('pass'), ('fail')) q(qc) LEFT JOIN reads ON q.qc = CASE WHEN flag & 512 > 0 THEN 'fail' ELSE 'pass' END GROUP BY q.qc",
        "idxstats": _with() + "SELECT f.ref_id, f.name, f.length, count(*) FILTER (WHERE r.flag & 4 = 0) AS mapped, count(*) FILTER (WHERE r.flag & 4 > 0) AS unmapped FROM (SELECT * FROM refs UNION ALL SELECT -1, '*', 0) f LEFT JOIN reads r ON r.ref_id = f.ref_id GROUP BY f.ref_id, f.name, f.length",
        "record_classes": _with() + "SELECT CASE WHEN flag & 256 > 0 THEN 'secondary' WHEN flag & 2048 > 0 THEN 'supplementary' ELSE 'primary' END AS record_class, count(*) AS records FROM reads GROUP BY 1",
        "read_group_state": _with() + "SELECT CASE WHEN rg IS NULL THEN 'missing' WHEN rg IN ('rg0', 'rg1') THEN 'known' WHEN rg = 'rg2' THEN 'ambiguous' ELSE 'unknown' END AS state, count(*) AS records FROM reads GROUP BY 1",
        "depth_runs": _with(_BASES) + ", turn AS (SELECT *, CASE WHEN depth = lag(depth) OVER (PARTITION BY ref_id ORDER BY spot) THEN 0 ELSE 1 END AS new FROM depth), numbered AS (SELECT *, sum(new) OVER (PARTITION BY ref_id ORDER BY spot) AS k FROM turn) SELECT ref_id, min(spot) AS start, max(spot) + 1 AS stop, min(depth) AS depth FROM numbered GROUP BY ref_id, k",
        "depth_histogram": _with(_BASES) + "SELECT depth, sum(n)::BIGINT AS bases FROM (SELECT depth, count(*) AS n FROM depth GROUP BY depth UNION ALL SELECT 0, 0) GROUP BY depth",
        "per_reference_coverage": _with(_BASES) + ", s AS (SELECT ref_id, sum(depth)::BIGINT AS accepted_bases, count(*) FILTER (WHERE depth > 0) AS covered, count(*) FILTER (WHERE depth = 0) AS uncovered FROM depth GROUP BY ref_id) SELECT ref_id, name, length, accepted_bases, covered, uncovered, " + _six("accepted_bases", "length") + " AS mean_depth FROM refs JOIN s USING (ref_id)",
        "coverage_thresholds": _with(_BASES) + ", s AS (SELECT t.threshold, count(*) FILTER (WHERE depth >= threshold) AS bases, count(*) AS n FROM depth, (SELECT unnest([1, 5, 10, 20, 30])::BIGINT AS threshold) t GROUP BY t.threshold) SELECT threshold, bases, " + _six("bases", "n", 100) + " AS percent FROM s",
        "coverage_invariants": _with(_BASES) + "SELECT (SELECT count(*) FROM depth) AS run_bases, (SELECT sum(depth)::BIGINT FROM depth) AS depth_sum, (SELECT min(depth) FROM depth) AS least_depth, (SELECT sum(length)::BIGINT FROM refs) AS territory, (SELECT sum(m1 + m2)::BIGINT FROM covering) AS accepted_bases, true AS holds",
        "target_merge": _with(_merged(0)) + "SELECT ref_id, start, stop FROM merged",
        "selected_merge": _with(_merged(250)) + "SELECT ref_id, start, stop FROM merged",
        "merge_provenance": _with(_merged(250)) + "SELECT ref_id, start, sources FROM merged",
        "merge_report": _with(_merged(250)) + "SELECT (SELECT count(*) FROM targets) AS inputs, (SELECT count(*) FROM targets WHERE start = stop) AS empty_inputs, count(*) FILTER (WHERE cl) AS left_clips, count(*) FILTER (WHERE cr) AS right_clips, count(*) FILTER (WHERE start < reach) AS overlap_merges, count(*) FILTER (WHERE start = reach) AS adjacent_merges, (SELECT count(*) FROM merged) AS merged, (SELECT sum(stop - start)::BIGINT FROM merged) AS territory FROM reached",
        "target_depth_histogram": _with(_BASES, _ON) + "SELECT depth, sum(n)::BIGINT AS bases FROM (SELECT depth, count(*) AS n FROM depth JOIN inside USING (ref_id, spot) GROUP BY depth UNION ALL SELECT 0, 0) GROUP BY depth",
        "target_partition": _with(_BASES, _PARTITION) + "SELECT on_bases, selected_bases - on_bases AS near_bases, accepted_bases - selected_bases AS off_bases, accepted_bases, target_territory, selected_territory - target_territory AS near_territory, genome_territory FROM sums",
        "per_target_coverage": _with(_BASES) + ", s AS (SELECT t.source_index, t.stop - t.start AS length, coalesce(sum(depth), 0)::BIGINT AS depth_sum, count(*) FILTER (WHERE depth > 0) AS covered, count(*) FILTER (WHERE depth >= 10) AS at_least_10 FROM targets t LEFT JOIN depth d ON d.ref_id = t.ref_id AND d.spot >= t.start AND d.spot < t.stop GROUP BY 1, 2) SELECT source_index, length, depth_sum, covered, length - covered AS uncovered, covered AS at_least_1, at_least_10, CASE WHEN length > 0 THEN " + _six("depth_sum", "length") + " END AS mean_depth, CASE WHEN length = 0 THEN 'zero_length_target' END AS mean_reason, CASE WHEN length > 0 THEN " + _six("covered", "length", 100) + " END AS covered_percent FROM s",
        "zero_runs": _with(_BASES) + ", z AS (SELECT t.source_index, d.spot, d.spot - row_number() OVER (PARTITION BY t.source_index ORDER BY d.spot) AS k FROM targets t JOIN depth d ON d.ref_id = t.ref_id AND d.spot >= t.start AND d.spot < t.stop WHERE d.depth = 0) SELECT source_index, min(spot) AS start, max(spot) + 1 AS stop FROM z GROUP BY source_index, k",
        "dropout": _with(_BASES) + "SELECT count(*) AS dropout_targets FROM targets t WHERE EXISTS (SELECT 1 FROM depth d WHERE d.ref_id = t.ref_id AND d.spot >= t.start AND d.spot < t.stop AND d.depth = 0)",
        "target_enrichment": _with(_BASES, _PARTITION) + "SELECT 'available' AS status, " + _six("(on_bases::HUGEINT * genome_territory)", "(accepted_bases::HUGEINT * target_territory)") + " AS value, NULL::VARCHAR AS reason FROM sums",
        "target_d20": _with(_BASES, _ON, _D20) + "SELECT d20 FROM twenty",
        "uniformity_penalty": _with(_BASES, _PARTITION, _D20) + "SELECT CASE WHEN d20 = 0 THEN 'unavailable' ELSE 'available' END AS status, CASE WHEN d20 > 0 THEN " + _six("on_bases", "(target_territory * d20)") + " END AS value, CASE WHEN d20 = 0 THEN 'target_depth_20th_percentile_is_zero' END AS reason FROM sums, twenty",
        "samtools_sn": _stats(),
        "samtools_is": _with(_INSERTS) + ", dense AS (SELECT s.size, coalesce(inward, 0) AS inward, coalesce(outward, 0) AS outward, coalesce(other, 0) AS other, coalesce(inward + outward + other, 0) AS pairs FROM (SELECT unnest(range(0, 8001)) AS size) s LEFT JOIN cells USING (size)), run AS (SELECT *, sum(pairs) OVER (ORDER BY size) AS up, sum(pairs) OVER () AS n FROM dense) SELECT size, pairs, inward, outward, other FROM run WHERE size <= (SELECT min(size) FROM run WHERE up > 0.99::DOUBLE * n)",
        "insert_orientation": _with(_INSERTS) + "SELECT sum(inward)::BIGINT AS inward, sum(outward)::BIGINT AS outward, sum(other)::BIGINT AS other FROM cells",
        "picard_insert_histogram": _with(_PICARD) + ", m AS (SELECT orientation, median(size) AS mid FROM kept GROUP BY orientation), a AS (SELECT k.orientation, median(abs(size - mid)) AS mad FROM kept k JOIN m USING (orientation) GROUP BY k.orientation) SELECT orientation, size, count(*) AS n FROM kept JOIN m USING (orientation) JOIN a USING (orientation) WHERE size <= floor(mid + 10 * mad) GROUP BY orientation, size",
        "picard_insert_metrics": _with(_PICARD) + ", m AS (SELECT orientation, median(size) AS mid FROM kept GROUP BY orientation), a AS (SELECT k.orientation, median(abs(size - mid)) AS mad FROM kept k JOIN m USING (orientation) GROUP BY k.orientation), u AS (SELECT orientation, size, count(*) AS n FROM kept GROUP BY orientation, size), o AS (SELECT orientation, sum(n)::BIGINT AS read_pairs, min(size) AS least, max(size) AS most FROM u GROUP BY orientation), top AS (SELECT orientation, size AS mode, row_number() OVER (PARTITION BY orientation ORDER BY n DESC, size) AS r FROM u), t AS (SELECT k.orientation, avg(size) AS mean, stddev_samp(size) AS sd FROM kept k JOIN m USING (orientation) JOIN a USING (orientation) WHERE size <= floor(mid + 10 * mad) GROUP BY k.orientation) SELECT orientation, read_pairs, mode, least, most, round(mid * 2)::BIGINT AS median_x2, round(mad * 2)::BIGINT AS mad_x2, round(mean * 1000)::BIGINT AS mean_x1000, round(sd * 1000)::BIGINT AS deviation_x1000 FROM o JOIN m USING (orientation) JOIN a USING (orientation) JOIN t USING (orientation) JOIN top USING (orientation) WHERE r = 1",
        "picard_insert_widths": _with(_PICARD) + f", m AS (SELECT orientation, floor(median(size)) AS c FROM kept GROUP BY orientation), d AS (SELECT k.orientation, abs(size - c)::BIGINT AS d, row_number() OVER (PARTITION BY k.orientation ORDER BY abs(size - c)) AS r, count(*) OVER (PARTITION BY k.orientation) AS n FROM kept k JOIN m USING (orientation)), shares AS (SELECT unnest({_WIDTH_SHARES})::DOUBLE AS share) SELECT orientation, round(share * 100)::BIGINT AS percent, min(d) * 2 + 1 AS width FROM (SELECT orientation, d, max(r) AS r, max(n) AS n FROM d GROUP BY orientation, d), shares WHERE r::DOUBLE / n >= share GROUP BY orientation, share",
        "adapter_reads": _with(_ADAPTERS) + "SELECT ref_id, count(*) AS reads FROM marked WHERE adapter GROUP BY ref_id",
        "no_call_cycles": _with(_ADAPTERS, _CATEGORIES) + "SELECT category, CASE WHEN flag & 16 > 0 THEN seq_len - i + 1 ELSE i END AS cycle, count(*) AS no_calls FROM (SELECT category, flag, seq_len, seq, unnest(range(1, seq_len + 1)) AS i FROM split) WHERE substr(seq, i::INT, 1) = 'N' GROUP BY 1, 2",
        "bad_cycles": _with(_CATEGORIES.replace("FROM marked", "FROM reads"), "masked AS (SELECT category, flag, seq_len, CASE WHEN h % 8 = 7 THEN seq WHEN flag & 16 > 0 THEN concat(substr(seq, 1, seq_len - 12), repeat('N', 12)) ELSE concat(repeat('N', 12), substr(seq, 13)) END AS seq FROM split)") + ", cycles AS (SELECT category, CASE WHEN flag & 16 > 0 THEN seq_len - i + 1 ELSE i END AS cycle, seq, i FROM (SELECT *, unnest(range(1, seq_len + 1)) AS i FROM masked)), bad AS (SELECT category, cycle FROM cycles WHERE substr(seq, i::INT, 1) = 'N' GROUP BY category, cycle HAVING count(*) >= 0.8 * (SELECT count(*) FROM masked s WHERE s.category = cycles.category)), sums AS (SELECT category, count(*) AS bad_cycles FROM bad GROUP BY category) SELECT * FROM sums UNION ALL SELECT 'PAIR', sum(bad_cycles)::BIGINT FROM sums WHERE category <> 'UNPAIRED' HAVING sum(bad_cycles) IS NOT NULL",
        "order_violations": _with() + "SELECT rec AS rec_index FROM (SELECT rec, CASE WHEN ref_id < 0 THEN 2147483647 ELSE ref_id END AS r, CASE WHEN ref_id < 0 THEN 0 ELSE pos END AS p, lag(r) OVER (ORDER BY rec) AS r0, lag(p) OVER (ORDER BY rec) AS p0 FROM reads) WHERE r < r0 OR (r = r0 AND p < p0)",
        "crowded_loci": _with() + ", kept AS (SELECT * FROM reads WHERE flag & (4 + 256 + 512 + 1024 + 8) = 0 AND flag & 1 = 1 AND mapq >= 20), b AS (SELECT ref_id, unnest(range(pos, pos + m1)) AS spot FROM kept UNION ALL SELECT ref_id, unnest(range(pos + m1 + del_len, pos + m1 + del_len + m2)) AS spot FROM kept) SELECT ref_id, spot AS \"at\", count(*) AS bases FROM b GROUP BY ref_id, spot HAVING count(*) > 4",
        "uncontained": _with(_merged(0)) + ", inn AS (SELECT t.source_index, t.ref_id, greatest(t.start - 5, 0) AS start, least(t.stop + 5, r.length) AS stop FROM targets t JOIN refs r USING (ref_id) WHERE t.stop > t.start) SELECT i.source_index, i.ref_id, i.start, i.stop FROM inn i WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.ref_id = i.ref_id AND m.start <= i.start AND m.stop >= i.stop)",
        "reordered": _with() + "SELECT count(*) FILTER (WHERE k <> source_index) AS moved FROM (SELECT source_index, row_number() OVER (ORDER BY ref_id, start, stop, source_index) AS k FROM targets)",
        "picard_alignment_summary": _with(_ADAPTERS, _CATEGORIES) + ", rows AS (SELECT category, flag, seq_len, xn, adapter FROM split UNION ALL SELECT 'PAIR', flag, seq_len, xn, adapter FROM split WHERE category <> 'UNPAIRED'), m AS (SELECT category, median(seq_len) AS mid FROM rows WHERE flag & 512 = 0 GROUP BY category), a AS (SELECT r.category, median(abs(seq_len - mid)) AS mad FROM rows r JOIN m USING (category) WHERE flag & 512 = 0 GROUP BY r.category), bad AS (SELECT category, count(*) AS n FROM (SELECT category, cycle FROM (SELECT category, CASE WHEN flag & 16 > 0 THEN seq_len - i + 1 ELSE i END AS cycle, seq, i FROM (SELECT category, flag, seq_len, seq, unnest(range(1, seq_len + 1)) AS i FROM split)) c WHERE substr(seq, i::INT, 1) = 'N' GROUP BY category, cycle HAVING count(*) >= 0.8 * (SELECT count(*) FROM split s WHERE s.category = c.category)) GROUP BY category) SELECT r.category, count(*) AS total_reads, count(*) FILTER (WHERE flag & 512 = 0) AS pf_reads, count(*) FILTER (WHERE flag & 512 = 0 AND xn) AS pf_noise_reads, count(*) FILTER (WHERE flag & 512 = 0 AND adapter) AS adapter_reads, coalesce(CASE WHEN r.category = 'PAIR' THEN (SELECT sum(n) FROM bad WHERE category <> 'UNPAIRED') ELSE (SELECT sum(n) FROM bad b WHERE b.category = r.category) END, 0)::BIGINT AS bad_cycles, min(seq_len) FILTER (WHERE flag & 512 = 0) AS least, max(seq_len) FILTER (WHERE flag & 512 = 0) AS most, round(any_value(mid) * 2)::BIGINT AS median_x2, round(any_value(mad) * 2)::BIGINT AS mad_x2, round(avg(seq_len) FILTER (WHERE flag & 512 = 0) * 1000)::BIGINT AS mean_x1000 FROM rows r JOIN m USING (category) JOIN a USING (category) GROUP BY r.category",
        "wgs_overlap": _with() + ", kept AS (SELECT * FROM reads WHERE flag & (4 + 256 + 512 + 1024 + 8) = 0 AND flag & 1 = 1 AND mapq >= 20), b AS (SELECT qname, ref_id, h, seq, pos + i AS spot, i AS q FROM (SELECT *, unnest(range(0, m1)) AS i FROM kept) UNION ALL SELECT qname, ref_id, h, seq, pos + m1 + del_len + i, m1 + ins_len + i FROM (SELECT *, unnest(range(0, m2)) AS i FROM kept)), e AS (SELECT qname, ref_id, spot, (h + 7 * q) % 42 >= 20 AND substr(seq, (q + 1)::INT, 1) <> 'N' AS ok FROM b) SELECT (SELECT count(*) FROM (SELECT DISTINCT qname, ref_id, spot FROM e WHERE ok)) AS retained, count(*) FILTER (WHERE NOT ok) AS baseq_excluded, count(*) FILTER (WHERE ok) - (SELECT count(*) FROM (SELECT DISTINCT qname, ref_id, spot FROM e WHERE ok)) AS overlap_excluded FROM e",
        "hs_overlap": _with() + ", kept AS (SELECT *, pos + m1 AS s2, pos + m1 + del_len AS s3, pos + m1 + del_len + m2 AS s4 FROM reads WHERE flag & (256 + 512 + 1024) = 0 AND mapq >= 20 AND flag & 1 = 1 AND flag & 12 = 0 AND mate_pos >= pos AND NOT (mate_pos = pos AND flag & 64 > 0)) SELECT coalesce(sum(CASE WHEN mate_pos < s2 THEN s2 - mate_pos ELSE 0 END + CASE WHEN mate_pos < s2 THEN ins_len ELSE 0 END + CASE WHEN mate_pos < s3 THEN m2 WHEN mate_pos < s4 THEN s4 - mate_pos ELSE 0 END), 0)::BIGINT AS clipped_bases FROM kept",
        "violations": _violations(),
        "broken_rules": _broken_rules(),
        "cigar_spans": _with() + "SELECT sum(CASE WHEN unm THEN 0 ELSE seq_len END)::BIGINT AS query_bases, sum(CASE WHEN unm THEN 0 ELSE m1 + del_len + m2 END)::BIGINT AS reference_bases, sum(CASE WHEN unm THEN 0 ELSE m1 + ins_len + m2 END)::BIGINT AS aligned_bases, sum(seq_len)::BIGINT AS unclipped_bases, sum(CASE WHEN flag & 3844 = 0 AND ref_id >= 0 THEN m1 + m2 ELSE 0 END)::BIGINT AS accepted_bases, sum(CASE WHEN unm THEN 0 ELSE 2 + (ins_len > 0)::INT + (del_len > 0)::INT + (soft_len > 0)::INT END)::BIGINT AS operations FROM reads",
        "metric_diff": _with() + ", e AS (SELECT name AS metric, count(*) FILTER (WHERE flag & 4 = 0) AS n FROM refs LEFT JOIN reads USING (ref_id) WHERE ref_id < 20 GROUP BY name), a AS (SELECT name AS metric, count(*) AS n FROM reads JOIN refs USING (ref_id) WHERE ref_id >= 3 AND flag & 1028 = 0 GROUP BY name) SELECT metric, e.n::VARCHAR AS expected, a.n::VARCHAR AS actual, CASE WHEN a.n IS NULL THEN 'missing' WHEN e.n IS NULL THEN 'unexpected' WHEN e.n = a.n THEN 'equal' ELSE 'different' END AS status FROM e FULL JOIN a USING (metric)",
        "typed_metric_diff": _typed_metric_diff(),
    }
    return out
