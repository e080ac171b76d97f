"""SAM flag tests, CIGAR measures and base functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the SAM format.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20
READ1, READ2, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x40, 0x80, 0x100, 0x200, 0x400, 0x800
CIGAR_OPS = "MIDNSHP=X"
READ_SCHEMA = (
    "rec_index bigint, qname string, flag int, ref_id int, pos bigint, mapq int, mate_ref_id int, mate_pos bigint, tlen int,"
    "seq string, qual binary, cigar array<struct<len: int, op: int>>, nm bigint, md string, rg string, xn boolean"
)
#: Further columns of the BAM reader: the length of seq, without its bases.
DERIVED_SCHEMA = "seq_length bigint"
REF_SCHEMA = "ref_id int, name string, length bigint"
#: Reads with any of these flags give no coverage.
NOT_COVERING = UNMAPPED | SECONDARY | QC_FAIL | DUPLICATE | SUPPLEMENTARY


def has(bits: int, flag: Column | str = "flag") -> Column:
    flag = F.col(flag) if isinstance(flag, str) else flag
    return flag.bitwiseAND(F.lit(bits)) != 0


def record_class() -> Column:
    return F.when(has(SECONDARY), "secondary").when(has(SUPPLEMENTARY), "supplementary").otherwise("primary")


def span(ops: str, cigar: Column | str = "cigar", runs: bool = False) -> Column:
    """Sum of the lengths of the CIGAR operations named in ops; with runs, each stands for `times` equal ones."""
    codes = [CIGAR_OPS.index(o) for o in ops]
    length = lambda o: o["len"].cast("bigint") * o["times"] if runs else o["len"]
    return F.aggregate(cigar, F.lit(0).cast("bigint"), lambda a, o: a + F.when(o["op"].isin(codes), length(o)).otherwise(0))


def query_span(runs: bool = False) -> Column:
    return span("MIS=X", runs=runs)


def reference_span(runs: bool = False) -> Column:
    return span("MDN=X", runs=runs)


def aligned_bases() -> Column:
    return span("MI=X")


def unclipped_length() -> Column:
    return seq_length() + span("H")


def seq_length() -> Column:
    return F.coalesce(F.length("seq"), F.lit(0)).cast("bigint")


def reverse_complement(seq: Column) -> Column:
    """IUPAC complement, upper case, '.' as N."""
    return F.translate(F.reverse(F.upper(seq)), "ACGTMRWSYKVHDBN.", "TGCAKYWSRMBDHVNN")


def same_base(a: Column, b: Column) -> Column:
    """Equality of two IUPAC codes; N equals N and '.' only, other characters nothing."""
    known = "ACGTUMRWSYKVHDBN."
    canonical = lambda c: F.translate(F.upper(c), "U.", "TN")
    return F.lit(known).contains(F.upper(a)) & (F.length(a) == 1) & (canonical(a) == canonical(b))
