"""Alignment fixtures as rows; expected values are stated in the tests."""

from readloom.functions.sam import CIGAR_OPS, READ_SCHEMA

REFS = [(0, "chr1", 1_000_000), (1, "chr2", 1_000_000)]


def ops(text):
    out, n = [], ""
    for c in text:
        if c.isdigit():
            n += c
        else:
            out.append((int(n), CIGAR_OPS.index(c)))
            n = ""
    return out


def read(qname, flag, ref, pos, cigar, seq=None, mate=(-1, -1), tlen=0, mapq=60, qual=None, **tags):
    cigar = ops(cigar) if isinstance(cigar, str) else cigar
    seq = seq if seq is not None else "A" * sum(n for n, o in cigar if o in (0, 1, 4, 7, 8))
    return {"qname": qname, "flag": flag, "ref_id": ref, "pos": pos, "cigar": cigar, "seq": seq, "mate_ref_id": mate[0], "mate_pos": mate[1], "tlen": tlen, "mapq": mapq, "qual": qual or bytes([30] * len(seq)), **tags}


def frame(spark, rows):
    names = ("qname", "flag", "ref_id", "pos", "mapq", "mate_ref_id", "mate_pos", "tlen", "seq", "qual", "cigar", "nm", "md", "rg", "xn")
    return spark.createDataFrame([(i, *(r.get(n) for n in names)) for i, r in enumerate(rows)], READ_SCHEMA)


def refs(spark, rows=None):
    return spark.createDataFrame(rows or REFS, "ref_id int, name string, length bigint")


def targets(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "source_index bigint, ref_id int, start bigint, stop bigint")


BASIC = [read("mapped-1", 0, 0, 100, "10M", "ACGTACGTAC"), read("mapped-2", 0, 1, 200, "4M1I5M", "AAAACGGGGG"), read("unmapped-1", 4, -1, -1, "", "NNNN", mapq=0)]
CIGARS = [read("ops", 0, 0, 500, "2S3M1I2=1X1D4N1P1H", "ACGTACGTA")]
FLAGS = [
    read("pair-a", 0x43, 0, 100, "10M", "A" * 10, (0, 160), 70, rg="rg1"), read("pair-a", 0xB3, 0, 160, "10M", "C" * 10, (0, 100), -70, rg="rg1"), read("secondary", 0x100, 0, 300, "5M", "G" * 5),
    read("supplementary", 0x800, 0, 350, "5M", "T" * 5), read("dual", 0x900, 0, 400, "5M"), read("duplicate", 0x400, 0, 450, "5M", "C" * 5), read("qc-fail", 0x200, 0, 500, "5M", "G" * 5),
    read("singleton", 0x49, 0, 550, "5M", "T" * 5), read("discordant", 0x41, 0, 600, "5M", "A" * 5, (1, 100)),
]
CHUNKS = [read("chunk-left", 0, 0, 65530, "20M"), read("chunk-right", 0, 0, 65536, "4M20N4M")]
ALIGNMENT_EDGE = [
    *(read(f"u{i}", 0, 0, 100 + 10 * i, "4M", s, xn=True if i == 0 else None) for i, s in enumerate(("NAAA", "NCCC", "NGGG", "NTTT", "AAAA"))),
    read("pair", 0x41, 0, 200, "16M", "AATGATACGGCGACCA", (0, 300), 116, mapq=0), read("pair", 0x91, 0, 300, "16M", "TGGTCGCCGTATCATT", (0, 200), -116, mapq=0),
    *(read(f"s{i}", 0x800, 0, 400 + 10 * i, "4M", "ANAA") for i in range(4)), *(read(f"t{i}", 0x100, 0, 500 + 10 * i, "4M", "AANA") for i in range(4)),
]


def insert_edge():
    sizes = [100] * 10 + [101] * 10 + [102] * 8 + [103] * 8 + [1000]
    kinds = [(0x91, -50, -s) for s in sizes] + [(0x91, 50, -200), (0x91, 50, -202), (0x81, -50, 300)]
    kinds += [(0x491, -50, -150), (0x191, -50, -151), (0x891, -50, -152), (0x99, -50, -153), (0x91, -50, 0), (0x51, -50, 154)]
    return [read(f"i{k}", flag, 0, 1000 + 20 * k, "10M", None, (0, 1000 + 20 * k + away), tlen) for k, (flag, away, tlen) in enumerate(kinds)]


OVERLAP = [
    read("pair-overlap", 0x41, 0, 100, "40M", None, (0, 120)), read("pair-overlap", 0x81, 0, 120, "40M", None, (0, 100)),
    read("quality-order", 0x41, 0, 200, "20M", None, (0, 210), qual=bytes([30] * 10 + [10] * 10)), read("quality-order", 0x81, 0, 210, "20M", None, (0, 200)),
    read("supplementary-edge", 0x41, 0, 300, "10M", None, (0, 305)), read("supplementary-edge", 0x881, 0, 305, "10M", None, (0, 300)), read("supplementary-edge", 0x181, 0, 307, "5M", None, (0, 300)),
    read("equal-start", 0x41, 0, 400, "10M", None, (0, 400)), read("equal-start", 0x81, 0, 400, "10M", None, (0, 400)),
    read("extended-cigar", 0x81, 0, 500, "5=5X", None, (0, 502)), read("insertion-cigar", 0x81, 0, 550, "5M2I5M", None, (0, 553)),
]
