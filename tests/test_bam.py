"""The BAM reader: splits against one plain walk, columns, hostile bytes, and bad files."""

import random
import struct
import zlib

import pytest

from readloom.errors import LoomError
from readloom.operators import validation
from readloom.sources import bam, bgzf
from tests import rows as R

CONTIGS = [("chr1", 1_000_000), ("chr2", 1_000_000)]
COLUMNS = ["rec_index", "qname", "flag", "ref_id", "pos", "mapq", "mate_ref_id", "mate_pos", "tlen", "seq", "qual", "cigar", "nm", "md", "rg", "xn"]


def some_reads(n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        ops = [(rng.randrange(1, 60), 0), (rng.randrange(1, 4), rng.choice((1, 2, 3))), (rng.randrange(1, 40), 0)]
        r = R.read(f"read-{rng.randrange(10**6)}", rng.choice((0, 16, 4, 99)), rng.randrange(2), 10 * i, ops, "".join(rng.choice("ACGTN") for _ in range(sum(k for k, o in ops if o != 2 and o != 3))), mate=(rng.randrange(-1, 2), rng.randrange(1000)), tlen=rng.randrange(-500, 500), mapq=rng.randrange(61))
        r |= {"nm": rng.choice((None, 0, 3, 1000)), "md": rng.choice((None, "10A5")), "rg": rng.choice((None, "rg1")), "xn": rng.choice((None, True)), "qual": bytes(rng.randrange(42) for _ in r["seq"])}
        out.append(r)
    return out


def expected(reads, first=1):
    """The written reads as the reader gives them."""
    keep = lambda r, c: [{"len": n, "op": o} for n, o in r["cigar"]] if c == "cigar" else r.get(c) or (None if c in ("md", "rg", "xn") else r.get(c))
    return [{"rec_index": i, **{c: keep(r, c) for c in COLUMNS[1:]}} for i, r in enumerate(reads, first)]


def plain(df):
    got = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(({k: bytes(v) if k == "qual" else v for k, v in r.items()} for r in got), key=lambda r: r["rec_index"])


@pytest.mark.parametrize("split", [37, 500, 3000, 1 << 20])
def test_every_split_size_gives_the_same_records(spark, tmp_path, split):
    reads = some_reads(300, split)
    path = str(tmp_path / "x.bam")
    bam.write_bam(path, CONTIGS, reads, block=1500)
    split = max(split, (tmp_path / "x.bam").stat().st_size // 150) if split < 100 else split
    df = bam.read_bam(spark, path, split_bytes=split)
    assert plain(df) == expected(reads)
    if split < 1 << 20:
        assert df.rdd.getNumPartitions() > 10


def stored_blocks(payload, size=60_000):
    """BGZF blocks that hold their bytes as they are."""
    out = b""
    for part in [*(payload[i : i + size] for i in range(0, len(payload), size)), b""]:
        packed = b"\x01" + struct.pack("<HH", len(part), len(part) ^ 0xFFFF) + part
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\6\0BC\2\0" + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def test_bytes_that_look_like_blocks_and_records(spark, tmp_path):
    inner = tmp_path / "inner.bam"
    bam.write_bam(str(inner), CONTIGS, some_reads(40, 1), block=200)
    hidden = inner.read_bytes()
    record = lambda r: struct.pack("<iiBBHHHiiii", 0, 5, 2, 60, 0, 0, 0, 0, -1, -1, 0) + b"a\0"
    fake = b"".join(struct.pack("<i", len(record(0))) + record(0) for _ in range(30))
    # Names can't hold zero bytes, so hostile bytes stand where qualities do.
    reads = []
    for k, bad in enumerate((hidden, fake, hidden[:1000] + fake, fake * 40, hidden * 3)):
        reads += some_reads(5, k)
        reads.append(R.read(f"hostile-{k}", 4, -1, -1, "", "A" * len(bad), qual=bad, mapq=0))
    reads += some_reads(20, 77)
    plain_file = tmp_path / "plain.bam"
    bam.write_bam(str(plain_file), CONTIGS, reads)
    stream = b"".join(made for _, made in bgzf.blocks(str(plain_file)))
    path = tmp_path / "stored.bam"
    path.write_bytes(stored_blocks(stream))
    want = expected(reads)
    for split in (900, 4000, 30_000):
        assert plain(bam.read_bam(spark, str(path), split_bytes=split)) == want
        assert plain(bam.read_bam(spark, str(plain_file), split_bytes=split)) == want


def test_a_record_of_many_blocks_and_an_empty_file(spark, tmp_path):
    reads = [R.read("a", 0, 0, 5, "5M"), R.read("long", 4, -1, -1, "", "ACGT" * 500_000, mapq=0), R.read("b", 0, 0, 9, "5M")]
    path = str(tmp_path / "x.bam")
    bam.write_bam(path, CONTIGS, reads)
    assert plain(bam.read_bam(spark, path, split_bytes=3000)) == expected(reads)
    bam.write_bam(path, CONTIGS, [])
    assert bam.read_bam(spark, path, split_bytes=20).collect() == []


def test_a_folder_is_one_input(spark, tmp_path):
    parts = [some_reads(50, 1), [], some_reads(60, 2)]
    for k, part in enumerate(parts):
        bam.write_bam(str(tmp_path / f"part-{k}.bam"), CONTIGS, part, block=900)
    got = plain(bam.read_bam(spark, str(tmp_path), split_bytes=1000))
    assert got == expected(parts[0] + parts[2])
    # The second file begins before the first one's end.
    places = [R.read("a", 0, 0, 10, "5M"), R.read("b", 0, 0, 20, "5M"), R.read("c", 0, 0, 15, "5M"), R.read("d", 0, 1, 1, "5M")]
    for name, part in (("1", places[:2]), ("2", places[2:])):
        (tmp_path / "two").mkdir(exist_ok=True)
        bam.write_bam(str(tmp_path / "two" / f"{name}.bam"), CONTIGS, part)
    assert [r[0] for r in validation.order_violations(bam.read_bam(spark, str(tmp_path / "two"))).collect()] == [3]
    bam.write_bam(str(tmp_path / "two" / "3.bam"), CONTIGS[:1], [])
    with pytest.raises(LoomError, match="different contigs"):
        bam.read_bam(spark, str(tmp_path / "two"))


def test_columns_are_decoded_alone(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "x.bam")
    reads = some_reads(30, 5)
    bam.write_bam(path, CONTIGS, reads)
    df = bam.read_bam(spark, path, ["flag", "seq_length", "rec_index"])
    assert df.columns == ["flag", "seq_length", "rec_index"]
    assert [(r["rec_index"], r["flag"], r["seq_length"]) for r in df.orderBy("rec_index").collect()] == [(i, r["flag"], len(r["seq"])) for i, r in enumerate(reads, 1)]
    spark.dataSource.register(bam.BamSource)
    source = spark.read.format("bam").schema("flag int, qname string").load(path)
    assert sorted(map(tuple, source.collect())) == sorted((r["flag"], r["qname"]) for r in reads)
    # Tags of no use are not looked at.
    monkeypatch.setattr(bam, "_tags", lambda *a: pytest.fail("tags were decoded"))
    list(bam.records(path, ["flag", "seq", "qual"]))


def with_aux(path, aux):
    """One record with such tag bytes."""
    fixed = struct.pack("<iiBBHHHiiii", 0, 5, 2, 60, 0, 0, 0, 0, -1, -1, 0) + b"a\0" + aux
    head = b"BAM\1" + struct.pack("<ii", 0, 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<I", 1000)
    path.write_bytes(stored_blocks(head + struct.pack("<i", len(fixed)) + fixed))
    return str(path)


@pytest.mark.parametrize("aux,want", [
    (b"NMC\x05", (5, None, None, None)), (b"NMs\x05\x01XXZabc\0RGZr\0", (261, None, "r", None)), (b"BBBs\x02\0\0\0\1\0\2\0XNi\1\0\0\0MDZ5\0", (None, "5", None, True)), (b"AAAxFFf\0\0\0\0HHH1F\0XNc\2", (None, None, None, False)), (b"", (None, None, None, None)), (b"RGZ\0NMI\xff\xff\xff\xff", (4294967295, None, "", None)),
])
def test_tags(tmp_path, aux, want):
    (row,) = bam.records(with_aux(tmp_path / "x.bam", aux), ["nm", "md", "rg", "xn"])
    assert tuple(row.values()) == want


@pytest.mark.parametrize("aux,category", [(b"NMc\xff", "input_corrupt"), (b"NMC\1NMC\1", "input_corrupt"), (b"NMZa\0", "input_corrupt"), (b"MDi\0\0\0\0", "input_corrupt"), (b"XXZab", "input_corrupt"), (b"XXq\0", "input_corrupt"), (b"XXi\0", "input_corrupt"), (b"XXBi\xff\xff\xff\x7f", "input_corrupt"), (b"NM", "input_corrupt"), (b"CGBI\0\0\0\0", "unsupported_record"), (b"RGZ\xe9\0", "input_corrupt"), (b"XXBZ\0\0\0\0", "input_corrupt")])
def test_bad_tags(tmp_path, aux, category):
    with pytest.raises(LoomError) as e:
        list(bam.records(with_aux(tmp_path / "x.bam", aux), ["nm"]))
    assert e.value.category == category


def test_cut_and_changed_files(spark, tmp_path):
    path = tmp_path / "x.bam"
    bam.write_bam(str(path), CONTIGS, some_reads(200, 3), block=700)
    whole = path.read_bytes()
    for bad in (whole[: len(whole) // 2], whole[:-40], whole[:3000] + bytes([whole[3000] ^ 255]) + whole[3001:]):
        path.write_bytes(bad)
        with pytest.raises(Exception, match="input_corrupt|block|inside a record"):
            bam.read_bam(spark, str(path), split_bytes=1000).collect()
