"""Each text operator against a brute-force version, an exact round trip or held-out accuracy, and on edge cases."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readloom.llm import ann, bpe, components, jaccard, jpeg, lm, media, mixing, pii, queries, sharding, substrings, toxicity
from tests.llm.conftest import EDGE


def dicts(df):
    return [r.asDict() for r in df.collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def random_texts(n, seed, size=60):
    """Texts with shared passages, near and exact copies."""
    rng = random.Random(seed)
    vocabulary = [a + b for a in ("ta", "re", "mi", "lo", "su", "Ka") for b in ("n", "r", "st", "", "lly", ".")]
    passages = [[rng.choice(vocabulary) for _ in range(45)] for _ in range(4)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.15:
            out.append(rng.choice(out))
        elif out and kind < 0.45:
            w = rng.choice(out).split()
            for _ in range(rng.randrange(1, 4)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randrange(size * 2))]
            if rng.random() < 0.4:
                at = rng.randrange(len(w) + 1)
                w[at:at] = rng.choice(passages)
            out.append(" ".join(w))
    return out


# 1


RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_plain_rules():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("aB1.@+-%_ 0925()é") for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == brute_spans(text), text
    assert pii.base_spans("a" * 200_000) == [] and pii.base_spans("4111 1111 1111 1111")[0][0] == "card"


def test_pii_on_edges_and_discovery(spark, make_docs, edge_docs, empty_docs):
    got = dicts(pii.pii_spans(edge_docs))
    assert len(got) == len(EDGE) and all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in got)
    assert pii.pii_spans(empty_docs).count() == 0
    # Seeds after "call me" teach the pattern; numbers without "+" there are phones too, elsewhere they are not.
    texts = [f"please call me +1 555 010 {1000 + i} today" for i in range(30)] + ["please call me 555-010-7777 today", "the order is 555-010-8888 now"]
    by = {r["doc_id"]: r for r in dicts(pii.pii_spans(make_docs(texts)))}
    assert by[30]["spans"].startswith("phone:15:") and by[30]["n_phone"] == 0 and by[30]["n_discovered"] == 1
    assert by[31]["spans"] == "" and all(by[i]["n_discovered"] == 0 for i in range(30))
    out = {r["doc_id"]: r["text"] for r in dicts(pii.redact(make_docs([*texts, None, "mail a.b@c.de now"])))}
    assert out[30] == "please call me [PHONE] today" and out[32] is None and out[33] == "mail [EMAIL] now" and out[31] == texts[31]


def test_pii_discovers_grouped_and_long_identifiers(spark):
    texts = [f"please call me +1 555 010 {1000 + i} today" for i in range(30)]
    unseen = ["555 010 7777", "(555) 010-7777", "555-010-7778", "5" * 100, "77"]
    texts += [f"please call me {u} today" for u in unseen]
    rows = {r["doc_id"]: r for r in dicts(pii.pii_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    for i, u in enumerate(unseen, 30):
        assert rows[i]["spans"] == f"phone:15:{15 + len(u)}", u
    long = "y" * 200
    assert pii.mentions(f"{long} me 1234567 x", [])[0][4] == f"{hashlib.sha256(long.encode()).hexdigest()} me _"
    assert pii.mentions(f"a me 1234567 {long}", [])[0][5] == f"me _ {hashlib.sha256(long.encode()).hexdigest()}"
    assert pii.candidates("9" * 200_000) == [(0, 200_000)] and len(pii.candidates("1," * 50_000)) == 50_000


def test_pii_discovered_identifiers_teach_patterns(spark):
    """Identifiers found after "call me" make "dial now" a pattern, which no base rule knows, and that finds one more."""
    texts = [f"please call me +1 555 010 {1000 + i} today" for i in range(200)]
    texts += [f"please call me 555-020-{1000 + i} today" for i in range(40)] + [f"just dial now 555-020-{1000 + i} there" for i in range(40)]
    texts += ["just dial now 555-030-7777 there", "an order of 555-030-8888 there"]
    rows = {r["doc_id"]: r for r in dicts(pii.pii_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    assert rows[280]["spans"] == "phone:14:26" and rows[281]["spans"] == ""
    assert all(rows[i]["n_discovered"] == 1 for i in range(200, 280))


def test_pii_contexts_hold_all_glued_characters():
    def around(text):
        start = text.index("a@b.c")
        return pii._Words(text).context(start, start + 5)

    rng = random.Random(9)
    for _ in range(300):
        left = "".join(rng.choice("aB9é") for _ in range(rng.randrange(81, 200)))
        same = around(f"go {left}=a@b.c/{left} on")
        assert same == around(f"go {left}=a@b.c/{left} on") and same == around(f"go {left.upper().lower()}=a@b.c/{left} on")
        for other in ("z" + left[1:], left[:100] + "z" + left[100:]):
            assert around(f"go {other}=a@b.c/{left} on")[1] != same[1] != around(f"go {left}=a@b.c/{left[:-1]}z on")[1]
    word = "".join(rng.choice("aB90é") for _ in range(400))
    for _ in range(300):
        a, b = sorted(rng.sample(range(len(word) + 1), 2))
        plain, got = pii._plain(word[a:b]), pii._Glue(word).part(a, b)
        assert got == plain if len(plain) < 64 else got == pii._Glue(word[a:b]).part(0, b - a)
    long = "a@b.c/" * 30_000
    assert len(pii.mentions(long, pii.base_spans(long))) >= 30_000


def test_pii_of_rows_without_an_id(spark):
    texts = [f"please call me +1 555 010 {1000 + i} today" for i in range(30)]
    rows = [*enumerate(texts), (None, "please call me 555-010-7777 today"), (None, "mail a.b@c.de now"), (None, "mail a.b@c.de now"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["n_discovered"], r["n_email"]) for r in dicts(pii.pii_spans(docs)) if r["doc_id"] is None)
    assert found == [(0, 0), (0, 1), (0, 1), (1, 0)]
    out = [r["text"] for r in dicts(pii.redact(docs)) if r["doc_id"] is None]
    assert sorted(out, key=str) == [None, "mail [EMAIL] now", "mail [EMAIL] now", "please call me [PHONE] today"]


# 2


def test_poisson_counts_by_plain_inversion(spark, make_docs):
    docs = make_docs([f"text {i}" for i in range(400)], source=["a"] * 300 + ["b"] * 99 + [None])
    by = {r["source"]: r["rate"] for r in dicts(mixing.rates(docs))}
    got = collections.Counter(r["doc_id"] for r in dicts(mixing.mix_sources(docs)))
    for r in dicts(docs):
        u = int(hashlib.md5(f"0:{r['doc_id']}:{hashlib.md5(r['text'].encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / 2**52
        rate, k = by[r["source"]], 0
        term = cdf = math.exp(-rate)
        while cdf <= u:
            k += 1
            term *= rate / k
            cdf += term
        assert got[r["doc_id"]] == k
    even = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    shares = {r["source"]: r["share"] for r in dicts(mixing.share_report(mixing.mix_sources(docs, even)))}
    assert abs(shares["a"] - 0.5) < 0.08 and None not in shares


def test_mixing_on_edges(edge_docs, empty_docs, spark, make_docs):
    assert mixing.mix_sources(empty_docs).count() == 0
    assert set(edge_docs.columns) < set(mixing.mix_sources(edge_docs).columns)
    rows = dicts(mixing.mix_sources(make_docs(["t"] * 3), epochs=900.0))
    assert 2300 < len(rows) < 3100  # a rate over MAX_RATE is drawn in pieces
    keys = [r["shuffle_key"] for r in rows]
    assert keys != sorted(keys, key=lambda k: (k,))[::-1]


# 3


def test_bpe_equals_the_library(spark, make_docs, empty_docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    theirs, ours = Tokenizer.from_file(path), bpe.ForcedBoundaryBpe(bpe.load_tokenizer(path))
    rng = random.Random(2)
    alphabet = "abcABC ÉéßİΣσς́\x1c\x1f\x85\xa0 'sS<|endoftext|>123٣ªǅﬁ😀한국語​\t\n"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(25))) for _ in range(3000)] + ["a" * 5000, "ab" * 3000 + "é" * 99, "<|endoftext|>x<|startoftext|>", ""]
    for text, want in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ours.encode(text) == want.ids, text
        assert ours.decode(want.ids) == theirs.decode(want.ids, skip_special_tokens=False)
    digest = {r["doc_id"]: r for r in dicts(bpe.bpe_digest(make_docs(EDGE), path))}
    encoded = {r["doc_id"]: r for r in dicts(bpe.bpe_decode(bpe.bpe_encode(make_docs(EDGE), path), path))}
    for i, text in enumerate(EDGE):
        want = theirs.encode(text or "", add_special_tokens=False).ids
        assert encoded[i]["token_ids"] == want and digest[i]["n_tokens"] == len(want)
        assert digest[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert digest[i]["decoded_sha256"] == hashlib.sha256(encoded[i]["decoded"].encode()).hexdigest()
    assert bpe.bpe_digest(empty_docs, path).count() == 0


def test_forced_boundaries_are_inside_no_token():
    ours = bpe.ForcedBoundaryBpe(bpe.load_tokenizer(queries.tokenizer_path()))
    pieces = ours.cut("zqxjkvthe")
    assert "".join(pieces) == "zqxjkvthe</w>" and len(pieces) > 1
    for a, b in zip(pieces, pieces[1:], strict=False):
        assert not any(a[-1] + b[0] in t for t in ours.vocab)


# 4


@pytest.mark.parametrize("hot", [False, True])
def test_shards_are_equal_in_bytes(make_docs, hot):
    rng = random.Random(4)
    texts = [("same text " * 20 if hot and i % 3 == 0 else "x" * rng.randrange(500)) for i in range(3000)]
    rows = dicts(sharding.shard_documents(make_docs(texts)))
    total, by = sum(r["size"] for r in rows), collections.defaultdict(list)
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["grown_shard"] is None and r["law"] == "bytes"
        by[r["shard"]].append(r)
    assert sorted(by) == list(range(40))
    for part in by.values():
        assert abs(sum(r["size"] for r in part) - total / 40) <= max(r["size"] for r in rows)
        assert sorted(r["slot"] for r in part) == list(range(len(part)))


def test_shards_of_repeated_rows_and_null_ids(spark, monkeypatch):
    rows = [(None, "same text " * 3)] * 900 + [(7, "same text " * 3)] * 900 + [(i, "x" * (i % 90)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = dicts(sharding.shard_documents(docs, shards=10))
    total, sizes = sum(r["size"] for r in out), collections.Counter()
    for r in out:
        sizes[r["shard"]] += r["size"]
    assert len(out) == len(rows) and all(abs(s - total / 10) <= 120 for s in sizes.values())
    assert all(sorted(r["slot"] for r in out if r["shard"] == k) == list(range(sum(r["shard"] == k for r in out))) for k in sizes)


def test_shards_on_edges(edge_docs, empty_docs):
    rows = dicts(sharding.shard_documents(edge_docs))
    assert len(rows) == len(EDGE) and rows and sharding.shard_documents(empty_docs).count() == 0
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows))) for s in {r["shard"] for r in rows})


# 5


def test_nearest_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((3000, 32))
    vectors[100:160] = vectors[100]
    bad = [(-1, None), (-2, [0.0] * 32), (-3, [float("nan")] * 32), (-4, [None] * 32), (-5, [1.0] * 31), (-20, [float("inf")] * 32)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + bad, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in dicts(ann.nearest(df, F.col("vec_id") % 20 == 0)):
        got[r["query_id"]].append(r)
    hits, scores = 0, vectors @ vectors.T
    for q in range(0, 3000, 20):
        found = sorted(got[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21)) and q not in [r["vec_id"] for r in found]
        keys = [(-r["score"], r["vec_id"]) for r in found]
        assert keys == sorted(keys) and all(abs(r["score"] - scores[q, r["vec_id"]]) < 1e-9 for r in found)
        truth = [i for i in np.lexsort((np.arange(3000), -scores[q])) if i != q][:20]
        hits += len({*truth} & {r["vec_id"] for r in found})
    assert len(got) == 150 and hits / (150 * 20) >= 0.95
    twice = df.union(df.where("vec_id % 40 = 0"))
    again = collections.Counter(r["query_id"] for r in dicts(ann.nearest(twice, F.col("vec_id") % 20 == 0)))
    assert set(again.values()) == {20} and len(again) == 150
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in dicts(ann.nearest(few, F.col("vec_id") % 20 == 0))] == [(0, 1, 1, 0.5)]
    assert ann.nearest(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# 6


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 4097, 20_000])
def test_media_round_trip(n):
    payload = media.payload_of(random.Random(n).randbytes(n))
    data = media.encode_avi(payload)
    found, clips = media.read_avi(data)
    assert found == payload and clips[0][0] == 0 and clips[-1][1] == len(media.Avi(data).frames)
    assert data == media.encode_avi(payload)
    assert sum(2.0 ** -(10 - s) for s in range(9)) < 1  # the Huffman tables have room


def test_media_shots_and_edges(spark, make_docs, edge_docs, empty_docs):
    still, other = np.tile([1600, 2496] + [0] * 14, (10, 1)), np.tile([0] * 14 + [2496, 1600], (5, 1))
    assert media.shots(np.concatenate([still, other])) == [(0, 10), (10, 15)]
    rows = {r["doc_id"]: r for r in dicts(media.media_digest(edge_docs))}
    for i, text in enumerate(EDGE):
        payload = media.payload_of((text or "").encode())
        want = (len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (rows[i]["n_bytes"], rows[i]["payload_bytes"], rows[i]["payload_sha256"], rows[i]["tail_crc32"]) == want
    assert rows[4]["media_sha256"] == rows[5]["media_sha256"] and rows[4]["feature"] == rows[5]["feature"]
    assert media.media_digest(empty_docs).count() == 0
    clips = dicts(media.media_clips(media.encode_media(edge_docs.select("doc_id", "text")).drop("text")))
    assert {c["doc_id"] for c in clips} == set(range(len(EDGE))) and all(c["end_s"] > c["start_s"] for c in clips)


def test_typical_huffman_tables_are_whole():
    for counts, first in ((jpeg.AC_LUMA_COUNTS, jpeg.AC_LUMA_FIRST), (jpeg.AC_CHROMA_COUNTS, jpeg.AC_CHROMA_FIRST)):
        symbols = jpeg._typical_ac(first)
        assert sum(counts) == 162 == len(set(symbols)) and {0x00, 0xF0} <= set(symbols)


def written_by_java(spark, folder, name, pixels):
    """A JPEG that the JVM's writer makes of RGB pixels, and the pixels that Spark's image source reads from it."""
    jvm, (high, wide, _) = spark.sparkContext._jvm, pixels.shape
    image = jvm.java.awt.image.BufferedImage(wide, high, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    for y in range(high):
        for x in range(wide):
            r, g, b = (int(v) for v in pixels[y, x])
            image.setRGB(x, y, r << 16 | g << 8 | b)
    path = folder / name
    jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(path)))
    row = spark.read.format("image").load(str(path)).select("image.*").first()
    return path.read_bytes(), np.frombuffer(bytes(row["data"]), np.uint8).reshape(row["height"], row["width"], 3)[:, :, ::-1]


def colours(seed, high=37, wide=51):
    y, x = np.mgrid[:high, :wide]
    return np.stack([(x * 4 + seed * 60) % 256, (y * 5) % 256, (x + y + seed * 90) % 256], axis=2).astype(np.uint8)


def luma(rgb):
    return rgb @ np.array([0.299, 0.587, 0.114])


def container(pictures, index=True, step=40_000):
    """A plain AVI of JPEG frames with an audio chunk between them."""
    chunk = media._chunk
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII", 0, 0, 0, 0, 1, 25, 0, len(pictures), 0, 0, 0) + bytes(8)
    strf = struct.pack("<IiiHH4sIiiII", 40, 51, 37, 1, 24, b"MJPG", 0, 0, 0, 0, 0)
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", struct.pack("<14I", step, *[0] * 13)) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    body, entries = b"movi", b""
    for p in pictures:
        for name, data in ((b"01wb", b"sound"), (b"00dc", p)):
            entries += struct.pack("<4sIII", name, 0x10, len(body), len(data))
            body += chunk(name, data)
    return chunk(b"RIFF", b"AVI " + header + chunk(b"LIST", body) + (chunk(b"idx1", entries) if index else b""))


def test_decoder_equals_another_on_colour_frames(spark, tmp_path):
    frames = []
    for seed in range(2):
        data, other = written_by_java(spark, tmp_path, f"{seed}.jpg", colours(seed))
        ours = jpeg.decode(data)
        assert ours.shape == (37, 51, 3)
        # Both round brightness; the other's passed through RGB once more.
        assert np.abs(ours[:, :, 0] - luma(other)).mean() < 1.5
        frames.append(data)
    film = [frames[0]] * 12 + [b""] + [frames[1]] * 5
    for index in (True, False):
        payload, clips = media.read_avi(container(film, index))
        assert payload is None and [c[:2] for c in clips] == [(0, 13), (13, 18)] and clips[1][2:] == (0.52, 0.72)
    assert media.read_avi(container(film, step=0))[1][1][2:] == (0.52, 0.72)


def test_decoder_equals_the_look_up_and_restarts():
    payload = media.payload_of(random.Random(4).randbytes(9000))
    data = media.encode_avi(payload)
    avi = media.Avi(data)
    fast = media.decode_frames(b"".join(media._scan_of(data[a:b]) for a, b in avi.frames))[1]
    assert np.abs(media._histograms(avi) * 4096 - fast).max() <= 2  # rounding at the bins' edges
    # The same frame with a restart after each of its blocks (80 bytes), whose first coefficient then stands alone.
    a, b = avi.frames[0]
    codes = media._unpack(np.frombuffer(media._scan_of(data[a:b]), np.uint8)).reshape(64, 64)
    codes[:, 0] = media._DC_CODE[np.cumsum(media._DC_DIFF[codes[:, 0]]) + 255]
    pieces = [media._pack(c.astype(np.uint64)).tobytes().replace(b"\xff", b"\xff\0") for c in codes]
    scan = b"".join(p + bytes([0xFF, 0xD0 + k % 8]) for k, p in enumerate(pieces))[:-2]
    restarted = b"\xff\xd8" + media._segment(0xDD, b"\0\1") + media._HEAD[2:] + scan + b"\xff\xd9"
    assert (jpeg.decode(restarted) == jpeg.decode(data[a:b])).all()


def test_damaged_media_are_rows(spark, tmp_path):
    frame, _ = written_by_java(spark, tmp_path, "x.jpg", colours(3))
    good = container([frame] * 3)
    bad = [b"", b"RIFF", b"text", good[:200], good[:-900], container([frame[:300]]), container([frame.replace(b"\xff\xc0", b"\xff\xc2")]), container([b""]), good.replace(b"MJPG", b"H264")]
    huge = bytearray(frame)
    at = frame.index(b"\xff\xc0") + 5
    huge[at : at + 4] = b"\xff\xff\xff\xff"
    bad.append(container([bytes(huge)]))
    own = bytearray(media.encode_avi(bytes(64)))
    del own[-40:]
    bad.append(bytes(own))
    df = spark.createDataFrame([(k, bytearray(b), "z") for k, b in enumerate(bad)] + [(50, bytearray(good), "z"), (51, None, "z")], "id int, media binary, clip string")
    rows = dicts(media.media_clips(df))
    assert sorted(r["id"] for r in rows) == [*range(len(bad)), 50]
    for r in rows:
        assert r["input"]["clip"] == "z"
        if r["id"] == 50:
            assert (r["clip"], r["first_frame"], r["end_frame"], r["end_s"], r["error"]) == (0, 0, 3, 0.12, None)
        else:
            assert r["clip"] is None and r["first_frame"] is None and r["error"]
    rng = random.Random(7)
    for _ in range(300):  # no damage does more than raise ValueError
        spoilt = bytearray(good)
        for _ in range(3):
            spoilt[rng.randrange(len(spoilt))] = rng.randrange(256)
        try:
            media.read_avi(bytes(spoilt))
        except ValueError:
            pass


# 7


def brute_repeats(texts):
    seen, out = set(), []
    for t in texts:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(make_docs, seed):
    texts = random_texts(150, seed) + ["a b " * 60, "b a " * 60, *EDGE]
    rows = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in dicts(substrings.substring_digest(make_docs(texts)))}
    want = brute_repeats(texts)
    assert [i for i in range(len(texts)) if rows[i] != want[i]] == [] and sum(x[1] for x in want) > 1000


def test_substrings_texts_and_empty(make_docs, empty_docs):
    assert substrings.substring_digest(empty_docs).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    got = {r["doc_id"]: r["text"] for r in dicts(substrings.remove_repeats(make_docs([text, "x " + text + " y", text, None])))}
    assert got == {0: text, 1: "x y", 2: "", 3: None}


def test_substrings_clashing_columns_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(None, text), (1, "x " + text), (None, None), (2, "short")], "doc_id long, text string")
    clash = docs.withColumns({c: F.lit(7) for c in ("_d", "_h", "_dd", "_hh", "_kept", "kept", "d", "h", "whole", "n_removed", "a.b")})
    out = substrings.remove_repeats(clash)
    assert out.columns == clash.columns
    assert sorted((str(r["doc_id"]), str(r["text"]), r["_kept"], r["whole"], r["a.b"]) for r in dicts(out)) == sorted((str(i), t, 7, 7, 7) for i, t in [(None, text), (1, "x"), (None, "None"), (2, "short")])


# 8


def brute_components(texts, percent=80):
    sets = []
    for t in texts:
        w = words(lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard(make_docs, seed):
    texts = random_texts(220, seed) + EDGE
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in dicts(jaccard.jaccard_components(make_docs(texts)))}
    want = brute_components(texts)
    assert [i for i in range(len(texts)) if rows[i] != want[i]] == [] and len({c for _, c in want}) < 200
    kept = {r["doc_id"] for r in dicts(jaccard.keep_one(make_docs(texts)))}
    assert kept == {c for _, c in want}


@pytest.mark.parametrize(("crowd", "rounds"), [(2, 8), (3, 1), (2, 0)])
def test_jaccard_of_crowded_tokens(make_docs, monkeypatch, crowd, rounds):
    """Groups around leaders: near copies by the dozen, two templates, and a passage that fills most of many texts."""
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "RUN", 2000)
    rng = random.Random(crowd * 10 + rounds)
    vocabulary = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(n)] for n in (60, 60, 90)]
    bases[1][:30] = bases[0][:30]
    texts = []
    for _ in range(150):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [rng.choice(vocabulary[:40])] * rng.randrange(1, 3)
        texts.append(" ".join(w))
    texts += [" ".join(bases[2][:70] + [rng.choice(vocabulary) for _ in range(rng.randrange(25))]) for _ in range(60)] + random_texts(60, 5)
    rng.shuffle(texts)
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in dicts(jaccard.jaccard_components(make_docs(texts)))}
    want = brute_components(texts)
    assert [i for i in range(len(texts)) if rows[i] != want[i]] == [] and max(collections.Counter(c for _, c in want).values()) > 10


def test_jaccard_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (3, text), (3, text), (7, text + " end"), (8, None), (None, ""), (9, "w0 w1"), (9, "other words"), (4, "w0 w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in dicts(jaccard.jaccard_components(docs))), key=str)
    assert got == sorted([(None, 36, 3), (3, 36, 3), (3, 36, 3), (7, 37, 3), (8, 0, 8), (None, 0, None), (9, 1, 4), (9, 1, 9), (4, 1, 4)], key=str)
    clash = docs.withColumns({c: F.lit(1) for c in ("_copy", "copy", "whole", "component_id", "fp", "n", "token")})
    kept = jaccard.keep_one(clash)
    assert kept.columns == clash.columns and sorted((str(r["doc_id"]), r["text"] or "") for r in dicts(kept)) == sorted([("None", text), ("None", ""), ("3", text), ("3", text), ("8", ""), ("4", "w0 w1"), ("9", "other words")])


def test_jaccard_links_pass_through_rows_without_an_id(spark):
    base = [f"w{i}" for i in range(40)]
    a, x, b = (" ".join(base + [f"e{i}" for i in range(n)]) for n in (0, 7, 14))
    y, z = " ".join(f"v{i}" for i in range(30)), " ".join(f"v{i}" for i in range(31))
    rows = [(5, a), (None, x), (None, x), (6, b), (None, y), (None, z)]
    got = sorted(((r["doc_id"], r["component_id"]) for r in dicts(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")))), key=str)
    assert got == sorted([(5, 5), (None, 5), (None, 5), (6, 5), (None, None), (None, None)], key=str)
    alone = {r["doc_id"]: r["component_id"] for r in dicts(jaccard.jaccard_components(spark.createDataFrame([(5, a), (6, b)], "doc_id long, text string")))}
    assert alone == {5: 5, 6: 6}
    kept = [r["doc_id"] for r in dicts(jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")))]
    assert sorted(kept, key=str) == sorted([5, None, None, None, None], key=str)


def test_jaccard_prefixes_meet(make_docs, empty_docs):
    assert jaccard.jaccard_components(empty_docs).count() == 0
    rng = np.random.default_rng(8)
    frequent = (np.unique(rng.integers(0, 500, 200, dtype=np.uint64)), rng.integers(1, 9, 500))
    for _ in range(300):
        a = np.unique(rng.integers(0, 1000, rng.integers(1, 60), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.integers(0, 1000, rng.integers(0, 4), dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if len(b) and 100 * common >= 80 * (len(a) + len(b) - common):
            assert len(np.intersect1d(jaccard.prefix(a, frequent, 80)[0], jaccard.prefix(b, frequent, 80)[0]))


def test_jaccard_order_knows_tokens_that_no_run_repeats(make_docs, monkeypatch):
    """A passage of many texts is counted over all of them, however few a run holds, so that prefixes do without it."""
    monkeypatch.setattr(jaccard, "RUN", 10)
    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage = fresh(30)
    texts = [" ".join(fresh(50) + passage + fresh(50)) for _ in range(60)]
    docs = make_docs(texts).selectExpr("doc_id", "xxhash64(text) AS h", "text")
    known = jaccard._frequent(jaccard._profile(docs))
    rows = jaccard._prefix_rows(docs, known, 80)
    assert rows.count() == 60 * (126 - 101 + 1) and jaccard._crowded(jaccard._repeated(rows))[1].count() == 0
    shared = next(s for _, s in jaccard._sets(pa.array([" ".join(passage)])))
    low = {int(t) >> jaccard.DROPPED for t in shared if int(t) >> 52 < jaccard.LOW}
    assert dict(zip(known[0].tolist(), known[1].tolist(), strict=True)) == dict.fromkeys(low, 60) and 0 < len(low) < 26


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)], "u long, v long")
    got = {r["node"]: r["component"] for r in dicts(components.components(edges))}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components.components(edges.limit(0)).count() == 0


# 9


def test_toxicity_on_held_out_documents(spark, make_docs, edge_docs, empty_docs):
    rng = random.Random(9)
    bad, plain = ["zorgblat", "frumious", "grizzlow"], [a + b for a in "bcdfgh" for b in ("anter", "olin", "ume", "ista")]
    texts = [" ".join(rng.choice(plain) for _ in range(30)) + ("" if i % 4 else " " + rng.choice(bad) + ".") for i in range(800)]
    docs = make_docs(texts)
    labels = spark.createDataFrame([(i, i % 3 and 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (5, None, 1)], "doc_id long, quality long, toxic long")
    rows = dicts(toxicity.toxicity(docs, labels))
    assert {"p_poor", "p_toxic", *docs.columns} < set(rows[0])
    assert [r["doc_id"] for r in rows if r["doc_id"] >= 400 and r["is_toxic"] != (r["doc_id"] % 4 == 0)] == []
    assert len(dicts(toxicity.toxicity(edge_docs, labels))) == len(EDGE) and toxicity.toxicity(empty_docs, labels).count() == 0
    assert all(r["p_toxic"] < 0.5 for r in dicts(toxicity.toxicity(docs, labels.limit(0))))


def test_columns_named_like_results(spark, make_docs):
    """Inner and result names as extra columns: toxicity and mixing replace those of their results, whole-row stages keep all."""
    texts = [f"plain words number {i} mail a{i}@b.example.org" for i in range(12)]
    names = ("p_toxic", "p_poor", "is_toxic", "rate", "_source", "copy", "shuffle_key", "_id", "_hash", "_spans", "spans", "whole", "token_ids", "p", "done", "text_hash")
    docs = make_docs(texts).withColumns({c: F.lit(c) for c in names})
    labels = spark.createDataFrame([(i, 1, int(i == 0)) for i in range(12)], "doc_id long, quality long, toxic long")
    judged = toxicity.toxicity(docs, labels)
    assert len(set(judged.columns)) == len(judged.columns) and 0 <= judged.first()["p_toxic"] <= 1
    clean = toxicity.without_toxic(docs, labels)
    assert clean.columns == docs.columns and {r["p_toxic"] for r in dicts(clean)} == {"p_toxic"}
    mixed = mixing.mix_sources(docs)
    assert len(set(mixed.columns)) == len(mixed.columns) and isinstance(mixed.first()["rate"], float)
    assert mixing.mixed_rows(docs).select("whole.*").columns == docs.columns
    cut = dicts(pii.redact(docs))
    assert all(r["text"].endswith("mail [EMAIL]") and all(r[c] == c for c in names if c != "text_hash") for r in cut)
    encoded = bpe.bpe_encode(docs, queries.tokenizer_path())
    assert encoded.columns.count("token_ids") == 1 and encoded.first()["token_ids"][0] > 0


def test_toxicity_bounds_rows_and_cuts_whole_punctuation(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(5)], "doc_id long, quality long, toxic long")
    rows = dicts(toxicity.training_rows(docs, labels, toxicity.CATEGORIES, 3))
    assert len(rows) == len({r["doc_id"] for r in rows}) == 3 and len(toxicity.train(docs, labels, toxicity.CATEGORIES, 3)) == 2
    plain, wrapped = (toxicity._features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in (b"vile", b"(((((vile!!!!!!??"))
    assert plain.tolist() == wrapped.tolist() and not len(toxicity._features(np.frombuffer(b"!" * 5000, np.uint8), np.array([0, 5000]))[0])


def test_chain_feeds_earlier_probabilities():
    rng = np.random.default_rng(9)
    first = rng.random(600) < 0.5
    present = [np.array([1 if f else 2], np.uint64) for f in first]
    links = toxicity.fit_chain(np.arange(600), present, np.column_stack([first, first]).astype(float), max_features=0)
    assert links[0].earlier.shape == (0,) and links[1].earlier.shape == (1,)
    links = toxicity.fit_chain(np.arange(600), present, np.column_stack([first, first]).astype(float))
    assert links[1].earlier[0] > 0


# 10


def test_lm_base_and_order(spark, make_docs, edge_docs, empty_docs):
    texts = random_texts(300, 10) + EDGE
    rows = {r["doc_id"]: r for r in dicts(lm.score_texts(make_docs(texts), queries.tokenizer_path(), top=20))}
    counts, tokens = collections.Counter(), [[*words(lower(t)), None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    for w, h in zip(tokens, held, strict=True):
        if not h:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    for i, w in enumerate(tokens):
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
    outside = [rows[i] for i in range(300) if held[i]]
    assert sum(r["score"] for r in outside) > sum(r["base_score"] for r in outside) * 1.1
    assert lm.score_texts(empty_docs, queries.tokenizer_path()).count() == 0
    only = dicts(lm.score_texts(make_docs(["a b"], first=next(i for i in range(100) if held[i] or zlib.crc32(str(i).encode()) % 10 == 0)), queries.tokenizer_path()))
    assert only[0]["held_out"] and only[0]["n_known"] == 0 and only[0]["base_score"] == 0


def test_attention_gradients_and_windows():
    model = lm.Attention()
    rng = np.random.default_rng(1)
    for n in lm.Attention.SHAPES:
        model.w[n] = model.w[n].astype(np.float64)
    x, y, real = rng.integers(0, lm.CLASSES, (2, lm.WINDOW)), rng.integers(0, lm.CLASSES, (2, lm.WINDOW)), rng.random((2, lm.WINDOW)) < 0.8
    places = np.flatnonzero(real)
    loss = lambda: -model.log10(x, y.reshape(-1)[places], places).sum() * math.log(10) / real.sum()
    g = model.gradients(x, y, real)
    for name in ("q", "k", "v", "u", "b", "p"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        model.w[name][at] += 1e-5
        up = loss()
        model.w[name][at] -= 2e-5
        down = loss()
        model.w[name][at] += 1e-5
        assert math.isclose((up - down) / 2e-5, g[name][at], rel_tol=2e-2, abs_tol=1e-6), name
    lengths = np.array([1, 31, 32, 33, 56, 57, 200])
    text, begin, scored = lm.text_windows(lengths)
    for t, n in enumerate(lengths):
        seen = [b + k for b, s in zip(begin[text == t], scored[text == t], strict=True) for k in range(s, lm.WINDOW) if b + k < n]
        assert seen == list(range(n))


def test_attention_is_causal():
    model = lm.Attention()
    x = np.random.default_rng(2).integers(0, lm.CLASSES, (1, lm.WINDOW))
    other = x.copy()
    other[0, 20:] = 5
    assert np.allclose(model.forward(x)[-1][0, :20], model.forward(other)[-1][0, :20])


def plain_lm(texts, trained, pieces, model):
    """Scores by plain loops, in double precision, of texts after counting the trained ones."""
    split = [[w.encode() for w in words(lower(t))] for t in texts]
    train = [w for ws, t in zip(split, trained, strict=True) if t for w in ws]
    first = lambda w, known: max((p for p in known if w.startswith(p)), key=len, default=None)
    found = collections.Counter(first(w, pieces) for w in train)
    chosen = sorted(sorted(pieces, key=lambda p: -found[p])[: lm.CLASSES - 2], key=pieces.index)
    number = {p: k + 2 for k, p in enumerate(chosen)} | {None: 0}
    kind = {w: number[first(w, chosen)] for ws in split for w in ws}
    skip = {w: len(first(w, chosen) or b"") for w in kind}
    counts, sizes = collections.Counter(train), collections.Counter(kind[w] for w in train)
    n, once = len(train) + sum(trained), sum(c == 1 for c in [*counts.values(), sum(trained)])
    new = min(lm.MOST_NEW, max(lm.LEAST_NEW, once / n))

    def steps(w):
        w = w + b" "
        return [((w[i - 2] if i > 1 else 32) & 63, (w[i - 1] if i else 32) & 63, w[i]) for i in range(len(w))]

    triples = collections.Counter(t for w in train for t in steps(w))
    twos, pairs, ones = collections.Counter(), collections.Counter(), collections.Counter()
    for (a, b, c), k in triples.items():
        twos[a, b] += k
        pairs[b, c] += k
        ones[b] += k

    def spelled(w):
        back = lambda b, c: (pairs[b, c] + 1 / 256) / (ones[b] + 1)
        return sum(math.log10((triples[a, b, c] + 2 * back(b, c)) / (twos[a, b] + 2)) for a, b, c in steps(w)[skip[w] :])

    w = {k: v.astype(float) for k, v in model.w.items()}
    out = []
    for ws in split:
        y = [*(kind[x] for x in ws), 1]
        x, score = [1, *y[:-1]], 0.0
        for k in range(len(y)):
            begin = 0 if k < lm.WINDOW else (k - (lm.WINDOW - lm.FRESH)) // lm.FRESH * lm.FRESH
            h = np.array([w["e"][x[i]] + w["p"][i - begin] for i in range(begin, k + 1)])
            a = np.exp((h @ w["k"]) @ (h[-1] @ w["q"]) * lm.WIDTH**-0.5)
            logits = (h[-1] + (a / a.sum()) @ (h @ w["v"])) @ w["u"] + w["b"]
            score += (logits[y[k]] - np.log(np.exp(logits).sum())) / math.log(10)
        for x in ws:
            s, seen = math.log10(new) + spelled(x), (1 - new) * counts[x] / max(1, sizes[kind[x]])
            score += math.log10(seen + 10**s) if seen else s
        out.append(score)
    return out


@pytest.mark.parametrize("top", [5, 200_000])
def test_lm_scores_by_plain_loops(spark, monkeypatch, top):
    """Long unknown and non-ASCII words, null and repeated ids, in any order of rows."""
    rng = random.Random(4)
    vocabulary = ["the", "there", "in", "Inner", "re", "straße", "ωμέγα", "zq", "a", "b", "한국어"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(90))) for _ in range(40)]
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:8]
    free = [i for i in range(300) if zlib.crc32(str(i).encode()) % 10][: len(texts)]
    outside = ["z" * 200, "z" * 600, "z" * 20_000, "the " + "q" * 2_000 + " in", "ж" * 400, "", "the", "the"]
    null_held = zlib.crc32(b"") % 10 == 0
    rows = [*zip(free, texts, strict=True), *zip(held, outside, strict=True), (None, "the in"), (free[0], "there re")]
    trained = [True] * len(texts) + [False] * len(outside) + [not null_held, True]
    model = lm.Attention()
    monkeypatch.setattr(lm, "_fit", lambda *_: model)
    want = plain_lm([t for _, t in rows], trained, lm.pieces_of(queries.tokenizer_path()), model)
    for turned in (False, True):
        docs = spark.createDataFrame(rows[::-1] if turned else rows, "doc_id long, text string")
        got = sorted((str(r["doc_id"]), r["score"]) for r in dicts(lm.score_texts(docs, queries.tokenizer_path(), top=top)))
        expected = sorted((str(i), s) for (i, _), s in zip(rows, want, strict=True))
        assert [i for i, _ in got] == [i for i, _ in expected]
        assert np.allclose([s for _, s in got], [s for _, s in expected], rtol=1e-4, atol=1e-3)
    long = dict(zip(outside, want[len(texts) :], strict=False))
    assert long["z" * 20_000] < 20 * long["z" * 600] < 0


def test_lm_trains_on_every_token_and_end_once(spark):
    texts = ["", "one", " ".join(["the"] * 31), " ".join(["the", "in"] * 16), " ".join(["an", "re", "the"] * 900)]
    pieces = lm.pieces_of(queries.tokenizer_path())
    docs = spark.createDataFrame([(t, 5 << 3) for t in texts], "text string, place long")
    raw = [np.frombuffer(r["data"], np.int16) for r in dicts(lm._gather(docs, pieces).where("kind = 3"))]
    rows = np.stack(raw)
    ends = ((rows == -2)[:, 1:]).sum()
    assert ends == len(texts)
    seen = collections.Counter(rows[lm.predicted(rows) & (np.arange(lm.WINDOW + 1) > 0)].tolist())
    at = {p: i for i, p in enumerate(pieces)}
    assert sum(seen.values()) == sum(len(words(t)) + 1 for t in texts) and seen[at[b"the"]] == 31 + 16 + 900 and seen[at[b"re"]] == 900


def plain_ids(word, pieces):
    """Subword ids of a word by the longest piece at each place; inside words from len(pieces) on."""
    out, at = [], 0
    while at < len(word):
        n = next(n for n in range(lm.MAX_PIECE, 0, -1) if word[at : at + n] in pieces and len(word[at : at + n]) == n)
        out.append(pieces[word[at : at + n]] + (len(pieces) if at else 0))
        at += n
    return out


def test_lm_ids_spell_every_word():
    """All words have ids of their own, of any script and length; no word is cut or shares a class."""
    pieces = lm.pieces_of(queries.tokenizer_path())
    assert len(pieces) == lm.PIECES == len(set(pieces)) and lm.GROUPS * lm.GROUP == lm.CLASSES
    known = {p: k for k, p in enumerate(pieces)}
    text = ["The there inner", "", "straße ωμέγα ЖЩ 한국어\tʼx\x00\x7f \x0b!?  a", "z" * 20_000 + " " + "the" * 700 + "q", " "]
    data = "".join(text).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in text)])
    array = np.frombuffer(data, np.uint8)
    found = lm.Words(array, offsets, True)
    _, first, inverse = np.unique(found.hash, return_index=True, return_inverse=True)
    tokens, lengths = lm.text_ids(found, array, first, inverse, lm.Encoder(pieces))
    want = [[i for w in words(lower(t)) for i in plain_ids(w.encode(), known)] + [-2] for t in text]
    assert tokens.tolist() == [i for ids in want for i in ids] and lengths.tolist() == [len(ids) for ids in want]


def test_lm_chances_add_up_to_one():
    model = lm.Attention()
    x = np.random.default_rng(5).integers(0, lm.CLASSES, (1, lm.WINDOW))
    for place in (0, 15, 16, 100):
        each = model.log10(np.repeat(x, 9, axis=0), np.arange(lm.CLASSES), np.arange(lm.CLASSES) % 9 * lm.WINDOW + place)
        assert math.isclose((10**each).sum(), 1, rel_tol=1e-5)
    model.w["q"] *= 300  # logits beyond what single precision can hold as exponentials
    large = model.log10(x, np.zeros(lm.WINDOW, int), np.arange(lm.WINDOW))
    assert np.isfinite(large).all()


def plain_subword_lm(texts, pieces, model):
    """Scores by plain loops in double precision: every id is predicted from the ids before in its block and the one before."""
    known = {p: k for k, p in enumerate(pieces)}
    w = {k: v.astype(float) for k, v in model.w.items()}
    out = []
    for t in texts:
        y = [i for word in words(lower(t)) for i in plain_ids(word.encode(), known)] + [lm.END]
        x, score = [lm.END, *y[:-1]], 0.0
        for k in range(len(y)):
            window = 0 if k < lm.WINDOW else (k - (lm.WINDOW - lm.FRESH)) // lm.FRESH * lm.FRESH
            begin = max(window, window + ((k - window) // lm.BLOCK - 1) * lm.BLOCK)
            h = w["e"][x[begin : k + 1]]
            a = np.exp((h @ w["k"]) @ (h[-1] @ w["q"]) * lm.WIDTH**-0.5 + w["p"][np.arange(k - begin, -1, -1)])
            made = h[-1] + (a / a.sum()) @ (h @ w["v"])
            group, own = divmod(y[k], lm.GROUP)
            for logits, at in ((made @ w["c"] + w["d"], group), (made @ w["u"][group] + w["b"][group], own)):
                score += (logits[at] - np.log(np.exp(logits).sum())) / math.log(10)
        out.append(score)
    return out


@pytest.mark.parametrize("top", [5, 200_000])
def test_lm_scores_subword_ids_by_plain_loops(spark, monkeypatch, top):
    """Every id of every word is scored by attention: long, unknown and non-ASCII words, null and repeated ids, in any order of rows."""
    rng = random.Random(4)
    vocabulary = ["the", "there", "in", "Inner", "re", "straße", "ωμέγα", "zq", "a", "b", "한국어"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(90))) for _ in range(20)]
    texts += ["z" * 200, "z" * 4_000, "the " + "q" * 700 + " in", "ж" * 40, "щ" * 40, "", None, " the\n", "the", "thex", "they"]
    rows = [*enumerate(texts), (None, "the in"), (3, "there re")]
    model = lm.Attention()
    for name in "pbd":
        model.w[name] = np.random.default_rng(1).standard_normal(model.w[name].shape).astype(np.float32)
    monkeypatch.setattr(lm, "_fit", lambda *_: model)
    want = plain_subword_lm([t or "" for _, t in rows], lm.pieces_of(queries.tokenizer_path()), model)
    expected = sorted((str(i), s) for (i, _), s in zip(rows, want, strict=True))
    for turned in (False, True):
        docs = spark.createDataFrame(rows[::-1] if turned else rows, "doc_id long, text string")
        got = sorted((str(r["doc_id"]), r["score"]) for r in dicts(lm.score_texts(docs, queries.tokenizer_path(), top=top)))
        assert [i for i, _ in got] == [i for i, _ in expected]
        assert np.allclose([s for _, s in got], [s for _, s in expected], rtol=1e-5, atol=1e-4)
    score = dict(zip(texts, want, strict=False))
    assert len({round(score[t], 3) for t in ("ж" * 40, "щ" * 40, "the", "thex", "they")}) == 5


def test_lm_computes_each_block_once(monkeypatch):
    """No empty block of a window is computed, in scoring no block twice but one at each cut; cuts and memory of words change nothing."""
    model, rng, seen = lm.Attention(), np.random.default_rng(8), []
    model.w["p"][:] = rng.standard_normal(2 * lm.BLOCK)
    lengths = np.array([1, 16, 17, 240, 256, 257, 900, 2, 5_000])
    tokens = rng.integers(0, lm.CLASSES - 1, lengths.sum()).astype(np.int16)
    tokens[np.cumsum(lengths) - 1] = -2
    rows = np.concatenate([r for _, r in lm.training_windows(tokens, lengths)])
    whole = [lm.classes_of(rows)[:, :-1], lm.classes_of(rows)[:, 1:], lm.predicted(rows)[:, 1:]]
    at = np.flatnonzero(whole[2])
    want = np.add.reduceat(model.log10(whole[0], whole[1].reshape(-1)[at], at), np.cumsum(lengths) - lengths)
    both = model.gradients(*whole), model.gradients(*lm.stream(rows))
    for name in lm.Attention.SHAPES:
        assert np.allclose(both[0][name], both[1][name], rtol=1e-4, atol=1e-7), name
    attend = lm.Attention.attend
    monkeypatch.setattr(lm.Attention, "attend", lambda self, x, first: seen.append(len(x)) or attend(self, x, first))
    for together in (1, 16):
        seen.clear()
        monkeypatch.setattr(lm, "TOGETHER", together)
        assert np.allclose(lm.attention_scores(model, tokens, lengths), want, rtol=1e-5)
        assert sum(seen) == lm.BLOCK * ((-(-lengths // lm.BLOCK)).sum() + len(seen) - 1)
    assert len(lm.attention_scores(model, tokens[:0], lengths[:0])) == 0
    seen.clear()
    model.gradients(*lm.stream(rows))
    assert sum(seen) == lm.BLOCK * (rows[:, 1 :: lm.BLOCK] > -3).sum() < 0.9 * rows[:, 1:].size


def test_lm_remembers_words(monkeypatch):
    """A word's ids are the same when met first, when known and after words were forgotten."""
    encoder, texts = lm.Encoder(lm.pieces_of(queries.tokenizer_path())), ["the there zq", "", "Zq straße the", "in there " * 9, "the"]
    cut = []
    monkeypatch.setattr(lm.Encoder, "encode", lambda self, data, start, end, old=lm.Encoder.encode: cut.append(len(start)) or old(self, data, start, end))

    def ids(text, known):
        data = np.frombuffer(text.encode(), np.uint8)
        found = lm.Words(data, np.array([0, len(data)]), True)
        return lm.text_ids(found, data, *lm.distinct(found.hash)[1:], known)[0].tolist()

    want = [ids(t, lm.Encoder(lm.pieces_of(queries.tokenizer_path()))) for t in texts]
    cut.clear()
    assert [ids(t, encoder) for t in texts] == want and cut == [3, 1, 1]
    monkeypatch.setattr(lm, "REMEMBERED", 2)
    assert [ids(t, encoder) for t in texts] == want and cut == [3, 1, 1, 3, 3, 2, 1]


def test_lm_training_windows_are_few_rows(spark):
    """A row holds hundreds of ids, so that a task does not sort and send millions of rows."""
    docs = spark.createDataFrame([(" ".join(["the"] * 3_000),), (None,)], "text string")
    windows = lm._gather(docs, lm.pieces_of(queries.tokenizer_path())).where("kind = 3")
    assert windows.count() <= 20
