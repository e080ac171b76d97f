"""Centroid clustering, ranked lexical search and license scans against brute force, and on edge cases."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import centroids, lexical, license_rules, licenses
from tests.llm.conftest import EDGE


def dicts(df):
    return [r.asDict() for r in df.collect()]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


# 11


def brute_clusters(rows, d=64, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centers = [v for _, v in named[:k]]
    if not centers:
        return []

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centers))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centers = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centers)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = Counter()
    for _, n, far in found:
        total[n] += far
    return sorted(((i, n, far, total[n], sum(total.values()), hashlib.sha256(",".join(map(str, centers[n])).encode()).hexdigest()) for i, n, far in found), key=repr)


VECTORS = "vec_id long, embedding array<float>, cluster string, v int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS)


def ours(df):
    return sorted(map(tuple, centroids.cluster_digest(df).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(9, 64))
    rows = [(i, (centers[i % 9] * (i % 2) + rng.normal(size=64)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(None, rows[0][1]), (5, rows[7][1]), (5, rows[5][1]), (900, None), (901, [1.0]), (902, [float("nan")] * 64), (903, [float("inf")] + [0.0] * 63), (904, [None] * 64), (905, [0.0] * 64), (906, [0.0] * 64)]
    assert ours(vectors(spark, rows)) == brute_clusters(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, [1.0] * 64)], [(1, [0.5] * 64)], [(i, [0.25] * 64) for i in range(40)], [(i, [float(i % 3)] + [0.0] * 63) for i in range(40)]])
def test_few_and_equal_vectors(spark, rows):
    assert ours(vectors(spark, rows)) == brute_clusters(rows)


def test_a_component_too_large_is_refused(spark):
    with pytest.raises(Exception, match="too large"):
        centroids.cluster_digest(vectors(spark, [(1, [1e30] * 64)])).collect()


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(5)
    points = rng.integers(-200, 200, (16, 64))
    simplex = centroids.Simplex(points, 16)
    some = rng.integers(-200, 200, (400, 64))
    means = some.reshape(16, 25, 64).sum(axis=1) // 25
    a, b = simplex.apices(some), simplex.apices(means)
    far = np.sqrt(centroids.squared(some, means))
    flat = ((a[:, None, :-1] - b[None, :, :-1]) ** 2).sum(axis=2)
    assert (np.sqrt(flat + (a[:, -1:] - b[:, -1]) ** 2) <= far + 1e-6).all() and (np.sqrt(flat + (a[:, -1:] + b[:, -1]) ** 2) >= far - 1e-6).all()
    tight = np.vstack([rng.integers(-5, 5, (400, 64)) + np.repeat(points, 25, axis=0)])
    assert centroids.open_pairs(simplex.apices(tight), b * 0 + simplex.apices(points)).mean() < 0.1
    nearest, exact = centroids.assign(some, a, means, simplex)
    assert (exact == centroids.squared(some, means).min(axis=1)).all() and (nearest == centroids.squared(some, means).argmin(axis=1)).all()


# 12


def brute_ranks(docs, items, k=20):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n, length = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    first = {}
    for item, text in items:
        if text is not None and (item not in first or text.encode() < first[item].encode()):
            first[item] = text
    out = []
    for item, text in first.items():
        scored = []
        for i, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n) // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def corpus(n, seed, vocabulary=60):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["Straße", "ΑΣ", "İx", "été", "42"]
    share = 1 / np.arange(1, len(words) + 1)
    return [" ".join(rng.choice(words, rng.integers(0, 60), p=share / share.sum())) for _ in range(n)]


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_ranks_equal_brute_force(spark, make_docs, monkeypatch, block):
    monkeypatch.setattr(lexical, "BLOCK", block)
    texts = corpus(260, 1) + ["W0 w1, w2! w50"] * 30 + EDGE
    items = [(i, t) for i, t in enumerate(corpus(12, 2))] + [(20, None), (21, "..."), (22, "nowhere"), (1, "w1 w1 w1"), (None, "w3 w40 W3"), (23, "w0 w0 w0 w1 w59")]
    given = make_docs(texts).union(make_docs(texts[:3]).withColumn("doc_id", F.lit(None).cast("long"))).repartition(5)
    benchmark = spark.createDataFrame(items + items[:4], "item_id long, text string").withColumns({"rank": F.lit(1), "doc_id": F.lit(2), "score": F.lit("s")})
    got = sorted(map(tuple, lexical.ranked(given, benchmark).collect()), key=repr)
    assert got == brute_ranks([*enumerate(texts), *((None, t) for t in texts[:3])], items)


def test_ranks_in_groups_of_items(spark, make_docs, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 3)
    texts, items = corpus(120, 4), list(enumerate(corpus(10, 5)))
    assert sorted(map(tuple, lexical.ranked(make_docs(texts), spark.createDataFrame(items, "item_id long, text string")).collect()), key=repr) == brute_ranks(list(enumerate(texts)), items)


def test_ranks_of_nothing(spark, make_docs, empty_docs):
    asked, none = spark.createDataFrame([(1, "a")], "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert lexical.ranked(empty_docs, asked).collect() == [] and lexical.ranked(make_docs(["a"]), none).collect() == [] and lexical.ranked(make_docs([None, ""]), asked).collect() == []


def test_pair_bounds_hold_and_skip():
    rng = np.random.default_rng(8)
    n, listed = 500, np.arange(12)
    docs = [np.sort(rng.choice(n, rng.integers(3, 60), replace=False)) for _ in listed]
    first = np.cumsum([0, *map(len, docs)])
    block = lexical.Block(listed, first, np.concatenate(docs), rng.integers(1, 1000, first[-1]), n)
    pairs = [(a, b) for a in range(8) for b in range(a + 1, 8)]
    block.join(pairs)
    item = {int(t): 1 + t % 2 for t in listed}
    exact = np.zeros(n, np.int64)
    for t in listed:
        exact[docs[t]] += block.postings(t)[1] * item[t]
    plain = sum(int(block.most[t]) * item[t] for t in listed)
    parts = lexical.units(block, item, pairs)
    assert exact.max() <= sum(u.joint for u in parts) < plain
    for floor in (1, int(np.sort(exact)[-20]), int(exact.max()), int(exact.max()) + 1):
        found, scores = lexical.best_of(block, parts, floor)
        assert sorted(found) == np.flatnonzero(exact >= floor).tolist() and (exact[found] == scores).all()


# 13


def brute_base(text):
    words = terms(text)
    return sorted((i, label) for phrase, label in license_rules.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())


LICENSE_TEXTS = [
    "Licensed under CC BY-NC 4.0.", "Under the MIT License; under the mit\nlicense UNDER THE MIT LICENSE", "Apache License, Version 2.0 and CC-BY-NC", "a permit licensed to omit", "the apache license version 22",
    "under theİ mit license", "SPDX-License-Identifier: GPL-2.0-or-later", "http://www.apache.org/licenses/LICENSE-2.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Released under the GNU Lesser General Public License v2.1 or the MIT License",
    "word " * 3000 + "This is free and unencumbered software released into the public domain", "under the mit license " * 500,
]


def test_licenses_equal_brute_force(spark, make_docs):
    texts = LICENSE_TEXTS + EDGE
    given = make_docs(texts).union(make_docs(texts[:2]).withColumn("doc_id", F.lit(None).cast("long"))).repartition(3).withColumns({"labels": F.lit(1), "found": F.lit(2)})
    got = {r["doc_id"]: r for r in dicts(licenses.license_digest(given)) if r["doc_id"] is not None}
    assert len(got) == len(texts)
    every = license_rules.rules()
    for i, text in enumerate(texts):
        base, row = brute_base(text), got[i]
        assert (row["n_words"], row["n_base"]) == (len(terms(text)), len(base))
        assert (row["first_word"], row["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert row["base_labels"] == ",".join(sorted({label for _, label in base}))
        # Every rule tried on every text, every pair compared.
        spaced = (" " + " ".join(terms(text)) + " ").encode()
        found = [(spaced.count(b" ", 0, m.start()) - 1, spaced.count(b" ", 0, m.end()), order, r) for order, r in enumerate(every) for m in r.pattern.finditer(spaced)] if len(spaced) < 20_000 else None
        if found is not None:
            better = lambda e, d: e[3].priority <= d[3].priority and e[0] <= d[0] and d[1] <= e[1] and (e[3].priority, e[0] - e[1], e[2]) < (d[3].priority, d[0] - d[1], d[2])
            kept = [d for d in found if not any(better(e, d) for e in found)]
            assert row["n_found"] == len(kept) and row["labels"] == ",".join(sorted({d[3].label for d in kept} | {label for _, label in base}))
            assert row["score"] == max([0.0, *(d[3].confidence for d in kept), *([license_rules.BASE_CONFIDENCE] if base else [])])


def test_license_rules_and_suppression(spark, make_docs):
    assert len(license_rules.rules()) > 300 and all(r.words for r in license_rules.rules())
    rows = dicts(licenses.license_digest(make_docs(LICENSE_TEXTS)))
    labels = {r["doc_id"]: r["labels"] for r in rows}
    assert [labels[i] for i in (0, 1, 2, 3, 6, 7, 8)] == ["cc-by-nc", "mit", "apache-2,cc-by-nc", "", "gpl-2-or-later", "apache-2", "mit"]
    assert labels[9] == "lgpl-2.1,mit" and "unlicense" in labels[10]
    # A name inside a notice is suppressed by it, and a general sentence by a longer one.
    found = licenses.scan_licenses(make_docs(["Licensed under the Apache License, Version 2.0."])).first()["found"]
    assert [(d["label"], d["start"], d["stop"], d["confidence"]) for d in found] == [("apache-2", 0, 8, 0.95)]


def test_licenses_of_nothing(empty_docs):
    assert licenses.license_digest(empty_docs).collect() == []
