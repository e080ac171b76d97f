"""Ranked lexical search by pair-bound MaxScore (operator 12).

One pass over the documents makes an inverted index of the terms that the items ask for, in blocks of BLOCK documents: documents with
their lengths, and for each term its documents and counts. Blocks stay in the task that made them; only sums leave (how many documents
and terms there are, and how many documents hold each term).

With these sums the impact of every posting is known. For each block then, and for pairs of each item's PAIRED weightiest terms, the
intersection list of a pair's documents is made, with the largest joint impact. A document scores at most the sum over units (pairs,
matched by what they save, and single terms): a pair not held jointly gives its larger term's maximum, a joint one its own joint
maximum. Against the score of the k-th best document so far this skips blocks and documents: if a bound without joint pairs is too low, only
documents of intersection lists are opened; else units of small bounds are left out of the search for candidates (MaxScore), and looked up
for those that are still open. All of this is integer arithmetic, so that the result is exactly that of scoring all documents.

A task keeps k results an item and gives them when it ends; they are reduced by salted groups first, then by item. Items are asked in
groups of ITEMS, each of which reads the documents once, so what the driver and the closures hold is bounded by ITEMS.

Defined results: a null text has no terms, and an item without terms no rows. Documents with a null id count and rank like others, after
others of equal score; repeated rows are documents each. Equal rows of items ask once; of different texts under one item_id the
smallest asks. Without documents there are no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from readloom.llm.shared import slices, stored, text_buffers
from readloom.llm.words import NOT_ALNUM, Words

BLOCK, PAIRED, ITEMS, SALTS = 4096, 8, 2_000, 64
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
_LAST = np.iinfo(np.int64).max


def terms_of(text: str | None) -> list[str]:
    return _TERM.findall((text or "").translate(_LOWER))


class Vocabulary:
    """The terms that are asked for, recognised in the bytes of texts by hash and then by their bytes."""

    def __init__(self, terms: list[str]):
        self.terms, raw = terms, [t.encode() for t in terms]
        data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        hashes = Words(data, ends, True, NOT_ALNUM).hash
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        if len(hashes) > 1 and (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two terms share a hash")
        self.data, self.start, self.size = data, ends[:-1], np.diff(ends)

    def find(self, data: np.ndarray, words: Words) -> np.ndarray:
        """The number of each word's term, or -1."""
        at = np.minimum(np.searchsorted(self.hashes, words.hash), len(self.hashes) - 1)
        found = np.where(self.hashes[at] == words.hash, self.order[at], -1)
        hit = np.flatnonzero(found >= 0)
        size = words.end[hit] - words.start[hit]
        same = size == self.size[found[hit]]
        for n in np.unique(size[same]):
            k = np.flatnonzero(same & (size == n))
            for lo in range(0, len(k), 1 << 16):
                part = hit[k[lo : lo + (1 << 16)]]
                inside = np.arange(n)
                text = data[words.start[part][:, None] + inside]
                text = np.where((text >= 65) & (text <= 90), text + 32, text)
                same[k[lo : lo + (1 << 16)]] = (text == self.data[self.start[found[part]][:, None] + inside]).all(axis=1)
        found[hit[~same]] = -1
        return found


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _index(docs: DataFrame, vocabulary: Vocabulary, id_column: str, text: str) -> DataFrame:
    """Blocks of documents: ids, whether an id is there, terms in each, and postings by term (document of the block, count)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most the terms of ITEMS items
    n = len(vocabulary.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def block() -> pa.RecordBatch:
            ids, known, sizes, keys, counts = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(keys, kind="stable")  # by term, then by document of the block
            term, doc = np.divmod(keys[order], BLOCK)
            listed, first = np.unique(term, return_index=True)
            parts = [ids, known.astype(np.int8), sizes, listed.astype(np.int32), np.append(first, len(term)).astype(np.int32), doc.astype(np.int16), counts[order].astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], ["ids", "known", "sizes", "terms", "first", "docs", "counts"])

        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            column = batch.column("doc_id")
            known, ids = ~np.asarray(column.is_null()), column.fill_null(_LAST).to_numpy()
            for lo, hi in ((a, min(a + BLOCK, e)) for s, e in slices(offsets, 1 << 20) for a in range(s, e, BLOCK)):
                if count + hi - lo > BLOCK:
                    yield block()
                    held, count = [], 0
                part = data[offsets[lo] : offsets[hi]]
                words = Words(part, offsets[lo : hi + 1] - offsets[lo], True, NOT_ALNUM)
                found = shared.value.find(part, words) if n else np.full(len(words.start), -1)
                text_of = np.repeat(np.arange(count, count + hi - lo), words.counts)
                keys, counts = np.unique(found[found >= 0] * BLOCK + text_of[found >= 0], return_counts=True)
                held.append((ids[lo:hi], known[lo:hi], words.counts.astype(np.int64), keys.astype(np.int64), counts))
                count += hi - lo
        if held:
            yield block()

    given = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return stored(given.mapInArrow(run, "ids binary, known binary, sizes binary, terms binary, first binary, docs binary, counts binary"), "lexical-index")


def _numbers(batch: pa.RecordBatch, name: str, row: int, kind) -> np.ndarray:
    return np.frombuffer(batch.column(name)[row].as_buffer(), kind)


def _sums(index: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and documents of each asked term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms + 2, np.int64)
        for batch in batches:
            for row in range(len(batch)):
                sizes = _numbers(batch, "sizes", row, np.int64)
                total[_numbers(batch, "terms", row, np.int32) + 2] += np.diff(_numbers(batch, "first", row, np.int32))
                total[:2] += ((sizes > 0).sum(), sizes.sum())
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met])], ["place", "part"])

    parts = index.select("sizes", "terms", "first").mapInArrow(run, "place long, part long")
    total = np.zeros(n_terms + 2, np.int64)
    for r in parts.groupBy("place").agg(F.sum("part").alias("total")).collect():  # a row for each asked term
        total[r["place"]] = r["total"]
    return int(total[0]), int(total[1]), total[2:]


class Block:
    """Postings of one block with their impacts and the largest of each term, and intersection lists of pairs."""

    def __init__(self, terms: np.ndarray, first: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n: int):
        self.n, self.first, self.docs, self.impacts = n, first, docs, impacts
        self.place = dict(zip(terms.tolist(), range(len(terms)), strict=True))
        self.most = np.maximum.reduceat(impacts, first[:-1]) if len(terms) else np.zeros(0, np.int64)
        self.pairs: dict[tuple[int, int], tuple[np.ndarray, int]] = {}

    def postings(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        return self.docs[self.first[at] : self.first[at + 1]], self.impacts[self.first[at] : self.first[at + 1]]

    def join(self, wanted: list[tuple[int, int]]) -> None:
        """Make the intersection list of each wanted pair of terms: documents that hold both, and the largest joint impact."""
        by_longer: dict[int, list[tuple[int, tuple[int, int]]]] = {}
        for a, b in wanted:
            if a in self.place and b in self.place:
                short, long = sorted((self.place[a], self.place[b]), key=lambda k: self.first[k + 1] - self.first[k])
                by_longer.setdefault(long, []).append((short, (a, b)))
        dense = np.zeros(self.n, np.int64)
        for long, shorter in by_longer.items():
            other, more = self.postings(long)
            dense[other] = more
            for short, pair in shorter:
                docs, impacts = self.postings(short)
                met = dense[docs]
                both = np.flatnonzero(met)
                self.pairs[pair] = docs[both], int((impacts[both] + met[both]).max(initial=0))
            dense[other] = 0


class Unit:
    """A term, or a pair of terms with its intersection list: the bound of a document that holds it not jointly, and jointly."""

    __slots__ = ("apart", "joint", "listed", "places", "times")

    def __init__(self, places: list[int], times: list[int], apart: int, joint: int, listed: np.ndarray | None):
        self.places, self.times, self.apart, self.joint, self.listed = places, times, apart, joint, listed


def units(block: Block, item: dict[int, int], pairs: list[tuple[int, int]]) -> list[Unit]:
    """Disjoint units of an item's terms in a block; pairs are matched in order of what their bounds save."""
    here = {t: (block.place[t], c) for t, c in item.items() if t in block.place}
    bound = {t: int(block.most[p]) * c for t, (p, c) in here.items()}
    saved = []
    for a, b in pairs:
        if a in here and b in here:
            listed, joint = block.pairs[a, b]
            # A joint maximum is of single occurrences; terms that the item repeats are bounded by the larger count.
            joint *= max(here[a][1], here[b][1])
            apart = max(bound[a], bound[b])
            joint = max(apart, min(joint, bound[a] + bound[b])) if len(listed) else apart
            saved.append((bound[a] + bound[b] - joint, a, b, apart, joint, listed))
    made, used = [], set()
    for gain, a, b, apart, joint, listed in sorted(saved, key=lambda s: (-s[0], s[1], s[2])):
        if gain > 0 and a not in used and b not in used:
            used |= {a, b}
            made.append(Unit([here[a][0], here[b][0]], [here[a][1], here[b][1]], apart, joint, listed))
    made += [Unit([p], [c], bound[t], bound[t], None) for t, (p, c) in here.items() if t not in used]
    return sorted(made, key=lambda u: u.joint)


def best_of(block: Block, parts: list[Unit], floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the block and their exact scores: at least all those that score `floor` or more, and above 0."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    floor = max(floor, 1)
    if sum(u.joint for u in parts) < floor:
        return none
    apart = sum(u.apart for u in parts)
    bound = None
    if any(u.joint > u.apart for u in parts):
        bound = np.full(block.n, apart, np.int64)
        for u in parts:
            if u.listed is not None and u.joint > u.apart:
                bound[u.listed] += u.joint - u.apart
        if apart < floor:  # only documents of intersection lists can reach it
            open_docs = np.flatnonzero(bound >= floor)
            return _scores(block, parts, open_docs, np.zeros(len(open_docs), np.int64), floor)
    elif apart < floor:
        return none
    left, cut = 0, 0
    while cut < len(parts) and left + parts[cut].joint < floor:
        left += parts[cut].joint
        cut += 1
    total = np.zeros(block.n, np.int64)
    for u in parts[cut:]:
        for place, times in zip(u.places, u.times, strict=True):
            docs, impacts = block.postings(place)
            total[docs] += impacts * times
    possible = total + left >= floor
    if bound is not None:
        possible &= bound >= floor
    open_docs = np.flatnonzero(possible & (total > 0))
    return _scores(block, parts[:cut], open_docs, total[open_docs], floor)


def _scores(block: Block, parts: list[Unit], docs: np.ndarray, total: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Add the parts, largest bound first, to the documents that may still reach the floor."""
    rest = sum(u.joint for u in parts)
    for u in reversed(parts):
        keep = total + rest >= floor
        docs, total = docs[keep], total[keep]
        if not len(docs):
            break
        rest -= u.joint
        for place, times in zip(u.places, u.times, strict=True):
            held, impacts = block.postings(place)
            at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
            total = total + np.where(held[at] == docs, impacts[at] * times, 0)
    keep = total >= floor
    return docs[keep], total[keep]


def _search(index: DataFrame, items: list[dict[int, int]], documents: int, terms: int, weights: np.ndarray, k: int) -> DataFrame:
    """item (its number), doc_id, score of the best k documents of each task."""
    heavy = [sorted(item, key=lambda t: (-weights[t] * item[t], t))[:PAIRED] for item in items]
    pairs = [[(min(a, b), max(a, b)) for a, b in combinations(h, 2)] for h in heavy]
    wanted = sorted({p for listed in pairs for p in listed})
    shared = index.sparkSession.sparkContext.broadcast((items, pairs, wanted, weights))  # bounded by ITEMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, pairs, wanted, weights = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)) for _ in items]  # scores, ids, whether there is an id
        floors = [0] * len(items)
        for batch in batches:
            for row in range(len(batch)):
                get = lambda c, t: _numbers(batch, c, row, t)  # noqa: B023, E731
                ids, known, sizes, listed, first, docs, counts = get("ids", np.int64), get("known", np.int8), get("sizes", np.int64), get("terms", np.int32), get("first", np.int32), get("docs", np.int16).astype(np.int64), get("counts", np.int32).astype(np.int64)
                m = 100 - 25 + (25 * sizes * documents) // max(terms, 1)
                impacts = np.repeat(weights[listed], np.diff(first)) * ((1_000_000_000 * counts) // (1000 * counts + 12 * m[docs]))
                block = Block(listed, first, docs, impacts, len(ids))
                block.join(wanted)
                for i, item in enumerate(items):
                    found, scores = best_of(block, units(block, item, pairs[i]), floors[i])
                    if len(found):
                        scores, held, there = (np.concatenate(x) for x in zip(best[i], (scores, ids[found], known[found]), strict=True))
                        order = np.lexsort((held, -there, -scores))[:k]
                        best[i] = scores[order], held[order], there[order]
                        floors[i] = int(scores[order[-1]]) if len(order) == k else 0
        item = np.repeat(np.arange(len(items)), [len(b[0]) for b in best])
        scores, held, there = (np.concatenate(x) for x in zip(*best, strict=True)) if best else (np.zeros(0, np.int64),) * 3
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(held, pa.int64(), mask=there == 0), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    return index.mapInArrow(run, "item long, doc_id long, score long")


def ranked(docs: DataFrame, benchmark: DataFrame, k: int = 20, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    asked = benchmark.select(F.col(f"`{item_column}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text")).groupBy("item_id").agg(F.min("text").alias("text"))
    groups = -(-asked.count() // ITEMS)
    result = None
    for g in range(groups):
        rows: list[Row] = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).orderBy("item_id").collect()  # about ITEMS rows
        held = [Counter(terms_of(r["text"])) for r in rows]
        vocabulary = Vocabulary(sorted({t for c in held for t in c}))
        number = {t: i for i, t in enumerate(vocabulary.terms)}
        index = _index(docs, vocabulary, id_column, text)
        documents, terms, holding = _sums(index, len(number))
        weights = np.array([weight(documents, int(h)) for h in holding], np.int64)
        found = _search(index, [{number[t]: c for t, c in held_by.items()} for held_by in held], documents, terms, weights, k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item long, item_id long")
        # A task has k rows an item; salted groups come first, so that no task gets one item's rows of all tasks.
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
        top = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        named = top.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        result = named if result is None else result.union(named)
    return result if result is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
