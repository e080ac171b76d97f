"""License scan by ordered signature rules (operator 13).

A text is lower-cased (A-Z) and cut into words. A rule's pattern is tried only where all of its words occur, which is asked first of its
longest word, so that most texts meet few rules or none. A detection is suppressed if one of a better or equal priority contains it:
by priority first, then the longer, then the earlier rule. The base phrases are found by themselves and never suppressed.

Texts stay where they are: one pass without a shuffle, in runs of whole rows.

Defined results: a null or empty text has no words and no detections (null first_word and last_word, empty labels, score 0). Rows are
judged each by itself, so repeated rows and null ids give rows alike. The score is the confidence of the surest detection that is left.
Other columns of the documents do not pass.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.license_rules import BASE, BASE_CONFIDENCE, Rule, rules
from readloom.llm.shared import slices, text_buffers
from readloom.llm.words import NOT_ALNUM

_SPACED = bytes(32 if NOT_ALNUM[b] else b for b in range(256)).lower()
_PHRASES = [(f" {phrase} ".encode(), phrase, label) for phrase, label in BASE]


def count_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of each text of a buffer."""
    if not len(data):
        return np.zeros(len(offsets) - 1, np.int64)
    outside = NOT_ALNUM[data]
    begins = ~outside
    begins[1:] &= outside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = ~outside[heads]
    return np.diff(np.searchsorted(np.flatnonzero(begins), offsets))


@functools.cache
def _prepared() -> dict[bytes, list[tuple[int, Rule]]]:
    """The rules with their order, by the longest word of each."""
    made: dict[bytes, list[tuple[int, Rule]]] = {}
    for order, rule in enumerate(rules()):
        made.setdefault(max(rule.words, key=lambda w: (len(w), w)), []).append((order, rule))
    return made


def base_places(spaced: bytes) -> list[tuple[int, str]]:
    """First word and label of every place of a base phrase in words joined by one space, with one around them."""
    found = []
    for needle, _, label in _PHRASES:
        counted, place, at = 0, 0, spaced.find(needle)
        while at >= 0:
            counted, place = counted + spaced.count(b" ", place, at), at
            found.append((counted, label))
            at = spaced.find(needle, at + 1)
    return sorted(found)


def detections(spaced: bytes, words: set[bytes]) -> list[tuple[int, int, int, Rule]]:
    """start, end (words), order and rule of every match, before suppression. words: those of the text."""
    by_word, found = _prepared(), []
    for order, rule in (r for w in by_word.keys() & words for r in by_word[w]):
        if rule.words <= words:
            counted = place = 0
            for m in rule.pattern.finditer(spaced):
                counted, place = counted + spaced.count(b" ", place, m.start()), m.start()
                found.append((counted - 1, counted + m[0].count(b" "), order, rule))
    return found


def unsuppressed(found: list[tuple[int, int, int, Rule]]) -> list[tuple[int, int, int, Rule]]:
    """Detections that none of a better or equal priority contains.

    Containment and order are both transitive, so a detection may be dropped for one that is itself dropped; hence one sweep by start
    for each priority is enough."""
    kept = []
    for level in sorted({d[3].priority for d in found}):
        reach = -1
        for d in sorted((d for d in found if d[3].priority <= level), key=lambda d: (d[0], -d[1], d[2])):
            if d[3].priority == level and d[1] > reach:
                kept.append(d)
            reach = max(reach, d[1])
    return sorted(kept, key=lambda d: d[:3])


_FOUND = pa.struct([("label", pa.string()), ("rule", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("confidence", pa.float64())])


def scan_licenses(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_words, base (places: label, start) and found (detections: label, rule, start, stop, confidence; words from 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = {*_prepared(), b"mit", b"apache", b"cc"}
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            counts, base, found = [np.zeros(0, np.int64)], [], []
            for lo, hi in slices(offsets, 1 << 22):
                counts.append(count_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
                for i in range(lo, hi):
                    listed = data[offsets[i] : offsets[i + 1]].tobytes().translate(_SPACED).split()
                    words = set(listed)
                    if words.isdisjoint(some):
                        base.append([])
                        found.append([])
                        continue
                    spaced = b" ".join([b"", *listed, b""])
                    base.append([{"label": label, "start": at} for at, label in base_places(spaced)])
                    found.append([{"label": r.label, "rule": r.name, "start": a, "stop": b, "confidence": r.confidence} for a, b, _, r in unsuppressed(detections(spaced, words))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(counts), pa.int64()), pa.array(base, pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))), pa.array(found, pa.list_(_FOUND))],
                ["doc_id", "n_words", "base", "found"],
            )

    given = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, n_words long, base array<struct<label: string, start: long>>, found array<struct<label: string, rule: string, start: long, stop: long, confidence: double>>")


def license_digest(docs: DataFrame, **options) -> DataFrame:
    """One row a document: counts, places and labels of the base and of all detections, and the score."""
    scanned = scan_licenses(docs, **options)
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    sure = F.transform("found", lambda d: d["confidence"])
    own = F.when(F.size("base") > 0, F.lit(BASE_CONFIDENCE)).otherwise(0.0)
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.start").alias("first_word"), F.array_max("base.start").alias("last_word"),
        joined("base.label").alias("base_labels"), joined(F.concat("base.label", "found.label")).alias("labels"), F.greatest(F.coalesce(F.array_max(sure), F.lit(0.0)), own).alias("score"), F.size("found").cast("long").alias("n_found"),
    )
