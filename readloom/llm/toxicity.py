"""Toxicity by a chain of classifiers (operator 9).

The chain predicts categories in order; each link is a linear model over word and word-stem presence plus the
probabilities of the links before it. In training those come out of fold: a document's earlier probability is
predicted by models that have not seen it. The chain is fitted in one task on at most `max_rows` labelled documents, drawn
by the smallest hashes of their ids (a documented bound); every document is scored, whole, by an Arrow function of its text with
the broadcast weights (at most `max_features` a link), so that other columns stay where they are.

Defined results: a null or empty text scores as a text without features. Unlabelled, null-labelled or text-less
rows don't train. Without training rows of both classes a link gives its prior (0 without rows). Of repeated
labels of a document the largest value counts; of repeated documents of one id the text with the least hash trains, and each row
is scored. Ties in feature selection go to the smaller hash. A column of docs that is named like a result is replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm.shared import slices, text_buffers
from readloom.llm.words import Words, mix

MAX_ROWS, MAX_FEATURES, MIN_DOCS, FOLDS, STEM = 5_000, 2_000, 5, 5, 5
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased words (outer punctuation cut) and of their first STEM bytes, with the text of each."""
    words = Words(data, offsets, lower=True)
    place, letter = np.arange(len(data)), _LETTER[data]
    # The next letter from each byte on, and the last one up to it.
    after = np.minimum.accumulate(np.where(letter, place, len(data))[::-1])[::-1]
    before = np.maximum.accumulate(np.where(letter, place, -1))
    start, end = after[words.start], before[words.end - 1] + 1
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    keep = end > start
    start, end, text = start[keep], end[keep], text[keep]
    whole = words.spans(start, end)
    long = end - start > STEM
    stem = mix(words.spans(start[long], start[long] + STEM) ^ np.uint64(0x5851F42D4C957F2D))
    return np.concatenate([whole, stem]), np.concatenate([text, text[long]])


def _present(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Distinct features of each text."""
    hashes, text = _features(data, offsets)
    order = np.argsort(text, kind="stable")
    return [np.unique(x) for x in np.split(hashes[order], np.cumsum(np.bincount(text, minlength=len(offsets) - 1))[:-1])]


class Link:
    """A logistic model over selected features (sorted hashes) and earlier probabilities."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, earlier: np.ndarray, bias: float):
        self.features, self.weights, self.earlier, self.bias = features, weights, earlier, bias

    def predict(self, n: int, hashes: np.ndarray, row: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """Probabilities of n rows; hashes may repeat within a row and count once."""
        score = np.full(n, self.bias) + earlier @ self.earlier
        if len(self.features) and len(hashes):
            at = np.minimum(np.searchsorted(self.features, hashes), len(self.features) - 1)
            hit = self.features[at] == hashes
            pairs = np.unique(row[hit] * len(self.features) + at[hit])
            np.add.at(score, pairs // len(self.features), self.weights[pairs % len(self.features)])
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def _fit(hashes: np.ndarray, row: np.ndarray, target: np.ndarray, earlier: np.ndarray, max_features: int) -> Link:
    n, positives = len(target), int(target.sum())
    none = np.zeros(earlier.shape[1])
    if not 0 < positives < n:
        prior = np.clip(positives / n if n else 0.0, 1e-9, 1 - 1e-9)
        return Link(np.zeros(0, np.uint64), np.zeros(0), none, float(np.log(prior / (1 - prior))))
    known, at = np.unique(hashes, return_inverse=True)
    docs = np.bincount(at, minlength=len(known))
    toxic = np.bincount(at, weights=target[row], minlength=len(known))
    share = docs / n
    z = (toxic / positives - (docs - toxic) / (n - positives)) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / positives + 1 / (n - positives)))
    z[docs < MIN_DOCS] = 0
    chosen = np.sort(np.lexsort((known, -np.abs(z)))[:max_features])
    chosen = chosen[np.abs(z[chosen]) > 2]
    place = np.full(len(known), -1)
    place[chosen] = np.arange(len(chosen))
    column = place[at]
    row, column = row[column >= 0], column[column >= 0]
    m = len(chosen)
    theta = np.zeros(m + earlier.shape[1] + 1)
    theta[-1] = np.log(positives / (n - positives))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    ridge = np.full(len(theta), 1e-4)
    ridge[-1] = 0
    for step in range(1, 201):
        score = theta[-1] + earlier @ theta[m:-1] + np.bincount(row, weights=theta[:m][column], minlength=n)
        error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - target) / n
        gradient = np.concatenate([np.bincount(column, weights=error[row], minlength=m), earlier.T @ error, [error.sum()]]) + ridge * theta
        first += 0.1 * (gradient - first)
        second += 0.01 * (gradient**2 - second)
        theta -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Link(known[chosen], theta[:m], theta[m:-1], float(theta[-1]))


def fit_chain(ids: np.ndarray, present: list[np.ndarray], targets: np.ndarray, max_features: int = MAX_FEATURES, folds: int = FOLDS) -> list[Link]:
    """Links in the order of targets' columns, fitted on rows sorted by id so that row order doesn't matter."""
    order = np.argsort(ids, kind="stable")
    present, targets = [present[i] for i in order], targets[order]
    sizes = np.array([len(p) for p in present], np.int64)
    hashes = np.concatenate([*present, np.zeros(0, np.uint64)])
    row = np.repeat(np.arange(len(present)), sizes)
    fold = (mix(ids[order].astype(np.uint64) + np.uint64(77)) % np.uint64(folds)).astype(np.int64)
    links, outside = [], np.zeros((len(present), 0))
    for k in range(targets.shape[1]):
        links.append(_fit(hashes, row, targets[:, k], outside, max_features))
        if k + 1 == targets.shape[1]:
            break
        held = np.zeros(len(present))
        for f in range(folds):
            out = fold == f
            number = np.cumsum(~out) - 1
            train = ~out[row]
            part = _fit(hashes[train], number[row[train]], targets[~out, k], outside[~out], max_features)
            held[out] = part.predict(len(present), hashes[~train], row[~train], outside)[out]
        outside = np.column_stack([outside, held])
    return links


def training_rows(docs: DataFrame, labels: DataFrame, categories: dict[str, str], max_rows: int) -> DataFrame:
    """doc_id, text and categories of at most max_rows labelled documents."""
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.expr(e).cast("int").alias(c) for c, e in categories.items())).na.drop()
    given = given.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in categories))
    sample = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # max_rows bounds what is broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    # One text for each id, so that max_rows bounds what trains.
    return texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), *(F.first(c).alias(c) for c in categories))


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], max_rows: int = MAX_ROWS) -> list[Link]:
    """Fit the chain. categories: name -> SQL expression over labels that is 1 or 0 (null: the row doesn't train)."""
    rows = training_rows(docs, labels, categories, max_rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            found = [p.view(np.int64) for lo, hi in slices(offsets, 1 << 20) for p in _present(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c) for c in categories), pa.array(found, pa.list_(pa.int64()))], ["doc_id", *categories, "features"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, present, targets = [np.zeros(0, np.int64)], [], [np.zeros((0, len(categories)))]
        for batch in batches:
            ids.append(batch.column("doc_id").to_numpy())
            targets.append(np.column_stack([batch.column(c).to_numpy() for c in categories]).astype(float))
            present += [x.values.to_numpy().view(np.uint64) for x in batch.column("features")]
        chain = fit_chain(np.concatenate(ids), present, np.concatenate(targets))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(chain)], pa.binary())], ["chain"])

    schema = "doc_id long, " + "".join(f"{c} int, " for c in categories) + "features array<long>"
    made = rows.select("doc_id", *categories, "text").mapInArrow(features, schema).coalesce(1).mapInArrow(fit, "chain binary").first()
    return pickle.loads(made["chain"]) if made else fit_chain(np.zeros(0, np.int64), [], np.zeros((0, len(categories))))


def probabilities(text: Column, chain: list[Link], names: list[str]) -> Column:
    """A struct with a probability for each name."""
    links = SparkSession.active().sparkContext.broadcast(chain)
    returned = T.StructType([T.StructField(c, T.DoubleType()) for c in names])

    @F.arrow_udf(returned)
    def judge(texts: pa.Array) -> pa.Array:
        data, offsets = text_buffers(texts)
        made = [np.zeros((0, len(names)))]
        for lo, hi in slices(offsets, 1 << 20):
            hashes, row = _features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            earlier = np.zeros((hi - lo, 0))
            for link in links.value:
                earlier = np.column_stack([earlier, link.predict(hi - lo, hashes, row, earlier)])
            made.append(earlier)
        columns = np.concatenate(made)
        return pa.StructArray.from_arrays([pa.array(columns[:, k]) for k in range(len(names))], names)

    return judge(text.cast("string"))


#: The categories that the label table offers, in chain order.
CATEGORIES = {"p_poor": "1 - quality", "p_toxic": "toxic"}


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_rows: int = MAX_ROWS) -> DataFrame:
    """docs (with a text column) plus p_poor, p_toxic and the decision is_toxic (p_toxic >= threshold)."""
    judged = probabilities(F.col("text"), train(docs, labels, CATEGORIES, max_rows), list(CATEGORIES))
    results = [*CATEGORIES, "is_toxic"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in results]
    rows = docs.select(F.struct(*kept).alias("whole"), judged.alias("p"))
    return rows.select("whole.*", "p.*", (F.col("p.p_toxic") >= threshold).alias("is_toxic"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of docs that are not toxic, with all their columns as they are."""
    judged = probabilities(F.col("text"), train(docs, labels, CATEGORIES, max_rows), list(CATEGORIES))
    return docs.where(judged["p_toxic"] < threshold)
