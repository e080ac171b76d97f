"""Language-model scoring by a small causal self-attention model on subword ids (operator 10).

A text is the subword ids of its lower-cased words and one end. A word's ids are its pieces, each the longest one of a
public vocabulary that fits; every single byte is a piece, so that any word of any script is its ids and no more. Pieces that begin a
word and pieces inside one have ids of their own, so ids tell words apart. The model is
    P(text) = product over ids of P(id | ids before, by attention),
where an id is predicted as its group of ids, then as one of the group.
1. One pass over the training texts counts words and ids (all texts, all words), and emits overlapping windows of ids, in which
   every id and every end is predicted once, from the same ids before as in scoring.
2. The attention model is trained in numpy by local steps in every partition of windows; after each round Spark
   averages the partitions' weights. Every window is trained on in one of the rounds.
3. A second pass scores each text whole, as blocks in a row: batched masked attention, each id scored once.
   For the base score, the counts of the TOP most common words are broadcast (a fixed bound); all other words are joined by hash.

Attention goes by blocks: an id sees the BLOCK ids of the block before and those up to itself in its own, at learned distances.

Defined results: a null or empty text is one end token. A null id's remainder is that of crc32(''). Without training texts no
word is known, N and V are 0 and the base probability of each token is 1. Words are known by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.bpe import load_tokenizer
from readloom.llm.shared import slices, stored, text_buffers
from readloom.llm.words import Words

#: Pieces (256 of them single bytes) and their bytes at most; ids are those that begin a word, those inside one, and the end.
PIECES, MAX_PIECE = 1012, 6
CLASSES = 2 * PIECES + 1
END = CLASSES - 1
GROUPS = GROUP = 45  # groups of ids and ids of each: CLASSES in all
WIDTH, WINDOW, FRESH, BLOCK = 16, 256, 240, 16
ROUNDS, WINDOWS_PER_TASK, BATCH, STEP, LEAST_STEPS = 3, 20_000, 16, 0.02, 150
TOP = 200_000
REMEMBERED = 500_000  # words whose ids a task keeps at most
TOGETHER = 16  # windows computed at once: their arrays stay in a core's cache and in memory the process holds already
END_HASH = -1  # the end token's key; a word's hash of this value is as unlikely as any other collision


def pieces_of(tokenizer_path: str) -> list[bytes]:
    """All single bytes and the vocabulary's first plain pieces of 2 to MAX_PIECE bytes, in byte order."""
    spec = load_tokenizer(tokenizer_path)
    suffix = spec["model"]["end_of_word_suffix"] or ""
    names = sorted(spec["model"]["vocab"], key=spec["model"]["vocab"].get)
    plain = [n.encode() for n in names if not (suffix and n.endswith(suffix)) and n.isascii() and n.isalnum() and 1 < len(n) <= MAX_PIECE]
    return sorted([*(bytes([b]) for b in range(256)), *plain[: PIECES - 256]])


class Encoder:
    """Cuts words into pieces, longest first, by one walk of all bytes along a tree of the pieces; remembers words by their hashes."""

    def __init__(self, pieces: list[bytes]):
        nodes = {b"": 0} | {n: k for k, n in enumerate(sorted({p[:n] for p in pieces for n in range(1, len(p) + 1)}), 2)}
        self.next = np.ones((len(nodes) + 1, 256), np.int16)  # node 1 leads nowhere
        self.piece = np.full(len(nodes) + 1, -1, np.int16)
        for name, k in nodes.items():
            if name:
                self.next[nodes[name[:-1]], name[-1]] = k
        self.next[:, 32] = 1  # no word holds a space
        for k, p in enumerate(pieces):
            self.piece[nodes[p]] = k
        self.forget()

    def forget(self) -> None:
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # known words in order, and their numbers
        self.ids, self.begin = np.zeros(0, np.int16), np.zeros(1, np.int64)  # all ids in a row, and each number's first one

    def numbers(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of these different words; ids[begin[k] : begin[k + 1]] are those of number k until words are forgotten."""
        if len(self.hashes) > REMEMBERED:
            self.forget()
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        out, new = np.empty(len(hashes), np.int64), np.flatnonzero(~known)
        out[known] = self.place[at[known]]
        if len(new):
            out[new] = len(self.hashes) + np.arange(len(new))
            ids, sizes = self.encode(data, start[new], end[new])
            self.ids, self.begin = np.concatenate([self.ids, ids]), np.append(self.begin, self.begin[-1] + np.cumsum(sizes))
            self.hashes, self.place = np.append(self.hashes, hashes[new]), np.append(self.place, out[new])
            order = np.argsort(self.hashes)
            self.hashes, self.place = self.hashes[order], self.place[order]
        return out

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these bytes, in a row, and their number by word."""
        size = end - start + 1
        first = np.cumsum(size) - size
        total = int(size.sum())
        text = data[np.minimum(np.repeat(start - first, size) + np.arange(total), len(data) - 1)]
        text[first + size - 1] = 32
        long, best = np.ones(total, np.int64), np.zeros(total, np.int16)
        at, node = np.flatnonzero(text != 32), 0
        for n in range(MAX_PIECE):
            node = self.next[node, text[at + n]]
            live = node != 1
            at, node = at[live], node[live]
            found = self.piece[node]
            hit = found >= 0
            best[at[hit]], long[at[hit]] = found[hit], n + 1
        begins = np.zeros(total, bool)
        place = first
        for _ in range(64):
            begins[place] = True
            place = place + long[place]
            place = place[text[place] != 32]
            if not len(place):
                break
        if len(place):  # words of many pieces, one by one
            steps, stop = long.tolist(), (text == 32).tolist()
            for k in place.tolist():
                while not stop[k]:
                    begins[k] = True
                    k += steps[k]
        begins = np.flatnonzero(begins)
        ids = best[begins] + np.int16(PIECES)
        cut = np.searchsorted(begins, np.append(first, total))
        ids[cut[:-1]] -= np.int16(PIECES)
        return ids, np.diff(cut)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_ids(words: Words, data: np.ndarray, first: np.ndarray, inverse: np.ndarray, encoder: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids in a row, each text's with -2 as its end, and their number by text; first and inverse: of the distinct words."""
    numbers = encoder.numbers(words.hash[first], _LOWER[data], words.start[first], words.end[first])
    ids, starts = np.append(encoder.ids, np.int16(-2)), encoder.begin[np.append(numbers, -1)]
    sizes = np.append(np.diff(encoder.begin)[numbers], 1)
    ends = np.cumsum(words.counts)
    order = np.insert(inverse, ends, len(numbers))
    size = sizes[order]
    after = np.cumsum(size)
    tokens = ids[np.repeat(starts[order] - (after - size), size) + np.arange(after[-1] if len(after) else 0)]
    return tokens, np.diff(np.append(0, after[ends + np.arange(len(ends))]))


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different hashes in order, a place of each, and the number of each one among them."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(hashes)]
    inverse = np.empty(len(hashes), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ordered[new], order[new], inverse


def keep_memory() -> None:
    """Numbers of some megabytes taken and freed once: from then on the process keeps memory of smaller arrays for the next ones."""
    np.empty(24 << 20, np.uint8)


def _merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(inverse, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


def _gather(docs: DataFrame, pieces: list[bytes]) -> DataFrame:
    """Of the training texts: kind 0 word counts (key, n); 1 counts of ids; 3 windows of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        encoder = Encoder(pieces)
        parts, held, ends = [], 0, 0
        used = np.zeros(CLASSES, np.int64)

        def rows(kind: int, key: np.ndarray, n: np.ndarray, data: pa.Array | None = None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(n), pa.nulls(len(key), pa.binary()) if data is None else data], ["kind", "key", "n", "data"])

        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            ends += len(batch)
            for lo, hi in slices(offsets, 1 << 20):
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                words = Words(part, at, True)
                hashes, first, inverse = distinct(words.hash)
                parts.append((hashes, np.bincount(inverse, minlength=len(hashes))))
                held += len(hashes)
                tokens, lengths = text_ids(words, part, first, inverse, encoder)
                used += np.bincount(classes_of(tokens), minlength=CLASSES)
                for _, taken in training_windows(tokens, lengths):
                    cut = np.arange(len(taken) + 1, dtype=np.int32) * np.int32(taken.itemsize * (WINDOW + 1))
                    yield rows(3, np.arange(len(taken)), np.zeros(len(taken), np.int64), pa.Array.from_buffers(pa.binary(), len(taken), [None, pa.py_buffer(cut), pa.py_buffer(taken)]))
                if held > 1_000_000:
                    parts = [_merge_counts(parts)]
                    held = len(parts[0][0])
                    if held > 700_000:
                        yield rows(0, *parts[0])
                        parts, held = [], 0
        if parts:
            keys, n = _merge_counts(parts)
            for k in range(0, len(keys), 200_000):
                yield rows(0, keys[k : k + 200_000], n[k : k + 200_000])
        if ends:
            yield rows(0, np.array([END_HASH]), np.array([ends]))
            yield rows(1, np.zeros(1, np.int64), np.zeros(1, np.int64), pa.array([used.tobytes()], pa.binary()))

    return docs.mapInArrow(run, "kind int, key long, n long, data binary")


def _sum_arrays(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of binary int64 arrays of one size, a few tasks' shares at a time."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for x in table.column("data"):
            total += np.frombuffer(x.as_py(), np.int64)
        return pa.table([[total.tobytes()]], names=["data"])

    some = rows.select(F.pmod(F.xxhash64("data"), F.lit(8)).alias("salt"), "data").groupBy("salt").applyInArrow(add, "data binary")
    found = some.collect()  # 8 arrays at most
    return np.sum([np.frombuffer(r["data"], np.int64) for r in found], axis=0) if found else np.zeros(size, np.int64)


def exponentials(z: np.ndarray) -> None:
    """Turn logits in place to exponentials in proportion along the last axis."""
    if z.size and max(z.max(), -z.min()) > 60:  # single precision holds exp(60) and sums of it
        z -= z.max(axis=-1, keepdims=True)
    np.exp(z, out=z)


class Attention:
    """One masked attention head over subword ids with learned distances, a residual and a softmax over groups, then ids of a group.

    Keys and values depend on single ids, so windows and texts are computed as one stream of blocks, of which `first` begin one.
    """

    SHAPES = {"e": (CLASSES, WIDTH), "p": (2 * BLOCK,), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "c": (WIDTH, GROUPS), "d": (GROUPS,), "u": (GROUPS, WIDTH, GROUP), "b": (GROUPS, GROUP)}
    #: Distance of each of two blocks' places from each place of the second; below 0 for later places.
    AWAY = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)

    def __init__(self, flat: np.ndarray | None = None):
        rng = np.random.default_rng(3)
        if flat is None:
            flat = np.concatenate([rng.standard_normal(math.prod(shape)) * (0 if name in "bdp" else 0.2) for name, shape in self.SHAPES.items()])
        self.w = self.named(flat.astype(np.float32))

    @classmethod
    def named(cls, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Views of one array of all weights by name."""
        ends = np.cumsum([math.prod(shape) for shape in cls.SHAPES.values()])
        return {name: part.reshape(shape) for (name, shape), part in zip(cls.SHAPES.items(), np.split(flat, ends[:-1]), strict=True)}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[n].reshape(-1) for n in self.SHAPES]).astype(np.float64)

    def projections(self) -> np.ndarray:
        """The three projections side by side, so that one product makes queries (scaled), keys and values."""
        return np.concatenate([self.w["q"] * np.float32(WIDTH**-0.5), self.w["k"], self.w["v"]], axis=1)

    def heads(self) -> np.ndarray:
        """For each group the weights of all groups and of its ids side by side, with the added constants as the last row."""
        w = self.w
        out = np.empty((GROUPS, WIDTH + 1, GROUPS + GROUP), w["c"].dtype)
        out[:, :WIDTH, :GROUPS], out[:, WIDTH, :GROUPS] = w["c"], w["d"]
        out[:, :WIDTH, GROUPS:], out[:, WIDTH, GROUPS:] = w["u"], w["b"]
        return out

    def attend(self, x: np.ndarray, first: np.ndarray):
        """Embeddings, queries, keys, values and a one, weights in proportion, mixed values and the weights' sums."""
        blocks = len(x) // BLOCK
        h = np.take(self.w["e"], x, axis=0)
        made = np.empty((BLOCK + len(x), 3 * WIDTH + 1), h.dtype)
        made[:BLOCK], made[:, -1] = 0, 1
        np.matmul(h, self.projections(), out=made[BLOCK:, :-1])
        # A block's keys and values are those of the block before and its own.
        line, item = made.strides
        pairs = np.ndarray((blocks, 2 * BLOCK, made.shape[1]), made.dtype, made, strides=(BLOCK * line, line, item))
        q, k, v = pairs[:, BLOCK:, :WIDTH], pairs[..., WIDTH : 2 * WIDTH], pairs[..., 2 * WIDTH :]
        a = np.matmul(q, k.swapaxes(1, 2))
        away, seen = self.w["p"][np.maximum(self.AWAY, 0)], self.AWAY >= 0
        if max(a.max(), -a.min()) + np.abs(away).max() > 60:
            a += away
            a[:, ~seen] = -1e9
            a[first, :, :BLOCK] = -1e9
            exponentials(a)
        else:
            np.exp(a, out=a)
            a *= np.exp(away) * seen
            a[first, :, :BLOCK] = 0
        mixed = np.matmul(a, v).reshape(-1, WIDTH + 1)
        mixed[:, :WIDTH] /= mixed[:, WIDTH:]
        return h, q, k, v, a, mixed

    def forward(self, x: np.ndarray):
        """The parts of `attend` for windows, with the mixed values last."""
        *parts, mixed = self.attend(x.reshape(-1), np.arange(len(x)) * (x.shape[1] // BLOCK))
        return *parts, mixed[:, :WIDTH].reshape(*x.shape, WIDTH)

    def logits(self, h: np.ndarray, mixed: np.ndarray, y: np.ndarray, at: np.ndarray):
        """The places `at` by groups of their ids y: their order, those ids, where each group begins, values with a one behind, the heads, and logits over groups and over the ids of the own group."""
        order = np.argsort((y // GROUP).astype(np.uint8), kind="stable")
        y = y[order]
        cut = np.searchsorted(y, np.arange(GROUPS + 1) * GROUP)
        made = np.empty_like(mixed)
        made[:, WIDTH] = 1
        np.add(h, mixed[:, :WIDTH], out=made[:, :WIDTH])
        picked, heads = np.take(made, at[order], axis=0), self.heads()
        z = np.empty((len(at), GROUPS + GROUP), h.dtype)
        for g in np.flatnonzero(cut[1:] > cut[:-1]):
            np.matmul(picked[cut[g] : cut[g + 1]], heads[g], out=z[cut[g] : cut[g + 1]])
        return order, y, cut, picked, heads, z

    @staticmethod
    def chosen(y: np.ndarray) -> np.ndarray:
        """Where the logits of ids y stand among all logits: that of the group, that of the id of it."""
        line = np.arange(len(y)) * (GROUPS + GROUP)
        return np.stack([line + y // GROUP, line + GROUPS + y % GROUP])

    def log10(self, x: np.ndarray, y: np.ndarray, at: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
        """log10 P(y) at the flat places `at` of a batch of windows x, or of a stream."""
        h, *_, mixed = self.attend(x.reshape(-1), np.arange(len(x)) * (x.shape[1] // BLOCK) if first is None else first)
        order, y, *_, z = self.logits(h, mixed, y, at)
        parts = z.reshape(-1, GROUP)
        if z.size and max(z.max(), -z.min()) > 60:
            parts -= parts.max(axis=1, keepdims=True)
        own = z.reshape(-1)[self.chosen(y)].sum(axis=0, dtype=np.float64)
        np.exp(z, out=z)
        out = np.empty(len(at))
        out[order] = own - np.log(parts @ np.ones(GROUP, z.dtype)).reshape(-1, 2).sum(axis=1, dtype=np.float64)
        return out / math.log(10)

    def gradients(self, x: np.ndarray, y: np.ndarray, real: np.ndarray, first: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Gradients of the mean loss over the real places of windows or a stream; only these get logits."""
        w, at = self.w, np.flatnonzero(real)
        share = np.float32(1 / max(1, len(at)))
        first = np.arange(len(x)) * (x.shape[1] // BLOCK) if first is None else first
        x = x.reshape(-1)
        h, q, k, v, a, mixed = self.attend(x, first)
        order, y, cut, picked, heads, z = self.logits(h, mixed, y.reshape(-1)[at], at)
        parts = z.reshape(-1, GROUP)
        exponentials(parts)
        parts *= share / (parts @ np.ones((GROUP, 1), z.dtype))
        z.reshape(-1)[self.chosen(y)] -= share
        both, back, turned = np.zeros_like(heads), np.empty((len(at), WIDTH), z.dtype), picked.T
        for i in np.flatnonzero(cut[1:] > cut[:-1]):
            some = slice(cut[i], cut[i + 1])
            np.matmul(turned[:, some], z[some], out=both[i])
            np.matmul(z[some], heads[i, :WIDTH].T, out=back[some])
        shared = both[:, :, :GROUPS].sum(axis=0)
        g = {"c": shared[:WIDTH], "d": shared[WIDTH], "u": both[:, :WIDTH, GROUPS:], "b": both[:, WIDTH, GROUPS:]}
        dt = np.zeros((len(x), WIDTH), z.dtype)
        dt[at[order]] = back
        # The mean of da under a is that of the mixed values under dt; the weights' sums divide dt, not the weights.
        da = np.empty_like(mixed)
        np.divide(dt, mixed[:, WIDTH:], out=da[:, :WIDTH])
        np.matmul(da[:, :WIDTH] * mixed[:, :WIDTH], np.full((WIDTH, 1), -1, z.dtype), out=da[:, WIDTH:])
        da = da.reshape(-1, BLOCK, WIDTH + 1)
        ds = np.matmul(da, v.swapaxes(1, 2))
        ds *= a
        g["p"] = np.bincount(np.maximum(self.AWAY, 0).reshape(-1), weights=ds.sum(axis=0).reshape(-1), minlength=2 * BLOCK)
        d = np.empty((len(ds) + 1, BLOCK, 3 * WIDTH), z.dtype)
        np.matmul(ds, k, out=d[1:, :, :WIDTH])
        for place, left, right in ((slice(WIDTH, 2 * WIDTH), ds, q), (slice(2 * WIDTH, None), a, da[..., :WIDTH])):
            np.matmul(left[..., BLOCK:].swapaxes(1, 2), right, out=d[1:, :, place])
            d[1:-1, :, place] += np.matmul(left[1:, :, :BLOCK].swapaxes(1, 2), right[1:])
        d = d[1:].reshape(-1, 3 * WIDTH)
        g["q"], g["k"], g["v"] = np.split(h.T @ d, 3, axis=1)
        g["q"] = g["q"] * np.float32(WIDTH**-0.5)
        dt += d @ self.projections().T
        # Rows of one id are sorted together and added at once.
        order = np.argsort(x.astype(np.int16, copy=False), kind="stable")
        ordered = x[order]
        begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        g["e"] = np.zeros_like(w["e"])
        g["e"][ordered[begin]] = np.add.reduceat(np.take(dt, order, axis=0), begin, axis=0)
        return g

    def train(self, rows: np.ndarray, rate: float) -> None:
        """Adam over windows (rows, WINDOW + 1), again and again if they are few."""
        flat = self.flat().astype(np.float32)
        self.w = self.named(flat)
        g, m, s, root = np.empty_like(flat), np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
        into = self.named(g)
        each = -(-len(rows) // BATCH)
        for step in range(1, max(each, LEAST_STEPS) + 1):
            at = (step - 1) % each * BATCH
            for name, part in self.gradients(*stream(rows[at : at + BATCH])).items():
                into[name][...] = part
            m *= np.float32(0.9)
            np.multiply(g, np.float32(0.1), out=root)
            m += root
            s *= np.float32(0.99)
            g *= g
            g *= np.float32(0.01)
            s += g
            np.sqrt(s, out=root)
            root += np.float32(1e-8)
            np.divide(m, root, out=root)
            root *= np.float32(rate * math.sqrt(1 - 0.99**step) / (1 - 0.9**step))
            flat -= root


def _fit(windows: DataFrame, used: np.ndarray) -> Attention:
    """Rounds of local training in every partition, then an average of the weights by windows seen."""
    spark, model = windows.sparkSession, Attention()
    total = windows.count()
    common = (used + 1.0).reshape(GROUPS, GROUP)
    groups = common.sum(axis=1)
    model.w["d"] = np.log(groups / groups.sum()).astype(np.float32)
    model.w["b"] = np.log(common / groups[:, None]).astype(np.float32)
    parts = max(1, math.ceil(total / ROUNDS / WINDOWS_PER_TASK))
    hashed = windows.select("data", F.xxhash64("data", "key").alias("at"))

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_py()) for x in table.column("w")], axis=0)
        return pa.table([[total.tobytes()], [sum(table.column("n").to_pylist())]], names=["w", "n"])

    for k in range(ROUNDS):
        start = spark.sparkContext.broadcast(model.flat())

        def run(batches: Iterator[pa.RecordBatch], start=start, rate=STEP / (1 + k)) -> Iterator[pa.RecordBatch]:
            keep_memory()
            # About WINDOWS_PER_TASK windows of 514 bytes; partitions are dealt by hash.
            raw = np.frombuffer(b"".join(b"".join(batch.column("data").to_pylist()) for batch in batches), np.int16).reshape(-1, WINDOW + 1)
            if len(raw):
                own = Attention(start.value)
                own.train(raw, rate)
                yield pa.RecordBatch.from_arrays([pa.array([(own.flat() * len(raw)).tobytes()], pa.binary()), pa.array([len(raw)], pa.int64())], ["w", "n"])

        dealt = hashed.where(F.pmod("at", F.lit(ROUNDS)) == k).repartition(parts, "at").sortWithinPartitions("at", "data")
        sums = dealt.mapInArrow(run, "w binary, n long")
        sums = sums.select("*", F.pmod(F.xxhash64("w"), F.lit(32)).alias("salt")).groupBy("salt").applyInArrow(add, "w binary, n long")
        found = sums.collect()  # 32 weight vectors at most
        if found:
            model = Attention(np.sum([np.frombuffer(r["w"]) for r in found], axis=0) / sum(r["n"] for r in found))
    return model


def text_windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many tokens: text and first token of each window, and the first place in it that is scored."""
    numbers = 1 + np.maximum(-(-(lengths - WINDOW) // FRESH), 0)
    text = np.repeat(np.arange(len(lengths)), numbers)
    k = np.arange(len(text)) - np.repeat(np.cumsum(numbers) - numbers, numbers)
    return text, k * FRESH, np.where(k > 0, WINDOW - FRESH, 0)


def training_windows(tokens: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The windows of text_windows, some at a time: their texts, and rows of an id before (-2 at a text's begin) and WINDOW ids (-2: end, -3: nothing)."""
    first = np.cumsum(lengths) - lengths
    text, begin, _ = text_windows(lengths)
    places = np.arange(-1, WINDOW)
    for at in range(0, len(text), 8 * TOGETHER):
        t, b = text[at : at + 8 * TOGETHER], begin[at : at + 8 * TOGETHER]
        inside = b[:, None] + places
        rows = tokens[np.clip(first[t][:, None] + inside, 0, len(tokens) - 1)]
        rows[b == 0, 0] = -2
        rows[inside >= lengths[t][:, None]] = -3
        yield t, rows


def classes_of(tokens: np.ndarray) -> np.ndarray:
    """Ids of the model: -2, and -3 where nothing is predicted, as the end."""
    return np.where(tokens < 0, tokens.dtype.type(END), tokens)


def predicted(rows: np.ndarray) -> np.ndarray:
    """The places of training windows that are predicted there, as text_windows has it: each id of a text once."""
    return (rows > -3) & ((rows[:, :1] == -2) | (np.arange(WINDOW + 1) > WINDOW - FRESH))


def stream(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Training windows as a stream without their empty blocks: ids, ids that follow, where these are predicted, and the blocks that begin a window."""
    used = (rows[:, 1::BLOCK] > -3).reshape(-1)
    x, y, real = (part.reshape(-1, BLOCK)[used].reshape(-1) for part in (rows[:, :-1], rows[:, 1:], predicted(rows)[:, 1:]))
    return classes_of(x), classes_of(y), real, np.flatnonzero((np.arange(len(used)) % (WINDOW // BLOCK) == 0)[used])


def attention_scores(model: Attention, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of each text; tokens: all texts' ids in a row, lengths: their number by text."""
    y = classes_of(tokens)
    blocks = -(-lengths // BLOCK)
    begin = np.cumsum(blocks) - blocks
    place = np.arange(len(y)) + np.repeat(begin * BLOCK - (np.cumsum(lengths) - lengths), lengths)
    x = np.full(int(blocks.sum()) * BLOCK, END, y.dtype)
    x[place[1:]] = y[:-1]  # before a text's first id stands an end, the one of the text before
    found = np.empty(len(y))
    for lo in range(0, len(x), TOGETHER * WINDOW):
        start = max(0, lo - BLOCK)  # the block before is seen, not scored
        some = slice(*np.searchsorted(place, [lo, lo + TOGETHER * WINDOW]))
        first = begin[slice(*np.searchsorted(begin * BLOCK, [start, lo + TOGETHER * WINDOW]))] - start // BLOCK
        found[some] = model.log10(x[start : lo + TOGETHER * WINDOW], y[some], place[some] - start, np.append(first, 0))
    return np.add.reduceat(found, np.cumsum(lengths) - lengths) if len(lengths) else np.zeros(0)


def _score(docs: DataFrame, pieces: list[bytes], model: Attention, top: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """One row for each text: the attention's sum, the base's over common words, and the other words to join."""
    shared = docs.sparkSession.sparkContext.broadcast((model.flat(), top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        flat, (top_hash, top_count) = shared.value
        model, encoder = Attention(flat), Encoder(pieces)
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for lo, hi in slices(offsets, 1 << 20):
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                words = Words(part, at, True)
                n_texts = hi - lo
                hashes, first, inverse = distinct(words.hash)
                if len(top_hash) and len(hashes):
                    place = np.minimum(np.searchsorted(top_hash, hashes), len(top_hash) - 1)
                    common = top_hash[place] == hashes
                    count = np.where(common, top_count[place], 0)
                else:
                    common, count = np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
                text = np.repeat(np.arange(n_texts), words.counts)
                base = np.log10(count + 0.1)
                own = common[inverse]
                each = lambda values: np.bincount(text[own], weights=values[inverse[own]], minlength=n_texts).astype(float)  # noqa: B023, E731
                tokens, lengths = text_ids(words, part, first, inverse, encoder)
                key = text[~own] * len(hashes) + inverse[~own]
                key, times = np.unique(key, return_counts=True)
                which = key % max(1, len(hashes))
                cut = np.searchsorted(key // max(1, len(hashes)), np.arange(n_texts + 1)).astype(np.int32)
                listed = lambda values, t: pa.ListArray.from_arrays(pa.array(cut), pa.array(values, t))  # noqa: B023, E731
                rest = batch.slice(lo, n_texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        rest.column("row"), rest.column("doc_id"), rest.column("held_out"), pa.array(words.counts + 1), pa.array(each(np.ones(len(hashes))).astype(np.int64)), pa.array(each(base)),
                        pa.array(attention_scores(model, tokens, lengths)), listed(hashes[which].view(np.int64), pa.int64()), listed(times.astype(np.int32), pa.int32()),
                    ],
                    ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "words", "times"],
                )

    return docs.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, words array<long>, times array<int>")


def score_texts(docs: DataFrame, tokenizer_path: str, top: int = TOP) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    pieces = pieces_of(tokenizer_path)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    remainder = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 10
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder == 0).alias("held_out"), text.alias("text"))
    train = rows.where("NOT held_out").select("text")
    gathered = stored(_gather(train, pieces), "lm-gathered", partition_by="kind")
    counts = stored(gathered.where("kind = 0").groupBy("key").agg(F.sum("n").alias("c")), "lm-counts")
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = totals["n"] or 0, totals["v"]
    end = counts.where(f"key = {END_HASH}").first()
    ends = end["c"] if end else 0
    model = _fit(gathered.where("kind = 3"), _sum_arrays(gathered.where("kind = 1"), CLASSES))
    common = counts.where(f"key <> {END_HASH}").orderBy(F.desc("c"), "key").limit(top).toArrow()  # `top` pairs of numbers
    hashes, amounts = common.column("key").to_numpy().view(np.uint64), common.column("c").to_numpy()
    order = np.argsort(hashes)
    constant = math.log10(n + 0.1 * (v + 1)) if n else -1.0  # without training texts 0.1 / 0.1
    numbered = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held_out", "text")
    scored = stored(_score(numbered, pieces, model, (hashes[order], amounts[order])), "lm-scored")
    others = scored.where("size(words) > 0").select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("key"), F.col("w.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    joined = others.join(counts, "key", "left")
    summed = joined.groupBy("row").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.log10(c + 0.1)).alias("more_base"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    out = scored.drop("words", "times").join(summed, "row", "left")
    base = F.col("base") + zero("more_base") + math.log10(ends + 0.1) - F.col("n_tokens") * constant
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + zero("more_known") + int(ends > 0)).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
