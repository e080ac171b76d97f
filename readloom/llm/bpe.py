"""BPE encoding and decoding by forced boundaries (operator 3).

A byte pair that lies inside no vocabulary token can never be merged, so a cut between its bytes is certain.
Every word is cut at such pairs, the fragments are encoded independently (and remembered: fragments repeat far
more than words do), and their ids are concatenated. The vocabulary file is read once on the driver and
broadcast; its size is fixed by the tokenizer, not by the data. There is no shuffle.

Defined results: a null or empty text has no tokens; an unknown byte can't occur, as every byte is in the
vocabulary; texts of any length are encoded whole, in time n log n of the longest fragment.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain
from operator import add
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm.shared import slices, text_buffers

#: Words of the vocabulary's pre-tokenizer; white space is dropped before.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_WORD_OR_TAB = regex.compile(_WORD.pattern + r"|\t")
#: Unicode white space. str.split() also splits at 0x1C-0x1F, which are no white space here.
_SPACE = regex.compile("[\t-\r \x85\xa0  -     　]+")
_SEPARATORS = regex.compile("[\x1c-\x1f]")
#: Words and fragments that a task remembers at most; only speed depends on these.
REMEMBERED = 250_000
#: Characters of a fragment up to which fragments are merged together; NONE ranks after every merge.
WIDE, NONE = 32, 1 << 60


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Remembered:
    """A dictionary of bounded size: when its young half is full, the other half is forgotten."""

    def __init__(self) -> None:
        self.young: dict = {}
        self.old: dict = {}

    def put(self, key, value) -> None:
        self.young[key] = value
        if len(self.young) >= REMEMBERED:
            # `young` stays the same object, as loops hold on to it
            self.old = dict(self.young)
            self.young.clear()


class ForcedBoundaryBpe:
    """Encoder and decoder for one tokenizer file of the kind "BPE with word ends"."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        table = sorted(((a << 20) + b, rank, made) for (a, b), (rank, made) in self.ranks.items())
        self.pair_keys, self.pair_ranks = (np.array([t[k] for t in table], np.int64) for k in (0, 1))
        self.made_by_rank = np.zeros(len(table) and int(self.pair_ranks.max()) + 1, np.int64)
        self.made_by_rank[self.pair_ranks] = [t[2] for t in table]
        self.inner_pairs = set()
        for token in self.vocab:
            core = token.removesuffix(self.suffix)
            self.inner_pairs.update(map(add, core, core[1:]))
        self.symbols = str.maketrans({chr(b): s for b, s in enumerate(_byte_symbols()) if b not in (9, 10)})
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.numbers = {i: str(i) for i in self.tokens}
        self.named = {n: self.tokens[i] for i, n in self.numbers.items()}
        self.fragments = Remembered()
        self.chunks = Remembered()

    def cut(self, word: str) -> list[str]:
        """The fragments of a word (in byte symbols) between forced boundaries; the last ends in the suffix."""
        inner, begin, out = self.inner_pairs, 0, []
        if inner.issuperset(map(add, word, word[1:])):
            return [word + self.suffix]
        for i, pair in enumerate(map(add, word, word[1:]), 1):
            if pair not in inner:
                out.append(word[begin:i])
                begin = i
        out.append(word[begin:] + self.suffix)
        return out

    def merge(self, fragment: str) -> list[int]:
        """Apply the merges to one fragment: lowest rank first, leftmost among equals."""
        return self._merge_long(self._symbol_ids(fragment))

    def _symbol_ids(self, fragment: str) -> list[int]:
        get, suffix = self.vocab.__getitem__, self.suffix
        if suffix and fragment.endswith(suffix) and len(fragment) > len(suffix):
            return [*map(get, fragment[: -len(suffix) - 1]), get(fragment[-len(suffix) - 1 :])]
        return list(map(get, fragment))

    def merge_many(self, fragments: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Fragments with their ids, merged together: each round makes one merge in every row that has one left."""
        for f in [f for f in fragments if len(f) > WIDE]:
            yield f, self.merge(f)
        short = sorted((f for f in fragments if len(f) <= WIDE), key=len)
        for at in range(0, len(short), 4096):  # rows of about one length at a time
            part = short[at : at + 4096]
            ids = np.full((len(part), len(part[-1]) + 1), -1, np.int64)
            for k, f in enumerate(part):
                row = self._symbol_ids(f)
                ids[k, : len(row)] = row
            self._merge_rows(ids)
            for f, found, n in zip(part, ids.tolist(), (ids >= 0).sum(axis=1).tolist(), strict=True):
                yield f, found[:n]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NONE where there is no merge (-1 is no id)."""
        key = (a << 20) + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (b >= 0), self.pair_ranks[at], NONE)

    def _merge_rows(self, ids: np.ndarray) -> None:
        todo, ranks = np.arange(len(ids)), self._ranks(ids[:, :-1], ids[:, 1:])
        current, columns = ids, np.arange(ids.shape[1])
        while len(todo):
            best = ranks.argmin(axis=1)
            line = np.arange(len(todo))
            least = ranks[line, best]
            done = least == NONE
            if done.any():
                ids[todo[done]] = current[done]
                keep = ~done
                todo, current, ranks, best, least = todo[keep], current[keep], ranks[keep], best[keep], least[keep]
                line = line[: len(todo)]
                if not len(todo):
                    break
            take = np.minimum(columns + (columns > best[:, None]), ids.shape[1] - 1)
            current = np.take_along_axis(current, take, axis=1)
            current[:, -1] = -1
            current[line, best] = self.made_by_rank[least]
            shift = take[:, :-1]
            ranks = np.take_along_axis(ranks, np.minimum(shift, ranks.shape[1] - 1), axis=1)
            ranks[:, -1] = NONE
            ranks[line, best] = self._ranks(current[line, best], current[line, np.minimum(best + 1, ids.shape[1] - 1)])
            inner = best > 0
            ranks[line[inner], best[inner] - 1] = self._ranks(current[line[inner], best[inner] - 1], current[line[inner], best[inner]])

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        left, right, heap = list(range(-1, n - 1)), list(range(1, n + 1)), []
        right[-1] = -1
        ranks = self.ranks
        for i in range(n - 1):
            if (found := ranks.get((ids[i], ids[i + 1]))) is not None:
                heap.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = merged, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
                if (found := ranks.get((merged, ids[right[j]]))) is not None:
                    heapq.heappush(heap, (found[0], i, merged, ids[right[j]], found[1]))
            if left[i] >= 0 and (found := ranks.get((ids[left[i]], merged))) is not None:
                heapq.heappush(heap, (found[0], left[i], ids[left[i]], merged, found[1]))
        return [x for x in ids if x >= 0]

    def _fragments_of(self, chunks: list[str]) -> Iterator[list[str]]:
        """The fragments of each chunk, normalised and mapped to byte symbols in bulk; chunks hold no white space."""
        text = "\t".join(chunks)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        words = "\n".join(_WORD_OR_TAB.findall(text.lower())).encode().decode("latin-1").translate(self.symbols)
        inner, suffix, out = self.inner_pairs, self.suffix, []
        for word in words.split("\n"):
            if word == "\t":
                yield out
                out = []
            elif inner.issuperset(map(add, word, word[1:])):
                out.append(word + suffix)
            else:
                out += self.cut(word)
        yield out

    def chunk_table(self, chunks: set[str]) -> dict[str, tuple[str, int]]:
        """For each chunk its decimal ids, joined by spaces, and their number; new ones are encoded together."""
        table, missing = {}, []
        young, old = self.chunks.young.get, self.chunks.old.get
        for c in chunks:
            if (x := young(c) or old(c)) is None:
                missing.append(c)
            else:
                table[c] = x
        if not missing:
            return table
        new = list(self._fragments_of(missing))
        pieces = set(chain.from_iterable(new))
        encoded = self.encoded(pieces)
        for c, fragments in zip(missing, new, strict=True):
            if len(fragments) == 1:
                made = encoded[fragments[0]]
            else:
                parts = [encoded[f] for f in fragments]
                made = (" ".join([p[0] for p in parts]), sum([p[1] for p in parts]))
            table[c] = made
            if len(c) < 64:
                self.chunks.put(c, made)
        return table

    def encoded(self, fragments: set[str]) -> dict[str, tuple[str, int]]:
        """Fragments with what is remembered of them or newly encoded."""
        young, old = self.fragments.young.get, self.fragments.old.get
        out = {f: x for f in fragments if (x := young(f) or old(f)) is not None}
        numbers = self.numbers
        for f, ids in self.merge_many([f for f in fragments if f not in out]):
            out[f] = made = (" ".join([numbers[i] for i in ids]), len(ids))
            if len(f) < 64:
                self.fragments.put(f, made)
        return out

    def split(self, text: str) -> list[str | tuple[str, int]]:
        """Chunks of a text in order; special tokens, which match before all else, are pieces already."""
        if not self.specials or "<|" not in text:
            return _SPACE.split(text) if _SEPARATORS.search(text) else text.split()
        out, at = [], 0
        for a, b in [*(m.span() for m in self.specials.finditer(text)), (len(text), len(text))]:
            part = text[at:a]
            out += _SPACE.split(part) if _SEPARATORS.search(part) else part.split()
            if b > a:
                out.append((str(self.special[text[a:b]]), 1))
            at = b
        return out

    def pieces(self, texts: list[str]) -> list[list[tuple[str, int]]]:
        """For each whole text its encoded chunks."""
        lists = [self.split(t) for t in texts]
        table = self.chunk_table({c for chunks in lists for c in chunks if c and type(c) is str})
        known = table.get
        table[""] = ("", 0)
        return [[x for c in chunks if (x := known(c, c))[1]] for chunks in lists]

    def encode(self, text: str) -> list[int]:
        return [int(i) for piece in self.pieces([text])[0] for i in piece[0].split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The tokenizer has no decoder of its own, so tokens are joined by one space."""
        return " ".join(self.tokens[i] for i in ids)

    def decode_decimals(self, ids: str) -> str:
        """The same of decimal ids joined by spaces."""
        return " ".join(map(self.named.__getitem__, ids.split(" "))) if ids else ""


def load_tokenizer(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


_READY: dict[int, ForcedBoundaryBpe] = {}


def _key(path: str) -> int:
    """What tells tokenizer files apart."""
    return crc32(Path(path).read_bytes())


def _encoder(key: int, spec) -> ForcedBoundaryBpe:
    """One encoder for each Python worker, with what it remembers; one of another tokenizer is forgotten."""
    if key not in _READY:
        _READY.clear()
        _READY[key] = ForcedBoundaryBpe(spec.value)
    return _READY[key]


def bpe_encode(docs: DataFrame, tokenizer_path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """docs with a column of token ids, in place of one of that name; other columns pass unchanged. A null text gets an empty array."""
    spec = docs.sparkSession.sparkContext.broadcast(load_tokenizer(tokenizer_path))
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()))
    key, rest = _key(tokenizer_path), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(key, spec)
        for batch in batches:
            data, offsets = text_buffers(batch.column(text))
            for lo, hi in slices(offsets, 1 << 20):
                pieces = bpe.pieces([data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in range(lo, hi)])
                numbers = [np.fromstring(" ".join([p[0] for p in x]), np.int32, sep=" ") for x in pieces]
                cut = np.concatenate([[0], np.cumsum([len(n) for n in numbers])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(numbers)))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, ids], [*rest, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def bpe_decode(df: DataFrame, tokenizer_path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df with the decoded text of a column of ids; null ids give a null."""
    spec = df.sparkSession.sparkContext.broadcast(load_tokenizer(tokenizer_path))
    key = _key(tokenizer_path)

    @F.pandas_udf("string")
    def decode(column):
        bpe = _encoder(key, spec)
        return column.map(lambda x: None if x is None else bpe.decode(list(x)))

    return df.withColumn(out, decode(F.col(ids)))


def bpe_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text; nothing of the size of a text leaves a task."""
    spec = docs.sparkSession.sparkContext.broadcast(load_tokenizer(tokenizer_path))
    key = _key(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(key, spec)
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            numbers, ids_sha, text_sha = [], [], []
            for lo, hi in slices(offsets, 1 << 20):
                for pieces in bpe.pieces([data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in range(lo, hi)]):
                    ids = " ".join([p[0] for p in pieces])
                    numbers.append(sum([p[1] for p in pieces]))
                    ids_sha.append(sha256(ids.encode()).hexdigest())
                    text_sha.append(sha256(bpe.decode_decimals(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(numbers, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
