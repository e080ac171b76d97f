"""Personal data by bootstrapped contextual extraction (operator 1).

One map pass over the texts finds base entities (e-mail, IP, card, phone) and identifier-like tokens, each with
its lexical contexts. Base entities are the seeds. Spark then scores the graph of patterns (contexts of a kind)
and instances in rounds: a pattern's confidence is the share of its mentions whose instance is believed to be of
the kind, an instance's belief is the noisy-or of its confident patterns, and believed instances teach further patterns in the
next round. Identifiers that only confident patterns reach are the discovered spans; base spans always stay. Only mentions are
shuffled, never texts.

Defined results: a null or empty text has no spans. Offsets are code points, ends exclusive. Every search is
linear in the text's length. Repeated rows get the same spans each, and rows with a null doc_id get theirs. Kinds come in the order of KINDS, spans by
start within a kind.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.shared import bounded, stored, text_buffers

KINDS = ("email", "ip", "card", "phone")
#: A pattern needs this many different believed instances, and this confidence, to teach anything.
MIN_SEEDS, MIN_CONFIDENCE, ROUNDS = 5, 0.8, 3

# The leftmost match of local-part@domain at an "@" starts where the run of local-part characters before it
# starts, so searching from the "@" finds the same spans in linear time.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TOKEN = re.compile(r"[^\s\"'<>(){}\[\],;]+")
_WORD = re.compile(r"\S+")
#: Digit groups with one separator between, which a closing or opening bracket may join; group 1 is the first of them.
_GROUPS = re.compile(r"(\(?[0-9]++)(?:\)?[\x20./-]?\(?[0-9]++)*+")
#: Tokens under SHORT characters inside a run are parts of it; patterns hold words over LONG characters as digests.
SHORT, LONG = 6, 80
#: Modulus and base of the digests of a word's beginnings and ends.
_PRIME, _BASE = (1 << 61) - 1, 1_000_003_579
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, floor = [], 0
    for m in _DOMAIN.finditer(text):
        at = begin = m.start()
        while begin > floor and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        if begin < at:
            out.append((begin, m.end()))
            floor = m.end()
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base entities by kind, then start; a leftmost match that fails its test is dropped without a retry."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


class _Words:
    """A text's words as patterns write them; a word over LONG characters enters by its digest, so that whole words cost a fixed size."""

    def __init__(self, text: str):
        self.text, self.spans, self.known = text, [m.span() for m in _WORD.finditer(text)], {}
        self.starts, self.ends = [a for a, _ in self.spans], [b for _, b in self.spans]
        self.glue: dict[int, _Glue] = {}

    def at(self, i: int) -> str:
        if i not in self.known:
            self.known[i] = _plain(self.text[slice(*self.spans[i])])
        return self.known[i]

    def context(self, start: int, end: int) -> tuple[str, str]:
        """Two lexical patterns around a span: two words before, and one word on each side; empty where there are none.

        Neighbours are whole words; all characters glued to the span count as a word."""
        i, j = bisect_right(self.ends, start), bisect_left(self.starts, end)
        before, after = [self.at(k) for k in range(max(0, i - 2), i)], self.at(j) if j < len(self.spans) else ""
        if i < len(self.spans) and self.starts[i] < start:
            before.append(self.glued(i, self.starts[i], start))
        if j and self.ends[j - 1] > end:
            after = self.glued(j - 1, end, self.ends[j - 1])
        return (f"{before[-2]} {before[-1]} _" if len(before) > 1 else "", f"{before[-1]} _ {after}" if before and after else "")

    def glued(self, i: int, start: int, end: int) -> str:
        """The beginning or end of word i that lies between these places."""
        if end - start <= LONG:
            return _plain(self.text[start:end])
        if i not in self.glue:
            self.glue[i] = _Glue(self.text[slice(*self.spans[i])])
        return self.glue[i].part(start - self.starts[i], end - self.starts[i])


class _Glue:
    """A long word as patterns write it, with running digests, so that each of its many beginnings and ends costs a fixed time."""

    def __init__(self, word: str):
        made, self.upto, self.inside, digit = [], [0], [False], False
        for c in word:
            now = c in "0123456789"
            if not (now and digit):
                made.append("0" if now else c.lower())
            self.upto.append(len(made))
            self.inside.append(now)
            digit = now
        self.made, self.running = made, [0]
        for c in made:
            self.running.append((self.running[-1] * _BASE + sum(map(ord, c))) % _PRIME)

    def part(self, start: int, end: int) -> str:
        """Characters start to end; a run of digits cut at the start still begins with its 0."""
        a, b = self.upto[start], self.upto[end]
        if self.inside[start] and self.upto[start + 1] == a:
            a -= 1
        if b - a <= LONG:
            return "".join(self.made[a:b])
        return f"{(self.running[b] - self.running[a] * pow(_BASE, b - a, _PRIME)) % _PRIME:x}.{b - a}"


def _plain(word: str) -> str:
    word = re.sub("[0-9]+", "0", word.lower())
    return word if len(word) <= LONG else sha256(word.encode()).hexdigest()


def candidates(text: str) -> list[tuple[int, int]]:
    """Identifier-like spans by start: tokens with a digit or "@", and runs of digit groups; no run inside a token, no short token inside a run."""
    tokens = [m.span() for m in _TOKEN.finditer(text) if "@" in m[0] or _DIGIT.search(m[0])]
    runs = [m.span() for m in _GROUPS.finditer(text) if m.end(1) < m.end()]
    starts, first = [a for a, _ in tokens], [a for a, _ in runs]

    def within(a: int, b: int, others: list[tuple[int, int]], begins: list[int]) -> bool:
        k = bisect_right(begins, a) - 1
        return k >= 0 and others[k][1] >= b

    kept = [(a, b) for a, b in tokens if b - a >= SHORT or not within(a, b, runs, first)]
    kept += [(a, b) for a, b in runs if not within(a, b, tokens, starts)]
    return sorted(kept)


def mentions(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str, str, str]]:
    """Seeds and candidates that meet no seed: kind or '', start, end, instance, patterns."""
    if not base and not _DIGIT.search(text) and "@" not in text:
        return []
    words = _Words(text)
    out = [(kind, a, b, text[a:b].lower(), *words.context(a, b)) for kind, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    k = 0
    for a, b in candidates(text):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k < len(taken) and taken[k][0] < b:
            continue
        out.append(("", a, b, text[a:b].lower(), *words.context(a, b)))
    return out


_MENTION = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("before", pa.string()), ("around", pa.string())])


def _scan(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            numbers: dict[str, list[int]] = {k: [] for k in KINDS}
            spans, found = [], []
            for i in range(len(batch)):
                text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
                base = base_spans(text)
                for k in KINDS:
                    numbers[k].append(sum(s[0] == k for s in base))
                spans.append(",".join(f"{k}:{a}:{b}" for k, a, b in base))
                found.append([dict(zip(("kind", "start", "end", "instance", "before", "around"), m, strict=True)) for m in mentions(text, base)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), *(pa.array(numbers[k], pa.int64()) for k in KINDS), pa.array([sha256(s.encode()).hexdigest() for s in spans]), pa.array(spans, pa.string()), pa.array(found, pa.list_(_MENTION))],
                ["doc_id", "text_hash", *(f"n_{k}" for k in KINDS), "base_sha256", "base_spans", "mentions"],
            )

    return docs.mapInArrow(
        run,
        "doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base_spans string,"
        "mentions array<struct<kind: string, start: long, end: long, instance: string, before: string, around: string>>",
    )


def discover(scanned: DataFrame) -> DataFrame:
    """Rows doc_id, text_hash, kind, start, end of identifiers that confident patterns reach but no base rule does."""
    rows = scanned.where(F.size("mentions") > 0).select("doc_id", "text_hash", F.explode("mentions").alias("m")).select("doc_id", "text_hash", "m.*")
    sided = rows.select("*", F.explode(F.array("before", "around")).alias("pattern")).where("pattern <> ''")
    # One row for each pattern, instance and kind; a hot pattern's mentions are summed before they are shuffled.
    edges = sided.groupBy("pattern", "instance", "kind").agg(F.count("*").alias("n"))
    wide = edges.groupBy("pattern").agg(F.countDistinct("instance").alias("instances")).where(F.col("instances") >= MIN_SEEDS).select("pattern")
    edges = stored(edges.join(wide, "pattern", "left_semi"), "pii-edges")
    totals = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
    seeds = edges.where("kind <> ''").select("instance", F.col("kind").alias("as_kind"), F.lit(1.0).alias("belief")).distinct()
    belief = seeds
    for _ in range(ROUNDS):
        # What earlier rounds have discovered teaches patterns as seeds do. A mention that a base rule found is of that kind only.
        believed = edges.join(belief, "instance").where("kind = '' OR kind = as_kind")
        teachers = F.countDistinct(F.when(F.col("belief") >= MIN_CONFIDENCE, F.col("instance")))
        scored = believed.groupBy("pattern", "as_kind").agg(F.sum(F.col("belief") * F.col("n")).alias("mass"), teachers.alias("teachers")).where(F.col("teachers") >= MIN_SEEDS)
        confident = scored.join(totals, "pattern").select("pattern", "as_kind", (F.col("mass") / (F.col("total") + 1.0)).alias("confidence")).where(F.col("confidence") >= MIN_CONFIDENCE)
        confident = stored(confident, "pii-patterns")
        found = edges.where("kind = ''").join(bounded(confident), "pattern").groupBy("instance", "as_kind").agg((1 - F.product(1 - F.col("confidence"))).alias("belief"))
        found = stored(found, "pii-instances")
        belief = found.union(seeds).groupBy("instance", "as_kind").agg(F.max("belief").alias("belief"))
    best = found.groupBy("instance").agg(F.max_by("as_kind", F.struct("belief", "as_kind")).alias("as_kind"), F.max("belief").alias("belief"))
    best = best.where(F.col("belief") >= MIN_CONFIDENCE)
    reached = sided.where("kind = ''").join(best, "instance").join(bounded(confident.select("pattern", "as_kind")), ["pattern", "as_kind"], "left_semi")
    return reached.select("doc_id", "text_hash", F.col("as_kind").alias("kind"), "start", "end").distinct()


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("text_hash", F.xxhash64("text"))


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, counts, base_sha256 and all spans ("kind:start:end", comma-joined) of each document."""
    scanned = stored(_scan(_keyed(docs)), "pii-scan")
    more = discover(scanned).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    order = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    parts = F.filter(F.split("base_spans", ","), lambda s: s != "")
    base = F.transform(parts, lambda s: F.struct(F.split(s, ":")[0].alias("kind"), F.split(s, ":")[1].cast("long").alias("start"), F.split(s, ":")[2].cast("long").alias("end")))
    ranked = F.array_sort(F.transform(F.concat(base, F.col("more")), lambda s: F.struct(order[s["kind"]].alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    joined = F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    more = more.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "more")
    out = scanned.drop("mentions").join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return out.select("doc_id", "text_hash", *(f"n_{k}" for k in KINDS), "base_sha256", F.when(F.col("more").isNull(), F.col("base_spans")).otherwise(joined).alias("spans"), F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_discovered"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans are merged under the first one's kind.

    A null text stays null. All spans travel to the documents by doc_id (null equals null) and the text's hash. Other columns
    pass unchanged, whatever their names.
    """
    given = docs.select(F.col("doc_id").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    spans = pii_spans(given).where("spans <> ''").select(F.col("doc_id").alias("id"), "text_hash", "spans").distinct()

    @F.pandas_udf("string")
    def cut(texts, found):
        out = []
        for value, listed in zip(texts, found, strict=True):
            if value is None or not listed:
                out.append(value)
                continue
            made, at = [], 0
            for a, b, kind in sorted((int(s.split(":")[1]), int(s.split(":")[2]), s.split(":")[0]) for s in listed.split(",")):
                if a >= at:
                    made += [value[at:a], f"[{kind.upper()}]"]
                at = max(at, b)
            out.append("".join(made) + value[at:])
        import pandas as pd

        return pd.Series(out, dtype=object)

    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"))
    value = F.col(f"whole.`{text}`")
    hashed = whole.withColumn("hash_of", F.xxhash64(F.coalesce(value.cast("string"), F.lit(""))))
    joined = hashed.join(spans, F.col("whole.doc_id").cast("long").eqNullSafe(F.col("id")) & (F.col("hash_of") == F.col("text_hash")), "left")
    done = joined.select("whole", cut(value.cast("string"), F.col("spans")).alias("done"))
    return done.select(*(F.col("done").alias(c) if c == text else F.col(f"whole.`{c}`") for c in docs.columns))
