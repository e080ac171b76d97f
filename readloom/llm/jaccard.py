"""N-gram Jaccard join by a token-group matrix (operator 8).

1. One pass hashes each document's distinct 5-word shingles (tokens) to a fingerprint, so that equal sets become one
   representative, and counts tokens. Those of the least hashes, from which prefixes are taken, are counted over all documents
   (four bytes each are shuffled); those of other hashes where a run of documents holds them twice. The FREQUENT most
   frequent of them come last in the global order of tokens, by count; all other tokens come first, by hash.
2. Two sets at the threshold share one of the first n - ceil(t n) + 1 tokens of each (their prefixes). A second pass
   emits prefixes; those of their tokens that two sets share at least form the rows of the matrix.
3. Tokens that at most CROWD sets hold relate every set to the few others, as groups of one. The number of prefix tokens that two
   sets share bounds their overlap, and only pairs within the bound are opened.
4. Sets that share a more frequent token are partitioned into groups of similar documents around a leader, the holder with the
   fewest rarer tokens. The union of the group's tokens is stored as differences from the leader's, with the number of members
   that have each. A member links to the leader, or it differs from it by so much that it must share differences with any
   other member that it links to; how many follows from the sizes. So a member queries its group by a prefix of its own
   differences, rarest first, and opens only members that share one of these and whose places in the order leave the overlap
   possible. Sets far from the leader keep the token and form further groups.
5. Opened pairs are compared exactly; links become components.
Everything but step 5 only saves work: every link between two different components is found exactly.

Why step 4 loses nothing: let d be the size of a member's difference from leader c, b = (1 - t) / (1 + t). x and y link if and only
if their difference is at most b (nx + ny), and x links to c if and only if dx <= b (nx + nc). If x does not, dx + dy > b (nx + ny) for every y
(dy >= |ny - nc| for those that do link), so their differences from c overlap in more than none. Jaccard distance is a metric, so all
partners of a member within OWN of the leader are within OWN + 1 - t of it; those take part too.

Defined results: a null text, a text without words and an empty text have no shingles and are alone; a text of one to
four words has its whole sequence as its one shingle. Rows that repeat an id are documents of their own, and so are rows without an
id, which name no component (one of theirs alone has none). The threshold is in whole percents, so no floating point decides a
link. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.components import components
from readloom.llm.shared import bounded, slices, stored, text_buffers, thinned
from readloom.llm.words import Words, mix, sequence_hash, windows

WORDS, PERCENT = 5, 80
#: Tokens of which the order knows a count (broadcast, 16 bytes each), and tokens of a run of documents that is counted at once.
FREQUENT, RUN = 1 << 20, 1 << 20
#: Low bits of a hash that its count does without, and bits within one of 2^12 ranges; the first LOW ranges are counted over all documents,
#: and the order knows such tokens that over KNOWN sets hold. A prefix is a fifth of a set, so a third of all hashes leaves room for others.
DROPPED, WITHIN, LOW, KNOWN = 24, 28, 1365, 8
#: Sets that may hold a token before they are grouped around leaders; rounds of leaders before what is left is paired as in step 3.
CROWD, ROUNDS = 32, 8
#: Percent of Jaccard similarity to the leader from which on a set belongs to its group.
OWN = 50


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(data, offsets, lower=True)
    hashes, _, numbers = windows(words.hash, words.counts, WORDS, salt=5)
    ends, first = np.cumsum(numbers), np.cumsum(words.counts) - words.counts
    out = []
    for i, n in enumerate(words.counts):
        if n >= WORDS:
            out.append(np.unique(hashes[ends[i] - numbers[i] : ends[i]]))
        elif n:
            out.append(np.array([sequence_hash(words.hash[first[i] : first[i] + n], 9)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets = text_buffers(column)
    for lo, hi in slices(offsets, 1 << 19):
        yield from enumerate(shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), lo)


def fingerprint(s: np.ndarray) -> int:
    """A signed 64-bit identity of a set."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        h = mix(s).sum(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.bitwise_xor.reduce(mix(s ^ np.uint64(0xABCDEF12345)))
    return int(mix(np.array([h + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _profile(texts: DataFrame) -> DataFrame:
    """doc_id, h (the text's hash), n, fp of each document; range, ids (four bytes each) of tokens in the first LOW ranges; and token,
    times of other tokens that a run of documents holds twice at least. Tokens are without their DROPPED bits."""
    types = {"doc_id": pa.int64(), "h": pa.int64(), "n": pa.int64(), "fp": pa.int64(), "range": pa.int32(), "ids": pa.binary(), "token": pa.int64(), "times": pa.int64()}

    def batch_of(**columns: pa.Array) -> pa.RecordBatch:
        k = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(k, t)) for c, t in types.items()], list(types))

    def counted(tokens: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        t = np.concatenate(tokens) >> np.uint64(DROPPED)
        t.sort()
        low = np.searchsorted(t, np.uint64(LOW << WITHIN))
        ranges = (t[:low] >> np.uint64(WITHIN)).astype(np.int32)
        first = np.flatnonzero(np.diff(ranges, prepend=-1))
        data = (t[:low] & np.uint64((1 << WITHIN) - 1)).astype("<u4").tobytes()
        ids = [data[4 * i : 4 * j] for i, j in zip(first.tolist(), [*first[1:].tolist(), low], strict=False)]
        yield batch_of(range=pa.array(ranges[first]), ids=pa.array(ids, pa.binary()))
        t, times = np.unique(t[low:], return_counts=True)
        yield batch_of(token=pa.array(t[times > 1].view(np.int64)), times=pa.array(times[times > 1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, held, seen = [], 0, set()
        for batch in batches:
            ns, fps = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for i, s in _sets(batch.column("text")):
                ns[i], fps[i] = len(s), fingerprint(s)
                if len(s) and fps[i] not in seen:
                    seen.add(fps[i])
                    tokens.append(s)
                    held += len(s)
                if held > RUN:
                    yield from counted(tokens)
                    tokens, held = [], 0
            yield batch_of(doc_id=batch.column("doc_id"), h=batch.column("h"), n=pa.array(ns), fp=pa.array(fps))
        if tokens:
            yield from counted(tokens)

    return texts.mapInArrow(run, "doc_id long, h long, n long, fp long, range int, ids binary, token long, times long")


def _low_counts(profile: DataFrame) -> DataFrame:
    """token, times of the tokens in the first LOW ranges that over KNOWN sets hold; a range is counted at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            t, times = np.unique(np.frombuffer(b"".join(parts), "<u4"), return_counts=True)
            t, times = t[times > KNOWN].astype(np.int64), times[times > KNOWN]
            return pa.RecordBatch.from_arrays([pa.array(t + (held << WITHIN)), pa.array(times)], ["token", "times"])

        held, parts = None, []
        for batch in batches:
            for r, ids in zip(batch.column("range").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if r != held and parts:
                    yield counted()
                    parts = []
                held = r
                parts.append(ids)
        if parts:
            yield counted()

    rows = profile.where("ids IS NOT NULL").select("range", "ids")
    return rows.repartition("range").sortWithinPartitions("range").mapInArrow(run, "token long, times long")


def _frequent(profile: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The FREQUENT most frequent tokens without their DROPPED bits, sorted, and their counts."""
    summed = profile.where("token IS NOT NULL").groupBy("token").agg(F.sum("times").alias("times"))
    counts = stored(_low_counts(profile).union(summed), "jaccard-frequent")
    least, left = 0, FREQUENT
    for row in counts.groupBy("times").count().orderBy(F.desc("times")).toLocalIterator():
        least, left = row["times"], left - row["count"]
        if left <= 0:
            break
    top = counts.where(f"times >= {least}")
    top = (top.orderBy(F.desc("times"), "token").limit(FREQUENT) if left < 0 else top).toArrow()
    tokens, times = top.column("token").to_numpy().view(np.uint64), top.column("times").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], times[order]


def prefix(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], percent: int, dropped: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first n - ceil(t n) + 1 tokens in the global order, and which of them are frequent (s is sorted by hash).

    Tokens that differ in no bit but the dropped ones are one to frequent; the order is of the token alone even so."""
    n = len(s)
    keep = n - (percent * n + 99) // 100 + 1
    tokens, times = frequent
    if not len(tokens):
        return s[:keep], np.zeros(keep, bool)
    ids = s >> np.uint64(dropped)
    at = np.minimum(np.searchsorted(tokens, ids), len(tokens) - 1)
    hit = tokens[at] == ids
    plain = s[~hit][:keep]
    if len(plain) == keep:
        return plain, np.zeros(keep, bool)
    late = s[hit][np.argsort(times[at[hit]], kind="stable")][: keep - len(plain)]
    return np.concatenate([plain, late]), np.arange(keep) >= len(plain)


_ROW = "token long, fp long, n int, pos int"


def _prefix_rows(texts: DataFrame, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> DataFrame:
    """token, fp, n, pos and frequent of the prefixes of distinct sets; sets that a task has given before are passed over."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            made, size = [], 0
            for _, s in _sets(batch.column("text")):
                if not len(s) or (fp := fingerprint(s)) in seen:
                    continue
                seen.add(fp)
                tokens, late = prefix(s, shared.value, percent, DROPPED)
                k = len(tokens)
                made.append((tokens.view(np.int64), np.full(k, fp), np.full(k, len(s), np.int32), np.arange(k, dtype=np.int32), late))
                size += k
                if size > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made, strict=True)], ["token", "fp", "n", "pos", "frequent"])
                    made, size = [], 0
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made, strict=True)], ["token", "fp", "n", "pos", "frequent"])

    return texts.mapInArrow(run, f"{_ROW}, frequent boolean")


def _repeated(rows: DataFrame) -> DataFrame:
    """Rows of tokens that two different sets share, from one shuffle and sort; a run of one token is streamed, not gathered.

    Rows of frequent tokens, which may be in the prefixes of a third of all sets, are dealt by set as well, and all stay.
    """
    names = ["token", "fp", "n", "pos", "frequent"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last token's single row so far
        open_token, last_fp = None, None  # a token known to be repeated, and the last of its sets
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            if held is not None:
                columns = [np.concatenate([a, b]) for a, b in zip(held, columns, strict=True)]
                held = None
            t, f = columns[:2]
            if not len(t):
                continue
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (f[1:] != f[:-1])
            if open_token is not None and t[0] == open_token and f[0] == last_fp:
                new[0] = False
            columns = [c[new] for c in columns]
            t, f = columns[:2]
            if not len(t):
                continue
            same = np.zeros(len(t), bool)
            same[1:] = t[1:] == t[:-1]
            keep = same.copy()
            keep[:-1] |= same[1:]
            if open_token is not None:
                keep |= t == open_token
            keep |= columns[4]
            if keep[-1]:
                open_token, last_fp = t[-1], f[-1]
            else:
                held = [c[-1:] for c in columns]
                open_token = None
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns[:4]], names[:4])

    salted = rows.withColumn("salt", F.when(F.col("frequent"), F.pmod(F.xxhash64("fp"), F.lit(1024))).otherwise(0).cast("int"))
    return salted.repartition("token", "salt").sortWithinPartitions("token", "salt", "fp").select(*names).mapInArrow(run, _ROW)


def _sets_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """fp and s (sorted shingle hashes, binary) of the wanted sets (fp, doc_id, h), by one more pass that hashes only their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fps, values, size = [], [], 0
            for _, s in _sets(batch.column("text")):
                if not len(s) or (fp := fingerprint(s)) in seen:
                    continue
                seen.add(fp)
                fps.append(fp)
                values.append(s.tobytes())
                size += len(values[-1])
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(values, pa.binary())], ["fp", "s"])
                    fps, values, size = [], [], 0
            if fps:
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(values, pa.binary())], ["fp", "s"])

    mark = F.xxhash64("doc_id", "h").alias("mark")  # a null id leaves the text's hash
    thin = thinned(texts.select(mark, "text"), wanted.select(mark), "mark")
    found = thin.select("text").mapInArrow(run, "fp long, s binary").join(bounded(wanted.select("fp")), "fp", "left_semi")
    return found.dropDuplicates(["fp"])  # equal sets of different tasks


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets reach the threshold, compared exactly."""
    joined = pairs.select("a", "b").join(sets.select(F.col("fp").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("fp").alias("b"), F.col("s").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _sizes_allow(percent: int) -> str:
    return f"x.fp < y.fp AND 100L * least(x.n, y.n) >= {percent}L * greatest(x.n, y.n)"


def _few_apart(rows: DataFrame, crowded: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of rows (token, fp, n) that share so many prefix tokens that a link is possible.

    Any overlap is at most the shared prefix tokens and what lies outside the prefix that ends first. crowded (fp, more): prefix tokens of
    a set that are no rows here.
    """
    joined = rows.alias("x").join(rows.alias("y"), (F.col("x.token") == F.col("y.token")) & F.expr(_sizes_allow(percent)))
    pairs = joined.groupBy(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).agg(F.count("*").alias("shared"), F.first("x.n").alias("na"), F.first("y.n").alias("nb"))
    more = lambda side: crowded.select(F.col("fp").alias(side), F.col("more").alias(f"more_{side}"))
    pairs = pairs.join(more("a"), "a", "left").join(more("b"), "b", "left").na.fill(0)
    outside = f"greatest(floor(({percent}L * na + 99) / 100), floor(({percent}L * nb + 99) / 100)) - 1"
    return pairs.where(f"{100 + percent}L * (shared + least(more_a, more_b) + {outside}) >= {percent}L * (na + nb)").select("a", "b")


def _differences(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of members (leader, fp): a row with a null token for each, and rows of the tokens in which it differs from the leader."""
    salts = members.groupBy("leader").agg(F.ceil(F.count("*") / 1000).alias("salts"))  # a leader of many is read by many tasks
    leaders = sets.join(bounded(salts.withColumnRenamed("leader", "fp")), "fp").select(F.col("fp").alias("leader"), F.col("s").alias("leader_s"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    salted = members.join(bounded(salts), "leader").select("leader", "fp", F.pmod(F.xxhash64("fp"), F.col("salts")).alias("salt"))
    own = sets.join(bounded(members.select("fp").distinct()), "fp", "left_semi")  # later rounds have few members, and would shuffle all sets
    joined = salted.join(own, "fp").join(leaders, ["leader", "salt"]).select("leader", "fp", "s", "leader_s")
    reach = max(1, OWN - (100 - percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, size = [], 0
            for leader, fp, x, c in zip(*(batch.column(k) for k in ("leader", "fp", "s", "leader_s")), strict=True):
                x, c = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.uint64)
                added = x[~np.isin(x, c, assume_unique=True)]
                common = len(x) - len(added)
                union = len(c) + len(added)
                rows = np.zeros(0, np.int64)
                if 100 * common >= reach * union:
                    lost = c[~np.isin(c, x, assume_unique=True)]
                    # A token that the leader has and the member lacks is another difference than one the other way round.
                    rows = np.concatenate([added, mix(lost ^ np.uint64(0x632BE59BD9B4E019))]).view(np.int64)
                k = len(rows) + 1
                value = lambda v, t=np.int64: np.full(k, v, t)  # noqa: B023, E731
                made.append((value(leader.as_py()), value(fp.as_py()), value(len(x)), value(len(c)), value(len(x) + len(c) - 2 * common), value(100 * common >= percent * union, bool), value(100 * common >= OWN * union, bool), np.append(rows, 0), np.arange(k) < k - 1))
                size += k
                if size > 100_000:
                    yield batch_of(made)
                    made, size = [], 0
            if made:
                yield batch_of(made)

    def batch_of(made: list) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*made, strict=True)]
        arrays = [pa.array(c) for c in columns[:7]]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(columns[7], mask=~columns[8])], ["leader", "fp", "n", "leader_n", "d", "linked", "own", "token"])

    return joined.mapInArrow(run, "leader long, fp long, n long, leader_n long, d long, linked boolean, own boolean, token long")


def _within_groups(differences: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of a group, not both linked to its leader, whose differences from it may overlap enough."""
    a, s = 100 - percent, 100 + percent
    rows = differences.where("token IS NOT NULL")
    union = rows.groupBy("leader", "token").agg(F.count("*").alias("members")).where("members > 1")
    shared = rows.join(union, ["leader", "token"])
    one = Window.partitionBy("leader", "fp")  # as many rows as one set differs from another in
    # Differences of one member alone come first.
    placed = shared.withColumn("pos", F.row_number().over(one.orderBy("members", "token")) - F.count("*").over(one) + F.col("d") - 1)
    near, least = f"floor(({s}L * d - {a}L * n + {a}L * leader_n) / {2 * s}) + 1", f"greatest(1, ceil(({s}L * d - {a}L * n - {a}L * leader_n) / {2 * s}))"
    asking = placed.where(f"pos <= d - CASE WHEN linked THEN {near} ELSE {least} END").select("leader", "token", "fp", "n", "d", "linked", "pos")
    overlap = f"{2 * s}L * least(x.d - x.pos, y.d - y.pos) >= {s}L * (x.d + y.d) - {a}L * (x.n + y.n)"
    same = (F.col("x.leader") == F.col("y.leader")) & (F.col("x.token") == F.col("y.token"))
    joined = asking.alias("x").join(asking.alias("y"), same & F.expr(f"{_sizes_allow(percent)} AND NOT (x.linked AND y.linked) AND {overlap}"))
    return joined.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()


def _crowded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose token at most CROWD sets hold (and two at least), and rows of tokens that more hold."""
    counts = stored(rows.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1"), "jaccard-counts")
    many = bounded(counts.where(f"sets > {CROWD}").select("token"))
    return rows.join(many, "token", "left_anti"), rows.join(many, "token", "left_semi")


def _links(texts: DataFrame, reps: DataFrame, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> DataFrame:
    """Links (a, b) between fingerprints that give the same components as all links."""
    rows = stored(_repeated(_prefix_rows(texts, frequent, percent)), "jaccard-matrix")
    few, many = _crowded(rows)
    many = stored(many, "jaccard-crowded")
    crowded = many.groupBy("fp").agg(F.count("*").alias("more"))
    pairs = stored(_few_apart(few, crowded, percent), "jaccard-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp")).union(many.select("fp")).distinct()
    sets = stored(_sets_of(texts, stored(wanted.join(reps, "fp").select("fp", "doc_id", "h"), "jaccard-wanted")), "jaccard-sets")
    links = []
    for turn in range(ROUNDS + 1):
        if many.isEmpty():
            break
        if turn == ROUNDS:
            plain = many.alias("x").join(many.alias("y"), (F.col("x.token") == F.col("y.token")) & F.expr(_sizes_allow(percent)))
            pairs = pairs.union(plain.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")))
            break
        leaders = stored(many.groupBy("token").agg(F.min_by("fp", F.struct(F.col("pos") / F.col("n"), "fp")).alias("leader")), "jaccard-leaders")
        held = many.join(bounded(leaders), "token")
        differences = stored(_differences(held.select("leader", "fp").distinct(), sets, percent), "jaccard-differences")
        heads = differences.where("token IS NULL")
        links.append(heads.where("linked AND leader <> fp").select(F.col("leader").alias("a"), F.col("fp").alias("b")))
        pairs = pairs.union(stored(_within_groups(differences, percent), "jaccard-opened"))
        left = stored(held.join(heads.where("own").select("leader", "fp"), ["leader", "fp"], "left_anti").drop("leader"), "jaccard-left")
        few, many = _crowded(left)
        few_pairs = few.alias("x").join(few.alias("y"), (F.col("x.token") == F.col("y.token")) & F.expr(_sizes_allow(percent)))
        pairs = pairs.union(few_pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")))
        many = stored(many, "jaccard-crowded")
    out = _linked(pairs.distinct(), sets, percent)
    for more in links:
        out = out.union(more)
    return stored(out, "jaccard-links")


def _components(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, h, n, fp and component_id of each row of docs."""
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    profile = stored(_profile(texts), "jaccard-profile")
    each = profile.where("fp IS NOT NULL").select("doc_id", "h", "n", "fp")
    # One row stands for each set, under the least id, or under none where all its rows lack one; hot sets are reduced before the shuffle.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h")).alias("least")
    reps = stored(each.where("n > 0").groupBy("fp").agg(least).select("fp", "least.doc_id", "least.h"), "jaccard-representatives")
    links = _links(texts, reps, _frequent(profile), percent)
    joint = components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("fp"), "component")
    named = reps.join(stored(joint, "jaccard-joint"), "fp")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = named.join(least, "component").select("fp", "component_id")
    labels = reps.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = each.join(labels, "fp", "left")
    return out.withColumn("component_id", F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")))


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) and set_id of each document.

    Rows without an id link like others, so that links pass through them; component_id is null where no row of a component has an id.
    """
    return _components(docs, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.when(F.col("n") > 0, F.col("fp")).alias("set_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component, the one with the least id; all columns pass unchanged, whatever their names.

    Documents without an id or without words stay; links pass through those without an id. Rows repeated under a kept id and text all stay.
    """
    found = _components(docs, percent).where("doc_id <> component_id").select("doc_id", "h").distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"))
    rows = rows.withColumns({"doc_id": F.col("whole.doc_id").cast("long"), "h": F.xxhash64(F.col("whole.text").cast("string"))})
    return rows.join(found, ["doc_id", "h"], "left_anti").select("whole.*")
