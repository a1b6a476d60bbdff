"""Near copies by exact Jaccard similarity of word shingles, as an exact set-similarity join.

Two texts are linked when the sets of their SHINGLE-word shingles have Jaccard similarity of at least
SIMILARITY. Sets in one order of all shingles that are that similar share a shingle among their first
n - ceil(SIMILARITY n) + 1 (prefix filter), so pairs that meet under such a key are all that can be linked.
Any order gives the same links; shingles found often go last, so that few sets meet without being
similar. Pairs whose sizes or whose places of the key in that order leave too few shingles to share are
refuted at once; each other pair that meets is confirmed by its whole sets, unless both are already in one
class. Looked at first are the pairs that simhash.py finds, and under each key those of the set whose SimHash
is nearest to the majority of the key's sets: the original of a large group of copies links its group
before copies could meet each other.

Defined results: a text of up to SHINGLE words is one shingle; a null, empty or blank text has none and
is a copy of any other such text; words are ASCII-lowered and cut at ASCII white space. Shingles are
known by 64-bit hashes, equal sets by a 64-bit digest of these, rows by a 64-bit hash of all columns.
Sets are made from the texts whenever they are needed: written down they are larger than the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import arrow_map, dropped, given_back, written
from folio.llm.components import components

SHINGLE, SIMILARITY = 5, Fraction(4, 5)
#: Documents from which on a shingle counts as frequent, and how many of those the order knows; neither changes a result.
OFTEN, OFTEN_MOST = 20, 500_000
NO_WORDS = np.zeros(0, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return NO_WORDS
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return np.array([digest(b" ".join(words), len(words))], np.uint64)
    of = {w: digest(w) for w in set(words)}
    h = np.array([of[w] for w in words], np.uint64)
    n = len(h) - SHINGLE + 1
    x = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(x)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_length(n: int) -> int:
    """Shingles of a set of n of which a similar set has one at least."""
    return n - -(-n * SIMILARITY.numerator // SIMILARITY.denominator) + 1


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SIMILARITY.denominator >= SIMILARITY.numerator * (len(a) + len(b) - both)


def of_hashes(hashes: np.ndarray) -> int:
    """64-bit SimHash of hashed shingles."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(np.ascontiguousarray(hashes[i : i + 65536]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def digest_of(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63)


def sets_of(docs: DataFrame) -> DataFrame:
    """doc_id, row, digest, mark, n, bits for each row; the set's SimHash, number and bitmap only where the task has not met the digest before."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(cols, seen):
        out = [cols[0], cols[1], [], [], [], []]
        for t in cols[2]:
            own = shingles(t)
            d = digest_of(own)
            out[2].append(d)
            for to, x in zip(out[3:], (None,) * 3 if d in seen else (of_hashes(own) - (1 << 63), len(own), bitmap(own))):
                to.append(x)
            if len(seen) > 1_000_000:
                seen.clear()
            seen.add(d)
        return out

    rows = docs.select("doc_id", F.xxhash64(*docs.columns).alias("row"), "text")
    return arrow_map(rows, f"doc_id {kind}, row long, digest long, mark long, n int, bits binary", each, set)


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Digest and shingles of each text of the first column that has any and whose set the task has not met before."""
    seen: set[int] = set()
    for b in batches:
        for t in b.column(0):
            own = shingles(t.as_py())
            d = digest_of(own)
            if len(own) and d not in seen:
                yield d, own
            if len(seen) > 1_000_000:
                seen.clear()
            seen.add(d)


def repeated(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The values that are in the arrays twice or more, sorted, and how often; held is emptied, and only the repeats are copied."""
    x = np.concatenate(held)
    held.clear()
    x.sort()
    found, n = np.unique(x[1:][x[1:] == x[:-1]], return_counts=True)
    return found, n + 1


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that tasks meet in two documents or more, sorted, and their ranks by count."""

    def run(batches):
        held, size = [], 0
        for _, own in met(batches):
            held.append(own)
            size += len(own)
            if size > 4_000_000:
                yield from out(held)
                held, size = [], 0
        yield from out(held)

    def out(held):
        if held:
            x, n = repeated(held)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    found = docs.select("text").mapInArrow(given_back(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    rows = found.orderBy(F.desc("n"), "key").limit(OFTEN_MOST).select("key").toArrow().column(0).to_numpy()
    keys = np.ascontiguousarray(rows[::-1]).view(np.uint64)  # the rarest first
    at = np.argsort(keys)
    return keys[at], at


def prefixes(docs: DataFrame, often: np.ndarray, ranks: np.ndarray) -> DataFrame:
    """KEYED rows: the first shingles of each set in the common order, with their places in it."""

    def run(batches):
        parts, size = [], 0
        for d, x in met(batches):
            most, mark = prefix_length(len(x)), of_hashes(x) - (1 << 63)
            if len(often):
                at = np.searchsorted(often, x)
                at[at == len(often)] = 0
                known = often[at] == x
                if known.any():
                    x = np.concatenate([x[~known], x[known][np.argsort(ranks[at[known]])]])
            parts.append((x[:most].view(np.int64), np.full(most, d), np.full(most, len(x), np.int32), np.arange(most, dtype=np.int32), np.full(most, mark)))
            size += most
            if size > 200_000:
                yield out(parts)
                parts, size = [], 0
        if parts:
            yield out(parts)

    def out(parts):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["key", "digest", "n", "place", "mark"])

    return docs.select("text").mapInArrow(given_back(run), KEYED)


#: A key of a set: the set's digest and size, the key's place in it, the set's SimHash.
KEYED = "key long, digest long, n int, place int, mark long"


def by_runs(rows: DataFrame, schema: str, each) -> DataFrame:
    """each(columns as arrays) for the rows of each run of the first column, over runs of two rows or more; rows of one run must stand together.

    Pairs (a, b) are given with a < b, and once for all runs of a task, or of a part of it where it has very many.
    """
    names, pairs = [f.split()[0] for f in schema.split(", ")], schema == PAIRS

    def run(batches):
        held, made = None, []
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if held is not None:
                cols = [np.concatenate(c) for c in zip(held, cols)]
            changes = np.flatnonzero(cols[0][1:] != cols[0][:-1])
            last = int(changes[-1]) + 1 if len(changes) else 0  # the last run may go on
            held = [c[last:] for c in cols]
            yield from out([c[:last] for c in cols], made)
        if held is not None:
            yield from out(held, made)
        if made:
            yield batch(made)

    def out(cols, made):
        starts = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]]) if len(cols[0]) else np.zeros(0, int)
        ends = np.r_[starts[1:], len(cols[0])]
        many = ends - starts > 1
        size = sum(len(m[0]) for m in made)
        for s, e in zip(starts[many], ends[many]):
            for m in each([c[s:e] for c in cols]):
                made.append(m)
                size += len(m[0])
                if size > 500_000:
                    if pairs:
                        made[:] = [distinct(made)]
                        size = len(made[0][0])
                    if not pairs or size > 250_000:
                        yield batch(made)
                        made.clear()
                        size = 0

    def distinct(made):
        a, b = (np.concatenate(c) for c in zip(*made))
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        return a[first], b[first]

    def batch(made):
        cols = distinct(made) if pairs else [np.concatenate(c) for c in zip(*made)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    return rows.mapInArrow(given_back(run), schema)


PAIRS = "a long, b long"


def possible(n: np.ndarray, place: np.ndarray, i: int) -> np.ndarray:
    """Which sets of a key can be similar to its i-th, by sizes and by the key's places: 9 shared >= 4 sizes, for 0.8."""
    own, at = n.astype(np.int64), place.astype(np.int64)
    most = np.minimum(at, at[i]) + np.minimum(own - at, own[i] - at[i])
    p, q = SIMILARITY.numerator, SIMILARITY.denominator
    return (p + q) * most >= p * (own + own[i])


def fresh(cols):
    """The distinct sets of a key that two or more sets hold."""
    digest, at = np.unique(cols[1], return_index=True)
    if len(digest) > 1:
        yield [c[at] for c in cols]


def stars(cols):
    """Pairs of the set nearest to the majority of a key's SimHashes with all it may be similar to, then of those left, and so on."""
    _, digest, n, place, mark = cols
    marks = mark.view(np.uint64) ^ np.uint64(1 << 63)
    left = np.arange(len(n))
    while len(left) > 1:
        bits = np.unpackbits(np.ascontiguousarray(marks[left]).view(np.uint8).reshape(-1, 8), axis=1)
        middle = np.packbits(2 * bits.sum(0, dtype=np.int64) > len(left)).view(np.uint64)[0]
        at = np.lexsort((digest[left], np.bitwise_count(marks[left] ^ middle)))[0]
        near = possible(n[left], place[left], at)
        near[at] = False
        if near.any():
            yield np.full(int(near.sum()), digest[left[at]]), digest[left[near]]
        near[at] = True
        left = left[~near]


#: A key of a set of a class; and with the task that compares the key's sets.
PLACED = "key long, digest long, n int, place int, component long"
DEALT = PLACED + ", task long"
#: Tasks among which the keys that begin with one class are dealt. A pair that shares very many keys so meets in few tasks, each of which gives it once.
SPREAD = 8


def unlike(cols):
    """The sets of a key that holds sets of different classes, with their task."""
    if not (cols[4] == cols[4][0]).all():
        task = mixed(cols[4].min(keepdims=True).view(np.uint64) + mixed(cols[0][:1].view(np.uint64)) % np.uint64(SPREAD))
        yield [*cols, np.repeat(task.view(np.int64), len(cols[0]))]


def across(cols):
    """Pairs of a key's sets that are in different classes and may be similar."""
    digest, n, place, of, bits = cols[1:6]
    if (of == of[0]).all():
        return
    bits = np.frombuffer(b"".join(bits), np.uint64).reshape(-1, BITS // 64)
    for i in range(len(n) - 1):
        other = i + np.flatnonzero(possible(n[i:], place[i:], 0) & (of[i:] != of[i]))
        other = other[may_share(n, bits, i, other)]
        if len(other):
            yield np.full(len(other), digest[i]), digest[other]


#: Bits of a set's bitmap of shingles.
BITS = 1024


def bitmap(hashes: np.ndarray, bits: int = BITS) -> bytes:
    """A bit for each shingle, by its hash."""
    out = np.zeros(bits, bool)
    out[(hashes >> np.uint64(20)) % np.uint64(bits)] = True
    return np.packbits(out).tobytes()


def may_share(n: np.ndarray, bits: np.ndarray, i: int, other: np.ndarray) -> np.ndarray:
    """Whether the others can share enough shingles with the i-th set: a bit that one lacks is a shingle that it lacks."""
    return enough(n[i : i + 1], bits[i : i + 1], n[other], bits[other])


def enough(n: np.ndarray, bits: np.ndarray, m: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles with these bitmaps can share enough, row by row."""
    n, m = n.astype(np.int64), m.astype(np.int64)
    here, there = n - np.bitwise_count(bits & ~others).sum(1, dtype=np.int64), m - np.bitwise_count(others & ~bits).sum(1, dtype=np.int64)
    p, q = SIMILARITY.numerator, SIMILARITY.denominator
    return (p + q) * np.minimum(here, there) >= p * (n + m)


def plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that their bitmaps do not refute, written; so whole texts move for these alone."""
    maps = sets.where("bits is not null").select("digest", "n", "bits").dropDuplicates(["digest"])
    ends = [maps.select(F.col("digest").alias(e), F.col("n").alias(f"n_{e}"), F.col("bits").alias(f"bits_{e}")) for e in ("a", "b")]
    both = pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")

    def run(batches):
        for b in batches:
            one, two = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint64).reshape(-1, BITS // 64) for k in (3, 5))
            live = enough(b.column(2).to_numpy(), one, b.column(4).to_numpy(), two)
            yield b.select(["a", "b"]).filter(pa.array(live))

    return written(both.mapInArrow(given_back(run), PAIRS), "copies-plausible")


#: Digests (8 bytes each) that every task is given, so that not all texts are dealt out; more of them are met by sorting. Neither changes a result.
FEW = 1_000_000


def of_these(docs: DataFrame, sets: DataFrame, digests: DataFrame) -> DataFrame:
    """digest, text: one text for each of these digests."""
    ends = written(digests.distinct(), "copies-ends")
    side = F.broadcast if ends.count() <= FEW else lambda df: df.hint("merge")
    rows = sets.join(side(ends), "digest", "left_semi").groupBy("digest").agg(F.min("row").alias("row"))
    return docs.select(F.xxhash64(*docs.columns).alias("row"), "text").join(side(rows), "row").select("digest", "text").dropDuplicates(["digest"])


def compared(pairs: DataFrame, held: DataFrame, schema: str, read: Callable, test: Callable[[object, object], bool], label: str) -> DataFrame:
    """The pairs (a, b) with test(read(x of a), read(x of b)) under the names of schema, written. held: digest, x."""
    names = [f.split()[0] for f in schema.split(", ")]
    known = F.broadcast if pairs.count() <= FEW else lambda df: df  # few pairs go to the texts, not the texts to the pairs
    heads = held.join(known(pairs.select(F.col("a").alias("digest")).distinct()), "digest", "left_semi").select(F.col("digest").alias("a"), F.lit(None).cast("long").alias("b"), "x")
    rows = held.withColumnRenamed("digest", "b").join(known(pairs), "b").select("a", "b", "x").unionByName(heads).repartition("a").sortWithinPartitions("a", F.asc_nulls_first("b"))

    def run(batches):
        head = None
        for batch in batches:
            us, vs = [], []
            for u, v, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = read(x.as_py())
                if v is None:
                    head = own
                elif test(head, own):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=names)

    return written(rows.mapInArrow(given_back(run), schema), label)


def wide(hashes: np.ndarray) -> bytes:
    """Number of shingles and a bitmap of them with at least two bits for each, so that it can refute long sets too."""
    bits = BITS
    while bits < 2 * len(hashes):
        bits *= 2
    return np.int64(len(hashes)).tobytes() + bitmap(hashes, bits)


def wide_enough(one: bytes, two: bytes) -> bool:
    """Whether sets with these wide bitmaps can share enough; the wider is folded to the other's bits."""
    n, m = (np.frombuffer(x, np.int64, 1) for x in (one, two))
    a, b = (np.frombuffer(x, np.uint64, -1, 8) for x in (one, two))
    least = min(len(a), len(b))
    a, b = (np.bitwise_or.reduce(x.reshape(-1, least), 0, keepdims=True) for x in (a, b))
    return bool(enough(n, a, m, b)[0])


def confirmed(docs: DataFrame, pairs: DataFrame, sets: DataFrame, label: str) -> DataFrame:
    """u, v: the pairs (a, b) whose sets are similar, written."""
    used = written(of_these(docs, sets, pairs.select(F.explode(F.array("a", "b")).alias("digest"))), "copies-used")
    maps = written(arrow_map(used, "digest long, x binary", lambda c: [c[0], [wide(shingles(t)) for t in c[1]]]), "copies-wide")
    live = compared(pairs, maps, PAIRS, bytes, wide_enough, "copies-live")
    dropped(maps)
    out = compared(live, used.withColumnRenamed("text", "x"), "u long, v long", shingles, similar, label)
    dropped(used)
    dropped(live)
    return out


def classes(docs: DataFrame, sets: DataFrame, candidates: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, component: the class of each digest that has a link to another. candidates: pairs (a, b) looked at first."""
    rows = prefixes(docs, *frequent(docs)).repartition("key").sortWithinPartitions("key")
    shared = written(by_runs(rows, KEYED, fresh), "copies-keys")
    sort = lambda df: df.repartition("key").sortWithinPartitions("key")
    first = written(by_runs(sort(shared), PAIRS, stars).unionByName(candidates(sets)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "copies-stars")
    links = confirmed(docs, plausible(first, sets), sets, "copies-links")
    known = written(components(links, "copies-first"), "copies-known")
    placed = shared.join(known.withColumnRenamed("node", "digest"), "digest", "left").select("key", "digest", "n", "place", F.coalesce("component", "digest").alias("component"))
    # bitmaps go only to the keys that still hold sets of different classes
    apart = written(by_runs(sort(placed), DEALT, unlike), "copies-apart")
    dropped(shared)
    maps = sets.where("bits is not null").select("digest", "bits").dropDuplicates(["digest"])
    mapped = apart.join(maps, "digest").select("key", "digest", "n", "place", "component", "bits", "task").repartition("task").sortWithinPartitions("task", "key")
    second = written(by_runs(mapped, PAIRS, across).distinct().join(first, ["a", "b"], "left_anti"), "copies-across")
    dropped(apart)
    more = confirmed(docs, second, sets, "copies-more")
    return written(components(links.unionByName(more), "copies-all"), "copies-classes")


def without_copies(docs: DataFrame, candidates: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row of each class of near copies: that of the smallest doc_id, null the largest of all."""
    sets = written(sets_of(docs), "copies-sets")
    of = classes(docs, sets, candidates)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row")).alias("rank")
    least = sets.select("digest", rank).groupBy("digest").agg(F.min("rank").alias("rank"))
    best = least.join(of.withColumnRenamed("node", "digest"), "digest", "left").groupBy(F.coalesce("component", "digest").alias("c")).agg(F.min("rank").alias("rank"))
    kept = written(best.select(F.col("rank.row").alias("row")), "copies-kept")
    dropped(sets)
    # rows equal in all columns share a hash: one of them stays
    return docs.withColumn("row", F.xxhash64(*docs.columns)).join(kept.hint("merge"), "row", "left_semi").dropDuplicates(["row"]).select(*docs.columns)
