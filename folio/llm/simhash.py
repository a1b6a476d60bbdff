"""SimHash near-duplicates with a hierarchical index over Gray-ordered fingerprints.

Distinct fingerprints are sorted by Gray rank, in which those that share leading bits are neighbours. The
upper nodes of the index are the cells of that order: the fingerprints of one leading bit pattern, about
CELL of them. The patterns themselves make a tree; pairs of its nodes are descended together, the
differences of the masked, shared bits add up, and a pair of groups over the threshold is pruned whole.
The pairs of cells left are dealt out, one task to a cell and those it meets, where the tree goes on below
the pattern in the same way down to single fingerprints. A task returns one link per fingerprint to its
local class, never pairs. There is no other path at any size; a cell with many more fingerprints than CELL
is cut into pieces that meet like cells.

near_duplicates() takes five-word shingles and links texts with Jaccard similarity of 0.8 or more. Its
first candidates are the index's links, confirmed by the whole sets; as similar texts can differ in more
bits than the threshold, an exact set join over rare shingles (nearcopies.py) then finds every link left.

Defined results: a null, empty or blank text has fingerprint zero and links like any other; repeated
rows share a fingerprint; a null doc_id gets the class of its fingerprint, null where that has no other
doc_id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import nearcopies
from folio.llm.common import arrow_map, table, written
from folio.llm.components import Classes, components

SHINGLE, SEED = 3, 42
#: Fingerprints of a cell, about, and leading bits of a pattern at most (its counts go to the driver).
CELL, PATTERN_BITS = 2048, 20
#: Guests a task compares with its cell at once.
GUESTS = 65_536


def fingerprint(text: str | None, words_each: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= words_each:
        return digest(b" ".join(words), SEED)
    ones, n = np.zeros(64, np.int64), len(words) - words_each + 1
    for i in range(0, n, 65536):
        part = words[i : min(n, i + 65536) + words_each - 1]
        hashes = np.array([digest(b" ".join(g), SEED) for g in zip(*(part[j:] for j in range(words_each)))], dtype=np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words_each: int = SHINGLE) -> DataFrame:
    """doc_id, fp long (the 64 bits, signed)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = lambda c: [c[0], np.array([fingerprint(t, words_each) for t in c[1]], dtype=np.uint64).view(np.int64).tolist()]
    return arrow_map(docs.select("doc_id", "text"), f"doc_id {kind}, fp long", signed)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the reflected Gray sequence."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class Ranked:
    """Fingerprints sorted by Gray rank, and per level (so many leading bits) the first place of each node."""

    def __init__(self, fps: np.ndarray):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.x = fps[self.order]
        changed = self.x[1:] ^ self.x[:-1]
        self.starts = {top: np.r_[0, np.flatnonzero(changed >> np.uint64(64 - top)) + 1, len(fps)] for top in range(STEP, 65, STEP)}


#: Bits from one level of the tree to the next.
STEP = 4


def near_pairs(a: Ranked, b: Ranked, most: int = 2, chunk: int = 400_000):
    """Yield arrays (i, j) of places in a's and b's fingerprints with at most `most` differing bits; of a with itself each pair once."""
    if not len(a.x) or not len(b.x):
        return
    same, tops = a is b, []
    for top in range(STEP, 65, STEP):  # levels in which no node has split say nothing of their own
        if top == 64 or not tops or any(len(r.starts[top]) > len(r.starts[tops[-1]]) for r in (a, b)):
            tops.append(top)
    masks = [np.uint64(((1 << (top - low)) - 1) << (64 - top)) for low, top in zip([0, *tops], tops)]
    kids = [[np.searchsorted(r.starts[down], r.starts[up]) for up, down in zip(tops, tops[1:])] for r in (a, b)]
    n, m = len(a.starts[tops[0]]) - 1, len(b.starts[tops[0]]) - 1
    i, j = np.triu_indices(n) if same else (np.repeat(np.arange(n), m), np.tile(np.arange(m), n))
    stack = [(0, i, j, np.zeros(len(i), np.int64))]
    while stack:
        k, i, j, apart = stack.pop()
        apart = apart + np.bitwise_count((a.x[a.starts[tops[k]][i]] ^ b.x[b.starts[tops[k]][j]]) & masks[k])
        live = apart <= most
        i, j, apart = i[live], j[live], apart[live]
        if k == len(tops) - 1:
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield a.order[a.starts[64][i]], b.order[b.starts[64][j]]
            continue
        first_a, first_b = kids[0][k], kids[1][k]
        width = first_b[j + 1] - first_b[j]
        sizes = (first_a[i + 1] - first_a[i]) * width
        for s, e in cut(sizes, chunk):
            rep = np.repeat(np.arange(s, e), sizes[s:e])
            within = np.arange(len(rep)) - np.repeat(np.cumsum(sizes[s:e]) - sizes[s:e], sizes[s:e])
            ni, nj = first_a[i[rep]] + within // width[rep], first_b[j[rep]] + within % width[rep]
            if same:  # a node with itself gives each pair of its children once
                once = ni <= nj
                ni, nj, rep = ni[once], nj[once], rep[once]
            stack.append((k + 1, ni, nj, apart[rep]))


def cut(sizes: np.ndarray, most: int):
    """Ranges of consecutive items whose sizes sum to about `most`."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


class Cells:
    """The leading patterns that occur, the pieces of each, and the cells within the threshold of each other."""

    def __init__(self, bits: int, patterns: np.ndarray, counts: np.ndarray, most: int):
        self.bits, self.patterns = bits, patterns
        self.pieces = -(-counts // (2 * CELL))
        self.first = np.cumsum(self.pieces) - self.pieces
        left = (patterns << np.uint64(64 - bits)) if bits else patterns
        tree = Ranked(left)
        pairs = [np.array(p) for p in near_pairs(tree, tree, most)]
        i, j = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
        home = np.where((i + j) % 2 == 1, np.minimum(i, j), np.maximum(i, j))  # each cell has about half of its pairs
        guest = i + j - home
        order = np.argsort(guest, kind="stable")
        self.home, self.bounds = home[order], np.searchsorted(guest[order], np.arange(len(patterns) + 1))

    def of(self, fps: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.patterns, fps >> np.uint64(64 - self.bits)) if self.bits else np.zeros(len(fps), np.int64)

    def visits(self, cell: int, piece: int) -> np.ndarray:
        """The tasks that a piece of a cell goes to as a guest."""
        homes = self.home[self.bounds[cell] : self.bounds[cell + 1]]
        other = [np.arange(self.first[h], self.first[h] + self.pieces[h]) for h in homes]
        return np.concatenate([*other, np.arange(self.first[cell], self.first[cell] + piece)])


def cells(distinct: DataFrame, most: int) -> Cells | None:
    n = distinct.count()
    if not n:
        return None
    bits = min(PATTERN_BITS, max(0, math.ceil(math.log2(n / CELL))))
    pattern = F.shiftrightunsigned("fp", 64 - bits) if bits else F.lit(0).cast("long")
    rows = distinct.groupBy(pattern.alias("p")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    p, counts = rows.column(0).to_numpy().astype(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(p)
    return Cells(bits, p[order], counts[order], most)


def links(distinct: DataFrame, most: int = 2) -> DataFrame:
    """u, v: links between reps of distinct fingerprints (fp, rep), spanning what is within `most` differing bits."""
    index = cells(distinct, most)
    if index is None:
        return distinct.select(F.col("rep").alias("u"), F.col("rep").alias("v")).limit(0)

    def deal(batches):
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            cell = index.of(fps)
            piece = ((gray_rank(fps) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % index.pieces[cell]
            task = index.first[cell] + piece
            order = np.argsort(task, kind="stable")
            cuts = np.flatnonzero(np.diff(task[order], prepend=-1))
            for s, e in zip(cuts, [*cuts[1:], len(order)]):
                own = order[s:e]
                to = np.r_[task[own[0]], index.visits(cell[own[0]], int(piece[own[0]]))]
                for t in range(0, len(to), max(1, 500_000 // len(own))):
                    some = to[t : t + max(1, 500_000 // len(own))]
                    part = b.take(pa.array(np.tile(own, len(some))))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, len(own))), pa.array(np.repeat(some != task[own[0]], len(own))), *part.columns], names=["task", "guest", "fp", "rep"])

    rows = distinct.select("fp", "rep").mapInArrow(deal, "task long, guest boolean, fp long, rep long").repartition("task").sortWithinPartitions("task", "guest")

    def compared(own: tuple, guests: tuple | None):
        reps, classes = own[1], None
        if guests is None:
            classes = Classes(len(reps))
            for i, j in near_pairs(own[0], own[0], most):
                classes.link(i, j)
        else:
            reps = np.r_[reps, guests[1]]
            classes = Classes(len(reps))
            for i, j in near_pairs(own[0], Ranked(guests[0]), most):
                classes.link(i, j + len(own[1]))
        linked = np.flatnonzero(classes.root != np.arange(len(reps)))
        return pa.RecordBatch.from_arrays([pa.array(reps[linked], pa.int64()), pa.array(reps[classes.root[linked]], pa.int64())], names=["u", "v"])

    def run(batches):
        at, own, held, size = None, None, [], 0

        def flush():
            nonlocal own, held, size
            if held:
                fps, reps = (np.concatenate(x) for x in zip(*held))
                if own is None:
                    own = (Ranked(fps), reps)
                    yield compared(own, None)
                else:
                    yield compared(own, (fps, reps))
            held, size = [], 0

        for b in batches:
            key = b.column(0).to_numpy() * 2 + b.column(1).to_numpy(zero_copy_only=False)
            cuts = np.r_[0, np.flatnonzero(np.diff(key)) + 1] if len(key) else []
            for s, e in zip(cuts, [*cuts[1:], len(key)]):
                if at != key[s] or size > GUESTS and key[s] % 2:
                    yield from flush()
                    if at is None or at // 2 != key[s] // 2:
                        own = None
                    at = key[s]
                held.append((b.column(2)[s:e].to_numpy().view(np.uint64), b.column(3)[s:e].to_numpy()))
                size += e - s
        yield from flush()

    return rows.mapInArrow(run, "u long, v long")


def simhash_classes(docs: DataFrame, words_each: int = SHINGLE, most: int = 2) -> DataFrame:
    """doc_id, fp long, component_id: the smallest doc_id reachable by links of at most `most` differing bits."""
    prints = written(fingerprints(docs, words_each), "simhash")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").cast("long").alias("rep")), "simhash-distinct")
    classes = components(written(links(distinct.where("rep is not null"), most), "simhash-links"), "simhash-classes")
    of = written(distinct.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "simhash-of")
    return prints.join(of.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, most: int = 2) -> DataFrame:
    """The rows that stay: of each class linked by five-word shingles with Jaccard similarity of 0.8 or more the one with the smallest doc_id (null the largest of all)."""

    def first(sets: DataFrame) -> DataFrame:
        """a, b: digests whose fingerprints the index links."""
        marks = written(sets.where("mark is not null").select(F.col("digest").alias("rep"), F.col("mark").bitwiseXOR(F.lit(-(1 << 63))).alias("fp")).distinct(), "simhash-sets")
        distinct = written(marks.groupBy("fp").agg(F.min("rep").alias("rep")), "simhash-distinct")
        shared = marks.join(distinct.withColumnRenamed("rep", "head").hint("merge"), "fp").where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b"))
        return links(distinct, most).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).unionByName(shared)

    return nearcopies.without_copies(docs, first)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its fingerprint and the class its links make."""
    return simhash_classes(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
