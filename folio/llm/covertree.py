"""Embedding near-duplicates by dual traversal of cover trees, exact at the threshold.

Equal directions (bitwise equal vectors) are one point with a count. Points are dealt to the nearest of
at most PIVOTS pivots, and cells larger than BLOCK to several blocks, so a block is small in space and in
number. Each block builds a cover tree: nested levels of centres whose radii halve from 2 downwards, the
centres of a level more than its radius apart, every point within the radius of a centre of the level.
Blocks whose pivots are further apart than the chord of the threshold plus both covering radii never meet.
Others are traversed together: a pair of nodes is pruned by the same bound, a pair of nodes of at most
LEAF points is compared as one tile, a matrix product of bounded size in double precision. A tile adds to
counts and local classes, so no list of all pairs exists. Components join local classes.

Defined results: vectors that are null, zero, or hold null, NaN or infinite components link with
nothing and are kept; vectors of other length link only among their length; repeated rows with equal
vectors link to each other; a null vec_id links with nothing; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import table, written
from folio.llm.components import Classes, components

#: Points of a block and of a tile; a task holds the trees of two blocks.
BLOCK, LEAF = 8192, 512
#: Pivots travel with the tasks, so their number is bounded; more points make larger cells, cut into blocks.
PIVOTS = 2048
#: Blocks that one task compares with its own.
TOGETHER = 32
SLACK = 1e-7


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision."""
    x = x.astype(float)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


def chords(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T)))


class CoverTree:
    """Points in tree order (`order`), and nodes over ranges of them: start, end, centre, covering radius, kids."""

    def __init__(self, x: np.ndarray, least: float):
        parent, level = self.separated(x, least)
        self.order: list[int] = []
        self.start, self.end, self.centre, self.radius, self.kids = [], [], [], [], []
        below: dict[int, dict[int, list[int]]] = {}
        for p in np.argsort(level, kind="stable").tolist():
            if p:
                below.setdefault(int(parent[p]), {}).setdefault(int(level[p]), []).append(p)
        size = np.ones(len(x), np.int64)
        for p in np.argsort(-level, kind="stable").tolist():
            if p:
                size[parent[p]] += size[p]
        self._node(x, 0, [below.get(0, {})[k] for k in sorted(below.get(0, {}))], below, size)

    @staticmethod
    def separated(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Each point's parent, and the level in which it becomes a centre. Points below the last radius go one level deeper."""
        n = len(x)
        parent, level = np.zeros(n, np.int64), np.full(n, -1)
        level[0], rest = 0, np.arange(1, n)
        near, apart = np.zeros(n - 1, np.int64), chords(x[1:], x[:1])[:, 0]  # of the rest: nearest centre and its distance
        radius, k = 2.0, 0
        while len(rest) and radius > least:
            radius, k = radius / 2, k + 1
            above = near.copy()  # centres of the level above
            while (far := np.flatnonzero(apart > radius)[:LEAF]).size:
                inner = chords(x[rest[far]], x[rest[far]])
                open_, new = np.ones(len(far), bool), []
                for i in range(len(far)):
                    if open_[i]:
                        new.append(i)
                        open_ &= inner[i] > radius
                chosen = far[new]
                points = rest[chosen]
                parent[points], level[points] = above[chosen], k
                left = np.ones(len(rest), bool)
                left[chosen] = False
                rest, near, apart, above = rest[left], near[left], apart[left], above[left]
                if len(rest):
                    to = chords(x[rest], x[points])
                    best = to.argmin(1)
                    closer = to[np.arange(len(rest)), best] < apart
                    near[closer], apart[closer] = points[best[closer]], to[np.arange(len(rest)), best][closer]
        parent[rest], level[rest] = near, k + 1
        return parent, level

    def _add(self, x, start, centre) -> int:
        inside = x[self.order[start:]]
        self.start.append(start)
        self.end.append(len(self.order))
        self.centre.append(centre)
        self.radius.append(float(chords(inside, centre[None])[:, 0].max()) + SLACK)
        self.kids.append([])
        return len(self.start) - 1

    def _points(self, p, groups, below) -> list[int]:
        out, todo = [], [(p, groups)]
        while todo:
            q, own = todo.pop()
            out.append(q)
            for g in own:
                for c in g:
                    todo.append((c, [below[c][k] for k in sorted(below[c])] if c in below else []))
        return out

    def _node(self, x, p, groups, below, size) -> int:
        """The node of centre p with its children of these levels, the first the coarsest."""
        start = len(self.order)
        total = 1 + sum(int(size[c]) for g in groups for c in g)
        if total <= LEAF or not groups:
            self.order += self._points(p, groups, below)
            return self._add(x, start, x[p])
        kids, bundle = [], len(self.order)

        def closed():
            nonlocal bundle
            if len(self.order) > bundle:  # small children beside each other are one tile
                mean = x[self.order[bundle:]].mean(0)
                kids.append(self._add(x, bundle, mean / max(1e-12, np.sqrt(mean @ mean))))
            bundle = len(self.order)

        for c in groups[0]:
            own = [below[c][k] for k in sorted(below[c])] if c in below else []
            if size[c] > LEAF:
                closed()
                kids.append(self._node(x, c, own, below, size))
                bundle = len(self.order)
            else:
                if len(self.order) - bundle + size[c] > LEAF:
                    closed()
                self.order += self._points(c, own, below)
        closed()
        kids.append(self._node(x, p, groups[1:], below, size))
        k = self._add(x, start, x[p])
        self.kids[k] = kids
        return k

    @property
    def root(self) -> int:
        return len(self.start) - 1


class Points:
    """A block's points of one length, in tree order, with their tree."""

    def __init__(self, reps: np.ndarray, ns: np.ndarray, v: np.ndarray, least: float):
        x = unit(v)
        self.tree = CoverTree(x, least)
        order = np.array(self.tree.order)
        single = v.astype(np.float32)
        self.v = (single if (single == v).all() else v)[order]
        self.reps, self.ns = reps[order], ns[order]
        self.tree.order = []
        self.centres = np.array(self.tree.centre)
        self.tree.centre = []


def tiles(a: Points, b: Points, chord: float):
    """Pairs of nodes without kids that may hold linked points; of a block with itself each pair once."""
    ta, tb, same = a.tree, b.tree, a is b
    stack = [(ta.root, tb.root)]
    while stack:
        i, j = stack.pop()
        ki, kj = ta.kids[i], tb.kids[j]
        if not ki and not kj:
            yield i, j
        elif same and i == j:
            stack += near(a, b, [(p, q) for m, p in enumerate(ki) for q in ki[m:]], chord)
        elif ki and (not kj or ta.end[i] - ta.start[i] >= tb.end[j] - tb.start[j]):
            stack += near(a, b, [(p, j) for p in ki], chord)
        else:
            stack += near(a, b, [(i, q) for q in kj], chord)


def near(a: Points, b: Points, pairs: list[tuple[int, int]], chord: float) -> list[tuple[int, int]]:
    """The pairs of nodes whose balls are within the chord of each other."""
    i, j = np.array(pairs).T
    apart = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", a.centres[i], b.centres[j])))
    live = apart <= chord + np.array(a.tree.radius)[i] + np.array(b.tree.radius)[j] + SLACK
    return [p for p, keep in zip(pairs, live.tolist()) if keep]


def compared(a: Points, b: Points, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """u, v, n: for each point with a link between a and b the rows linked, and a local class (u to v)."""
    same, chord = a is b, math.sqrt(max(0.0, 2 - 2 * cosine))
    xa = unit(a.v)
    xb = xa if same else unit(b.v)
    shift = 0 if same else len(xa)
    counts, classes = np.zeros(shift + len(xb), np.int64), Classes(shift + len(xb))
    for i, j in tiles(a, b, chord):
        s, t = slice(a.tree.start[i], a.tree.end[i]), slice(b.tree.start[j], b.tree.end[j])
        cos = xa[s] @ xb[t].T
        if cos.max() < cosine:
            continue
        hit = cos >= cosine
        if same and i == j:
            np.fill_diagonal(hit, False)
        counts[s] += hit @ b.ns[t]
        if not (same and i == j):
            counts[slice(t.start + shift, t.stop + shift)] += a.ns[s] @ hit
        p, q = np.nonzero(hit)
        classes.link(p + s.start, q + t.start + shift)
    reps = a.reps if same else np.r_[a.reps, b.reps]
    own = np.flatnonzero(counts)
    return reps[own], reps[classes.root[own]], counts[own]


def usable(v) -> F.Column:
    """Whether a vector can link; never null."""
    bad = v.isNull() | (F.size(v) == 0) | F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) | F.forall(v, lambda c: c == 0)
    return ~F.coalesce(bad, F.lit(True))


class Cells:
    """The pivots of each vector length, and of each cell its covering radius and its blocks' numbers."""

    def __init__(self, pivots: dict[int, np.ndarray]):
        self.pivots, self.of = pivots, {}

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = self.pivots.get(x.shape[1])
        if known is None:  # a length that no pivot has is one cell, never pruned
            return np.zeros(len(x), np.int64), np.full(len(x), 2.0)
        d = chords(x, known)
        at = d.argmin(1)
        return at, d[np.arange(len(x)), at]

    def number(self, rows) -> int:
        """Give the blocks of all cells their numbers. rows: dim, pivot, n, radius. Returns the number of blocks."""
        at, self.cell = 0, []
        for r in sorted(rows, key=lambda r: (r["dim"], r["pivot"])):
            pieces = -(-r["n"] // BLOCK)
            self.of[r["dim"], r["pivot"]] = (at, pieces, r["radius"])
            self.cell += [(r["dim"], r["pivot"])] * pieces
            at += pieces
        return at

    def partners(self, block: int, chord: float) -> np.ndarray:
        """The blocks that may hold points linked with the block's, itself among them."""
        dim, pivot = self.cell[block]
        cells = [(p, x) for (d, p), x in self.of.items() if d == dim]
        if dim in self.pivots:
            apart = chords(self.pivots[dim][[p for p, _ in cells]], self.pivots[dim][pivot][None])[:, 0]
            live = apart <= chord + self.of[dim, pivot][2] + np.array([x[2] for _, x in cells]) + SLACK
            cells = [c for c, keep in zip(cells, live) if keep]
        return np.concatenate([np.arange(at, at + pieces) for _, (at, pieces, _) in cells])


def home(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of two blocks' tasks compares them: each gets about half of its pairs."""
    return np.where((a + b) % 2 == 1, np.minimum(a, b), np.maximum(a, b))


def by_size(b: pa.RecordBatch, column: int):
    """Parts of a batch with vectors of one length: the part and its matrix."""
    sizes = b.column(column).value_lengths().to_numpy()
    for dim in np.unique(sizes).tolist():
        part = b.filter(pa.array(sizes == dim))
        yield part, part.column(column).flatten().to_numpy().reshape(-1, dim)


def in_cells(points: DataFrame, cells: Cells) -> DataFrame:
    """dim, pivot, apart, rep, n, v for each point."""

    def run(batches):
        for b in batches:
            for part, v in by_size(b, 2) if b.num_rows else ():
                at, apart = cells.nearest(unit(v))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), v.shape[1], np.int32)), pa.array(at.astype(np.int32)), pa.array(apart), *part.columns], names=["dim", "pivot", "apart", "rep", "n", "v"])

    return points.select("rep", "n", "v").mapInArrow(run, f"dim int, pivot int, apart double, rep long, n long, v {dict(points.dtypes)['v']}")


def trees(placed: DataFrame, cells: Cells, blocks: int, cosine: float) -> DataFrame:
    """block int, tree binary: the pickled points of each block."""
    least, first = math.sqrt(max(0.0, 2 - 2 * cosine)) / 8, {k: (at, pieces) for k, (at, pieces, _) in cells.of.items()}

    def numbered(batches):
        for b in batches:
            rep = b.column(3).to_numpy()
            at = np.array([first[k] for k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]).reshape(-1, 2)
            mixed = (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            block = at[:, 0] + (mixed % np.maximum(1, at[:, 1]).astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), b.column(3), b.column(4), b.column(5)], names=["block", "rep", "n", "v"])

    rows = placed.mapInArrow(numbered, f"block int, rep long, n long, v {dict(placed.dtypes)['v']}").repartition(blocks, "block").sortWithinPartitions("block", "rep")

    def made(block, parts):
        reps, ns, v = (np.concatenate(x) for x in zip(*parts))
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([pickle.dumps(Points(reps, ns, v, least), 5)], pa.binary())], names=["block", "tree"])

    def run(batches):
        held, last = [], None
        for b in batches:
            block = b.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(block, prepend=-1 if last is None else last)).tolist()
            for s, e in zip([0, *cuts], [*cuts, b.num_rows]):
                if s in cuts and held:
                    yield made(last, held)
                    held = []
                if e > s:
                    part, last = b.slice(s, e - s), int(block[s])
                    held += [(p.column(1).to_numpy(), p.column(2).to_numpy(), v) for p, v in by_size(part, 3)]
        if held:
            yield made(last, held)

    return rows.mapInArrow(run, "block int, tree binary")


def dealt(stored: DataFrame, cells: Cells, blocks: int, chord: float) -> DataFrame:
    """home, part, guest, block, tree: a block's tree (guest 0) with those it is compared with (guest 1), TOGETHER at most."""

    def run(batches):
        for b in batches:
            for block, tree in zip(b.column(0).to_pylist(), b.column(1)):
                others = cells.partners(block, chord)
                at = home(others, np.full(len(others), block))
                own = np.unique(others[at == block] // TOGETHER)
                visits = others[(at != block)]
                for homes, parts, guest in ((np.full(len(own), block), own, 0), (visits, np.full(len(visits), block // TOGETHER), 1)):
                    for h, p in zip(homes.tolist(), parts.tolist()):
                        yield pa.RecordBatch.from_arrays([pa.array([h], pa.int32()), pa.array([p], pa.int32()), pa.array([guest], pa.int32()), pa.array([block], pa.int32()), pa.array([tree.as_py()], pa.binary())], names=["home", "part", "guest", "block", "tree"])

    rows = stored.mapInArrow(run, "home int, part int, guest int, block int, tree binary")
    return rows.repartition(max(1, blocks * -(-blocks // TOGETHER)), "home", "part").sortWithinPartitions("home", "part", "guest", "block")


def linked(points: DataFrame, n: int, cosine: float) -> DataFrame:
    """u, v, n_links: per rep and pair of blocks the rows of other points linked, and a local class (u to v)."""
    chord = math.sqrt(max(0.0, 2 - 2 * cosine))
    most = min(PIVOTS, -(-2 * n // BLOCK))
    sample = points.select("v", F.xxhash64("rep", F.lit("pivot")).alias("h")).orderBy("h").limit(most).collect()
    pivots: dict[int, list] = {}
    for r in sample:
        pivots.setdefault(len(r.v), []).append(r.v)
    cells = Cells({d: unit(np.array(v)) for d, v in pivots.items()})
    placed = written(in_cells(points, cells), "vector-cells")
    blocks = cells.number(placed.groupBy("dim", "pivot").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("radius")).collect())
    stored = written(trees(placed, cells, max(1, blocks), cosine), "vector-trees")

    def run(batches):
        own, last = None, None
        for b in batches:
            for h, p, guest, tree in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4)):
                points = pickle.loads(tree.as_py())
                if not guest:
                    own, last = points, (h, p)
                    b_ = own if h // TOGETHER == p else None
                else:
                    b_ = points
                if b_ is not None and (h, p) == last:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in compared(own, b_, cosine)], names=["u", "v", "n_links"])

    return dealt(stored, cells, max(1, blocks), chord).mapInArrow(run, "u long, v long, n_links long")


def near_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors(vec_id, embedding)."""
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{element if element in ('float', 'double') else 'double'}>").alias("v"))
    same = F.transform("v", lambda c: c + F.lit(0).cast("float"))  # -0 is 0
    good = usable(F.col("v")) & F.col("vec_id").isNotNull()
    keyed = rows.where(good).withColumns({"m1": F.xxhash64(same), "m2": F.xxhash64(F.reverse(same), F.lit(1))})
    points = written(keyed.groupBy("m1", "m2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")), "vectors")
    found = written(linked(points, points.count(), cosine), "vector-links")
    classes = components(found.select("u", "v"), "vector-classes")
    sums = found.groupBy("u").agg(F.sum("n_links").alias("others"))
    whole = points.select("m1", "m2", "rep", "n").join(sums.withColumnRenamed("u", "rep"), "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    of = written(whole.select("m1", "m2", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "vector-points")
    ids = keyed.select("vec_id", "m1", "m2").join(of.hint("merge"), ["m1", "m2"]).select("vec_id", "n_links", "component_id")
    lone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return ids.unionByName(lone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector of embeddings with its links at cosine 0.95 or more and the class they make."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
