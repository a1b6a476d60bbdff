"""Document fingerprints: Merkle trees over the sections and paragraphs of a text.

Leaves are the sentences of paragraphs with the white space after them (long ones in steps of STEP
characters), so leaves together are the whole text. Paragraphs (lines) hash their leaves, sections hash
paragraphs up to one whose hash ends the section, the root hashes the sections and the text. Section ends
depend on content, so an edit moves no later one. The fingerprint is the root and, per section, its hash
and the leaves of its paragraphs.

Two fingerprints with equal roots are equal texts. Otherwise their trees are descended together: children
with equal hashes that stand in the same order on both sides are equal branches and are not looked into;
what stands between two of them is compared one level down. Leaves that find no equal are the edits, and
their places in the texts are known. The likeness is the share of characters in equal branches.

Each document is compared with an edited text and with the next document by doc_id. Documents are dealt by
ranges of doc_id and streamed in order; the first document of a range is also sent to the range before it.

Defined results: null and empty texts share one fingerprint, like only each other (1.0); different texts
are less than 1.0 like; repeated doc_ids follow each other by text; a null doc_id comes first; the next of
the last document is the first, which may be itself; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import table

SENTENCE = re.compile(r"[.!?]\s+")
STEP, SECTION = 200, 8
#: Ranges of doc_id, whose bounds travel with the tasks; with more documents ranges are longer, and they are streamed.
RANGES = 10_000


def short(data: bytes) -> str:
    return hashlib.blake2b(data, digest_size=6).hexdigest()


class Node:
    """A branch: its hash, its characters and its children (none for a leaf)."""

    __slots__ = ("hash", "size", "kids")

    def __init__(self, hash_: str, size: int, kids: list[Node]):
        self.hash, self.size, self.kids = hash_, size, kids


def paragraph(text: str) -> Node:
    ends = [m.end() for m in SENTENCE.finditer(text)]
    leaves = [text[i : min(i + STEP, e)] for s, e in zip([0, *ends], [*ends, len(text)]) for i in range(s, e, STEP)]
    return above([Node(short(x.encode("utf-8", "surrogatepass")), len(x), []) for x in leaves])


def above(kids: list[Node]) -> Node:
    return Node(short("/".join([f"{k.hash}.{k.size}" for k in kids]).encode()), sum([k.size for k in kids]), kids)


class Tree:
    """The sections of a text under its root."""

    def __init__(self, root: str, sections: list[Node]):
        self.root, self.sections = root, sections

    @classmethod
    def of(cls, text: str | None) -> Tree:
        text = text or ""
        lines = text.split("\n")
        sections, open_ = [], []
        for line in [*(x + "\n" for x in lines[:-1]), *lines[-1:]]:
            if line:
                open_.append(paragraph(line))
                if int(open_[-1].hash, 16) % SECTION == 0:
                    sections.append(above(open_))
                    open_ = []
        if open_:
            sections.append(above(open_))
        whole = hashlib.blake2b(text.encode("utf-8", "surrogatepass")).digest()
        return cls(hashlib.blake2b("/".join([s.hash for s in sections]).encode() + whole, digest_size=16).hexdigest(), sections)

    def __str__(self) -> str:
        """root/section:leaf.size,leaf.size;leaf.size/section:... with `;` between paragraphs."""
        return "/".join([self.root, *[f"{s.hash}:" + ";".join([",".join([f"{x.hash}.{x.size}" for x in p.kids]) for p in s.kids]) for s in self.sections]])

    @classmethod
    def read(cls, print_: str) -> Tree:
        """The tree of a fingerprint."""
        root, *sections = print_.split("/")
        leaf = lambda x: Node(x[:12], int(x[13:]), [])
        return cls(root, [above([above([leaf(x) for x in p.split(",")]) for p in s.split(":", 1)[1].split(";")]) for s in sections])


def fingerprint(text: str | None) -> str:
    return str(Tree.of(text))


def aligned(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """Places of equal nodes, rising on both sides: of the pairs of equal k-th occurrences a longest such run."""
    head = 0
    while head < min(len(a), len(b)) and a[head].hash == b[head].hash:
        head += 1
    places: dict[str, list[int]] = {}
    for j in range(len(b) - 1, head - 1, -1):
        places.setdefault(b[j].hash, []).append(j)
    tops, chain = [], []  # the least last place of a run of each length, and each pair with the one before it
    for i in range(head, len(a)):
        if left := places.get(a[i].hash):
            j = left.pop()
            at = bisect_left(tops, j, key=lambda t: chain[t][1])
            chain.append((i, j, tops[at - 1] if at else -1))
            tops[at : at + 1] = [len(chain) - 1]
    run, at = [], tops[-1] if tops else -1
    while at >= 0:
        i, j, at = chain[at]
        run.append((i, j))
    return [*((i, i) for i in range(head)), *reversed(run)]


def compared(a: Tree, b: Tree) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Characters in equal branches, and the edits: ranges (start, end in a, start, end in b) that differ."""
    if a.root == b.root:
        return sum(s.size for s in a.sections), []
    edits: list[tuple[int, int, int, int]] = []

    def level(xa: list[Node], xb: list[Node], at_a: int, at_b: int) -> int:
        same, i, j = 0, 0, 0
        for p, q in [*aligned(xa, xb), (len(xa), len(xb))]:
            gap_a, gap_b = xa[i:p], xb[j:q]
            size_a, size_b = sum([x.size for x in gap_a]), sum([x.size for x in gap_b])
            if gap_a and gap_b and (gap_a[0].kids or gap_b[0].kids):
                same += level([k for x in gap_a for k in x.kids], [k for x in gap_b for k in x.kids], at_a, at_b)
            elif gap_a or gap_b:
                edits.append((at_a, at_a + size_a, at_b, at_b + size_b))
            at_a, at_b = at_a + size_a, at_b + size_b
            if p < len(xa):
                same += xa[p].size
                at_a, at_b = at_a + xa[p].size, at_b + xb[q].size
            i, j = p + 1, q + 1
        return same

    return level(a.sections, b.sections, 0, 0), edits


def likeness(a: Tree, b: Tree) -> float:
    """Characters in equal branches over all; 1 for equal roots alone."""
    if a.root == b.root:
        return 1.0
    same = compared(a, b)[0]
    return same / max(1, sum(s.size for s in a.sections) + sum(s.size for s in b.sections) - same)


def edited(text: str, after: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edits", pa.string())])
ROWS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edits string"


def with_next(docs: DataFrame, rows_each: int = 2000) -> DataFrame:
    """bucket int, late int, doc_id, text: ranges of doc_id, each with the row that follows it as its last (late = 1)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    parts = min(RANGES, max(1, -(-n // rows_each)))
    found = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else []
    cuts = np.array(sorted(set(found or [])), np.int64)

    def bucket(ids: pa.Array) -> np.ndarray:
        return np.where(ids.is_valid().to_numpy(zero_copy_only=False), np.searchsorted(cuts, ids.fill_null(0).to_numpy(), "right"), -1)

    def least(batches):
        held: dict[int, int | None] = {}
        for b in batches:
            for k, x in zip(bucket(b.column(0)).tolist(), b.column(0).to_pylist()):
                if k not in held or k >= 0 and x < held[k]:
                    held[k] = x
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.int64())], names=["bucket", "head"])

    heads = sorted(tuple(r) for r in docs.select("doc_id").mapInArrow(least, "bucket int, head long").groupBy("bucket").agg(F.min("head")).collect())
    before = np.array([heads[i - 1][0] for i in range(len(heads))], np.int32)  # of the first it is the last
    nulls = bool(heads) and heads[0][0] == -1
    known = np.array([h for _, h in heads[nulls:]], np.int64)

    def deal(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0)
            own = bucket(ids)
            at = np.searchsorted(known, ids.fill_null(0).to_numpy())
            late = np.where(own < 0, nulls, (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == ids.fill_null(0).to_numpy()) if len(known) else False)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(np.zeros(len(own)), pa.int32()), *b.columns], names=["bucket", "late", "doc_id", "text"])
            if late.any():
                some, to = b.filter(pa.array(late)), np.where(own < 0, 0, at + nulls)[late]
                yield pa.RecordBatch.from_arrays([pa.array(before[to], pa.int32()), pa.array(np.ones(len(to)), pa.int32()), *some.columns], names=["bucket", "late", "doc_id", "text"])

    return docs.mapInArrow(deal, "bucket int, late int, doc_id long, text string").repartition(parts, "bucket").sortWithinPartitions("bucket", "late", "doc_id", "text")


def merkle(docs: DataFrame) -> DataFrame:
    """A row of ROWS for each document; edits: start:end of the original that differs and start:end of the edited text."""

    def run(batches):
        held, out = None, []  # the row whose next is awaited: bucket, doc_id, text, tree
        for b in batches:
            for bucket, late, doc, text in zip(b.column(0), b.column(1), b.column(2), b.column(3)):
                bucket, late, doc, text = bucket.as_py(), late.as_py(), doc.as_py(), text.as_py()
                if late and (held is None or held[0] != bucket):
                    continue  # further rows with the head's doc_id
                tree = Tree.of(text)
                if held is not None:
                    _, d, t, own = held
                    e = edited(t, text)
                    et = Tree.of(e)
                    edits = ",".join([f"{i}:{j}>{p}:{q}" for i, j, p, q in compared(own, et)[1]])
                    out.append((d, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), str(own), str(et), likeness(own, et), likeness(own, tree), edits))
                held = None if late else (bucket, doc, text, tree)
                if len(out) >= 200:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out), SCHEMA)], schema=SCHEMA)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out), SCHEMA)], schema=SCHEMA)

    return with_next(docs).mapInArrow(run, ROWS)


def op8_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint, that of its edited text, their likeness and that to the next document."""
    return merkle(table(spark, sf_dir, "documents"))
