"""Toxicity: noisy-channel deobfuscation by Viterbi decoding, then scores of the restored text.

Stretches that look disguised (signs or digits beside letters, letters three times in a row, runs of
short fragments with any separators between them) become a lattice of characters. Each fragment is read
as letters, each sign as one of the letters it may stand for or as nothing, repeats merge or stay, each
separator is the edge of a word or nothing. A trigram character model of the corpus' plain words and the
costs of the channel choose the best path, and the words on it, so neighbours of a disguised word stay
words of their own. A lexicon of terms that separate labelled documents scores plain and restored words,
calibrated by isotonic regression on labelled documents that did not choose the terms.

The lexicon learns from at most TEACHERS labelled rows, those whose doc_id hashes lowest; what a few of
these rows say is bounded, so nothing else has a cap. Character counts, scores and results cover all rows.

Defined results: a null or empty text has no terms and the base score; labels that are null do not
teach, nor do those without a document; of labels with one doc_id the largest counts; repeated rows each
get a result; without labels every score is 0; other columns are not read. Time is linear in the text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import arrow_map, carried, flat_sum, held_out, table, written
from folio.llm.quality import isotonic

#: Letters that a sign may stand for (fixed values).
SIGNS = {"0": "o", "1": "il", "!": "i", "|": "il", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "+": "t", "8": "b", "9": "g", "(": "c", "6": "g", "2": "z"}
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
CODE = {c: i for i, c in enumerate(ALPHABET)}
EDGE = 26
READ = {c: [CODE[x] for x in v] for c, v in SIGNS.items()} | {c: [i] for c, i in CODE.items()}
WORD = re.compile(r"[^\W\d_]+")
#: A token is looked at again if it holds one of these; no repeats, so each search is linear.
ODD = re.compile(r"[a-z][^\w\s]|[^\w\s][a-z]|[a-z_][0-9_]|[0-9_][a-z]")
#: Marks around a word that are no part of a disguise, and a run of a sign that is decoration.
MARKS, DECORATION = ".,;:!?\"'()[]{}*#%&~^<>=/\\", re.compile(r"([^\w\s])\1{2,}")
#: Single characters with fragments of at most two after them, any white space between.
RUN = re.compile(r"(?<!\S)\S(?:\s++\S{1,2}(?!\S)){2,}")
STRETCH = re.compile(r"(.)\1{2,}")
#: Costs of the channel in natural logarithms: a sign read as a letter, a sign dropped, a repeat merged or kept, a separator dropped.
AS_LETTER, DROPPED, MERGED, KEPT, JOINED = 0.5, 4.0, 0.3, 1.0, 0.3
#: Letters of a lattice decoded at once; longer stretches go on from the best path so far.
PIECE = 400


class CharModel:
    """Log probabilities of the next letter after two (26 is the word's edge) by trigram counts with backing off to bigrams."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(27, 27, 27)
        c2 = c3.sum(0) + 0.1
        p2 = c2 / c2.sum(1, keepdims=True)
        p3 = (c3 + 5 * p2[None]) / (c3.sum(2, keepdims=True) + 5)
        self.log = np.log(p3).tolist()

    def restored(self, token: str) -> list[str]:
        """The words of the likeliest path. Separators are characters that READ does not know."""
        text = STRETCH.sub(r"\1\1", token)
        # state: the last two letters; value: log probability and the letters so far as a linked list
        best: dict[tuple[int, int], tuple[float, tuple]] = {(EDGE, EDGE): (0.0, ())}
        log = self.log
        for ch in text:
            after: dict[tuple[int, int], tuple[float, tuple]] = {}

            def offer(state, cost, path, after=after):
                if state not in after or cost > after[state][0]:
                    after[state] = (cost, path)

            letters = READ.get(ch)
            sign = ch not in CODE
            for (x, y), (cost, path) in best.items():
                if letters is None:  # a separator: nothing, or the edge of a word
                    offer((x, y), cost - JOINED, path)
                    if y != EDGE:
                        offer((EDGE, EDGE), cost + log[x][y][EDGE], (path, EDGE))
                    continue
                if y == EDGE:
                    x = EDGE
                for k in letters:
                    read = cost - AS_LETTER * sign
                    if k == y:
                        offer((x, y), read - MERGED, path)
                        read -= KEPT
                    offer((y, k), read + log[x][y][k], (path, k))
                if sign:
                    offer((x, y), cost - DROPPED, path)
            if len(after) > 8:  # paths far behind the best never catch up
                top = max([v[0] for v in after.values()]) - 12
                after = {s: v for s, v in after.items() if v[0] > top}
            best = after
        _, path = max(((cost + (log[x][y][EDGE] if y != EDGE else 0), path) for (x, y), (cost, path) in best.items()), key=lambda v: v[0])
        out = []
        while path:
            path, k = path
            out.append(" " if k == EDGE else ALPHABET[k])
        return "".join(reversed(out)).split()


def core(token: str) -> str:
    """What of a token may be disguised: no marks around it, no decoration; empty for a plain token."""
    if token.isalpha() and not STRETCH.search(token):
        return ""
    body = DECORATION.sub(r"\1", token).strip(MARKS)
    return body if ODD.search(body) or STRETCH.search(body) and not body.isdigit() else ""


def runs(low: str) -> list[str]:
    """Runs of three or more fragments, at least half of them single characters."""
    found = [m[0].split() for m in RUN.finditer(low)]
    return [" ".join(x) for x in found if 2 * sum(map(len, x)) <= 3 * len(x) and any(c in READ for c in x)]


def pieces(stretch: str) -> list[str]:
    """A stretch in parts of at most PIECE characters, cut at a separator where there is one."""
    out = []
    while len(stretch) > PIECE:
        cut = max(stretch.rfind(" ", 0, PIECE), PIECE // 2)
        out.append(stretch[:cut])
        stretch = stretch[cut:]
    return [*out, stretch] if stretch else out


def collapsed(word: str) -> str:
    """The word without repeats of a letter, under which stretched forms meet."""
    return "=" + re.sub(r"(.)\1+", r"\1", word)


def terms(text: str | None, model: CharModel, memory: dict) -> tuple[set[str], int]:
    """The distinct words of the text and of its restored stretches, and the number of distinct stretches restored."""
    low = (text or "").lower()
    found, n = set(WORD.findall(low)), 0
    for stretch in {*low.split(), *runs(low)}:
        words = memory.get(stretch)
        if words is None:
            words = ()
            for piece in pieces(stretch if " " in stretch else core(stretch)):
                words += tuple(y for w in model.restored(piece) if len(w) > 2 for y in (w, collapsed(w)))
            if len(memory) > REMEMBERED:
                memory.clear()
            if len(stretch) <= PIECE:
                memory[stretch] = words
        if words:
            found.update(words)
            n += 1
    return found, n


#: Tokens whose words a task remembers; more only cost time.
REMEMBERED = 200_000


def char_counts(docs: DataFrame) -> np.ndarray:
    """Letter trigrams of all texts' plain words (tokens of letters alone), summed by partition."""

    def run(batches):
        lut = np.full(256, EDGE, np.int64)
        lut[97:123] = np.arange(26)
        total = np.zeros(27**3)
        for b in batches:
            for s in range(0, b.num_rows, 100):
                plain = [w for t in b.column(0)[s : s + 100].to_pylist() if t for w in t.lower().split() if w.isalpha()]
                k = lut[np.frombuffer(f"  {'  '.join(plain)}  ".encode("utf-8", "surrogatepass"), np.uint8)]
                total += np.bincount(k[:-2] * 729 + k[1:-1] * 27 + k[2:], minlength=27**3)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "data"])

    total = flat_sum(docs.select("text").mapInArrow(run, "part int, data binary"))
    return np.zeros(27**3) if total is None else total


#: Labelled rows that teach at most; 16 bytes of each travel with the tasks. Of these, one in CALIBRATE chooses no terms.
TEACHERS, CALIBRATE = 100_000, 4
#: The fewest toxic teaching documents a term must be in, and bins of raw scores for calibration (parameters of the model).
LEAST_DOCS, BINS = 3, 400


def teachers(labels: DataFrame, modulus: int, remainder: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted doc_ids and labels of the rows that teach."""
    rows = labels.where(~held_out("doc_id", modulus, remainder) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), F.xxhash64(F.col("doc_id").cast("long"), F.lit("teach")).alias("h"))
    got = rows.groupBy("h", "doc_id").agg(F.max("toxic").alias("toxic")).orderBy("h", "doc_id").limit(TEACHERS).select("doc_id", "toxic").toArrow()
    ids, y = got.column(0).to_numpy(), got.column(1).to_numpy()
    order = np.argsort(ids, kind="stable")
    return np.ascontiguousarray(ids[order]).astype(np.int64), (y[order] > 0).astype(np.int8)


def toxicity_scores(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted, n_restored for each row, and the columns of carry as carried_<name>; labels(doc_id, toxic) teach where the document is not held out."""
    model = CharModel(char_counts(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids, marks = teachers(labels, modulus, remainder)

    def label(doc) -> int:
        """1 or 0 of a teaching document, -1 of others."""
        at = int(np.searchsorted(ids, doc)) if doc is not None else len(ids)
        return int(marks[at]) if at < len(ids) and ids[at] == doc else -1

    def words(cols, memory):
        out = [[], [], []]
        for doc, t in zip(*cols):
            y = label(doc)
            if y < 0:
                continue
            found = [*terms(t, model, memory)[0], ""]  # the empty term counts documents
            out[0] += found
            out[1] += [y] * len(found)
            out[2] += [doc % CALIBRATE == 0] * len(found)
        return out

    seen = arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), "term string, label int, apart boolean", words, dict).where("not apart")
    seen = written(seen.groupBy("term").agg(F.sum("label").cast("long").alias("a"), F.count(F.lit(1)).alias("all")), "toxicity-terms")
    sums = seen.where("term = ''").first()
    n, pos = (sums["all"], sums["a"]) if sums else (0, 0)
    neg = n - pos
    a, b = (F.col("a") + 0.5) / (pos + 1), (F.col("all") - F.col("a") + 0.5) / (neg + 1)
    # chi-squared with one degree of freedom over 50, and a tenfold likelihood: far above chance for any number of terms tested
    chi = (F.col("a") * neg - (F.col("all") - F.col("a")) * pos) ** 2 * n / (F.col("all") * (n - F.col("all") + 1e-9) * max(1, pos) * max(1, neg))
    chosen = seen.where((F.col("a") >= LEAST_DOCS) & (F.col("term") != "")).select("term", F.log(a / b).alias("w"), chi.alias("chi")).where("chi > 50 and w > 2.3")
    lexicon = {r.term: r.w for r in chosen.collect()} if pos else {}  # each term is in LEAST_DOCS of TEACHERS rows

    def raw(text, memory) -> tuple[float, int]:
        found, restored = terms(text, model, memory)
        return float(sum(sorted(lexicon[x] for x in found & lexicon.keys()))), restored

    def to_bin(x: float) -> int:
        return int(min(BINS - 1, x * 8 // 1))

    def taught(cols, memory):
        rows = [(to_bin(raw(t, memory)[0]), y) for d, t in zip(*cols) if (y := label(d)) >= 0 and d % CALIBRATE == 0]
        return [[x for x, _ in rows], [y for _, y in rows]]

    # only the teachers kept apart are scored for the curve; so no text is written before the one pass over all rows
    found = arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), "bin int, label int", taught, dict)
    bins = {r.bin: (r.n, r.pos) for r in found.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")).collect()}
    curve = isotonic(bins, BINS) if bins else np.zeros(BINS)

    def judged(cols, memory):
        out = [cols[0], [], []]
        for t in cols[1]:
            x, restored = raw(t, memory)
            out[1].append(float(curve[to_bin(x)]))
            out[2].append(restored)
        return out

    rows, named = carried(docs, carry)
    scored = arrow_map(rows, f"doc_id {kind}, score double, n_restored long", judged, dict, carry=named)
    return scored.select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_restored", *named)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its toxicity score."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
