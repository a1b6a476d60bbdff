"""LM scoring: a gated recurrent language model in numpy with a class-factored softmax.

log P(word | past) = log P(class | state) + log P(slot | class, state) [+ log P(word | class, rest)]. A word's
class is its last two bytes (the most frequent endings of the corpus have classes of their own, the others
share one, the end of a text has one). The SLOTS most frequent words of a class have slots of their own; the
last slot is the rest of the class, where words follow add-one counts of all training tokens. Both softmaxes
see the state of a gated recurrent unit that reads class and slot of each word.

Training is truncated backpropagation over all training tokens, each once. Documents are dealt to shards of
about SHARD tokens by a hash of doc_id and ordered by it, so shards do not depend on how the table is
partitioned. Shards train in up to ROUNDS rounds, each from the mean, by tokens, of the replicas before it,
summed in the order of shards. Scoring carries the state across windows: a document's likelihood is that of
the whole.

Counts of the most frequent words travel with the tasks (FREQUENT entries at most); the occurrences of every
other word meet in a bucket and are counted there, so counts are exact at any size of vocabulary.

Defined results: a null or empty text is the end token alone; repeated rows each get a score; a null
doc_id is training data; without training documents every count is 0 and the model is the untrained one;
other columns are not read.
"""

from __future__ import annotations

import ctypes
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import STEP_BYTES, WORD_GAPS, arrow_map, given_back, held_out, table, written

#: Parameters of the model.
ENDINGS, SLOTS, HIDDEN, FREQUENT = 46, 31, 16, 150_000
CLASSES, EACH = ENDINGS + 2, SLOTS + 1
#: Steps of a window, streams trained side by side at most, tokens of a shard, rounds at most.
WINDOW, STREAMS, SHARD, ROUNDS = 20, 512, 2_000_000, 6
#: Buckets of rare words at least, rows of a block.
BUCKETS, BLOCK = 256, 1 << 15
#: Whether a byte stands between words.
GAP = np.isin(np.arange(256), list(WORD_GAPS))


def tokens(texts: list[str | None]) -> tuple[pa.BinaryArray, np.ndarray]:
    """Lower-cased words of each text and its end, one text after the other, and how many each text has."""
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*texts, b""]).lower(), np.uint8)  # a gap follows each text
    gap = np.concatenate([[True], GAP[data]])
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[::2], edges[1::2]
    words = np.diff(np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)), prepend=0)
    sizes = np.zeros(len(starts) + len(texts), np.int32)  # 0: an end
    sizes[np.arange(len(starts)) + np.repeat(np.arange(len(texts)), words)] = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[~gap[1:]])]), words + 1


def sigmoid(x: np.ndarray) -> None:
    """x becomes its sigmoid, by way of tanh(), which takes less than exp() and a division."""
    half = x.dtype.type(0.5)
    x *= half
    np.tanh(x, out=x)
    x *= half
    x += half


def softmax(x: np.ndarray, at: np.ndarray, probabilities: bool, bounded: bool = False) -> np.ndarray:
    """Log probability of the column at[i] of each row of logits x; x becomes the probabilities, if wanted. bounded: no row needs its largest logit taken off first."""
    if not bounded:
        x -= x.max(-1, keepdims=True)
    own = x.reshape(-1)[np.arange(0, x.size, x.shape[1]) + at]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[-1], x.dtype)
    if probabilities:
        x *= (1 / total)[:, None]
    return own - np.log(total)


def bounded(weights: np.ndarray, bias: np.ndarray, most: float = 60) -> np.ndarray:
    """Whether states within -1 and 1 give no logit over most, and in each row one over -most at least. So exp() keeps within single precision."""
    reach = np.abs(weights).sum(-2)
    return ((bias + reach).max(-1) < most) & ((bias - reach).max(-1) > -most)


def shares(x: np.ndarray, bounded: bool) -> np.ndarray:
    """What makes probabilities of each row of x, which becomes the exponentials of logits x."""
    if not bounded:
        x -= x.max(-1, keepdims=True)
    np.exp(x, out=x)
    return 1 / (x @ np.ones(x.shape[-1], x.dtype))


def by_code(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the codes, and the codes in that order: 16 bits each, which are sorted by radix."""
    codes = codes.astype(np.uint16)
    order = np.argsort(codes, kind="stable")
    return order, codes[order]


def classes(codes: np.ndarray) -> list[tuple[int, slice]]:
    """Each class of the ordered codes, and where it lies."""
    bounds = np.searchsorted(codes, np.arange(CLASSES + 1, dtype=np.uint16) * np.uint16(EACH)).tolist()
    return [(c, slice(*b)) for c, b in enumerate(zip(bounds, bounds[1:])) if b[0] < b[1]]


def with_ones(states: np.ndarray, order: np.ndarray) -> np.ndarray:
    """States in the order, each with a 1 that meets the bias."""
    out = np.empty((len(order), HIDDEN + 1), states.dtype)
    out[:, :-1], out[:, -1] = states.take(order, 0), 1
    return out


def blocks(n: int, rows: int = 2048) -> list[slice]:
    """Slices of n rows whose logits stay in the processor's cache."""
    return [slice(i, min(n, i + rows)) for i in range(0, n, rows)]


def keep_freed() -> None:
    """Freed memory stays with the process, so arrays of the next step need no new pages; given_back() returns it as a task ends. For glibc alone."""
    set_option = getattr(ctypes.CDLL(None), "mallopt", None)
    if set_option:
        set_option(-3, 32 << 20)  # M_MMAP_THRESHOLD
        set_option(-1, 256 << 20)  # M_TRIM_THRESHOLD


class Gru:
    """Gated recurrent unit over codes (class * EACH + slot), with a softmax over classes and one over each class's slots."""

    def __init__(self, class_bias: np.ndarray, slot_bias: np.ndarray, seed: int = 5):
        r = np.random.default_rng(seed)
        h, c = HIDDEN, CLASSES
        self.p = {"w": np.repeat(r.normal(0, 0.3, (c, 3 * h)), EACH, 0), "u": r.normal(0, 0.2, (h, 3 * h)), "b": np.zeros(3 * h), "o": r.normal(0, 0.1, (h, c)), "d": class_bias.copy(), "s": np.zeros((c, h, EACH)), "e": slot_bias.copy()}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()]).astype(float)

    def set_flat(self, x: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = x[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size

    def gates(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of codes, with biases, and of states, by gate: what is worked on lies side by side, so numpy's loops are long."""
        w, u = ((x.reshape(len(x), 3, HIDDEN).transpose(1, 0, 2)) for x in (self.p["w"] + self.p["b"], self.p["u"]))
        return np.ascontiguousarray(w), np.ascontiguousarray(u)

    def states(self, h: np.ndarray, x: np.ndarray, keep: list | None = None, gates: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All states before each step's token, and the state after. x: steps by streams of codes. keep gets both gates and the new values, and the gated states."""
        w, u = gates or self.gates()
        all3 = w.take(x, 1)  # the gates' inputs, then their outputs
        out = np.empty((len(x), len(h), HIDDEN), h.dtype)
        gated, zr = np.empty_like(out) if keep is not None else np.empty((1, *h.shape), h.dtype), np.empty((2, *h.shape), h.dtype)
        for t in range(len(x)):
            out[t] = h
            a, g, rh = all3[:2, t], all3[2, t], gated[t if keep is not None else 0]
            a += np.matmul(h, u[:2], out=zr)
            sigmoid(a)
            g += np.matmul(np.multiply(a[1], h, out=rh), u[2], out=zr[0])
            np.tanh(g, out=g)
            h = g - h
            h *= a[0]
            h += out[t]
        if keep is not None:
            keep += [all3, gated]
        return out, h

    def softmaxes(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the class softmax and of each class's slots, with the biases as a last row: what a 1 beside each state meets."""
        p = self.p
        return np.concatenate([p["o"], p["d"][None]]), np.concatenate([p["s"], p["e"][:, None]], 1)

    def likelihood(self, states: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural log likelihood of each code after its state, and that of its class alone."""
        p, (every, slots) = self.p, self.softmaxes()
        order, codes = by_code(codes)
        states, first = with_ones(states, order), np.empty(len(codes), states.dtype)
        k, slot = codes // EACH, codes % EACH
        safe, small = bool(bounded(p["o"], p["d"])), bounded(p["s"], p["e"]).tolist()
        for own in blocks(len(codes)):
            first[own] = softmax(states[own] @ every, k[own], False, safe)
        whole = first.copy()
        for c, own in classes(codes):
            whole[own] += softmax(states[own] @ slots[c], slot[own], False, small[c])
        out = np.empty((2, len(codes)), first.dtype)
        out[0, order], out[1, order] = whole, first
        return out[0], out[1]

    def slopes(self, states: np.ndarray, order: np.ndarray, codes: np.ndarray, grads: dict) -> np.ndarray:
        """Gradient, at the states, of the mean negative log likelihood of the ordered codes; grads get those of both softmaxes."""
        p, n, (every, slots) = self.p, len(codes), self.softmaxes()
        states, back = with_ones(states, order), np.empty_like(states)
        k, slot = codes // EACH, codes % EACH
        safe, small = bool(bounded(p["o"], p["d"])), bounded(p["s"], p["e"]).tolist()

        def slope(own: slice, at: np.ndarray, weights: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray]:
            """Gradients at weights, and at the states own."""
            x = states[own] @ weights
            x *= (shares(x, safe) / x.dtype.type(n))[:, None]
            x.reshape(-1)[np.arange(0, x.size, x.shape[1]) + at[own]] -= x.dtype.type(1 / n)
            return states[own].T @ x, x @ weights[:-1].T

        total = np.zeros_like(every)
        for own in blocks(n):
            g, back[own] = slope(own, k, every, safe)
            total += g
        grads["o"][:], grads["d"][:] = total[:-1], total[-1]
        for c, own in classes(codes):
            g, more = slope(own, slot, slots[c], small[c])
            grads["s"][c], grads["e"][c] = g[:-1], g[-1]
            back[own] += more
        out = np.empty_like(back)
        out[order] = back
        return out

    def train(self, stream: np.ndarray, rate: float = 0.01) -> None:
        """Truncated backpropagation over windows of parallel streams, by Adam. stream: codes of documents in a row."""
        width = min(STREAMS, max(1, len(stream) // (40 * WINDOW)))
        # the last stream is filled up from the start, so no token is left out
        x = np.concatenate([stream, np.resize(stream, -len(stream) % width)]).reshape(width, -1).T
        h = np.zeros((width, HIDDEN), np.float32)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step, t in enumerate(range(0, len(x), WINDOW), 1):
            grads, h = self.gradient(h, x[t : t + WINDOW])
            speed = np.float32(rate / (1 + step / 400) / (1 - 0.9**step))
            scale = np.float32(1 / (1 - 0.99**step))
            for k, g in grads.items():
                np.clip(g, -1, 1, out=g)
                m[k] *= np.float32(0.9)
                m[k] += np.float32(0.1) * g
                s[k] *= np.float32(0.99)
                s[k] += np.float32(0.01) * g * g
                self.p[k] -= speed * m[k] / (np.sqrt(s[k] * scale) + np.float32(1e-6))

    def gradient(self, h: np.ndarray, x: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean negative log likelihood of x's codes, and the state after."""
        p, n, keep, (w, u) = self.p, HIDDEN, [], self.gates()
        states, last = self.states(h, x, keep, (w, u))
        all3, gated = keep
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        order, codes = by_code(x.ravel())
        dout = self.slopes(states.reshape(-1, n), order, codes, grads).reshape(states.shape)
        back, each = np.ascontiguousarray(u.transpose(0, 2, 1)), np.empty_like(all3)
        dh, through, rest, drh = np.zeros_like(h), np.empty((2, *h.shape), h.dtype), np.empty_like(h), np.empty_like(h)
        for t in range(len(x) - 1, -1, -1):
            (z, r, g), (dz, dr, dg) = all3[:, t], each[:, t]
            np.subtract(1, z, out=rest)
            np.multiply(g, g, out=dg)  # dh * z * (1 - g * g)
            np.subtract(1, dg, out=dg)
            dg *= z
            dg *= dh
            np.matmul(dg, back[2], out=drh)
            np.subtract(g, states[t], out=dz)  # dh * (g - before) * z * (1 - z)
            dz *= z
            dz *= rest
            dz *= dh
            np.subtract(1, r, out=dr)  # drh * before * r * (1 - r)
            dr *= gated[t]
            dr *= drh
            np.matmul(each[:2, t], back[:2], out=through)
            dh *= rest
            drh *= r
            dh += drh
            dh += through[0]
            dh += through[1]
            dh += dout[t]
        flat, before = each.reshape(3, -1, n), states.reshape(-1, n).T
        for i, past in enumerate((before, before, gated.reshape(-1, n).T)):
            own = slice(i * n, (i + 1) * n)
            grads["u"][:, own] = past @ flat[i]
        starts = np.flatnonzero(np.diff(codes, prepend=codes[0] + np.uint16(1)))
        pairs = flat.take(order, 1).view(np.result_type(flat.dtype, 1j))  # two numbers are summed at once
        sums = np.add.reduceat(pairs, starts, 1).view(flat.dtype)
        grads["w"].reshape(-1, 3, n)[codes[starts]] = sums.transpose(1, 0, 2)
        grads["b"][:] = sums.sum(1).ravel()
        return grads, last

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log likelihood of each document's codes, its state carried from window to window."""
        sizes = np.array([len(d) for d in docs])
        order = np.argsort(-sizes, kind="stable")
        flat, firsts, sizes = np.concatenate(docs), (np.cumsum(sizes) - sizes)[order], sizes[order]
        total, h, at = np.zeros(len(docs)), np.zeros((len(docs), HIDDEN), np.float32), 0
        held: list[tuple] = []

        def add() -> None:
            who, states, codes = (np.concatenate(x) for x in zip(*held))
            total[:] += np.bincount(who, self.likelihood(states, codes)[0], len(total))
            held.clear()

        while (live := int(np.searchsorted(-sizes, -at, "left"))) > 0:
            # a window ends where half of the documents have ended, so few steps are empty
            steps = int(min(128, max(8, sizes[live // 2] - at), sizes[0] - at))
            place = at + np.arange(steps)[:, None]
            for s in range(0, live, STREAMS):
                own = slice(s, min(live, s + STREAMS))
                mask = place < sizes[own]
                x = flat[np.where(mask, place + firsts[own], 0)].astype(np.int64)
                states, h[own] = self.states(h[own], x)
                held.append((s + np.nonzero(mask)[1], states[mask], x[mask]))
                if sum(len(x[0]) for x in held) > 60_000:
                    add()
            at += steps
        if held:
            add()
        out = np.zeros(len(docs))
        out[order] = total
        return out


def word_counts(train: DataFrame) -> DataFrame:
    """word binary, c long: counts of all tokens of the texts."""

    def run(batches):
        held: list[pa.Table] = []

        def out():
            yield from pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns({"c_sum": "c"}).select(["word", "c"]).combine_chunks().to_batches(max_chunksize=100_000)

        for b in batches:
            step = max(1, int(b.num_rows * STEP_BYTES / max(1, b.nbytes)))
            for i in range(0, b.num_rows, step):
                counts = tokens(b.column(0).slice(i, step).to_pylist())[0].value_counts()
                held.append(pa.table({"word": counts.field("values"), "c": counts.field("counts")}))
                if sum(len(t) for t in held) > 1_000_000:
                    yield from out()
                    held.clear()
        if held:
            yield from out()

    return train.select("text").mapInArrow(given_back(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Codes:
    """Class and slot of each word: the endings that are classes, and the slots of their most frequent words."""

    def __init__(self, endings: list[bytes], frequent: dict[bytes, int]):
        self.of = {e: i for i, e in enumerate(endings)}
        self.words = pa.array(list(frequent), pa.binary())
        # by a word's last two bytes, its only byte, or none
        self.ends = np.array([*(self.of.get(bytes(divmod(i, 256)), ENDINGS) for i in range(1 << 16)), *(self.of.get(bytes([i]), ENDINGS) for i in range(256)), ENDINGS + 1], np.uint16)
        counts = np.array(list(frequent.values()), np.int64)
        k = np.array([self.ending(w) for w in frequent], np.int64)
        self.code = k * EACH + SLOTS
        self.counts = np.zeros((CLASSES, EACH), np.int64)  # of the slots
        for c in range(CLASSES):
            best = sorted(np.flatnonzero(k == c).tolist(), key=lambda i: -counts[i])[:SLOTS]  # frequent is in order of counts and words
            self.code[best] = c * EACH + np.arange(len(best))
            self.counts[c, : len(best)] = counts[best]
        self.logs = np.log10(counts + 1.0)

    def ending(self, word: bytes) -> int:
        return self.of.get(word[-2:], ENDINGS) if word else ENDINGS + 1

    def __call__(self, words: pa.BinaryArray | list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the words, log10 of count + 1 of each (0 for rare words), and whether each is rare."""
        words = pa.array(words, pa.binary()) if isinstance(words, list) else words
        at = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy()
        rare = at < 0
        _, offsets, data = words.buffers()
        offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
        data, sizes = np.frombuffer(data or b"", np.uint8), np.diff(offsets)[rare]
        last, before = (data[np.maximum(offsets[1:][rare] - i, 0)].astype(np.int64) if len(data) else np.zeros(len(sizes), np.int64) for i in (1, 2))
        end = np.where(sizes > 1, before * 256 + last, np.where(sizes == 1, (1 << 16) + last, (1 << 16) + 256))
        codes, logs = np.empty(len(words), np.uint16), np.zeros(len(words))
        codes[~rare], logs[~rare] = self.code[at[~rare]], self.logs[at[~rare]]
        codes[rare] = self.ends[end] * EACH + SLOTS
        return codes, logs, rare


def most_frequent(vocab: DataFrame) -> dict[bytes, int]:
    """Words and counts of the FREQUENT most frequent words at most: those over the least count that so many reach."""
    below, least = 0, None
    for r in sorted(vocab.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.c):  # a row per different count
        below += r.n
        if below > FREQUENT:
            break
        least = r.c
    rows = vocab.where(F.col("c") >= least).collect() if least is not None else []
    return dict(sorted(((bytes(r.word), r.c) for r in rows), key=lambda x: (-x[1], x[0])))


def summed(replicas: DataFrame, fan: int = 32) -> np.ndarray | None:
    """Sum of the arrays (shard int, data binary) in an order that does not depend on partitions."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = np.frombuffer(x)
                total[k % fan] = total[k % fan] + v if k % fan in total else v.copy()
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["shard", "data"])

    rows = replicas.repartition(fan, F.col("shard") % fan).sortWithinPartitions("shard").mapInArrow(add, "shard int, data binary").collect()
    parts = [np.frombuffer(r.data) for r in sorted(rows, key=lambda r: r.shard)]
    return sum(parts[1:], parts[0]) if parts else None


def trained(gru: Gru, coded: DataFrame, train_tokens: int) -> Gru:
    """The model after all training documents of coded(doc_id, held_out, codes)."""
    shards = max(1, -(-train_tokens // SHARD))
    rounds = min(ROUNDS, shards)
    mixed = F.xxhash64(F.col("doc_id").cast("string"), F.lit("lm"))
    rows = coded.where("not held_out").select(F.pmod(mixed, F.lit(shards)).cast("int").alias("shard"), mixed.alias("h"), "codes")
    dealt = written(rows.repartition(shards, "shard").sortWithinPartitions("shard", "h", "codes"), "lm-shards")
    for k in range(rounds):

        def fit(batches, start=gru):
            held, last = [], None

            def done():
                own = Gru.__new__(Gru)
                own.p = {n: v.copy() for n, v in start.p.items()}
                keep_freed()
                stream = np.concatenate(held)
                own.train(stream.astype(np.int64), 0.01 / (1 + k / 2))
                data = np.r_[own.flat() * len(stream), len(stream)]
                return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([data.tobytes()], pa.binary())], names=["shard", "data"])

            for b in batches:
                for shard, codes in zip(b.column(0).to_pylist(), b.column(1)):
                    if held and shard != last:
                        yield done()
                        held = []
                    last = shard
                    held.append(np.frombuffer(codes.as_py(), np.uint16))
            if held:
                yield done()

        some = dealt.where(F.col("shard") % rounds == k).repartition(-(-shards // rounds), "shard").sortWithinPartitions("shard", "h", "codes")
        total = summed(some.select("shard", "codes").mapInArrow(given_back(fit), "shard int, data binary"))
        if total is not None:
            after = Gru.__new__(Gru)
            after.p = dict(gru.p)
            after.set_flat(total[:-1] / total[-1])
            gru = after
    return gru


def flat(words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the words, and their bytes in a row."""
    if not len(words):
        return np.zeros(0, np.int32), np.zeros(0, np.uint8)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    return np.diff(offsets), np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]


def cut(values: np.ndarray, sizes: np.ndarray) -> pa.BinaryArray:
    """The values as one binary for each size."""
    ends = np.concatenate([[0], np.cumsum(sizes * values.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def joined(column: pa.Array, kind: type) -> np.ndarray:
    """The values of all binaries of a column."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def words_of(lengths: np.ndarray, data: np.ndarray) -> pa.BinaryArray:
    """The inverse of flat()."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def by_key(batches, made):
    """made(the rows of a key) of each key of the first column, by which the batches are sorted."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        keys = b.column(0).to_numpy()
        bounds = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)] if len(keys) else []
        for i, j in zip(bounds, bounds[1:]):
            if held and keys[i] != last:
                yield from made(pa.Table.from_batches(held))
                held = []
            last = keys[i]
            held.append(b.slice(i, j - i))
    if held:
        yield from made(pa.Table.from_batches(held))


def rare_counts(rare: DataFrame, buckets: int) -> DataFrame:
    """row long, more long, more_logs double: of the rare words of each row, the occurrences known in training, and the sum of log10 of count + 1.

    rare: row, held_out, and the different words (bytes in a row, lengths) with their times. Words are dealt to buckets
    by a hash, a few rows of many words each; in a bucket a word's count is the sum of its times in training rows. What
    is found goes back by blocks of BLOCK rows in the same manner.
    """
    kind = "bucket long, row binary, held binary, words binary, lengths binary, times binary"
    names = ["row", "held", "lengths", "times"]

    def deal(batches):
        for b in batches:
            c = {n: b.column(i) for i, n in enumerate(("row", "held_out", "words", "lengths", "times"))}
            lengths = joined(c["lengths"], np.int32)
            each = np.array([len(x) // 4 for x in c["lengths"].to_pylist()], np.int64)
            words = words_of(lengths, joined(c["words"], np.uint8))
            bucket = np.fromiter(map(crc32, words.to_numpy(zero_copy_only=False)), np.int64, len(words)) % buckets
            order = np.argsort(bucket, kind="stable")
            sizes = np.bincount(bucket, minlength=buckets)
            used = np.flatnonzero(sizes)
            values = {"row": np.repeat(c["row"].to_numpy(), each), "held": np.repeat(c["held_out"].to_numpy(zero_copy_only=False), each).astype(np.uint8), "lengths": lengths, "times": joined(c["times"], np.int32)}
            out = {n: cut(v[order], sizes[used]) for n, v in values.items()}
            ordered, data = flat(words.take(pa.array(order)))
            ends = np.cumsum(ordered)[np.cumsum(sizes[used]) - 1] if len(used) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), out["row"], out["held"], cut(data, np.diff(ends, prepend=0)), out["lengths"], out["times"]], names=["bucket", "row", "held", "words", "lengths", "times"])

    def count(t: pa.Table):
        row, held, lengths, times = (joined(t[n], k) for n, k in zip(names, (np.int64, np.uint8, np.int32, np.int32)))
        words = words_of(lengths, joined(t["words"], np.uint8)).dictionary_encode()
        at = words.indices.to_numpy()
        c = np.bincount(at, times * (held == 0), len(words.dictionary))[at]  # below 2**53, so exact
        order = np.argsort(row // BLOCK, kind="stable")
        blocks, sizes = np.unique(row[order] // BLOCK, return_counts=True)
        found = (row, np.where(c > 0, times, 0).astype(np.int32), times * np.log10(c + 1))
        yield pa.RecordBatch.from_arrays([pa.array(blocks), *(cut(x[order], sizes) for x in found)], names=["block", "row", "more", "logs"])

    def total(t: pa.Table):
        row, more, logs = (joined(t[n], k) for n, k in zip(("row", "more", "logs"), (np.int64, np.int32, np.float64)))
        rows, at = np.unique(row, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.bincount(at, more).astype(np.int64)), pa.array(np.bincount(at, logs))], names=["row", "more", "more_logs"])

    dealt = rare.where("octet_length(lengths) > 0").mapInArrow(given_back(deal), kind).repartition("bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(given_back(lambda batches: by_key(batches, count)), "block long, row binary, more binary, logs binary")
    return found.repartition("block").sortWithinPartitions("block").mapInArrow(given_back(lambda batches: by_key(batches, total)), "row long, more long, more_logs double")


def lm_scores(docs: DataFrame, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    out_flag = held_out("doc_id", modulus, remainder)
    vocab = written(word_counts(docs.where(~out_flag)), "lm-words")
    ends = F.expr("substring(word, greatest(1, length(word) - 1), 2)")
    # 65,793 rows at most; that of the end of a text is empty
    sums = sorted(((bytes(r.e), r.n, r.v) for r in vocab.groupBy(ends.alias("e")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()), key=lambda x: (-x[1], x[0]))
    codes = Codes([e for e, _, _ in sums if e][:ENDINGS], most_frequent(vocab))
    n_k, v_k = np.zeros(CLASSES), np.zeros(CLASSES)
    for e, n, v in sums:
        n_k[codes.ending(e)] += n
        v_k[codes.ending(e)] += v
    big_n, big_v = int(n_k.sum()), int(v_k.sum())
    slots = codes.counts.astype(float)
    rest = n_k - slots.sum(1)
    below = np.log10(rest + v_k - (slots > 0).sum(1) + 1)  # of the rest slots
    slots[:, SLOTS] = rest
    slots = np.where((slots > 0) | (np.arange(EACH) == SLOTS), slots + 1, 1e-6)  # a slot without a word has next to no probability

    class State:
        def __init__(self):
            self.row = TaskContext.get().partitionId() << 33

    def encoded(cols, state):
        words, sizes = tokens(cols[1])
        words = words.dictionary_encode()
        at, n = words.indices.to_numpy(), len(sizes)
        own, logs, rare = (x[at] for x in codes(words.dictionary))  # each different word is looked up once
        text = np.repeat(np.arange(n), sizes)
        others = own % EACH == SLOTS
        rest = np.bincount(text[others], logs[others] - below[own[others] // EACH], n)
        met, times = np.unique(text[rare] * np.int64(len(words.dictionary)) + at[rare], return_counts=True)
        texts, different = np.divmod(met, max(1, len(words.dictionary)))
        each = np.bincount(texts, minlength=n)
        lengths, bytes_ = flat(words.dictionary.take(pa.array(different)))
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(each)])]
        rows = np.arange(state.row, state.row + n)
        state.row += n
        return [cols[0], cols[2], *map(pa.array, (rows, sizes, sizes - np.bincount(text[rare], minlength=n), np.bincount(text, logs, n), rest)), cut(bytes_, np.diff(ends)), cut(lengths, each), cut(times.astype(np.int32), each), cut(own, sizes)]

    schema = f"doc_id {kind}, held_out boolean, row long, n_tokens long, known long, logs double, rest double, words binary, lengths binary, times binary, codes binary"
    coded = written(arrow_map(docs.select("doc_id", "text", out_flag.alias("h")), schema, encoded, State), "lm-codes")
    gru = trained(Gru(np.log((n_k + 1) / (n_k + 1).sum()), np.log(slots / slots.sum(1, keepdims=True))), coded, big_n)

    def scored(cols):
        keep_freed()
        return [*cols[:-1], (gru.score([np.frombuffer(c, np.uint16) for c in cols[-1]]) / np.log(10)).tolist()]

    model = arrow_map(coded.select("doc_id", "held_out", "row", "n_tokens", "known", "logs", "rest", "codes"), f"doc_id {kind}, held_out boolean, row long, n_tokens long, known long, logs double, rest double, model double", scored)
    met = rare_counts(coded.select("row", "held_out", "words", "lengths", "times"), max(BUCKETS, big_n // SHARD))
    whole = model.join(met.hint("merge"), "row", "left")
    more = F.coalesce("more_logs", F.lit(0.0))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(big_n).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.lit(float(np.log10(big_n + big_v + 1)))).alias("base_score"), (F.col("model") + F.col("rest") + more).alias("score"),
    )


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's log likelihood under the model, beside that under add-one counts."""
    return lm_scores(table(spark, sf_dir, "documents"))
