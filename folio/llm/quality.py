"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

Each text becomes a row of document statistics. Random Fourier features approximate a Gaussian kernel
over the standardised statistics. Partitions sum their normal equations, the driver solves one system
of fixed size, and pool-adjacent-violators over fixed score bins turns ridge scores into probabilities.

Defined results: a null or empty text has the statistics of an empty text; a label that is null does
not teach; repeated rows each get their own result; without any labelled row every score is 0.5;
other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import arrow_map, carried, flat_sum, held_out, table, written

STATS = 20
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
SENTENCE_ENDS = frozenset(b".!?")


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; those that are counts of everything are logarithms."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    lines = raw.split(b"\n")
    distinct = set(words)
    pairs = set(zip(words, words[1:]))
    alpha = max(1, int(by[LETTERS].sum()))
    punct = int(by[33:48].sum() + by[58:65].sum() + by[91:97].sum() + by[123:127].sum())
    plain = int(by[44] + by[46])
    packed = len(zlib.compress(raw, 1)) / n
    return [
        np.log1p(len(raw)), np.log1p(len(words)), float(sizes.mean()), float(sizes.std()),
        by[65:91].sum() / alpha, by[48:58].sum() / n, (punct - plain) / n, plain / w, by[33] / w, by[124] / w,
        by[128:].sum() / n, by[10] / w, len(distinct) / w, len(pairs) / w, len(set(lines)) / len(lines),
        packed, float(sizes.max()) / 50, (by[35:39].sum() + by[42]) / w, sum(x[-1] in SENTENCE_ENDS for x in words) / w,
        np.log1p(len(raw) / len(lines)),
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, stats array<double> of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), f"doc_id {kind}, stats array<double>", lambda c: [c[0], [statistics(t) for t in c[1]]])


def isotonic(bins: dict[int, tuple[float, float]], n_bins: int) -> np.ndarray:
    """Non-decreasing probability for each bin from (rows, positives) of the bins, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for b in sorted(bins):
        n, pos = bins[b]
        blocks.append([pos, n, b, b])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            pos, n, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + pos, blocks[-1][1] + n, blocks[-1][2], last]
    if not blocks:
        return np.full(n_bins, 0.5)
    at = [x for b in blocks for x in (b[2], b[3])]
    value = [x for b in blocks for x in ((b[0] + 0.5) / (b[1] + 1),) * 2]
    return np.maximum.accumulate(np.interp(np.arange(n_bins), at, value))


class RandomFourier:
    def __init__(self, mean, std, dim: int, gamma: float, seed: int):
        r = np.random.default_rng(seed)
        self.mean, self.std = np.array(mean), np.maximum(np.array(std), 1e-9)
        self.w = r.normal(0, np.sqrt(2 * gamma), (len(self.mean), dim))
        self.b = r.uniform(0, 2 * np.pi, dim)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), z, np.ones((len(x), 1))])


#: Bins of raw scores between these two for calibration.
BINS, LOW, HIGH = 400, -0.5, 1.5


def binned(raw: np.ndarray) -> np.ndarray:
    return np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(int)


def fit_scores(stats: DataFrame, labelled: DataFrame, dim: int = 192, gamma: float = 0.04, ridge: float = 1e-3, seed: int = 7):
    """A function from statistics (numpy, a row each) to probabilities. labelled: doc_id, label int 0/1, to learn from."""
    train = written(stats.join(labelled, "doc_id").where("label is not null").select("stats", F.col("label").cast("double")), "quality-train")
    rows = train.select(*[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(STATS)], *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(STATS)], F.count(F.lit(1)).alias("n")).first()
    if not rows["n"]:
        return lambda x: np.full(len(x), 0.5)
    rff = RandomFourier([rows[f"m{i}"] for i in range(STATS)], [rows[f"s{i}"] for i in range(STATS)], dim, gamma, seed)
    width = dim + STATS + 1

    def equations(batches):
        import pyarrow as pa

        total = np.zeros((width, width + 1))
        for b in batches:
            z = rff(np.array(b.column(0).to_pylist(), dtype=float).reshape(-1, STATS))
            total += z.T @ np.hstack([z, np.array(b.column(1).to_pylist())[:, None]])
        from pyspark import TaskContext

        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "data"])

    both = flat_sum(train.mapInArrow(equations, "part int, data binary")).reshape(width, width + 1)
    beta = np.linalg.solve(both[:, :-1] + ridge * rows["n"] * np.diag([*[1.0] * (width - 1), 1e-6]), both[:, -1])
    counts = arrow_map(train, "bin int, label double", lambda c: [binned(rff(np.array(c[0], dtype=float).reshape(-1, STATS)) @ beta).tolist(), c[1]])
    bins = {r.bin: (r.n, r.pos) for r in counts.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")).collect()}
    curve = isotonic(bins, BINS)
    return lambda x: curve[binned(rff(x) @ beta)]


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted for each document, and the columns of carry; labels(doc_id, quality) teach where the document is not held out."""
    stats = written(features(docs), "quality-stats")
    labelled = labels.where(~held_out("doc_id", modulus, remainder)).select("doc_id", F.col("quality").alias("label"))
    model = fit_scores(stats.select("doc_id", "stats"), labelled)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def judged(ids, rows):
        score = model(np.array(rows, dtype=float).reshape(-1, STATS))
        return [ids, score.tolist(), (score >= 0.5).astype(int).tolist()]

    out = f"doc_id {kind}, score double, predicted int"
    if carry:  # what is carried along is not written with the statistics: these are made of the texts once more instead
        rows, named = carried(docs, carry)
        scored = arrow_map(rows, out, lambda c: judged(c[0], [statistics(t) for t in c[1]]), carry=named)
    else:
        scored = arrow_map(stats, out, lambda c: judged(*c))
    return scored.select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "score", "predicted", *[c for c in scored.columns if c.startswith("carried_")])


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its quality score."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
