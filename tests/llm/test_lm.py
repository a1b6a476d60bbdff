import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from folio.llm import lm

CODES = lm.CLASSES * lm.EACH


def fresh(double=False):
    g = lm.Gru(np.zeros(lm.CLASSES), np.zeros((lm.CLASSES, lm.EACH)))
    if double:
        r = np.random.default_rng(1)
        g.p = {k: v.astype(float) + r.normal(0, 0.1, v.shape) for k, v in g.p.items()}
    return g


def test_gradient_equals_differences():
    r = np.random.default_rng(0)
    g = fresh(True)
    x, h = r.integers(0, CODES, (5, 3)), np.zeros((3, lm.HIDDEN))
    grads, _ = g.gradient(h, x)

    def loss():
        states, _ = g.states(h, x)
        return -g.likelihood(states.reshape(-1, lm.HIDDEN), x.ravel())[0].mean()

    k = int(x[2, 1]) // lm.EACH
    for name, at in (("w", (x[1, 0], 3)), ("w", (x[1, 0], 40)), ("u", (2, 5)), ("u", (2, 40)), ("b", (1,)), ("o", (3, 7)), ("d", (2,)), ("s", (k, 4, int(x[2, 1]) % lm.EACH)), ("s", (k, 2, 5)), ("e", (k, 6))):
        old = g.p[name][at]
        g.p[name][at] = old + 1e-4
        up = loss()
        g.p[name][at] = old - 1e-4
        down = loss()
        g.p[name][at] = old
        assert abs((up - down) / 2e-4 - grads[name][at]) < 1e-6, name


def step_by_step(g, codes):
    """The likelihood by plain loops, one document, one step at a time."""
    p, n = {k: v.astype(float) for k, v in g.p.items()}, lm.HIDDEN
    h, total = np.zeros(n), 0.0
    for code in codes:
        k, slot = divmod(int(code), lm.EACH)
        for logits, at in ((h @ p["o"] + p["d"], k), (h @ p["s"][k] + p["e"][k], slot)):
            total += logits[at] - math.log(sum(math.exp(v) for v in logits))
        x = p["w"][code] + p["b"]
        z = 1 / (1 + np.exp(-(x[:n] + h @ p["u"][:, :n])))
        r = 1 / (1 + np.exp(-(x[n : 2 * n] + h @ p["u"][:, n : 2 * n])))
        h = (1 - z) * h + z * np.tanh(x[2 * n :] + (r * h) @ p["u"][:, 2 * n :])
    return total


def test_state_is_carried_through_whole_documents():
    r = np.random.default_rng(3)
    g = fresh()
    g.train(r.integers(0, 40, 20_000))
    docs = [r.integers(0, CODES, n).astype(np.uint16) for n in (1, 700, 3, 129, 128, 40)]
    assert np.allclose(g.score(docs), [step_by_step(g, d) for d in docs], rtol=2e-5)


def documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(70_000, None), (70_001, ""), (70_002, "never-seen ÄÖ"), (None, "a b c"), (70_003, "a b c"), (70_003, "a b c")]
    return rows, spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")


def test_scores(spark, sf, monkeypatch):
    rows, docs = documents(spark, sf)
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), ""]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(w for i, t in rows if not held[i] for w in words(t))
    n, v = sum(c.values()), len(c)
    monkeypatch.setattr(lm, "FREQUENT", 300)
    monkeypatch.setattr(lm, "SHARD", 4000)
    models, train = [], lm.trained
    monkeypatch.setattr(lm, "trained", lambda *a: models.append(train(*a)) or models[-1])
    coders, codes = [], lm.Codes
    monkeypatch.setattr(lm, "Codes", lambda *a: coders.append(codes(*a)) or coders[-1])
    by_layout = []
    for parts in (1, 8):
        out = {(r.doc_id, r.n_tokens): r for r in lm.lm_scores(docs.repartition(parts)).collect()}
        for i, t in rows:
            w = words(t)
            r = out[i, len(w)]
            assert (r.held_out, r.n_known, r.train_tokens) == (held[i], sum(x in c for x in w), n)
            assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        own = [r for r in out.values() if r.held_out]
        assert sum(r.score for r in own) > sum(r.base_score for r in own)
        by_layout.append(out)
    assert all(math.isclose(r.score, by_layout[1][k].score, rel_tol=1e-5) for k, r in by_layout[0].items())
    # the score by its definition: class and slot by the network, words of the rest by their counts
    coder, rest_n, rest_v = coders[-1], Counter(), Counter()
    of = {w.encode(): int(coder([w.encode()])[0][0]) for w in c}
    for w, k in c.items():
        if of[w.encode()] % lm.EACH == lm.SLOTS:
            rest_n[of[w.encode()] // lm.EACH] += k
            rest_v[of[w.encode()] // lm.EACH] += 1
    for i, t in [rows[0], rows[5], rows[-6], rows[-5], rows[-4]]:
        own = coder([w.encode() for w in words(t)])[0]
        want = step_by_step(models[-1], own) / math.log(10)
        want += sum(math.log10((c[w] + 1) / (rest_n[k // lm.EACH] + rest_v[k // lm.EACH] + 1)) for w, k in zip(words(t), own.tolist()) if k % lm.EACH == lm.SLOTS)
        assert math.isclose(by_layout[1][i, len(own)].score, want, rel_tol=1e-5)


def test_odd_tables(spark):
    schema = "doc_id long, text string, row long"
    assert lm.lm_scores(spark.createDataFrame([], schema)).count() == 0
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2]
    out = lm.lm_scores(spark.createDataFrame([(i, "some words", 1) for i in held], schema)).collect()
    assert len(out) == len(held) and all(r.train_tokens == 0 == r.n_known and math.isfinite(r.score) for r in out)


@pytest.mark.parametrize("n", [1, 60, 3001, 50_000])
def test_training_sees_every_token(n):
    stream = np.random.default_rng(n).integers(0, CODES, n)
    seen = Counter()

    class Watched(lm.Gru):
        def gradient(self, h, x):
            seen.update(x.ravel().tolist())
            return super().gradient(h, x)

    Watched(np.zeros(lm.CLASSES), np.zeros((lm.CLASSES, lm.EACH))).train(stream)
    want = Counter(stream.tolist())
    assert all(seen[k] >= want[k] for k in want) and sum(seen.values()) < n + lm.STREAMS
