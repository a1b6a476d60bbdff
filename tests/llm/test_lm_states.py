import numpy as np

from folio.llm import lm
from folio.llm.lm import CLASSES, EACH, HIDDEN, Gru, sigmoid


def test_states_equal_the_definition_and_sigmoid_works_in_place():
    rng = np.random.default_rng(1)
    gru = Gru(np.zeros(CLASSES), np.zeros((CLASSES, EACH)))
    gru.p["b"] = rng.normal(0, 0.3, 3 * HIDDEN).astype(np.float32)
    x, h = rng.integers(0, CLASSES * EACH, (9, 6)), rng.normal(0, 0.5, (6, HIDDEN)).astype(np.float32)
    first, got, last = h.copy(), *gru.states(h, x)
    assert (h == first).all() and (got[0] == first).all()
    p, n = gru.p, HIDDEN
    for t in range(9):
        assert np.allclose(got[t], h, atol=1e-6)
        i = p["w"][x[t]] + p["b"]
        zr = 1 / (1 + np.exp(-(i[:, : 2 * n] + h @ p["u"][:, : 2 * n])))
        z, r = zr[:, :n], zr[:, n:]
        h = h + z * (np.tanh(i[:, 2 * n :] + (r * h) @ p["u"][:, 2 * n :]) - h)
    assert np.allclose(last, h, atol=1e-6)
    y = np.array([-2.0, 0, 2], np.float32)
    sigmoid(y)
    assert np.allclose(y, [0.1192029, 0.5, 0.8807971])


def test_bounded_logits_are_not_searched_for_their_largest(monkeypatch):
    r = np.random.default_rng(4)
    flat = np.log(np.full((lm.CLASSES, lm.EACH), 1 / lm.EACH))
    states, codes = np.tanh(r.normal(size=(500, lm.HIDDEN))).astype(np.float32), r.integers(0, lm.CLASSES * lm.EACH, 500)
    plain, asked = lm.softmax, []
    monkeypatch.setattr(lm, "softmax", lambda x, at, wanted, bounded=False: (asked.append(bounded), plain(x, at, wanted, bounded))[1])
    for scale in (1, 1000):  # weights this large would overflow single precision
        gru = lm.Gru(flat[:, 0], flat)
        gru.p["o"] *= scale
        gru.p["s"] += (scale * r.normal(0, 0.1, gru.p["s"].shape)).astype(np.float32)
        asked.clear()
        got = gru.likelihood(states, codes)[0]
        assert asked and all(a == (scale == 1) for a in asked)
        k, slot = codes // lm.EACH, codes % lm.EACH
        p, x = {n: v.astype(float) for n, v in gru.p.items()}, states.astype(float)
        a = x @ p["o"] + p["d"]
        b = np.einsum("nh,nhe->ne", x, p["s"][k]) + p["e"][k]
        want = sum(y[np.arange(500), at] - y.max(1) - np.log(np.exp(y - y.max(1, keepdims=True)).sum(1)) for y, at in ((a, k), (b, slot)))
        assert np.isfinite(got).all() and np.allclose(got, want, rtol=1e-3, atol=1e-3)
