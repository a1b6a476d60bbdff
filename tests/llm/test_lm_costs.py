import ctypes
import re
import resource
from collections import Counter

import numpy as np
import pytest

from folio.llm import lm

TEXTS = [None, "", "  ", "One two\tONE\x0btwo\x0c\r\n", "a", " x ", "ÄÖ Ü z É\x1f\x85", "0" * 300 + " b\x00c", "é lone"]


def plain(text):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))] + [b""]


def test_tokens_of_many_texts_are_cut_at_once():
    words, sizes = lm.tokens(TEXTS)
    assert words.to_pylist() == [w for t in TEXTS for w in plain(t)]
    assert sizes.tolist() == [len(plain(t)) for t in TEXTS]
    words, sizes = lm.tokens([])
    assert len(words) == len(sizes) == 0


def test_codes_of_an_arrow_array_equal_those_of_each_word():
    words, _ = lm.tokens([*TEXTS, "walking talking in n g ng xng"])
    for frequent in ({}, {b"": 9, b"one": 5, b"walking": 4, b"n": 3}):
        codes = lm.Codes([b"ng", b"ne", b"n", b"wo"], frequent)
        for part in (words, words.slice(3, 9), words.slice(2, 0)):
            own, logs, rare = codes(part)
            assert rare.tolist() == [w not in frequent for w in part.to_pylist()]
            assert [k // lm.EACH for k in own.tolist()] == [codes.ending(w) for w in part.to_pylist()]
            assert np.allclose(logs, [np.log10(frequent.get(w, 0) + 1) for w in part.to_pylist()])
            assert all((k % lm.EACH == lm.SLOTS) == (w not in frequent) for k, w in zip(own.tolist(), part.to_pylist()))


def test_each_different_word_of_a_batch_is_looked_up_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "to be or not to be " * 200) for i in range(20)], "doc_id long, text string").coalesce(1)
    rows, plain_map = [], lm.arrow_map

    def mapped(df, schema, each, state=None, carry=()):
        if "codes binary" in schema:  # the encoding pass, here on this side
            made = each([[i for i in range(20)], ["to be or not to be new" for _ in range(20)], [False] * 20], type("S", (), {"row": 7})())
            rows.append([x.to_pylist() if hasattr(x, "to_pylist") else x for x in made])
        return plain_map(df, schema, each, state, carry)

    calls, plain_call = [], lm.Codes.__call__
    monkeypatch.setattr(lm, "arrow_map", mapped)
    with monkeypatch.context() as m:
        m.setattr(lm.Codes, "__call__", lambda self, words: (calls.append(len(words)), plain_call(self, words))[1])
        assert lm.lm_scores(docs).count() == 20
    assert calls == [6]  # to, be, or, not, new and the end
    made = rows[0]
    assert made[2] == list(range(7, 27)) and made[3] == [8] * 20 and made[4] == [7] * 20
    assert made[7] == [b"new"] * 20 and made[8] == [b"\3\0\0\0"] * 20 and made[9] == [b"\1\0\0\0"] * 20 and all(len(c) == 16 for c in made[10])


@pytest.mark.parametrize("buckets", [1, 7, 300])
def test_rare_words_are_counted_where_they_meet(spark, monkeypatch, buckets):
    monkeypatch.setattr(lm, "BLOCK", 4)
    r = np.random.default_rng(buckets)
    texts = [Counter({w: int(r.integers(1, 9)) for w in {b"x" * int(n) + b"%d" % k for n, k in r.integers(0, 12, (m, 2))} | {b""}} if m else {}) for m in r.integers(0, 15, 60)]
    held = [i % 5 == 0 for i in range(60)]
    pack = lambda x: np.array(list(x), np.int32).tobytes()
    rows = [((i % 3 << 33) + i, held[i], b"".join(t), pack(map(len, t)), pack(t.values())) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "row long, held_out boolean, words binary, lengths binary, times binary").repartition(3)
    count = sum((t for t, out in zip(texts, held) if not out), Counter())
    got = {x.row: x for x in lm.rare_counts(table, buckets).collect()}
    assert set(got) == {row[0] for row, t in zip(rows, texts) if t}
    for row, t in zip(rows, texts):
        if t:
            assert got[row[0]].more == sum(n for w, n in t.items() if count[w])
            assert np.isclose(got[row[0]].more_logs, sum(n * np.log10(count[w] + 1) for w, n in t.items()))
    assert lm.rare_counts(table.where("row < 0"), buckets).count() == 0


def test_rare_words_move_in_few_rows(spark, sf, monkeypatch):
    moved, plain_counts = [], lm.rare_counts
    monkeypatch.setattr(lm, "FREQUENT", 300)
    monkeypatch.setattr(lm, "rare_counts", lambda rare, buckets: (moved.append(rare), plain_counts(rare, buckets))[1])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = lm.lm_scores(docs)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "lm-words" not in plan  # no row for each occurrence, no join with the vocabulary
    assert len(moved) == 1 and moved[0].count() == docs.count()


def test_sigmoid_of_large_numbers_does_not_overflow():
    x = np.array([-300.0, -20, 0, 20, 300], np.float32)
    with np.errstate(all="raise"):
        lm.sigmoid(x)
    assert np.allclose(x, [0, 0, 0.5, 1, 1], atol=1e-6)


def test_class_likelihood_is_part_of_the_whole():
    r = np.random.default_rng(2)
    g = lm.Gru(r.normal(size=lm.CLASSES), r.normal(size=(lm.CLASSES, lm.EACH)))
    states, codes = r.normal(0, 0.3, (5000, lm.HIDDEN)).astype(np.float32), r.integers(0, lm.CLASSES * lm.EACH, 5000)
    whole, first = g.likelihood(states, codes)
    logits = states.astype(float) @ g.p["o"] + g.p["d"]
    assert np.allclose(first, logits[np.arange(5000), codes // lm.EACH] - np.log(np.exp(logits).sum(1)), atol=1e-4)
    assert (whole < first).all()


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "mallopt"), reason="glibc alone")
def test_training_windows_reuse_their_memory():
    g = lm.Gru(np.zeros(lm.CLASSES), np.zeros((lm.CLASSES, lm.EACH)))
    x, h = np.random.default_rng(1).integers(0, lm.CLASSES * lm.EACH, (lm.WINDOW, lm.STREAMS)), np.zeros((lm.STREAMS, lm.HIDDEN), np.float32)
    lm.keep_freed()
    for _ in range(5):
        g.gradient(h, x)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    for _ in range(10):
        g.gradient(h, x)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before < 2000  # of before: 10,960
