import numpy as np

from folio.llm import simhash


def brute(fps, ids, most=2):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= most:
                x, y = sorted((top(ids[a]), top(ids[b])))
                root[y] = x
    return {i: top(i) for i in ids}


def test_near_pairs_equal_brute_force():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [np.uint64(0)] + [np.uint64(1) << np.uint64(r.integers(64)) for _ in range(30)]
    fps = np.unique(np.array([b ^ f ^ g for b in base for f, g in zip(flips, flips[::-1])], dtype=np.uint64))
    one = simhash.Ranked(fps)
    got = {tuple(sorted((int(i), int(j)))) for a, b in simhash.near_pairs(one, one, 2, chunk=1000) for i, j in zip(a, b)}
    want = {(j, i) for i in range(len(fps)) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 2}
    assert got == want and want
    half = [simhash.Ranked(fps[::2]), simhash.Ranked(fps[1::2])]
    got = {tuple(sorted((2 * int(i), 2 * int(j) + 1))) for a, b in simhash.near_pairs(*half, 2, chunk=1000) for i, j in zip(a, b)}
    assert got == {p for p in want if (p[0] + p[1]) % 2}


def test_groups_are_pruned_whole():
    fps = np.random.default_rng(5).integers(0, 1 << 63, 6000, dtype=np.uint64)
    one, looked = simhash.Ranked(fps), 0
    count = np.bitwise_count

    class Counting:
        def __call__(self, x):
            nonlocal looked
            looked += len(x)
            return count(x)

    np.bitwise_count = Counting()
    try:
        list(simhash.near_pairs(one, one, 2))
    finally:
        np.bitwise_count = count
    assert looked < 0.25 * 6000 * 6000 / 2


def independent(text, words_each=3):
    """The fingerprint as the contract words it."""
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + words_each]) for i in range(max(1, len(words) - words_each + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in h) > len(h))


def test_fingerprint_as_worded(sf):
    import pyarrow.parquet as pq

    texts = [*pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist(), None, "", " \t", "One", "one TWO", "a b c", "A\u00a0b É c d"]
    assert [simhash.fingerprint(t) for t in texts] == [independent(t) for t in texts]


def test_classes_equal_brute_force(spark, sf, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000 + i, t) for i, (_, t) in enumerate(rows[:20])] + [(20_000, None), (20_001, ""), (20_002, " \n"), (20_003, "one"), (20_004, "one")]
    rows += [(30_000 + i, t + " x") for i, (_, t) in enumerate(rows[:60]) if t]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute([simhash.fingerprint(t) for _, t in rows], [i for i, _ in rows])
    for cell in (simhash.CELL, 8, 2):
        monkeypatch.setattr(simhash, "CELL", cell)
        assert {r.doc_id: r.component_id for r in simhash.simhash_classes(docs).collect()} == want


def test_heavy_cells_are_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 4)
    monkeypatch.setattr(simhash, "PATTERN_BITS", 1)
    r = np.random.default_rng(8)
    fps = np.unique(r.integers(0, 1 << 12, 300, dtype=np.uint64) << np.uint64(30))
    rows = [(int(f), i) for i, f in enumerate(fps.view(np.int64))]
    got = simhash.components(simhash.links(spark.createDataFrame(rows, "fp long, rep long")))
    want = brute([int(f) for f in fps], list(range(len(fps))))
    assert {x.node: x.component for x in got.collect()} == {i: c for i, c in want.items() if sum(v == c for v in want.values()) > 1}


def test_empty_and_null_ids(spark):
    schema = "doc_id long, text string, fp string"
    assert simhash.simhash_classes(spark.createDataFrame([], schema)).count() == 0
    out = simhash.simhash_classes(spark.createDataFrame([(None, "a b c", ""), (None, "x y", ""), (5, "a b c", ""), (5, "a b c", "")], schema)).collect()
    assert sorted((x.doc_id or 0, x.component_id or 0) for x in out) == [(0, 0), (0, 5), (5, 5), (5, 5)]


def test_very_long_text():
    assert 0 < simhash.fingerprint("word other third " * 200_000) < 1 << 64
