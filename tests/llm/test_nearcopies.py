import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from folio.llm import nearcopies, quality, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """The doc_ids that stay, by comparing all pairs; and the number of pairs linked that are not equal."""
    sets, root, near = [shingles(r[1]) for r in rows], list(range(len(rows))), 0

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                near += sets[a] != sets[b]
                root[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for i, r in enumerate(rows):
        least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return sorted(least.values()), near


def corpus(spark, sf):
    r = random.Random(4)
    rows = [(x.doc_id, x.text, "en", "s", 1) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    made = []
    for k in range(40):  # near copies on both sides of the bound, chains of them, and a common first part
        words = [f"w{r.randrange(5000)}" for _ in range(r.randrange(6, 90))]
        for _ in range(8):
            made.append(" ".join(words))
            for _ in range(r.randrange(1, 3)):
                words[r.randrange(len(words))] = f"w{r.randrange(5000)}"
        made.append("one licence line that many of the texts begin with " + " ".join(words))
    made += [None, "", " \n", "One two", "one  TWO", "one two three four five", "one two three four six"]
    return rows + [(10**6 + i, t, "en", "s", 1) for i, t in enumerate(made)]


def test_only_pairs_that_cannot_be_similar_are_refuted():
    r = random.Random(9)
    for _ in range(300):
        base = r.sample(range(60), r.randrange(4, 40))
        a = sorted({x if r.random() > 0.1 else r.randrange(60) for x in base})
        b = sorted({x if r.random() > 0.1 else r.randrange(60) for x in base})
        n = np.array([len(a), len(b)])
        similar = 5 * len(set(a) & set(b)) >= 4 * len(set(a) | set(b))
        keys = [k for k in a[: nearcopies.prefix_length(len(a))] if k in b[: nearcopies.prefix_length(len(b))]]
        bits = np.array([np.frombuffer(nearcopies.bitmap(np.array(x, np.uint64) << np.uint64(20)), np.uint64) for x in (a, b)])
        assert not similar or nearcopies.may_share(n, bits, 0, np.array([1]))[0]
        assert not similar or keys and all(nearcopies.possible(n, np.array([a.index(k), b.index(k)]), 0)[1] for k in keys)


def test_stage_equals_brute_force(spark, sf, monkeypatch):
    rows = corpus(spark, sf)
    want, near = brute(rows)
    assert near > 50
    docs = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), COLUMNS).repartition(3)
    for often in (nearcopies.OFTEN, 2):
        monkeypatch.setattr(nearcopies, "OFTEN", often)
        out = corpus_pipeline.near_duplicates(spark, docs, sf)
        assert out.columns == corpus_pipeline.COLUMNS
        assert sorted(r.doc_id for r in out.collect()) == want


def test_one_row_of_each_class(spark, sf):
    rows = [(None, "a b c d e f", "en", "s", 1), (None, "a b c d e f", "en", "t", 1), (7, "x y", "en", "s", 1), (7, "x y", "en", "s", 1), (7, "other words", "en", "s", 1)]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, COLUMNS), sf).collect()
    assert sorted(r.text for r in out) == ["a b c d e f", "other words", "x y"]
    assert corpus_pipeline.near_duplicates(spark, spark.createDataFrame([], COLUMNS), sf).count() == 0


def test_each_row_has_its_own_verdict(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("score", F.lit(1))
    for stage, scores, keep in ((corpus_pipeline.quality, "quality_scores", 1), (corpus_pipeline.toxicity, "toxicity_scores", 0)):
        labels = spark.read.parquet(f"{sf}/labels.parquet")
        made = (quality.quality_scores if scores == "quality_scores" else toxicity.toxicity_scores)(docs, labels)
        want = sorted(r.doc_id for r in made.collect() if r.predicted == keep)
        assert sorted(r.doc_id for r in stage(spark, docs, sf).collect()) == want
    ids = docs.selectExpr("cast(null as bigint) doc_id", "text", "lang", "source", "n_chars").limit(300)
    out = corpus_pipeline.quality(spark, ids, sf)
    assert out.columns == corpus_pipeline.COLUMNS and 0 < out.count() <= 300


def test_a_pair_is_given_once_however_many_keys_it_shares(spark):
    r = random.Random(2)
    n, place = 500, 3
    sets = [(d, bytes(nearcopies.bitmap(np.arange(n, dtype=np.uint64) << np.uint64(20)))) for d in range(4)]
    rows = [(key, d, n, place, d, bits) for key in range(200) for d, bits in r.sample(sets, 4)]
    keys = spark.createDataFrame(rows, "key long, digest long, n int, place int, component long, bits binary").repartition(1).sortWithinPartitions("key")
    out = nearcopies.by_runs(keys, "a long, b long", nearcopies.across).collect()
    assert sorted((x.a, x.b) for x in out) == [(a, b) for a in range(4) for b in range(a + 1, 4)]


def test_sets_are_not_written_down(spark):
    text = " ".join(f"w{i}" for i in range(20_000))
    made = nearcopies.sets_of(spark.createDataFrame([(1, text, "en", "s", 1)], COLUMNS)).first()
    assert sum(len(x) for x in made if isinstance(x, (bytes, bytearray))) <= nearcopies.BITS // 8


def test_wide_bitmaps_refute_long_sets_but_no_similar_ones():
    r = np.random.default_rng(3)
    refuted = 0
    for k in range(200):
        n, share = int(r.integers(5, 9000)), r.uniform(0.4, 1)
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.r_[a[: int(len(a) * share)], r.integers(0, 2**63, int(len(a) * r.uniform(0, 0.3)) + 1).astype(np.uint64)])
        kept = nearcopies.wide_enough(nearcopies.wide(a), nearcopies.wide(b))
        assert kept or not nearcopies.similar(a, b)
        refuted += not kept
        assert nearcopies.wide_enough(nearcopies.wide(b), nearcopies.wide(a)) == kept
    assert refuted > 50
