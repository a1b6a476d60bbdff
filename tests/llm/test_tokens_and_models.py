import hashlib
import time
import zlib

import duckdb
import numpy as np
from tokenizers import Tokenizer

from folio.llm import bpe, packing, quality, registry, toxicity

ODD = [None, "", " \n", "<|endoftext|> x", "Ünïcode ǅ ΑΣ 🙂 it's 123", "a" * 5000, "don't\x1cstop　now", "é é"]


def reference(texts):
    t = Tokenizer.from_file(bpe.vocabulary())
    t.no_truncation()
    t.no_padding()
    ids = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    return ids, [t.decode(i, skip_special_tokens=False) for i in ids]


def documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(10**6 + i, t) for i, t in enumerate(ODD)]
    return rows, spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")


def test_bpe_equals_library(spark, sf):
    rows, docs = documents(spark, sf)
    ids, texts = reference([t for _, t in rows])
    got = {r.doc_id: r for r in bpe.bpe_digests(docs, bpe.vocabulary()).collect()}
    assert len(got) == len(rows)
    for (i, _), x, d in zip(rows, ids, texts):
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(d.encode()).hexdigest()), i


def test_packing_holds_each_id_once(spark, sf):
    rows, docs = documents(spark, sf)
    ids = {i: [*x, 1] for (i, _), x in zip(rows, reference([t for _, t in rows])[0])}
    pieces = packing.packed(docs, bpe.vocabulary()).collect()
    at, fill = dict.fromkeys(ids, 0), {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == fill.get(p.sequence_id, 0) and p.doc_tokens == len(ids[p.doc_id])
        fill[p.sequence_id] = p.offset + p.length
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == at[p.doc_id]
        at[p.doc_id] += p.length
    assert at == {i: len(x) for i, x in ids.items()} and sum(v < 2048 for v in fill.values()) <= 1 and max(fill.values()) <= 2048
    assert packing.packed(docs.limit(0), bpe.vocabulary()).count() == 0


def held_out_accuracy(spark, rows, column):
    labels = {r.doc_id: r[column] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    return sum(p == y for p, y in held) / len(held)


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    assert held_out_accuracy(spark, quality.op7_quality(spark, sf).collect(), "quality") > 0.97
    assert held_out_accuracy(spark, toxicity.op6_toxicity(spark, sf).collect(), "toxic") > 0.93


def test_classifiers_take_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 0.1) for i, t in enumerate(ODD)] + [(None, "x", 0.2), (0, None, 0.3)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 0), (2, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    for f in (quality.quality_scores, toxicity.toxicity_scores):
        for y in (labels, labels.limit(0)):
            out = f(docs, y).collect()
            assert len(out) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in out)
        assert f(docs.limit(0), labels).count() == 0


def char_model(*words):
    counts = np.zeros((27, 27, 27))
    for w in words:
        p = [26, 26, *[ord(c) - 97 for c in w], 26]
        for x in zip(p, p[1:], p[2:]):
            counts[x] += 50
    return toxicity.CharModel(counts)


def test_restores_disguised_words():
    model = char_model("stupid", "idiot", "moron", "bad", "hate", "the", "ass", "a", "pathetic", "is")
    for disguise, word in {"1d10t": "idiot", "stuuupid": "stupid", "hat3": "hate", "idio7": "idiot", "a55": "ass", "$tupid,": "stupid", "b a d": "bad", "m   o r o n": "moron", "m/o/r/o/n": "moron", "m\no\nr\no\nn": "moron", "id-iot": "idiot", "a i d i o t": "idiot", "pa.the.tic": "pathetic", "i.d.i.o.t!!!": "idiot"}.items():
        assert word in toxicity.terms(f"so {disguise} und", model, {})[0], disguise
    for plain in ("the idiot!", "das, was (hier)", "10 20 30.5", "is it a an at", "wh### yes&&&", None, ""):
        assert toxicity.terms(plain, model, {})[1] == 0, plain


def test_toxicity_is_linear_in_very_long_texts():
    model = char_model("idiot")
    for t in ("ab" * 500_000, "." * 1_000_000, "a" + " " * 1_000_000 + "b", "x1!" * 10_000, "a " * 20_000):
        began = time.time()
        toxicity.terms(t, model, {})
        assert time.time() - began < 4, t[:5]


def test_warc_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.execute(registry.ORACLES["op5_warc"]).fetchall()
    assert sorted(map(tuple, registry.QUERIES["op5_warc"](spark, sf).collect()), key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs.count()]
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == p.COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append(docs.count())
    assert kept[0] > kept[1] >= kept[2] > 0 and kept[3] == kept[4]
    assert {r.doc_id for r in p.packing(spark, docs, sf).collect()} == {r.doc_id for r in docs.collect()}
