from folio.llm import pii


def test_terms_refuted_beside_mentions_are_not_counted(spark, monkeypatch):
    """A word beside many addresses is no candidate for the pass over all texts; the terms found stay the same."""
    texts = [f"shared name{chr(97 + i)} writes from a{i}@example.org as shared" for i in range(20)] + ["namea stands here too", "", None]
    seen = []
    of = pii.Bloom.of.__func__

    def noted(cls, keys):
        seen.extend(r.key for r in keys.select("key").collect())
        return of(cls, keys)

    monkeypatch.setattr(pii.Bloom, "of", classmethod(noted))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r.term: (r.n_near, r.n_all) for r in pii.disclosing_terms(docs).collect()}
    assert pii.key("shared") not in seen and pii.key("writes") not in seen and pii.key("namea") in seen
    assert got == {f"name{chr(97 + i)}": (1, 1) for i in range(1, 20)}
