import re

from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=800, deadline=None)
@given(st.text(st.sampled_from("a.@-+ 0149(é"), max_size=60))
def test_base_equals_plain_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_known_and_long_texts():
    assert [k for k, _, _ in pii.base_spans("x.y@a.b.c 8.8.8.8 or 4111 1111-11111111 or +1 (743) 555-3824")] == ["email", "ip", "card", "phone"]
    assert pii.base_spans("a" * 200_000 + "1" * 200_000) == []


def brute_terms(texts):
    """The disclosing terms by the definition, over positions of all words."""
    near, total = {}, {}
    for t in texts:
        base = brute(t or "")
        tokens = [m for m in re.finditer(r"[^\W\d_]+", t or "")]
        for m in tokens:
            total[m[0].lower()] = total.get(m[0].lower(), 0) + 1
        free = [m for m in tokens if not any(m.start() < e and s < m.end() for _, s, e in base)]
        seen = set()
        for kind, s, e in base:
            value = re.sub("[^0-9]", "", t[s:e]) if kind == "card" else t[s:e].lower()
            for m in [*[m for m in free if m.end() <= s][-pii.WINDOW :], *[m for m in free if m.start() >= e][: pii.WINDOW], *[m for m in tokens if m.start() < e and s < m.end()]]:
                if (kind, value, m.start()) not in seen:
                    seen.add((kind, value, m.start()))
                    near[m[0].lower(), kind, value] = near.get((m[0].lower(), kind, value), 0) + 1
    return {w for (w, _, _), n in near.items() if n / (total[w] + 0.5) >= 0.5}


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, spans int")


def test_terms_equal_brute_force(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    made = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(5))
    texts += [" . ".join(f"{made(k)} {made(k + 5000)} kontakt a@b.org {made(k + 9000)} {made(k + 14000)}" for k in range(30)), *["kontakt und " * 20] * 25]
    texts += [f"{made(k)} a@b.org zentrale a@b.org {made(k + 5000)}" for k in range(12)] + ["zentrale " * 14, "Jane ÄÖ Quixby quixby@x.org and the rest", None, "", "4111 1111 1111 1111 mine"]
    want = brute_terms(texts)
    got = {r.term: r for r in pii.disclosing_terms(rows_of(spark, texts)).collect()}
    assert sorted(set(got) ^ want) == []
    assert "quixby" in want and not {"kontakt", "zentrale", "und"} & want
    assert all(0 <= r.bits <= 1 and r.n_near <= r.n_all for r in got.values())


def test_common_word_stays(spark):
    texts = [f"{'common ' * 200}{w} mail a@b.org common" for w in ("eins", "zwei", "drei", "vier")] + ["mail " * 40]
    got = {r.term for r in pii.disclosing_terms(rows_of(spark, texts)).collect()}
    assert got == {"eins", "zwei", "drei", "vier", "a", "b", "org"}  # the last three stand in the address alone


def test_spans_and_sanitised_texts(spark, monkeypatch):
    texts = [f"word Zorbax mail a@b.org other{chr(97 + i)}" for i in range(4)] + ["plain words mail only other word"] * 20 + [None, ""] * 2 + ["word Zorbax mail a@b.org othera"] * 2
    docs = rows_of(spark, texts)
    for most in (pii.FLAGGED_MOST, 0):
        monkeypatch.setattr(pii, "FLAGGED_MOST", most)
        got = {r.doc_id: r for r in pii.pii_spans(docs).collect()}
        assert len(got) == len(texts) and "term:5:11" in got[0].spans and got[25].spans == "" == got[4].spans
        clean = {r.doc_id: r.text for r in pii.without_pii(docs.select("doc_id", "text", docs.spans.alias("n_chars"))).collect()}
        assert clean[0] == "word [TERM] mail [EMAIL] [TERM]" and clean[4] == texts[4] and clean[24] is None and clean[28] == clean[0]
        assert pii.pii_spans(docs.limit(0)).count() == 0
