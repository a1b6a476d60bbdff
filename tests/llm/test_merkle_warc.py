import gzip
import hashlib
import random

import pytest

from folio.llm import merkle, warc


def test_merkle_equals_brute_force(spark, sf, monkeypatch):
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    rows += [(10**6, ""), (10**6 + 1, "é\nb. c"), (10**6 + 2, "")]
    docs = spark.createDataFrame([(i, t or None, "x") for i, t in rows], "doc_id long, text string, bucket string")
    want = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        e = t[: len(t) - n] + after[:n]
        want[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), merkle.fingerprint(t), merkle.fingerprint(e), round(merkle.likeness(merkle.Tree.of(t), merkle.Tree.of(after)), 9))
    for each in (17, 10**6):
        got = merkle.with_next(docs, each)
        monkeypatch.setattr(merkle, "with_next", lambda d, got=got: got)
        out = merkle.merkle(docs).collect()
        monkeypatch.undo()
        assert {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_next, 9)) for r in out} == want and len(out) == len(want)


def leaves(tree):
    return [x for s in tree.sections for p in s.kids for x in p.kids]


def common_run(a, b):
    """Most characters of leaves that are common in order, by dynamic programming."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + x.size if x.hash == y.hash else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_likeness_by_brute_force():
    r = random.Random(3)
    texts = ["", "a", "One. Two.", "Two. One.", "a\n\nb", "b\na", "a  b", "a b"]
    for _ in range(60):
        lines = [". ".join(r.choice(["ab", "cd", "ef gh", "x" * 250]) for _ in range(r.randrange(5))) + r.choice(["", "."]) for _ in range(r.randrange(1, 30))]
        texts += ["\n".join(lines), "\n".join([*lines[: len(lines) // 2], "new. line", *lines[len(lines) // 2 :]])]
    trees = [merkle.Tree.of(t) for t in texts]
    for t, x in zip(texts, trees):
        assert sum(k.size for k in leaves(x)) == len(t) and str(merkle.Tree.read(str(x))) == str(x)
    for s, a in zip(texts, trees):
        for t, b in zip(texts, trees):
            value = merkle.likeness(a, b)
            assert (value == 1) == (s == t) and 0 <= value <= 1
            same, edits = merkle.compared(a, b)
            assert same <= common_run(leaves(a), leaves(b))
            # what is outside the edits is equal, in order, and is what counts as the same
            rest = lambda x, at: "".join(x[i:j] for i, j in zip([0, *(e[at + 1] for e in edits)], [*(e[at] for e in edits), len(x)]))
            assert rest(s, 0) == rest(t, 2) and len(rest(s, 0)) == same


def test_edits_are_located_without_a_look_at_equal_branches():
    lines = [f"Line {i} says this. And that {i}." for i in range(400)]
    a, b = merkle.Tree.of("\n".join(lines)), merkle.Tree.of("\n".join([*lines[:200], "Line 200 says more.", *lines[201:]]))
    same, edits = merkle.compared(a, b)
    at = len("\n".join(lines[:200])) + 1
    assert edits[0][0] == at and edits[-1][1] <= at + len(lines[200]) + 1 and merkle.likeness(a, b) > 0.99
    changed = {s.hash for s in a.sections} ^ {s.hash for s in b.sections}
    assert len(changed) <= 4 < len(a.sections)
    assert merkle.fingerprint(None) == merkle.fingerprint("") and merkle.likeness(merkle.Tree.of(None), merkle.Tree.of("x")) == 0


def test_merkle_takes_very_long_texts():
    t = "a. " * 300_000 + "b" * 1_000_000 + "\n" * 100_000
    a, b = merkle.Tree.of(t), merkle.Tree.of("x" + t)
    assert 0.9 < merkle.likeness(a, b) < 1


def test_merkle_single_and_empty(spark):
    one = merkle.merkle(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert merkle.merkle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = merkle.merkle(spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "doc_id long, text string")).collect()
    assert len(twice) == 3 and {r.doc_id for r in twice} == {None, 1}
    lone = merkle.merkle(spark.createDataFrame([(None, "abcd")], "doc_id long, text string")).collect()
    assert len(lone) == 1 and lone[0].near_next == 1


def test_normaliser_keeps_records_and_index():
    recs = [warc.record("response", "http://a/é", f"urn:page:{i}", b"x" * i + b"\r\n\r\nWARC/1.1", "d", i) for i in range(5)]
    data, index = warc.normalised(gzip.compress(b"".join(recs)))
    assert [gzip.decompress(data[o : o + n]) for o, n in index] == recs
    head, payload = warc.read_at(data, *index[3])
    assert payload == b"xxx\r\n\r\nWARC/1.1" and head["warc-date"] == warc.DATE and head["content-type"] == "application/http; msgtype=response"


def test_archives_as_files(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    normal = warc.normalise(warc.archives(warc.with_roles(pages)))
    made = warc.exported(normal, f"file://{tmp_path}/out").collect()
    n = 0
    for r in made:
        data = (tmp_path / "out" / r.archive).read_bytes()
        places = [tuple(map(int, x.split())) for x in (tmp_path / "out" / f"{r.archive}.idx").read_text().splitlines()]
        assert len(data) == r.bytes and sum(n for _, n in places) == len(data)
        whole = gzip.decompress(data)
        assert b"".join(gzip.decompress(data[o : o + k]) for o, k in places) == whole and whole.count(b"WARC/1.1\r\n") == len(places) == r.records
        n += r.records
    assert n == pages.count()


def test_revisits_are_checked(spark):
    read = spark.createDataFrame([(1, 200, "d", "response", None), (2, 200, "d", "revisit", 1)], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    assert warc.checked(read).count() == 2
    for wrong in ("'e'", "null"):
        with pytest.raises(ValueError):
            warc.checked(read.selectExpr("page_id", "payload_bytes", f"if(page_id = 1, {wrong}, payload_digest) payload_digest", "record_type", "refers_to"))


def test_null_ids_have_records_of_their_own(spark):
    pages = spark.createDataFrame([(None, "u", "a"), (None, "u", "b" * 200), (5, "u", "b" * 200), (None, None, None)], "page_id long, url string, html string")
    out = warc.warc_round_trip(pages).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in out) == [(0, 0, "response", 0), (0, 1, "response", 0), (0, 200, "revisit", 5), (5, 200, "response", 0)]


def test_warc_roles(spark, sf):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rows += [(9001, rows[0][1]), (9002, rows[0][1]), (9003, "short"), (9004, "short"), (9005, None), (9006, "")]
    pages = spark.createDataFrame([(i, "http://x\r\ny", h) for i, h in rows], "page_id long, url string, html string")
    first = {}
    for i, h in sorted(rows):
        first.setdefault(h or "", i)
    want = {}
    for i, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and first[h] != i
        want[i] = (len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None)
    out = warc.warc_round_trip(pages).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out} == want and len(out) == len(rows)
    assert warc.warc_round_trip(pages.limit(0)).count() == 0
