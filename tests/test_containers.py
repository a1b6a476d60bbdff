"""Containers and chunks on small inputs."""

import io
import random
import zipfile

from pyspark.sql import functions as F

from folio.operators import chunks as C
from folio.sources import containers as K

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in entries.items():
            z.writestr(n, t)
    return out.getvalue()


EPUB = zipped({
    "mimetype": "application/epub+zip", "META-INF/container.xml": '<container xmlns="urn:x"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>',
    "OPS/p.opf": '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="b" href="b.html"/><item id="a" href="t/a.html"/><item id="c" href="c.css"/></manifest><spine><itemref idref="a"/><itemref idref="none"/><itemref idref="b"/></spine></package>',
    "OPS/b.html": "<p>B</p>", "OPS/t/a.html": "<p>A</p>", "OPS/c.css": "p{}",
})
DOCX = zipped({"word/document.xml": f'<w:document xmlns:w="{W}"><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:tab/></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:br w:type="page"/></w:r><w:r><w:t>last</w:t></w:r></w:p></w:body></w:document>', "x.bin": "x"})
PACK = zipped({"n.textbundle/info.json": '{"version": 2, "b": 1}', "n.textbundle/text.md": "# T", "n.textbundle/assets/a.png": "p"})


def test_containers(spark):
    found = spark.createDataFrame([("a.epub", "epub", EPUB), ("a.docx", "docx", DOCX), ("a.textpack", "textpack", PACK)], "path string, kind string, content binary")
    want = {"epub": [("OPS/t/a.html", "<p>A</p>"), ("OPS/b.html", "<p>B</p>")], "docx": [("paragraph", "One \ttwo"), ("paragraph", "\n\nlast"), ("cell", "cell")], "textpack": [("n.textbundle/text.md", "# T"), ("n.textbundle/info.json", '{"b": 1, "version": 2}')]}
    for kind, rows in want.items():
        own = found.where(F.col("kind") == kind)
        got = K.parts(own, kind)
        assert [(r.name, r.text) for r in got.orderBy("place").collect()] == rows
        back = K.put_back(own, got.where("place = 1").select("path", "place", F.lit("<p>new</p>").alias("text")), kind)
        assert [r.text.strip() for r in K.parts(back, kind).orderBy("place").collect()] == ["<p>new</p>", *(t.strip() for _, t in rows[1:])]
    assert [r.f for r in found.select(K.format_of(F.col("path")).alias("f")).collect()] == ["epub", "docx", "textpack"]


def test_runs_in_proportion():
    assert K.shares("abcdefghij", [3, 2, 5]) == ["abc", "de", "fghij"] and K.shares("abc", [1]) == ["abc"]
    assert K.docx_parts(K.docx_with(DOCX, {1: "Uno dos"}, keep_runs=True))[0][2] == "Uno \tdos"


def test_files_as_rows(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_text("héllo\nworld")
    got = K.texts(spark, f"file://{tmp_path}").first()
    assert got.path.endswith("sub/a.txt") and got.text == "héllo\nworld"


def test_sentences_and_chunks(spark):
    assert list(C.sentences('He said "No. Go." Then left. It\'s off. done')) == ['He said "No. Go." Then left.', "It's off. done"]
    assert C.paragraphs("a\r\n\r\n b \n\n\n\nc") == ["a", "b", "c"] and len(C.paragraphs("One is here. " * 100)) == 100
    assert list(C.chunks("aaaa\n\nbbbb\n\ncccc", 10, 0)) == ["aaaa\n\nbbbb", "cccc"]
    assert C.overlap_of("one two three four", 9) == "four"
    r = random.Random(2)
    text = "\n\n".join(" ".join(f"w{r.randrange(99)}" + r.choice(["", ".", "!"]) for _ in range(r.randrange(1, 120))) for _ in range(60))
    for size, overlap in ((80, 0), (200, 20), (2000, 100)):
        made = list(C.chunks(text, size, overlap))
        assert all(0 < len(c) <= size + overlap + 4 for c in made)
        if not overlap:
            assert "".join("".join(made).split()) == "".join(text.split())
    docs = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "", 0)], "doc_id long, text string, chunk int")
    assert [r.chunk for r in C.chunk_rows(docs, 200, 20).orderBy("place").collect()] == list(C.chunks(text, 200, 20))
