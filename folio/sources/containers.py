"""EPUB, DOCX, TextBundle and TextPack: containers as rows of their texts, and containers with texts put back.

Files come as rows (path, content) as Spark's binaryFile reader gives them, so any store will do.
"""

from __future__ import annotations

import io
import json
import posixpath
import xml.etree.ElementTree as ET
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of XML parts and tags.
CONTAINER = "META-INF/container.xml"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Formats by extension.
FORMATS = {"txt": "text", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "xml": "html", "epub": "epub", "docx": "docx", "doc": "docx", "textbundle": "textbundle", "textpack": "textpack"}


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of all files under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text: whole files as UTF-8 text."""
    return files(spark, path).select("path", F.decode("content", "UTF-8").alias("text"))


def format_of(path: Column) -> Column:
    """The format by extension, null for others."""
    known = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    return F.element_at(known, F.lower(F.regexp_extract(path, r"\.([^./]+)/?$", 1)))


def package_of(z: zipfile.ZipFile) -> str:
    """The package file of an EPUB: that which the container names, else the first by name."""
    if CONTAINER in z.namelist():
        for e in ET.fromstring(z.read(CONTAINER)).iter():
            if e.tag.endswith("rootfile") and e.get("full-path") in z.namelist():
                return e.get("full-path")
    found = sorted(n for n in z.namelist() if n.endswith(".opf"))
    if not found:
        raise ValueError("the archive holds no package file")
    return found[0]


def epub_parts(data: bytes) -> list[tuple[int, str, str]]:
    """place, name, html of the spine's items in order; ids that the manifest lacks are left out."""
    z = zipfile.ZipFile(io.BytesIO(data))
    package = package_of(z)
    root, base = ET.fromstring(z.read(package)), posixpath.dirname(package)
    items = {e.get("id"): posixpath.normpath(posixpath.join(base, e.get("href"))) for e in root.iter() if e.tag.endswith("}item") or e.tag == "item"}
    spine = [items[e.get("idref")] for e in root.iter() if (e.tag.endswith("}itemref") or e.tag == "itemref") and e.get("idref") in items]
    return [(i, n, z.read(n).decode("utf-8", "replace")) for i, n in enumerate((n for n in spine if n in z.namelist()), 1)]


def rezipped(data: bytes, changed: dict[str, bytes]) -> bytes:
    """The archive with these entries replaced, all others and their order as they were."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w") as made:
        for i in z.infolist():
            made.writestr(i, changed.get(i.filename, z.read(i.filename)))
    return out.getvalue()


def run_text(run: ET.Element) -> str:
    """Text of a run; a tab, line or page break counts where the run holds no text."""
    text = "".join(t.text or "" for t in run.iter(f"{WORD}t"))
    if text:
        return text
    breaks = [e.get(f"{WORD}type") for e in run.iter(f"{WORD}br")]
    return "".join(["\t" * sum(1 for _ in run.iter(f"{WORD}tab")), *("\n\n" if b == "page" else "\n" for b in breaks)])


def docx_blocks(root: ET.Element) -> list[tuple[str, ET.Element]]:
    """kind and paragraph: all paragraphs of the body, then those of table cells, those with text."""
    body = next(root.iter(f"{WORD}body"))
    found = [("paragraph", p) for p in body.findall(f"{WORD}p")] + [("cell", p) for t in body.iter(f"{WORD}tbl") for p in t.iter(f"{WORD}p")]
    return [(k, p) for k, p in found if paragraph_text(p).strip()]


def paragraph_text(p: ET.Element) -> str:
    return "".join(run_text(r) for r in p.iter(f"{WORD}r"))


def docx_parts(data: bytes) -> list[tuple[int, str, str]]:
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    return [(i, k, paragraph_text(p)) for i, (k, p) in enumerate(docx_blocks(root), 1)]


def shares(text: str, sizes: list[int]) -> list[str]:
    """The text cut in proportion to the sizes, the rest to the last."""
    whole, out, at = max(1, sum(sizes)), [], 0
    for n in sizes[:-1]:
        to = at + len(text) * n // whole
        out.append(text[at:to])
        at = to
    return [*out, text[at:]]


def docx_with(data: bytes, texts_: dict[int, str], keep_runs: bool = False) -> bytes:
    """The document with texts in its blocks: in the first run of each, or over its runs in proportion."""
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    for i, (_, p) in enumerate(docx_blocks(root), 1):
        if i in texts_:
            runs = [r for r in p.iter(f"{WORD}r") if r.find(f"{WORD}t") is not None]
            sizes = [len(run_text(r).encode()) for r in runs]
            parts = shares(texts_[i], sizes) if keep_runs else [texts_[i], *[""] * (len(runs) - 1)]
            for r, part in zip(runs, parts):
                first, *others = r.findall(f"{WORD}t")
                first.text = part
                first.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
                for e in others:
                    r.remove(e)
    return rezipped(data, {"word/document.xml": ET.tostring(root, encoding="utf-8", xml_declaration=True)})


def epub_with(data: bytes, texts_: dict[int, str]) -> bytes:
    return rezipped(data, {n: texts_[i].encode() for i, n, _ in epub_parts(data) if i in texts_})


def bundle_parts(data: bytes) -> list[tuple[int, str, str]]:
    """place, name, text of a zipped TextBundle: its text, and its info as JSON."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = sorted(z.namelist(), key=lambda n: (n.count("/"), n))
    text = next((n for n in names if posixpath.basename(n).startswith("text.")), None)
    info = next((n for n in names if posixpath.basename(n) == "info.json"), None)
    made = [(text, z.read(text).decode())] if text else []
    made += [(info, json.dumps(json.loads(z.read(info)), sort_keys=True, ensure_ascii=False))] if info else []
    return [(i, n, t) for i, (n, t) in enumerate(made, 1)]


def bundle_with(data: bytes, texts_: dict[int, str]) -> bytes:
    return rezipped(data, {n: texts_[i].encode() for i, n, _ in bundle_parts(data) if i in texts_})


PARTS = {"epub": epub_parts, "docx": docx_parts, "textpack": bundle_parts, "textbundle": bundle_parts}
PUT = {"epub": epub_with, "docx": docx_with, "textpack": bundle_with, "textbundle": bundle_with}


def parts(found: DataFrame, kind: str) -> DataFrame:
    """path, place, name, text of the containers (path, content) of this kind."""
    each = PARTS[kind]

    def run(batches):
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1)):
                rows = each(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.string()) for k in (1, 2))], names=["path", "place", "name", "text"])

    return found.select("path", "content").mapInArrow(run, "path string, place long, name string, text string")


def put_back(found: DataFrame, translated: DataFrame, kind: str) -> DataFrame:
    """path, content: containers with the texts of translated(path, place, text) in place; other parts as they are."""
    each = PUT[kind]
    given = translated.groupBy(F.col("path").alias("_path")).agg(F.collect_list(F.struct("place", "text")).alias("_texts"))

    def run(batches):
        for b in batches:
            made = [each(data, {t["place"]: t["text"] for t in own or ()}) for data, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    return found.select("path", "content").join(given, F.col("path") == F.col("_path"), "left").select("path", "content", "_texts").mapInArrow(run, "path string, content binary")
