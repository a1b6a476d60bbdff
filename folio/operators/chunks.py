"""Chunks of texts by paragraphs and sentences, with an overlap that begins at a word."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Quotes, and the ends of sentences.
QUOTES, ENDS = "\"'", ".!?。！？"
STOPS = re.compile(f"[{re.escape(QUOTES + ENDS)}]")
#: A single paragraph longer than this is cut into sentences from the start.
LONG_PARAGRAPH = 1000


def sentences(text: str) -> Iterator[str]:
    """Sentences end outside quotes, before white space or where one character is left; an apostrophe counts as a quote."""
    begin, quoted, last = 0, False, len(text) - 1
    for m in STOPS.finditer(text):
        i = m.start()
        if m[0] in QUOTES:
            quoted = not quoted
        elif not quoted and i < last and (text[i + 1].isspace() or i + 1 == last) and (own := text[begin : i + 1].strip()):
            yield own
            begin = i + 1
    if own := text[begin:].strip():
        yield own


def paragraphs(text: str) -> list[str]:
    parts = [p.strip() for p in text.replace("\r\n", "\n").replace("\r", "\n").split("\n\n")]
    parts = [p for p in parts if p]
    return list(sentences(parts[0])) if len(parts) == 1 and len(parts[0]) > LONG_PARAGRAPH else parts


def fixed(text: str, size: int) -> list[str]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def overlap_of(text: str, size: int) -> str:
    """The end of a chunk, from its second word on where the first may be cut."""
    if len(text) <= size:
        return text
    words = text[-size:].split()
    return " ".join(words[1:]) if len(words) > 1 else text[-size:]


def of_sentences(paragraph: str, size: int) -> Iterator[str]:
    """Sentences of a long paragraph, packed greedily; a longer one is cut at fixed widths."""
    held, used = [], 0
    for s in sentences(paragraph):
        if held and (len(s) > size or used + len(s) + 1 > size):
            yield " ".join(held).strip()
            held, used = [], 0
        if len(s) > size:
            yield from fixed(s, size)
        else:
            used += len(s) + (1 if held else 0)
            held.append(s)
    if held:
        yield " ".join(held).strip()


def chunks(text: str, size: int = 2000, overlap: int = 100) -> Iterator[str]:
    """Paragraphs packed greedily up to `size` characters (one more counts for the gap); a new chunk begins with the overlap."""
    if len(text) <= size:
        yield from [text] if text else []
        return
    held, used = "", 0
    for p in paragraphs(text):
        if len(p) > size:
            if held:
                yield held.strip()
            held, used = "", 0
            yield from of_sentences(p, size)
            continue
        if used and used + len(p) + 1 > size:
            yield held.strip()
            held = overlap_of(held, overlap) if overlap else ""
            used = len(held)
            held += "\n\n" if held else ""
        if held:
            held, used = held + "\n\n", used + 2
        held, used = held + p, used + len(p)
    if held:
        yield held.strip()


def chunk_rows(docs: DataFrame, size: int = 2000, overlap: int = 100) -> DataFrame:
    """doc_id, place, chunk: a row per chunk of each text; a null or empty text has none. One text at a time is in memory."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for doc, text in zip(b.column(0), b.column(1)):
                made = list(chunks(text.as_py() or "", size, overlap))
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(made), b.schema.field(0).type), pa.array(range(1, len(made) + 1), pa.int64()), pa.array(made)], names=["doc_id", "place", "chunk"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, place long, chunk string")
