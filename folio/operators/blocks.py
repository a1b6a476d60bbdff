"""Markdown documents to typed blocks, and oversized nodes to pieces.

Both scan lines with a state that SQL folds express badly, so they run on Arrow batches; a document is
one row and no shuffle is needed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FENCE = "```"
HEADING = re.compile(r"#{1,6}\s+.+$")
HEADING_START = re.compile(r"#{1,6}\s+")
ITEM = re.compile(r"\s*(?:[-*+]|[0-9]+\.)\s+")
RULE = re.compile(r"(?:\*{3,}|-{3,}|_{3,})$")
SEPARATOR = re.compile(r"\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
GUARDS = ("REFERENCES_PROTECTED", "TABLE_PROTECTED")
#: Kinds of blocks whose text is not translated.
FIXED_KINDS = frozenset({"code", "protected", "hr", "empty"})


def kind_of(lines: list[str], i: int) -> str:
    """The kind of the block that begins at line i."""
    line = lines[i]
    bare = line.strip()
    tests = (
        ("code", lambda: line.startswith(FENCE)),
        ("heading", lambda: HEADING.match(line)),
        ("list", lambda: ITEM.match(line)),
        ("quote", lambda: bare.startswith(">")),
        ("table", lambda: "|" in line and i + 1 < len(lines) and SEPARATOR.match(lines[i + 1])),
        ("protected", lambda: any(f"<!-- {g} -->" in line for g in GUARDS)),
        ("hr", lambda: RULE.match(bare)),
        ("empty", lambda: not bare),
    )
    return next((name for name, holds in tests if holds()), "paragraph")


def breaks_paragraph(line: str) -> bool:
    bare = line.strip()
    return not bare or line.startswith(FENCE) or bare.startswith(">") or bool(HEADING_START.match(line) or ITEM.match(line) or RULE.match(bare))


def end_of(kind: str, lines: list[str], i: int) -> int:
    """The line after the block of this kind that begins at line i; a block has one line at least."""
    after = range(i + 1, len(lines))
    if kind == "code":
        return next((k + 1 for k in after if lines[k].startswith(FENCE)), len(lines))
    if kind == "protected":
        guard = next(g for g in GUARDS if f"<!-- {g} -->" in lines[i])
        return next((k + 1 for k in range(i, len(lines)) if f"<!-- /{guard} -->" in lines[k]), len(lines))
    if kind == "quote":
        return next((k for k in after if not lines[k].strip().startswith(">")), len(lines))
    if kind == "table":
        return next((k for k in after if not lines[k].strip() or k > i + 1 and "|" not in lines[k]), len(lines))
    if kind == "paragraph":
        return next((k for k in after if breaks_paragraph(lines[k])), len(lines))
    return i + 1


def markdown_blocks(text: str | None) -> Iterator[tuple[str, str]]:
    """(kind, content) of each block, empty lines included, so the contents joined by \\n are the text. A null text has none."""
    lines = [] if text is None else text.split("\n")
    i = 0
    while i < len(lines):
        kind = kind_of(lines, i)
        end = end_of(kind, lines, i)
        yield kind, "\n".join(lines[i:end])
        i = end


#: Split sizes in characters, and the share of a piece that its successor repeats.
THRESHOLD, MOST, OVERLAP = 1500, 800, 0.1
CODE = re.compile(r"^```[\s\S]*?^```$", re.M)
TABLE_LINE, LIST_LINE = re.compile(r"\|.*\|.*$"), re.compile(r"\s*[-*+]\s+|\s*[0-9]+\.\s+")


def fixed_width(text: str, most: int = MOST) -> list[str]:
    return [text[i : i + most] for i in range(0, len(text), most)]


def packed_segments(segments: list[str], most: int = MOST, overlap: float = OVERLAP) -> list[str]:
    """Segments joined by \\n up to `most` characters; what is longer alone is cut at fixed widths."""
    out, held = [], ""
    for s in segments:
        if len(s) > most:
            out += [*([held.strip()] if held else []), *fixed_width(s, most)]
            held = ""
            continue
        if held and len(held) + 1 + len(s) > most:
            out.append(held.strip())
            tail = int(len(held) * overlap)
            held = held[-tail:] + "\n" if 0 < tail < len(held) else ""
        held = f"{held}\n{s}" if held else s
    return [*out, held.strip()] if held else out


def packed_lines(text: str, most: int, may_cut: Callable[[str], bool]) -> list[str]:
    """Lines in pieces of up to `most` characters, cut only before lines that allow it."""
    out, held, size = [], [], 0
    for line in text.split("\n"):
        allowed = may_cut(line)
        if allowed and size and size + len(line) + 1 > most:
            out.append("\n".join(held).strip())
            held, size = [], 0
        held.append(line)
        size += len(line) + 1
    return [*out, "\n".join(held).strip()] if any(held) or len(held) > 1 else out


class OutsideFences:
    """True for lines that are not inside a fenced block; a closing fence counts as outside."""

    def __init__(self):
        self.opened = ""

    def __call__(self, line: str) -> bool:
        if line.startswith((FENCE, "~~~")):
            if not self.opened:
                self.opened = line[:3]
            elif line.startswith(self.opened):
                self.opened = ""
        return not self.opened


def is_item(line: str) -> bool:
    return bool(re.match(r"[-*+] |\d+[.)] ", line.strip()))


def split_text(text: str, threshold: int = THRESHOLD, most: int = MOST, overlap: float = OVERLAP) -> list[str]:
    """The pieces of an oversized text by its kind of content: outside of fences, at table rows, at list items, else by paragraphs.

    A text of up to `threshold` characters is its own only piece. Table rows are written once each.
    """
    if len(text) <= threshold:
        return [text]
    lines = text.split("\n")
    if CODE.search(text):
        return packed_lines(text, most, OutsideFences())
    if sum(bool(TABLE_LINE.match(x)) for x in lines) >= 2:
        return packed_lines(text, most, lambda x: "|" in x)
    if sum(bool(LIST_LINE.match(x)) for x in lines) >= 2:
        return packed_lines(text, most, is_item)
    return packed_segments(text.split("\n\n"), most, overlap)


ENDS = frozenset(".!?。！？")
QUOTES = frozenset("\"'“”‘’")


def sentences(text: str, least: int = 10) -> list[str]:
    """Sentences outside of quotes; one of up to `least` characters stays with the next."""
    out, begin, quoted = [], 0, False
    for i, c in enumerate(text):
        quoted ^= c in QUOTES
        if quoted or c not in ENDS:
            continue
        final = i + 1 == len(text)
        if final or text[i + 1].isspace() or i + 2 == len(text):
            s = text[begin : i + 1].strip()
            if len(s) > (0 if final else least):
                out.append(s)
                begin = i + 1
    rest = text[begin:].strip()
    return [*out, rest] if rest else out


def exploded(docs: DataFrame, schema: str, rows: Callable[[str | None], list[tuple]]) -> DataFrame:
    """doc_id, place (1-based) and the columns of schema: a row for each tuple that rows(text) gives."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    full = f"doc_id {kind}, place long, {schema}"
    out = to_arrow_schema(StructType.fromDDL(full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                made = [(d, k, *r) for d, t in zip(*(c.to_pylist() for c in part.columns)) for k, r in enumerate(rows(t), 1)]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), out)], schema=out)

    return docs.select("doc_id", "text").mapInArrow(run, full)


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, place, kind, content, translatable of each Markdown block."""
    return exploded(docs, "kind string, content string, translatable boolean", lambda t: [(k, c, k not in FIXED_KINDS) for k, c in markdown_blocks(t)])


def pieces(docs: DataFrame) -> DataFrame:
    """doc_id, place, piece: each text, cut where it is oversized. A null text has no pieces."""
    return exploded(docs, "piece string", lambda t: [] if t is None else [(p,) for p in split_text(t)])


def sentence_rows(docs: DataFrame) -> DataFrame:
    return exploded(docs, "sentence string", lambda t: [(s,) for s in sentences(t or "")])
