"""HTML as rows: text and attribute nodes with their context, Markdown of pages, and pages with texts put back.

Spark has no HTML parser of its own, so pages go through Python's in Arrow batches; what follows is DataFrames.
Each text is one node, known by its place in the document, however many elements are around it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.responses import attribute_priority, node_priority

#: Elements whose texts are not translated, elements without an end, attributes that hold text.
SKIPPED = frozenset(("script", "style", "noscript", "iframe", "object", "embed", "canvas", "svg", "math", "code", "pre"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
ATTRIBUTES = ("alt", "title", "placeholder", "aria-label", "aria-description", "data-tooltip", "data-title", "label")
SECTIONS = frozenset(("header", "nav", "main", "article", "section", "aside", "footer"))
EDGES = re.compile(r"^([ \t\r\n]*)(.*?)([ \t\r\n]*)$", re.S)
MOST_BYTES = 500


class Page(HTMLParser):
    """Pieces of a page in order: what stands between texts as it is, and the texts and attributes that are nodes."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=False)
        self.html, self.open, self.nodes, self.counts = html, [], [], [{}]
        self.starts = [0]
        for line in html.split("\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.text_at = None
        self.feed(html)
        self.close()
        self._close_text(len(html))

    def _at(self) -> int:
        line, column = self.getpos()
        return self.starts[min(line - 1, len(self.starts) - 1)] + column

    def _close_text(self, end: int) -> None:
        if self.text_at is not None:
            start, self.text_at = self.text_at, None
            text = self.html[start:end]
            if text.strip() and not any(skip for _, skip, _ in self.open):
                self.nodes.append((start, end, self._path() + "/text()", text, None, self.open[-1][0] if self.open else "body", self._section()))

    def _path(self) -> str:
        return "".join([f"/{p}" for _, _, p in self.open])

    def _section(self) -> str:
        return next((t for t, _, _ in reversed(self.open) if t in SECTIONS), "body")

    def handle_starttag(self, tag, attrs):
        start = self._at()
        self._close_text(start)
        seen = self.counts[-1]
        seen[tag] = seen.get(tag, 0) + 1
        step = f"{tag}[{seen[tag]}]"
        skip = tag in SKIPPED or any(k == "translate" and v == "no" for k, v in attrs)
        if not skip and not any(s for _, s, _ in self.open):
            kind = dict(attrs).get("type")
            for name, value in attrs:
                wanted = name in ATTRIBUTES or name == "value" and tag in ("input", "button") and kind in ("submit", "button")
                if wanted and value and value.strip() and len(value.encode("utf-8", "surrogatepass")) <= MOST_BYTES:
                    self.nodes.append((start, start + len(self.get_starttag_text()), f"{self._path()}/{step}/@{name}", value, name, tag, self._section()))
        if tag not in VOID:
            self.open.append((tag, skip, step))
            self.counts.append({})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()
            self.counts.pop()

    def handle_endtag(self, tag):
        self._close_text(self._at())
        if any(t == tag for t, _, _ in self.open):
            while self.open.pop()[0] != tag:
                self.counts.pop()
            self.counts.pop()

    def _text(self, *_):
        if self.text_at is None:
            self.text_at = self._at()

    handle_data = handle_entityref = handle_charref = _text

    def _other(self, *_):
        self._close_text(self._at())

    handle_comment = handle_decl = handle_pi = unknown_decl = _other


def nodes_of(html: str) -> Iterator[tuple]:
    """path, text, lead, trail, attribute, parent, section, before, after of each node in order; references as they stand."""
    found = sorted(Page(html).nodes, key=lambda n: (n[0], n[4] or ""))
    texts = [EDGES.match(n[3]) for n in found]
    for i, (n, m) in enumerate(zip(found, texts)):
        before, after = (texts[i - 1][2][-50:] if i else ""), (texts[i + 1][2][:50] if i + 1 < len(texts) else "")
        yield n[2], m[2], m[1], m[3], n[4], n[5], n[6], before, after


NODES = "node_id long, path string, text string, lead string, trail string, attribute string, parent string, section string, before string, after string"


def html_nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key and NODES, is_attribute, priority: a row per text or attribute that is translated; a null page has none."""
    kind = pages.schema[key].dataType.simpleString()
    kinds = [pa.int64(), *[pa.string()] * 9]

    def run(batches):
        for b in batches:
            for k, page in zip(b.column(0), b.column(1)):
                rows = [(i, *n) for i, n in enumerate(nodes_of(page.as_py() or ""), 1)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(rows), b.schema.field(0).type), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]], names=[key, *[f.split()[0] for f in NODES.split(", ")]])

    made = pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, {NODES}")
    is_attribute = F.col("attribute").isNotNull()
    return made.withColumns({"is_attribute": is_attribute, "priority": F.when(is_attribute, attribute_priority(F.col("attribute"))).otherwise(node_priority(F.col("parent"), is_attribute))})


def translatable_attribute(value: Column) -> Column:
    """Whether an attribute's value is text: no address, no identifier of less than 30 letters, digits, `_` and `-`."""
    like_url = value.rlike(r"(?i)^(?:https?://|ftp://|www\.|mailto:|/|#|\./|\.\./)")
    return ~like_url & ~value.rlike(r"^[A-Za-z0-9_-]{1,29}$")


def put_back(html: str, texts: dict[int, str]) -> str:
    """The page with the texts of these nodes replaced, blanks around them and all else as it was."""
    out, at = [], 0
    found = sorted(Page(html).nodes, key=lambda n: (n[0], n[4] or ""))
    tags: dict[int, str] = {}
    for i, n in enumerate(found, 1):
        if i not in texts:
            continue
        start, end, _, old, attribute = n[:5]
        if attribute is None:
            m = EDGES.match(old)
            tags[start] = (end, m[1] + texts[i] + m[3])
        else:  # several attributes of one tag are replaced one after the other
            tag = tags.get(start, (end, html[start:end]))[1]
            pattern = re.compile(rf"""(\s{re.escape(attribute)}\s*=\s*)("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
            tags[start] = (end, pattern.sub(lambda m, i=i: f'{m[1]}"{escape(texts[i])}"', tag, count=1))
    for start, (end, text) in sorted(tags.items()):
        out += [html[at:start], text]
        at = end
    return "".join([*out, html[at:]])


def html_render(pages: DataFrame, translated: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, html: pages with the texts of translated(key, node_id, text) in their nodes; others stay as they are."""
    kind = pages.schema[key].dataType.simpleString()
    given = translated.groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct("node_id", "text")).alias("_texts"))
    rows = pages.select(key, html).join(given, F.col(key) == F.col("_key"), "left").select(key, html, "_texts")

    def run(batches):
        for b in batches:
            made = [page if page is None or not texts else put_back(page, {t["node_id"]: t["text"] for t in texts}) for page, texts in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], names=[key, "html"])

    return rows.mapInArrow(run, f"`{key}` {kind}, html string")


class Markdown(HTMLParser):
    """The body of a page as Markdown."""

    #: Marks around inline elements.
    MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.lists, self.links, self.skip = [], [], [], 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style", "head", "title"):
            self.skip += 1
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "p":
            self.out.append("\n\n")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "pre":
            self.out.append("\n\n```\n")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n\n" if len(self.lists) == 1 else "")
        elif tag == "li":
            self.lists = self.lists or [["ul", 0]]
            self.lists[-1][1] += 1
            self.out.append("\n" + ("- " if self.lists[-1][0] == "ul" else f"{self.lists[-1][1]}. "))
        elif tag == "a":
            self.links.append(a.get("href") or "")
            self.out.append("[")
        elif tag == "img":
            self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag in self.MARKS:
            self.out.append(self.MARKS[tag])

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head", "title"):
            self.skip = max(0, self.skip - 1)
        elif tag == "pre":
            self.out.append("\n```\n\n")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag == "p" or len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.out.append("\n\n")
        elif tag in self.MARKS:
            self.out.append(self.MARKS[tag])

    def handle_data(self, data):
        if self.out and self.out[-1].endswith(" "):
            data = data.lstrip(" ")
        if not self.skip and (data.strip() or self.out and not self.out[-1].endswith("\n")):
            self.out.append(data)


def markdown_of(html: str | None) -> str:
    made = Markdown()
    made.feed(html or "")
    made.close()
    return re.sub(r"\n{3,}", "\n\n", "".join(made.out)).strip()


def html_markdown(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, text: each page's body as one Markdown text."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([markdown_of(x) for x in b.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, text string")


def inline_html(c: Column) -> Column:
    """Inline Markdown as HTML: images, links, bold, italic and code."""
    c = F.regexp_replace(c, r"!\[([^\]]*)\]\(([^)]*)\)", '<img src="$2" alt="$1"/>')
    c = F.regexp_replace(c, r"\[([^\]]*)\]\(([^)]*)\)", '<a href="$2">$1</a>')
    c = F.regexp_replace(c, r"\*\*([^*\n]+)\*\*", "<strong>$1</strong>")
    c = F.regexp_replace(c, r"\*([^*\n]+)\*", "<em>$1</em>")
    return F.regexp_replace(c, r"`([^`\n]+)`", "<code>$1</code>")


def block_html(c: Column) -> Column:
    """One Markdown block as HTML: headings, lists of items that start with `-` or `*`, else a paragraph."""
    level = F.char_length(F.regexp_extract(c, r"^(#{1,6})\s", 1)).cast("string")
    items = F.transform(F.filter(F.split(c, "\n"), lambda x: x.rlike(r"^\s*[-*]\s+")), lambda x: F.concat(F.lit("<li>"), inline_html(F.regexp_replace(x, r"^\s*[-*]\s+", "")), F.lit("</li>")))
    heading = F.concat(F.lit("<h"), level, F.lit(">"), inline_html(F.regexp_replace(c, r"^#{1,6}\s+", "")), F.lit("</h"), level, F.lit(">"))
    return F.when(c.rlike(r"^#{1,6}\s"), heading).when(c.rlike(r"^\s*[-*]\s+"), F.concat(F.lit("<ul>"), F.array_join(items, ""), F.lit("</ul>"))).otherwise(F.concat(F.lit("<p>"), inline_html(c), F.lit("</p>")))


def markdown_html(text: Column) -> Column:
    """A Markdown text as HTML, block by block."""
    blocks = F.filter(F.split(text, r"\n\s*\n"), lambda b: F.trim(b) != "")
    return F.array_join(F.transform(blocks, block_html), "\n")


def with_body(html: Column, body: Column) -> Column:
    """The page with another body, its head and attributes as they were; a page without a body is the new body."""
    parts = F.regexp_extract(html, r"(?is)^(.*?<body[^>]*>).*(</body>.*)$", 1), F.regexp_extract(html, r"(?is)^(.*?<body[^>]*>).*(</body>.*)$", 2)
    return F.when(parts[0] == "", body).otherwise(F.concat(parts[0], body, parts[1]))
