"""Protection: spans that must not change become numbered placeholders, and come back afterwards.

Everything is one fold over an ordered list of patterns, so it stays in the JVM. Each pattern sees the
text as the earlier ones left it; the numbers run on through all patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.bind import bound

PREFIX, SUFFIX = "@@PRESERVE_", "@@"
MARK = r"@@PRESERVE_\d+@@"

#: The ordered patterns of each format, in Java's dialect (`(?d)`: only \n ends a line).
COMMON = (
    r"(?i)(https?|ftp|file)://[^\s\)]+",
    r"(?i)www\.[^\s\)]+",
    r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    r"(?:^|[\s(])/(?:[^/\s]+/)*[^/\s]+(?:\.[a-zA-Z0-9]+)?",
    r'[A-Za-z]:\\(?:[^\\/:*?"<>|\r\n]+\\)*[^\\/:*?"<>|\r\n]+',
    r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    r"\bv?\d+\.\d+(?:\.\d+)?(?:-[a-zA-Z0-9]+)?(?:\+[a-zA-Z0-9]+)?\b",
)
MARKDOWN = (
    *COMMON,
    "(?s)```[^\\n]*\\n.*?\\n```",
    r"(?dm)^(?: {4}|\t)+.*$",
    "`[^`]+`",
    r"(?s)\$\$[^$]*?\$\$",
    r"\$[^$\n]*?\$",
    r"(?s)\\\[[^\]]*?\\\]",
    r"(?s)\\\([^\)]*?\\\)",
    r"(?dm)^\|.*\|[ \t]*$\n^\|[ \t]*[-:| ]+[ \t]*\|[ \t]*$(?:\n^\|.*\|[ \t]*$)*",
    r"(?dm)^[ \t]*!\[[^\]]*\]\([^)]+\)[ \t]*$",
    r"!\[[^\]]*\]\[[^\]]*\]",
    r"(?dm)^\s*\[[^\]]+\]:\s*\S+.*$",
    r"(?s)<table[^>]*>.*?</table>",
    r"(?s)<script[^>]*>.*?</script>",
    r"(?s)<style[^>]*>.*?</style>",
    r"<[^>]+>",
    r"&[a-zA-Z]+;",
    r"&#\d+;",
    r"(?s)<!-- TABLE_PROTECTED -->.*?<!-- /TABLE_PROTECTED -->",
    r"(?s)<!-- REFERENCES_PROTECTED -->.*?<!-- /REFERENCES_PROTECTED -->",
    r"(?s)<!-- [A-Z_]+_PROTECTED -->.*?<!-- /[A-Z_]+_PROTECTED -->",
    r"\[[0-9]+([-,][0-9]+)*\]",
)
HTML = (
    *COMMON,
    r"(?s)<script[^>]*>.*?</script>",
    r"(?s)<style[^>]*>.*?</style>",
    r"(?s)<pre[^>]*>.*?</pre>",
    r"(?s)<code[^>]*>.*?</code>",
    r"(?s)<table[^>]*>.*?</table>",
    r"(?s)<form[^>]*>.*?</form>",
    r"<input[^>]*>",
    r"(?d)<button[^>]*>.*?</button>",
    r"<img[^>]*>",
    r"(?s)<video[^>]*>.*?</video>",
    r"(?s)<audio[^>]*>.*?</audio>",
    r"<meta[^>]*>",
    r"<link[^>]*>",
    r"""<a\s+class=["']page["'][^>]*/>""",
    r"""<a\s+[^>]*class=["'][^"']*page[^"']*["'][^>]*/>""",
    r"""<a\s+class=["']anchor["'][^>]*/>""",
    r"""<a\s+[^>]*class=["'][^"']*anchor[^"']*["'][^>]*/>""",
    r"""<a\s+id=["'][^"']+["'][^>]*/>""",
    r"""<a\s+name=["'][^"']+["'][^>]*/>""",
    r"""(?d)<a\s+class=["']xref["'][^>]*>.*?</a>""",
    r"""(?d)<a\s+[^>]*class=["'][^"']*xref[^"']*["'][^>]*>.*?</a>""",
    r"(?s)<nav[^>]*>.*?</nav>",
    r"""(?s)<div\s+class=["']nav[^"']*["'][^>]*>.*?</div>""",
    r"""(?s)<div\s+class=["']toc[^"']*["'][^>]*>.*?</div>""",
    r"""(?s)<div\s+id=["']toc["'][^>]*>.*?</div>""",
    r"""(?d)<a\s+href=["']#[^"']*["'][^>]*>.*?</a>""",
    r"(?s)<svg[^>]*>.*?</svg>",
    r"(?s)<math[^>]*>.*?</math>",
    r'\s+[a-zA-Z-]+="[^"]*"',
    r"\s+[a-zA-Z-]+='[^']*'",
    r"&[a-zA-Z]+;",
    r"&#\d+;",
    r"&#x[0-9a-fA-F]+;",
    r"(?s)<!--.*?-->",
)
TEXT = (
    *COMMON,
    r"(?dm)^(?: {4}|\t)+.*$",
    r"(?dm)^[-=]{3,}$",
    r"(?dm)^[*]{3,}$",
    r"(?dm)^[+\-|\s]+[+\-|]$",
)
FORMATS = {"markdown": MARKDOWN, "html": HTML, "epub": HTML, "text": TEXT}
EXTENSIONS = {"md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "epub": "epub", "txt": "text"}


def patterns_for(format_name: str) -> tuple[str, ...]:
    """The patterns of a format; those common to all where it is unknown."""
    return FORMATS.get(format_name.lower(), COMMON)


def patterns_for_extension(extension: str) -> tuple[str, ...]:
    return patterns_for(EXTENSIONS.get(extension.lower().lstrip("."), ""))


def placeholder(number: Column) -> Column:
    return F.concat(F.lit(PREFIX), number.cast("string"), F.lit(SUFFIX))


def protected(text: Column, patterns: tuple[str, ...]) -> Column:
    """struct<text string, kept array<string>>: kept holds what stood at each placeholder. A null text gives null fields."""

    def step(acc: Column, pattern: Column) -> Column:
        # split() drops a leading empty part only before empty matches, and no pattern matches the empty text
        cut = F.struct(F.split(acc["text"], pattern, -1).alias("pieces"), F.regexp_extract_all(acc["text"], pattern, F.lit(0)).alias("found"), F.size(acc["kept"]).alias("n"))

        def joined(s: Column) -> Column:
            marks = F.transform(s["found"], lambda _, i: placeholder(s["n"] + i))
            text = F.array_join(F.zip_with(s["pieces"], marks, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
            return F.when(F.size(s["found"]) > 0, F.struct(text.alias("text"), F.concat(acc["kept"], s["found"]).alias("kept"))).otherwise(acc)

        return bound(cut, joined)

    return F.aggregate(F.array(*[F.lit(p) for p in patterns]), F.struct(text.alias("text"), F.array().cast("array<string>").alias("kept")), step)


#: Placeholders stand in at most so many others: there are fewer patterns in any list.
NESTED = 48


def restored(text: Column, kept: Column) -> Column:
    """The text with each placeholder replaced by what stood there, nested ones too; unknown numbers stay.

    Each level of nesting splits the text at its marks once, so the time is linear in the text and not in text times marks.
    """

    def level(held: Column):
        def step(t: Column, _: Column) -> Column:
            cut = F.struct(F.split(t, MARK, -1).alias("pieces"), F.regexp_extract_all(t, F.lit(MARK), F.lit(0)).alias("marks"))
            number = lambda m: F.regexp_extract(m, r"\d+", 0).try_cast("int")
            original = lambda m: F.coalesce(F.get(held, number(m)), m)
            joined = lambda s: F.array_join(F.zip_with(s["pieces"], s["marks"], lambda p, m: F.concat(p, F.coalesce(original(m), F.lit("")))), "")
            return F.when(t.contains(PREFIX), bound(cut, joined)).otherwise(t)

        return step

    levels = F.sequence(F.lit(1), F.lit(NESTED))
    return bound(kept, lambda held: F.when(F.size(held) > 0, F.aggregate(levels, text, level(held))).otherwise(text))


def without_marks(text: Column) -> Column:
    """The text without placeholders, trimmed, each run of white space one space."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, MARK, ""), r"(?U)^\s+|\s+$", ""), r"\s+", " ")


def only_protected(text: Column) -> Column:
    """True where nothing but placeholders and white space is left: such a node is never sent."""
    return without_marks(text) == ""
