"""Clean-up and formatting of provider output, all built of Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.bind import bound

#: What prompts leave in answers (`\z`: the end of the text, `(?d)`: only \n ends a line).
PROMPT_LEFTOVERS = (
    r"(?i)</?(?:translation|translate|source|target|text)>",
    r"(?i)</?(?:翻译|译文|原文|目标)>",
    r"(?i)\[(?:翻译|TRANSLATION|TRANSLATE)\]",
    r"(?i)(?:以下是翻译：|Translation:|翻译结果：|Translated text:)",
    r"(?di)(?:Please translate|请翻译|Translate the following).*?:",
    r"(?i)^(?:翻译：|译：|Translation:\s*)",
    r"(?di)(?:翻译完成|Translation complete|翻译结束).*?\z",
)
#: Names that are not translated.
PROPER_NOUNS = {"苹果公司": "Apple", "微软公司": "Microsoft", "谷歌公司": "Google", "脸书": "Facebook", "推特": "Twitter", "优步": "Uber", "亚马逊": "Amazon", "网飞": "Netflix"}
#: Ordered spacing rules between Han and other letters, as (pattern, replacement).
SPACING = (
    (r"(\p{IsHan})([a-zA-Z0-9])", "$1 $2"),
    (r"([a-zA-Z0-9])(\p{IsHan})", "$1 $2"),
    (r"([a-zA-Z]{2,})(\d+\.\d+)", "$1 $2"),
    (r"(\p{IsHan})([%$€£¥#&@])", "$1 $2"),
    (r"([%$€£¥#&@])(\p{IsHan})", "$1 $2"),
    (r"(\p{IsHan})\s+([，。！？；：、])", "$1$2"),
    (r"([，。！？；：、])\s+(\p{IsHan})", "$1$2"),
)
#: Tags around reasoning, matched anywhere, in order.
REASONING = (
    ("<think>", "</think>"),
    ("<thinking>", "</thinking>"),
    ("<thought>", "</thought>"),
    ("<reasoning>", "</reasoning>"),
    ("<reflection>", "</reflection>"),
    ("<internal>", "</internal>"),
    (r"\[THINKING\]", r"\[/THINKING\]"),
    (r"\[REASONING\]", r"\[/REASONING\]"),
    ("```thinking", "```"),
    ("```reasoning", "```"),
)
BLANK_ENDS = r"(?U)^\s+|\s+$"


def trimmed(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, BLANK_ENDS, "")


def without_prompts(c: Column) -> Column:
    for p in PROMPT_LEFTOVERS:
        c = F.regexp_replace(c, p, "")
    return trimmed(F.regexp_replace(c, r"\n\s*\n\s*\n", "\n\n"))


def consistent_marks(c: Column) -> Column:
    """One kind of quotes, three dots for any two or more, a double dash for runs of dashes."""
    c = F.translate(c, "“”„「」『』‘’‚", "\"\"\"\"\"\"\"'''")
    c = F.replace(F.regexp_replace(c, r"\.{2,}", "..."), F.lit("……"), F.lit("..."))
    return F.regexp_replace(c, "[-–—]{2,}", "——")


def mixed_spacing(c: Column) -> Column:
    for p, to in SPACING:
        c = F.regexp_replace(c, p, to)
    return c


def fields(c: Column) -> Column:
    """The words of a text; none of a blank one."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def without_repeats(c: Column) -> Column:
    """Words that differ from the word before them, by single spaces."""
    before = lambda ws: F.concat(F.array(F.lit(None).cast("string")), F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))))
    # array_join leaves nulls out
    return F.array_join(bound(fields(c), lambda ws: F.zip_with(ws, before(ws), lambda w, b: F.when(b.isNull() | (w != b), w))), " ")


def proper_nouns(c: Column) -> Column:
    for wrong, right in PROPER_NOUNS.items():
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return c


def shorter_chains(c: Column) -> Column:
    return F.regexp_replace(c, r"(\w+)的(\w+)的(\w+)", "$1$2$3")


def polished(c: Column) -> Column:
    """The clean-up steps in order."""
    return shorter_chains(proper_nouns(without_repeats(mixed_spacing(consistent_marks(without_prompts(c))))))


def without_reasoning_anywhere(c: Column) -> Column:
    """Without any tagged reasoning; trimmed, with at most one blank line in a row."""
    for start, end in REASONING:
        c = F.regexp_replace(c, f"(?s){start}.*?{end}", "")
    return F.regexp_replace(trimmed(c), r"\n{3,}", "\n\n")


def has_reasoning(c: Column) -> Column:
    low = F.lower(c)
    #: Tags that count as reasoning.
    tags = (
        "<think>", "</think>", "<thinking>", "</thinking>", "<thought>", "</thought>",
        "<reasoning>", "</reasoning>", "<reflection>", "</reflection>", "<internal>", "</internal>",
        "[thinking]", "[/thinking]", "[reasoning]", "[/reasoning]",
    )
    found = c.rlike("(?dm)^```(?:thinking|reasoning|thought|reflection|internal)")
    for t in tags:
        found = found | low.contains(t)
    return found


def is_han_paragraph(c: Column) -> Column:
    """More Han letters than ASCII characters."""
    return F.regexp_count(c, F.lit(r"\p{IsHan}")) > F.regexp_count(c, F.lit(r"[\x00-\x7F]"))


def wrapped(c: Column, most: int) -> Column:
    """Words in lines of up to `most` bytes; a longer word has a line of its own."""

    def step(acc: Column, w: Column) -> Column:
        n, size = F.octet_length(w), F.octet_length(acc["line"])
        long, full = n > most, (size > 0) & (size + 1 + n > most)
        shut = F.when((long | full) & (size > 0), F.concat(acc["lines"], F.array(acc["line"]))).otherwise(acc["lines"])
        lines = F.when(long, F.concat(shut, F.array(w))).otherwise(shut)
        line = F.when(long, "").when(full | (size == 0), w).otherwise(F.concat(acc["line"], F.lit(" "), w))
        return F.struct(lines.alias("lines"), line.alias("line"))

    zero = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))
    end = lambda a: F.array_join(F.when(a["line"] == "", a["lines"]).otherwise(F.concat(a["lines"], F.array(a["line"]))), "\n")
    return F.aggregate(fields(c), zero, step, end)


def cut_every(c: Column, most: int) -> Column:
    """Lines of `most` characters each."""
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(c), F.lit(1)), F.lit(most))
    return F.array_join(F.transform(starts, lambda i: F.substring(c, i, F.lit(most))), "\n")


def formatted(c: Column, most: int = 0, tab: int = 4) -> Column:
    """Plain text with \\n line ends, no blanks at line ends, tabs as spaces, paragraphs wrapped (most > 0), one final \\n."""
    c = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), r"(?dm)[ \t]+$", "")
    if tab:
        c = F.replace(c, F.lit("\t"), F.lit(" " * tab))
    if most:
        paragraphs = F.transform(F.split(c, "\n\n", -1), lambda p: trimmed(F.replace(p, F.lit("\n"), F.lit(" "))))
        c = F.array_join(F.transform(paragraphs, lambda p: F.when(is_han_paragraph(p), cut_every(p, most)).otherwise(wrapped(p, most))), "\n\n")
    c = trimmed(c)
    return F.when(c == "", c).otherwise(F.concat(c, F.lit("\n")))


def same_places(a: Column, b: Column) -> Column:
    """The share of byte places at which two texts agree; two empty texts are equal."""
    both = F.struct(F.encode(a, "UTF-8").alias("x"), F.encode(b, "UTF-8").alias("y"))

    def share(s: Column) -> Column:
        least, most = F.least(F.octet_length(s["x"]), F.octet_length(s["y"])), F.greatest(F.octet_length(s["x"]), F.octet_length(s["y"]))
        places = F.when(least > 0, F.sequence(F.lit(1), least)).otherwise(F.array().cast("array<int>"))
        same = F.aggregate(places, F.lit(0), lambda n, i: n + (F.substring(s["x"], i, F.lit(1)) == F.substring(s["y"], i, F.lit(1))).cast("int"))
        return F.when(most == 0, F.lit(1.0)).otherwise(same.cast("double") / most)

    return bound(both, share)


def hash31(c: Column) -> Column:
    """The polynomial hash of the code points with factor 31, modulo 2^32."""
    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(0).cast("long"), lambda h, x: (h * 31 + F.ascii(x)) % 4294967296)


def delay(attempt: Column, base: float, factor: float, cap: float) -> Column:
    """Seconds before a retry: base times factor to the attempt (from 0), at most cap."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(float(factor)), attempt), F.lit(float(cap)))


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole) * 100, F.lit(0.0))


def xml_declaration(c: Column) -> Column:
    return trimmed(F.regexp_extract(c, r"(?i)^\s*<\?xml[^>]*\?>", 0))


def blank_ends(c: Column) -> Column:
    """struct<lead, trail>: the blanks, tabs and line ends before and after the text."""
    return F.struct(F.regexp_extract(c, r"^[ \t\r\n]*", 0).alias("lead"), F.regexp_extract(c, r"[ \t\r\n]*\z", 0).alias("trail"))
