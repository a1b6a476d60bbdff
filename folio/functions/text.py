"""Scalar text functions, all built of Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse_newlines(c: Column) -> Column:
    """White-space-only lines become empty; three or more line ends become two."""
    return F.regexp_replace(F.regexp_replace(c, "\n[ \t]+\n", "\n\n"), "\n{3,}", "\n\n")


def plain_quotes(c: Column) -> Column:
    return F.translate(c, "“”„«»‘’‚‹›", "\"\"\"\"\"'''''")


#: What a text must hold to count as each kind, in Java's dialect.
CODE_BLOCK = "(?dm)^```(?s:.*?)^```$"
TABLE_LINE = r"(?dm)^\|.*\|.*$"
LIST_LINE = r"(?dm)^[ \t\r\f]*(?:[-*+]|\d+\.)[ \t\r\f]"
MATH = r"\$\$(?s:.*?)\$\$|\$[^$\n]+\$"


def content_type(c: Column) -> Column:
    """code_block, table (two lines of it at least), list (two items), math or plain_text, the first that holds."""
    count = lambda p: F.regexp_count(c, F.lit(p))
    return F.when(c.rlike(CODE_BLOCK), "code_block").when(count(TABLE_LINE) >= 2, "table").when(count(LIST_LINE) >= 2, "list").when(c.rlike(MATH), "math").otherwise("plain_text")


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length in characters; two empty texts are equal."""
    most = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b).cast("double") / most)


def truncated(c: Column, n: int) -> Column:
    return F.when(F.char_length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)
