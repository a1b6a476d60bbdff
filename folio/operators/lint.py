"""Lint: issue rows of Markdown and plain text, and the fixes that need no judgement.

Rules on a line are expressions over that line; rules on neighbouring lines are folds over the document's
array of lines. Either way a document is one row until its issues are exploded: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUE = "array<struct<line:bigint,rule:string,severity:string,fixable:boolean,col:bigint,original:string,fixed:string>>"
BLANK = r"(?U)^\s*$"


def _bytes_before(line: Column, needle: str) -> Column:
    """1-based byte place of the first needle in the line."""
    return F.octet_length(F.substring_index(line, needle, 1)).cast("long") + 1


def issue(line: Column, rule: str, severity: str, fixable: bool, col: Column, original: Column, fixed: Column | None = None) -> Column:
    return F.struct(
        line.cast("long").alias("line"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(fixable).alias("fixable"),
        col.cast("long").alias("col"), original.alias("original"), (F.lit("") if fixed is None else fixed).alias("fixed"),
    )


def _found(*rules: tuple[Column, Column]) -> Column:
    """The issues of the rules whose conditions hold, in order."""
    return F.filter(F.array(*[F.when(cond, made) for cond, made in rules]), lambda x: x.isNotNull())


def _marked(line: Column, n: Column, pattern: str, rule: str) -> tuple[Column, Column]:
    """A mark (group 1) that its text (group 2) follows without a space."""
    mark, rest = F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2)
    return line.rlike(pattern), issue(n, rule, "warning", True, F.octet_length(mark) + 1, line, F.concat(mark, F.lit(" "), rest))


def _markdown_line(line: Column, n: Column) -> Column:
    count = lambda s: F.regexp_count(line, F.lit(s))
    swapped = r"\([^)]+\)\[[^\]]+\]"
    links = F.transform(
        F.regexp_extract_all(line, F.lit(swapped), F.lit(0)),
        lambda m: issue(n, "MD011", "error", True, F.octet_length(F.left(line, F.instr(line, m) - 1)) + 1, m, F.regexp_replace(m, r"(?s)^\(([^)]+)\)\[([^\]]+)\]$", r"[$1]($2)")),
    )
    stars = (count(r"\*") % 2 == 1) & ~line.contains("`") & ~(line.contains("[") & line.contains("]"))
    table = (count(r"\|") >= 2) & (line.contains("---") | line.contains(":--") | line.contains("--:")) & ~F.regexp_replace(line, r"(?U)^\s+|\s+$", "").rlike(r"^[|:\s-]+$")
    return F.concat(
        _found(
            _marked(line, n, r"(?d)^(#{1,6})([^#\s].*)$", "MD018"),
            _marked(line, n, r"(?d)^(\s*[-*+])([^\s].*)$", "MD030"),
            _marked(line, n, r"(?d)^(\s*\d+\.)([^\s].*)$", "MD030"),
            (line.contains("\t"), issue(n, "MD010", "warning", True, _bytes_before(line, "\t"), line, F.replace(line, F.lit("\t"), F.lit("    ")))),
        ),
        links,
        _found(
            (stars, issue(n, "MD037", "info", False, _bytes_before(line, "*"), line)),
            (F.regexp_replace(line, r"(?U)^\s+|\s+$", "") == "```", issue(n, "MD040", "info", False, F.lit(1), line)),
            (table, issue(n, "MD055", "warning", False, F.lit(1), line)),
        ),
    )


#: Characters that point to a broken encoding, and what stands in for them.
ODD_CHARACTERS = (("\ufffd", "?"), ("\u00a0", " "), ("\u2028", ""), ("\u2029", ""))
LONG_LINE = 100


def _text_line(line: Column, n: Column) -> Column:
    trimmed = F.regexp_replace(line, r"(?U)\s+$", "")
    return _found(
        (line.rlike(r"\s$"), issue(n, "TRAILING_WHITESPACE", "warning", True, F.octet_length(trimmed) + 1, line, trimmed)),
        (line.contains("\t"), issue(n, "TAB_CHARACTER", "info", True, _bytes_before(line, "\t"), line, F.replace(line, F.lit("\t"), F.lit("    ")))),
        (line.contains("\r"), issue(n, "MIXED_LINE_ENDINGS", "warning", True, F.lit(1), line, F.replace(line, F.lit("\r"), F.lit("")))),
        (F.octet_length(line) > LONG_LINE, issue(n, "LONG_LINE", "info", False, F.lit(LONG_LINE + 1), line)),
        *[(line.contains(c), issue(n, "ENCODING_ISSUE", "warning", True, _bytes_before(line, c), line, F.replace(line, F.lit(c), F.lit(to)))) for c, to in ODD_CHARACTERS],
        (line.rlike(r"\w+rn\w+"), issue(n, "OCR_ERROR", "info", False, _bytes_before(line, "rn"), line)),
    )


def blank_runs(lines: Column, rule: str, severity: str, most: int) -> Column:
    """Issues for runs of over `most` blank lines that a line which is not blank ends."""

    def step(acc: Column, x: Column) -> Column:
        blank = x["text"].rlike(BLANK)
        over = ~blank & (acc["run"] > most)
        made = issue(acc["start"], rule, severity, True, F.lit(1), F.repeat(F.lit("\n"), acc["run"].cast("int")), F.lit("\n" * most))
        return F.struct(
            F.when(blank, acc["run"] + 1).otherwise(F.lit(0)).cast("long").alias("run"),
            F.when(blank & (acc["run"] == 0), x["n"]).otherwise(acc["start"]).cast("long").alias("start"),
            F.when(over, F.concat(acc["out"], F.array(made).cast(ISSUE))).otherwise(acc["out"]).alias("out"),
        )

    zero = F.struct(F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("start"), F.array().cast(ISSUE).alias("out"))
    return F.aggregate(lines, zero, step)["out"]


def heading_jumps(lines: Column) -> Column:
    """Issues for headings more than one level below the one before."""

    def step(acc: Column, x: Column) -> Column:
        level = F.char_length(F.regexp_extract(x["text"], r"(?U)^\s*(#*)", 1))
        jump = (acc["last"] > 0) & (level > acc["last"] + 1)
        made = issue(x["n"], "MD001", "warning", False, F.lit(1), x["text"])
        return F.struct(
            F.when(level > 0, level).otherwise(acc["last"]).cast("int").alias("last"),
            F.when(jump, F.concat(acc["out"], F.array(made).cast(ISSUE))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(lines, F.struct(F.lit(0).alias("last"), F.array().cast(ISSUE).alias("out")), step)["out"]


def _numbered(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda t, i: F.struct((i + 1).cast("long").alias("n"), t.alias("text")))


def markdown_issues(text: Column) -> Column:
    """array of issues: those of lines first, then those of the document."""
    lines = _numbered(text)
    of_lines = F.flatten(F.transform(lines, lambda x: _markdown_line(x["text"], x["n"]).cast(ISSUE)))
    return F.concat(of_lines, blank_runs(lines, "MD012", "warning", 1), heading_jumps(lines))


def text_issues(text: Column) -> Column:
    lines = _numbered(text)
    last = F.element_at(lines, -1)
    open_end = F.when(last["text"] != "", F.array(issue(last["n"], "NO_FINAL_NEWLINE", "info", True, F.octet_length(last["text"]) + 1, last["text"], F.concat(last["text"], F.lit("\n")))).cast(ISSUE)).otherwise(F.array().cast(ISSUE))
    of_lines = F.flatten(F.transform(lines, lambda x: _text_line(x["text"], x["n"]).cast(ISSUE)))
    return F.concat(of_lines, blank_runs(lines, "CONSECUTIVE_BLANK_LINES", "info", 2), open_end)


RULES = {"markdown": markdown_issues, "text": text_issues}


def issues(docs: DataFrame, kind: str) -> DataFrame:
    """doc_id, then the fields of an issue: a row for each issue of each document. A null text has none."""
    return docs.select("doc_id", F.explode(RULES[kind](F.col("text"))).alias("i")).select("doc_id", "i.*")


def fixed(text: Column, found: Column) -> Column:
    """The text after all fixable issues, in order; each replaces every occurrence of its original."""
    usable = F.filter(found, lambda i: i["fixable"] & (i["original"] != ""))
    return F.aggregate(usable, text, lambda t, i: F.replace(t, i["original"], i["fixed"]))
