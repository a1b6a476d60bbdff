"""Protection, lint, blocks and splitting against what plain Python gives, and their edge cases."""

import re

from pyspark.sql import functions as F

from folio.functions import protect as P
from folio.operators import blocks as B
from folio.operators import lint

MD = "# Title\n\nSee https://a.b/c and `x=1` or $y$.\n\n```py\ncode\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n> quote\n> more\n\n- item\n1. one\n\n***\npara\nstill [3]\n"


def plainly_protected(text, patterns):
    kept = []

    def keep(m):
        kept.append(m[0])
        return f"{P.PREFIX}{len(kept) - 1}{P.SUFFIX}"

    for p in patterns:
        text = re.sub(p.replace("(?d)", "").replace("(?dm)", "(?m)"), keep, text, flags=re.A)
    return text, kept


def test_protection_equals_plain_substitution_and_comes_back(spark):
    texts = [MD, "", "no marks", "<p class='x'>a &amp; b</p><!-- c -->", "mail a@b.co v1.2.3 10.0.0.1"]
    for patterns in (P.MARKDOWN, P.HTML, P.TEXT, P.COMMON):
        df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", P.protected(F.col("text"), patterns).alias("p"))
        for r in df.select("text", "p", P.restored(F.col("p.text"), F.col("p.kept")).alias("back")).collect():
            assert (r.p.text, list(r.p.kept)) == plainly_protected(r.text, patterns)
            assert r.back == r.text


def test_protection_of_null_and_of_nothing_else(spark):
    df = spark.createDataFrame([(None,), (" @@PRESERVE_0@@ @@PRESERVE_12@@\n",), ("a  @@PRESERVE_0@@ b",)], "text string")
    got = df.select(P.restored(P.protected(F.col("text"), P.TEXT)["text"], P.protected(F.col("text"), P.TEXT)["kept"]).alias("t"), P.only_protected(F.col("text")).alias("only"), P.without_marks(F.col("text")).alias("bare")).collect()
    assert got[0].t is None and got[0].only is None
    assert (got[1].only, got[1].bare, got[2].only, got[2].bare) == (True, "", False, "a b")


def test_blocks():
    got = [(k, c) for k, c in B.markdown_blocks(MD) if k != "empty"]
    assert [k for k, _ in got] == ["heading", "paragraph", "code", "table", "quote", "list", "list", "hr", "paragraph"]
    assert dict(got)["code"] == "```py\ncode\n```" and dict(got)["quote"] == "> quote\n> more"
    assert "\n".join(c for _, c in B.markdown_blocks(MD)) == MD
    assert list(B.markdown_blocks(None)) == [] and list(B.markdown_blocks("")) == [("empty", "")]
    assert list(B.markdown_blocks("# ")) == [("paragraph", "# ")]


def test_splitting():
    text = "\n\n".join(c * 300 for c in "abcdefg")
    got = B.split_text(text, overlap=0)
    assert got == [f"{a * 300}\n{b * 300}" for a, b in ("ab", "cd", "ef")] + ["g" * 300]
    assert all(len(p) <= 800 for p in B.split_text("x" * 5000)) and "".join(B.split_text("x" * 5000)) == "x" * 5000
    assert B.split_text("short") == ["short"] and B.split_text("") == [""]
    items = "\n".join(f"- {'i' * 100}" for _ in range(20))
    assert "\n".join(B.split_text(items)) == items
    code = "```\n" + "\n".join("c" * 90 for _ in range(30)) + "\n```\ntail\n" + "t" * 700
    assert B.split_text(code)[0].count("```") == 1 and "\n".join(B.split_text(code)) == code
    assert B.sentences('One two three. "Quoted. Still." Four five six seven. No') == ["One two three.", '"Quoted. Still." Four five six seven.', "No"]


def test_lint_rows(spark):
    md = "#x\n\n\n\n### y\n# z\n### jump\n-item\n1.item\n\tt\n(a)[b] (c)[d]\n2 * 3\n```\n|a|--- x|\n\n\n"
    docs = spark.createDataFrame([(1, md), (2, None), (3, "")], "doc_id long, text string")
    got = {(r.line, r.rule, r.fixed) for r in lint.issues(docs, "markdown").collect()}
    assert got == {
        (1, "MD018", "# x"), (2, "MD012", "\n"), (5, "MD001", ""), (7, "MD001", ""), (8, "MD030", "- item"), (9, "MD030", "1. item"), (10, "MD010", "    t"),
        (11, "MD011", "[a](b)"), (11, "MD011", "[c](d)"), (12, "MD037", ""), (13, "MD040", ""), (14, "MD055", ""),
    }


def test_lint_text_and_fix(spark):
    docs = spark.createDataFrame([(1, "a \nb\tc\r\n\n\n\nburning é�"), (2, None)], "doc_id long, text string")
    df = docs.select("doc_id", "text", lint.text_issues(F.col("text")).alias("found"))
    rows = {r.doc_id: r for r in df.select("doc_id", "found", lint.fixed(F.col("text"), F.col("found")).alias("fixed")).collect()}
    assert [(i.line, i.rule) for i in rows[1].found] == [(1, "TRAILING_WHITESPACE"), (2, "TRAILING_WHITESPACE"), (2, "TAB_CHARACTER"), (2, "MIXED_LINE_ENDINGS"), (6, "ENCODING_ISSUE"), (6, "OCR_ERROR"), (3, "CONSECUTIVE_BLANK_LINES"), (6, "NO_FINAL_NEWLINE")]
    assert rows[1].fixed.startswith("a\nb") and "\r" not in rows[1].fixed and "�" not in rows[1].fixed
    assert rows[2].fixed is None
