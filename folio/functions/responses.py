"""What comes back from a provider: unwrapping, reasoning, errors, formatting that was lost; and keys and priorities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.bind import bound
from folio.functions.polish import trimmed

#: Tags that open an answer; what they hold is removed, or kept where the third is true.
LEADING_TAGS = (
    ("<think>", "</think>", False),
    ("<thinking>", "</thinking>", False),
    ("<thought>", "</thought>", False),
    ("<reasoning>", "</reasoning>", False),
    ("<reflection>", "</reflection>", False),
    ("<internal>", "</internal>", False),
    ("<scratch>", "</scratch>", False),
    ("<analysis>", "</analysis>", False),
    ("<brainstorm>", "</brainstorm>", False),
    ("[THINKING]", "[/THINKING]", False),
    ("[REASONING]", "[/REASONING]", False),
    ("[INTERNAL]", "[/INTERNAL]", False),
    ("[SCRATCH]", "[/SCRATCH]", False),
    ("<answer>", "</answer>", True),
    ("<result>", "</result>", True),
    ("<output>", "</output>", True),
)
#: Tags that may be cut off before their end.
CUT_TAGS = ("<think>", "<thinking>", "<thought>", "<reasoning>", "<reflection>")
#: What an answer may begin with, in order.
ANSWER_PREFIXES = ("Here is the translation:", "Here's the translation:", "Translation:", "Translated text:", "The translation is:")
#: Kinds of errors by what their message holds, the first that fits.
ERROR_KINDS = (("timeout", "timeout"), ("rate limit", "rate_limit"), ("context", "context_error"), ("network", "network_error"), ("auth", "auth_error"), ("quota", "quota_exceeded"))
#: Messages of errors that may pass.
RETRYABLE = (
    "timeout", "deadline exceeded", "connection refused", "temporary failure", "rate limit", "429", "503", "504",
    "ContentLength", "Body length 0", "connection reset", "broken pipe", "no such host", "network is unreachable", "i/o timeout",
)
#: Patterns of formatting.
FORMATTING = (r"\*\*.*?\*\*", r"\*.*?\*", "#+ ", "`.*?`", "```", r"\$.*?\$", r"\$\$.*?\$\$", "<[^>]+>", r"\[[^\]]+\]\([^)]+\)")
#: Weights of attributes and of parents.
ATTRIBUTE_PRIORITY = {"alt": 10, "title": 9, "placeholder": 8, "aria-label": 7, "aria-description": 6, "value": 5, "summary": 4, "data-tooltip": 3, "data-title": 2, "label": 1}
PARENT_PRIORITY = {"h1": 10, "h2": 10, "h3": 10, "title": 20, "p": 3, "span": 1, "div": 1}


def quoted(s: str) -> str:
    return rf"\Q{s}\E"


def without_leading_reasoning(c: Column) -> Column:
    """Without one tagged part at the start; one without an end takes all that follows."""

    def once(t: Column) -> Column:
        out = F.when(F.lit(False), t)
        for start, end, kept in LEADING_TAGS:
            pattern = rf"(?s)\A{quoted(start)}(.*?){quoted(end)}"
            after = F.regexp_extract(t, pattern, 1) if kept else F.regexp_replace(t, pattern, "")
            out = out.when(t.startswith(start) & t.rlike(pattern), trimmed(after))
        return out.otherwise(t)

    def cut(t: Column) -> Column:
        found = F.lit(False)
        for tag in CUT_TAGS:
            found = found | (t.startswith(tag) & ~t.contains(tag.replace("<", "</")))
        return F.when(found, "").otherwise(t)

    return trimmed(F.regexp_replace(bound(bound(trimmed(c), once), cut), r"\n{3,}", "\n\n"))


def reasoning_parts(c: Column, start: str, end: str) -> Column:
    """What stands between the tags, trimmed."""
    return F.transform(F.regexp_extract_all(c, F.lit(f"(?s){quoted(start)}(.*?){quoted(end)}"), F.lit(1)), trimmed)


def unwrapped(c: Column) -> Column:
    """An answer without what announces it and without a fence around it."""

    def without(prefix: str):
        return lambda t: F.when(trimmed(t).startswith(prefix), trimmed(F.substring(trimmed(t), F.lit(len(prefix) + 1), F.lit(2**31 - 1)))).otherwise(t)

    for p in ANSWER_PREFIXES:
        c = bound(c, without(p))

    def inner(t: Column) -> Column:
        lines = F.split(t, "\n", -1)
        return F.when(t.startswith("```") & t.endswith("```") & (F.size(lines) >= 3), F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")).otherwise(t)

    return trimmed(bound(c, inner))


def error_kind(c: Column) -> Column:
    low = F.lower(c)
    out = F.when(c.isNull(), "")
    for what, kind in ERROR_KINDS:
        out = out.when(low.contains(what), kind)
    return out.otherwise("unknown_error")


def retryable(c: Column) -> Column:
    """Whether an error may pass, whatever the case of its letters."""
    low, out = F.lower(c), F.lit(False)
    for what in RETRYABLE:
        out = out | low.contains(what.lower())
    return F.coalesce(out, F.lit(False))


def has_formatting(c: Column) -> Column:
    out = F.lit(False)
    for p in FORMATTING:
        out = out | c.rlike(f"(?d){p}")
    return out


def cache_key(step: Column, provider: Column, model: Column, source: Column, target: Column, temperature: Column, tokens: Column, text: Column, context: Column | None = None) -> Column:
    """MD5 of all that decides an answer."""
    parts = {"step:": step, "|provider:": provider, "|model:": model, "|src:": source, "|tgt:": target, "|temp:": F.format_string("%.2f", temperature), "|tokens:": tokens.cast("string"), "|text:": text}
    whole = F.concat(*[x for k, v in parts.items() for x in (F.lit(k), v)])
    if context is not None:
        whole = F.concat(whole, F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("|context:"), context)).otherwise(""))
    return F.md5(whole)


def _weight(c: Column, weights: dict[str, int]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), c), F.lit(0))


def attribute_priority(name: Column) -> Column:
    return _weight(name, ATTRIBUTE_PRIORITY)


def node_priority(parent: Column, is_attribute: Column) -> Column:
    return 1 + F.when(is_attribute, 2).otherwise(0) + _weight(parent, PARENT_PRIORITY)


def protected_ids(c: Column) -> Column:
    """Numbers of the element placeholders in a text."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"@@PROTECTED_(\d+)@@"), F.lit(1)), lambda x: x.cast("long"))


def images_apart(c: Column) -> Column:
    """Each image a paragraph of its own, a caption after it another."""
    c = F.regexp_replace(c, r"(!\[[^\]]*\]\([^)]*\))\s*([^\n]*)", "\n\n$1\n\n$2\u0001")
    c = F.regexp_replace(c, "[ \t\r\f]*\u0001", "\u0001")
    return F.replace(F.regexp_replace(c, r"(\))\n\n\.?" + "\u0001", "$1\n\n"), F.lit("\u0001"), F.lit("\n\n"))


def formulas_apart(c: Column) -> Column:
    """Each display formula a paragraph of its own, its marks on lines of their own."""
    return F.regexp_replace(c, r"\$\$\s*([^$]+?)\s*\$\$", "\n\n\\$\\$\n$1\n\\$\\$\n\n")


def fewer_newlines(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"\n\s+\n", "\n\n")


def changed_lines(a: Column, b: Column) -> Column:
    """Lines that differ place by place, and lines that one has more."""
    x, y = F.split(a, "\n", -1), F.split(b, "\n", -1)
    return F.size(F.filter(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), lambda same: ~same)).cast("long")
