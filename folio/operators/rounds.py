"""Rounds of requests: answers decoded, met with their nodes, missing ones tried again; and what is recorded of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.polish import trimmed
from folio.operators import nodes as N


def answers(responses: DataFrame, response: str, *keys: str) -> DataFrame:
    """keys, node_id, text: a row per node whose marks agree; contents are trimmed, of an id's repeats the last counts."""
    rows = responses.select(*keys, F.posexplode(N.decoded(F.col(response))).alias("pos", "n"))
    return rows.groupBy(*keys, F.col("n.node_id").alias("node_id")).agg(trimmed(F.max_by("n.text", "pos")).alias("text"))


def answers_by_line(responses: DataFrame, response: str, *keys: str) -> DataFrame:
    """As answers(), by scanning lines: a start mark opens a node, any end mark closes it."""
    rows = responses.select(*keys, F.posexplode(F.slice(F.split(response, r"(?:^|\n)[ \t]*@@NODE_START_"), 2, 2**31 - 1)).alias("pos", "part"))
    cut = rows.select(*keys, "pos", F.regexp_extract("part", r"^(\d+)@@[ \t]*(?:\n|$)", 1).try_cast("long").alias("node_id"), F.split(F.regexp_replace("part", r"^\d+@@[ \t]*\n?", ""), r"(?:^|\n)[ \t]*@@NODE_END_\d+@@", 2).alias("p"))
    return cut.where("node_id is not null and size(p) = 2").groupBy(*keys, "node_id").agg(trimmed(F.max_by(F.get("p", 0), "pos")).alias("text"))


def met(nodes: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """nodes with status, translated and error: what was found for each, else failed as not found."""
    got = found.withColumnRenamed("text", "translated")
    joined = nodes.join(got, [*keys, "node_id"], "left")
    ok = F.col("translated").isNotNull()
    return joined.withColumns({"status": F.when(ok, "success").otherwise("failed"), "error": F.when(~ok, "translation not found")})


def missing(nodes: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """The nodes without an answer."""
    return nodes.join(found.select(*keys, "node_id"), [*keys, "node_id"], "left_anti")


def in_rounds(nodes: DataFrame, provider: Callable[[Column, int], Column], rounds: int) -> DataFrame:
    """nodes with translated, status and attempts: a provider (text, round) that gives null has failed and is asked again.

    Each round asks only for what the rounds before it left: one expression per round, no shuffle between them.
    """
    left, attempts = F.lit(None).cast("string"), F.lit(0)
    for k in range(rounds):
        attempts = F.when(left.isNull(), F.lit(k + 1)).otherwise(attempts)
        nodes = nodes.withColumns({"_answer": F.coalesce(left, provider(F.col("text"), k)), "_attempts": attempts})
        left, attempts = F.col("_answer"), F.col("_attempts")
    out = nodes.withColumns({"translated": left, "attempts": attempts.cast("long"), "status": F.when(left.isNull(), "failed").otherwise("success")})
    return out.drop("_answer", "_attempts")


def by_round(done: DataFrame, rounds: int, *keys: str) -> DataFrame:
    """keys, round, asked, succeeded, failed for each round that asked for something."""
    each = done.withColumn("round", F.explode(F.sequence(F.lit(1).cast("long"), F.col("attempts"))))
    good = (F.col("round") == F.col("attempts")) & (F.col("status") == "success")
    return each.groupBy(*keys, "round").agg(F.count(F.lit(1)).alias("asked"), F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"))


def retry_context(nodes: DataFrame, key: str, order: str) -> DataFrame:
    """Failed nodes and their successful neighbours before and after, which are context (is_context) and never overwritten."""
    w = Window.partitionBy(key).orderBy(order)
    beside = F.coalesce(F.lag("status").over(w) == "failed", F.lit(False)) | F.coalesce(F.lead("status").over(w) == "failed", F.lit(False))
    marked = nodes.withColumn("is_context", (F.col("status") == "success") & beside)
    return marked.where((F.col("status") == "failed") | F.col("is_context"))


def diagnosis(request: Column, response: Column) -> dict[str, Column]:
    """Counts of marks on both sides, whether they balance and are kept, and the look of the answer."""
    count = lambda c, what: F.regexp_count(c, F.lit(what)).cast("long")
    starts, ends, back, back_ends = (count(c, f"@@NODE_{k}_") for c in (request, response) for k in ("START", "END"))
    first = F.left(trimmed(response), F.lit(1))
    return {
        "request_starts": starts, "request_ends": ends, "response_starts": back, "response_ends": back_ends,
        "balanced": back == back_ends, "preserved": starts == back, "is_json": first.isin("{", "["), "is_empty": trimmed(response) == "",
        "short": F.octet_length(response) * 2 < F.octet_length(request), "bare_marks": count(response, "NODE_START_"),
    }


def marker_id(c: Column) -> Column:
    """The number of the first start mark, else of the first end mark; null without one."""
    return F.coalesce(F.regexp_extract(c, r"@@NODE_START_(\d+)@@", 1).try_cast("long"), F.regexp_extract(c, r"@@NODE_END_(\d+)@@", 1).try_cast("long"))
