"""Documents to nodes, greedy groups, the marked protocol, and providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, lang, node_id (1-based), text: a row per line of each document that is not blank."""
    return docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n"))).select("doc_id", "lang", (F.col("pos") + 1).cast("long").alias("node_id"), F.col("col").alias("text")).where(F.trim("text") != "")


def greedy_groups(docs: DataFrame, max_bytes: int = 2000) -> DataFrame:
    """doc_id, lang, nodes array<struct<node_id, text, grp>>: nodes in order, a new group where the size would pass max_bytes.

    One fold per document: no shuffle, no Python.
    """
    parts = F.filter(F.transform(F.split("text", "\n"), lambda t, i: F.struct((i + 1).cast("long").alias("node_id"), t.alias("text"))), lambda s: F.trim(s["text"]) != "")
    sizes = F.transform("parts", lambda s: F.octet_length(s["text"]).cast("long"))
    zero = F.struct(F.lit(0).cast("long").alias("grp"), F.lit(0).cast("long").alias("size"), F.array().cast("array<bigint>").alias("of"))

    def step(acc: Column, n: Column) -> Column:
        full = (acc["size"] > 0) & (acc["size"] + n > max_bytes)
        grp = F.when(full, acc["grp"] + 1).otherwise(acc["grp"])
        return F.struct(grp.alias("grp"), F.when(full, n).otherwise(acc["size"] + n).alias("size"), F.concat(acc["of"], F.array(grp)).alias("of"))

    grouped = docs.select("doc_id", "lang", parts.alias("parts")).withColumn("of", F.aggregate(sizes, zero, step)["of"])
    return grouped.select("doc_id", "lang", F.zip_with("parts", "of", lambda s, g: F.struct(s["node_id"].alias("node_id"), s["text"].alias("text"), g.alias("grp"))).alias("nodes"))


def encoded(node_id: Column, text: Column) -> Column:
    """A node in the marked protocol."""
    number = node_id.cast("string")
    return F.concat(F.lit("@@NODE_START_"), number, F.lit("@@\n"), text, F.lit("\n@@NODE_END_"), number, F.lit("@@"))


def decoded(response: Column) -> Column:
    """array<struct<node_id, text>> of the nodes whose start and end marks agree."""
    pattern = r"(?s)@@NODE_START_(\d+)@@\r?\n(.*?)\r?\n@@NODE_END_\1@@"
    ids = F.regexp_extract_all(response, F.lit(pattern), F.lit(1))
    return F.zip_with(ids, F.regexp_extract_all(response, F.lit(pattern), F.lit(2)), lambda i, t: F.struct(i.cast("long").alias("node_id"), t.alias("text")))


def raw_provider(request: Column) -> Column:
    """The deterministic provider: the request as it is."""
    return request


def neighbours(nodes: DataFrame, failed: Column, distance: int, key: str, order: str) -> DataFrame:
    """Nodes that failed or stand within `distance` of one that failed, in the order of each key."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order).rowsBetween(-distance, distance)
    return nodes.withColumn("_near", F.max(failed.cast("int")).over(w)).where("_near = 1").drop("_near")
