"""Queries over the library's operators, and the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import nodes as N


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


LINES = "WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS node_id FROM documents) "


@query(LINES + "SELECT lang, count(*) AS nodes, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) AS succeeded FROM l WHERE trim(text, ' ') <> '' GROUP BY lang")
def doc_line_groups(spark, sf_dir):
    """Lines in greedy groups, encoded, sent to the raw provider, decoded, met with their nodes and rolled up."""
    grouped = N.greedy_groups(table(spark, sf_dir, "documents"))
    request = F.array_join(F.transform("nodes", lambda s: N.encoded(s["node_id"], s["text"])), "\n\n")
    answered = grouped.select("lang", "nodes", N.decoded(N.raw_provider(request)).alias("back"))
    matched = F.size(F.array_intersect(F.transform("nodes", lambda s: F.struct(s["node_id"].alias("node_id"), s["text"].alias("text"))), "back")).cast("long")
    sizes = F.aggregate("nodes", F.lit(0).cast("long"), lambda a, s: a + F.octet_length(s["text"]))
    return answered.groupBy("lang").agg(F.sum(F.size("nodes").cast("long")).alias("nodes"), F.sum(sizes).alias("bytes"), F.sum(matched).alias("succeeded"))


@query(LINES + "SELECT doc_id, CAST(node_id AS BIGINT) AS node_id, text FROM l WHERE trim(text, ' ') <> ''")
def split_lines(spark, sf_dir):
    return N.lines(table(spark, sf_dir, "documents")).select("doc_id", "node_id", "text")


@query()
def greedy_groups(spark, sf_dir):
    g = N.greedy_groups(table(spark, sf_dir, "documents"))
    return g.select("doc_id", F.explode("nodes").alias("s")).groupBy("doc_id", F.col("s.grp").alias("group_id")).agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.octet_length("s.text").cast("long")).alias("bytes"))


@query(LINES + ", p AS (SELECT * FROM l WHERE strlen(text) >= 2 AND regexp_matches(text, '[A-Za-z0-9]') AND NOT regexp_matches(text, '^[0-9]+$')) SELECT lang, count(*) AS kept FROM p GROUP BY lang")
def prefilter_nodes(spark, sf_dir):
    l = N.lines(table(spark, sf_dir, "documents"))
    return l.where((F.octet_length("text") >= 2) & F.col("text").rlike("[A-Za-z0-9]") & ~F.col("text").rlike("^[0-9]+$")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))


@query(LINES + "SELECT text, min(doc_id) AS doc_id, count(*) AS copies FROM l WHERE trim(text, ' ') <> '' GROUP BY text")
def dedup_nodes(spark, sf_dir):
    return N.lines(table(spark, sf_dir, "documents")).groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}')) AS n_ipv4, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}')) AS n_email FROM documents")
def protect_counts(spark, sf_dir):
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", count("[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}").alias("n_ipv4"), count("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}").alias("n_email"))


@query("SELECT doc_id, regexp_replace(regexp_replace(concat(text, chr(10), ' ', chr(10), chr(10), chr(10), source), '\n[ \t]+\n', '\n\n', 'g'), '\n{3,}', '\n\n', 'g') AS text FROM documents".replace("\\n", "\n"))
def collapse_newlines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse_newlines(F.concat("text", F.lit("\n \n\n\n"), "source")).alias("text"))


@query("SELECT doc_id, translate(concat('“', text, '”'), '“”„«»‘’‚‹›', '\"\"\"\"\"''''''''''') AS text FROM documents")
def quote_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.plain_quotes(F.concat(F.lit("“"), "text", F.lit("”"))).alias("text"))


@query("SELECT doc_id, CASE WHEN length(text) > 50 THEN concat(left(text, 50), '...') ELSE text END AS shown, length(text) AS n_chars FROM documents")
def truncate_display(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.truncated(F.col("text"), 50).alias("shown"), F.char_length("text").cast("long").alias("n_chars"))


@query("SELECT doc_id, length(text) > 1500 AS should_split FROM documents")
def should_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (F.char_length("text") > 1500).alias("should_split"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '(?m)^```(?s:.*?)^```$') THEN 'code_block' WHEN len(regexp_extract_all(text, '(?m)^\\|.*\\|.*$')) >= 2 THEN 'table'
WHEN len(regexp_extract_all(text, '(?m)^[ \\t\\r\\f]*(?:[-*+]|\\d+\\.)[ \\t\\r\\f]')) >= 2 THEN 'list' WHEN regexp_matches(text, '\\$\\$(?s:.*?)\\$\\$|\\$[^$\\n]+\\$') THEN 'math' ELSE 'plain_text' END AS kind FROM documents""")
def content_type(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_type(F.col("text")).alias("kind"))


@query("SELECT event_type, count(*) AS requests, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY event_type")
def provider_metrics(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("requests"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


@query("SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'error') * 100.0 / count(*) AS pct_failed FROM events GROUP BY user_id".replace("* 100.0 /", "* 100.0::DOUBLE /"))
def status_breakdown(spark, sf_dir):
    bad = F.count(F.when(F.col("event_type") == "error", 1))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), bad.alias("failed"), (bad * 100.0 / F.count(F.lit(1))).alias("pct_failed"))


@query("WITH w AS (SELECT event_id, user_id, event_type, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM events) SELECT event_id, user_id, event_type FROM w WHERE m = 1")
def neighbours_2(spark, sf_dir):
    return N.neighbours(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), F.col("event_type") == "error", 2, "user_id", "event_id")


@query("SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_top_20(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(20)


@query("SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before_role, length(text) AS n_chars FROM conversations")
def turn_context(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("before_role"), F.char_length("text").cast("long").alias("n_chars"))


@query("SELECT page_id, regexp_extract(html, '(?i)<!DOCTYPE[^>]*>', 0) AS doctype, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages")
def html_head(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "(?i)<!DOCTYPE[^>]*>", 0).alias("doctype"), F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"))

