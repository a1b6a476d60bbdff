"""Queries over protection, lint, blocks, splitting, similarity and streams, and the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import protect as P
from folio.functions import text as T
from folio.operators import blocks as B
from folio.operators import lint
from folio.plans.catalogue import query, table
from folio.streaming import rollup


def masked_sql(column: str, patterns: tuple[str, ...]) -> str:
    """Nested replacements by one mark, in the SQL engine's dialect."""
    out = column
    for p in patterns:
        plain = p.replace("(?d)", "").replace("(?dm)", "(?m)").replace("'", "''")
        out = f"regexp_replace({out}, '{plain}', '@@PRESERVE_0@@', 'g')"
    return out


def masked(text, patterns):
    """The protected text with all numbers 0."""
    return F.regexp_replace(P.protected(text, patterns)["text"], P.MARK, "@@PRESERVE_0@@")


@query(f"SELECT doc_id, {masked_sql('text', P.MARKDOWN)} AS text FROM documents")
def protect_markdown(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", masked(F.col("text"), P.MARKDOWN).alias("text"))


@query(f"SELECT doc_id, {masked_sql('text', P.TEXT)} AS text FROM documents")
def protect_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", masked(F.col("text"), P.TEXT).alias("text"))


@query(f"SELECT page_id, {masked_sql('html', P.HTML)} AS html FROM pages")
def protect_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", masked(F.col("html"), P.HTML).alias("html"))


@query("SELECT page_id, html FROM pages")
def protect_restore(spark, sf_dir):
    """Protected and restored: the page as it was."""
    held = table(spark, sf_dir, "pages").select("page_id", P.protected(F.col("html"), P.HTML).alias("p"))
    return held.select("page_id", P.restored(F.col("p.text"), F.col("p.kept")).alias("html"))


L = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line, len(string_split(text, chr(10))) AS lines FROM documents)"
RUNS = ", b AS (SELECT doc_id, line, lines, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS grp FROM l WHERE regexp_matches(text, '^\\s*$')), r AS (SELECT doc_id, min(line) AS line, count(*) AS n FROM b GROUP BY doc_id, grp, lines HAVING max(line) < lines)"
HEADINGS = ", h AS (SELECT doc_id, line, length(regexp_extract(text, '^\\s*(#+)', 1)) AS level FROM l WHERE regexp_matches(text, '^\\s*#')), j AS (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY line) AS last FROM h)"


def rules_sql(rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, CAST(line AS BIGINT) AS line, '{rule[:-1] if rule[-1] == '_' else rule}' AS rule FROM l WHERE {cond}" for rule, cond in rules.items())


MARKDOWN_SQL = rules_sql({
    "MD018": "regexp_matches(text, '^(#{1,6})([^#\\s].*)$')", "MD030": "regexp_matches(text, '^(\\s*)([-*+])([^\\s].*)$')", "MD030_": "regexp_matches(text, '^(\\s*)(\\d+\\.)([^\\s].*)$')", "MD010": "contains(text, chr(9))",
    "MD037": "(length(text) - length(replace(text, '*', ''))) % 2 = 1 AND NOT contains(text, '`') AND NOT (contains(text, '[') AND contains(text, ']'))", "MD040": "trim(text, ' ' || chr(9) || chr(13)) = '```'",
    "MD055": "length(text) - length(replace(text, '|', '')) >= 2 AND (contains(text, '---') OR contains(text, ':--') OR contains(text, '--:')) AND NOT regexp_matches(trim(text, ' ' || chr(9) || chr(13)), '^[|:\\s-]+$')",
})
TEXT_SQL = rules_sql({
    "TRAILING_WHITESPACE": "regexp_matches(text, '\\s$')", "TAB_CHARACTER": "contains(text, chr(9))", "MIXED_LINE_ENDINGS": "contains(text, chr(13))", "LONG_LINE": "strlen(text) > 100",
    **{"ENCODING_ISSUE" + "_" * k: f"contains(text, chr({c}))" for k, c in enumerate((65533,))}, "OCR_ERROR": "regexp_matches(text, '\\w+rn\\w+')", "NO_FINAL_NEWLINE": "line = lines AND text <> ''",
})
ODD_SQL = "".join(f" UNION ALL SELECT doc_id, CAST(line AS BIGINT), 'ENCODING_ISSUE' FROM l WHERE contains(text, chr({c}))" for c in (160, 8232, 8233))


@query(f"{L}{RUNS}{HEADINGS} {MARKDOWN_SQL} UNION ALL SELECT doc_id, CAST(line AS BIGINT), 'MD012' FROM r WHERE n > 1 UNION ALL SELECT doc_id, CAST(line AS BIGINT), 'MD001' FROM j WHERE level > last + 1 UNION ALL SELECT doc_id, CAST(line AS BIGINT), 'MD011' FROM (SELECT doc_id, line, unnest(regexp_extract_all(text, '\\([^)]+\\)\\[[^\\]]+\\]')) AS m FROM l)")
def lint_markdown(spark, sf_dir):
    return lint.issues(table(spark, sf_dir, "documents"), "markdown").select("doc_id", "line", "rule")


@query(f"{L}{RUNS} {TEXT_SQL}{ODD_SQL} UNION ALL SELECT doc_id, CAST(line AS BIGINT), 'CONSECUTIVE_BLANK_LINES' FROM r WHERE n > 2")
def lint_text(spark, sf_dir):
    return lint.issues(table(spark, sf_dir, "documents"), "text").select("doc_id", "line", "rule")


@query()
def lint_fix(spark, sf_dir):
    """Texts after all automatic fixes of the plain-text rules."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", lint.text_issues(F.col("text")).alias("found"))
    return docs.select("doc_id", lint.fixed(F.col("text"), F.col("found")).alias("text"))


@query("SELECT doc_id, text FROM documents")
def markdown_round_trip(spark, sf_dir):
    """Blocks of each document, put together again in order."""
    made = B.blocks(table(spark, sf_dir, "documents"))
    kept = made.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "content"))).alias("b"))
    return kept.select("doc_id", F.array_join(F.transform("b", lambda x: x["content"]), "\n").alias("text"))


@query()
def markdown_kinds(spark, sf_dir):
    return B.blocks(table(spark, sf_dir, "documents")).groupBy("kind", "translatable").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.char_length("content").cast("long")).alias("chars"))


@query()
def split_nodes(spark, sf_dir):
    return B.pieces(table(spark, sf_dir, "documents"))


@query()
def split_sentences(spark, sf_dir):
    return B.sentence_rows(table(spark, sf_dir, "documents"))


@query("SELECT doc_id, CAST(i + 1 AS BIGINT) AS place, substring(text, i * 800 + 1, 800) AS piece FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 799) // 800)) AS i FROM documents WHERE length(text) > 0)")
def split_fixed(spark, sf_dir):
    """Fixed widths of 800 characters, in the JVM."""
    starts = F.transform(F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / 800).cast("int")), lambda i: F.struct((i + 1).cast("long").alias("place"), F.substring(F.col("text"), i * 800 + 1, F.lit(800)).alias("piece")))
    return table(spark, sf_dir, "documents").where("char_length(text) > 0").select("doc_id", F.explode(starts).alias("s")).select("doc_id", "s.*")


@query("SELECT p_partkey, 1 - levenshtein(p_name, p_type)::DOUBLE / greatest(length(p_name), length(p_type)) AS similarity FROM part")
def similarity(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.similarity(F.col("p_name"), F.col("p_type")).alias("similarity"))


@query("SELECT event_type, count(*) AS requests, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def stream_counters(spark, sf_dir):
    """The counters of provider_metrics kept by a stream over the same records."""
    made = rollup.saved(rollup.counters(rollup.file_stream(spark, f"{sf_dir}/events.parquet"), "event_type", "value"), spark)
    return made.withColumn("total", F.round("total", 4))
