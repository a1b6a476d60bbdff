"""Queries over clean-up and formatting, and the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import polish as Z
from folio.plans.catalogue import query, table

FRONT, BACK = "以下是翻译：汉abc汉 ，“", "”版本version2.0汉$5好的的 A的B的C 苹果公司 word word [TRANSLATE]...... -- Translation complete now"
NOISY = f"concat('{FRONT}', text, '{BACK}')"


def noisy():
    """Texts with what the clean-up looks for put around them."""
    return F.concat(F.lit(FRONT), F.col("text"), F.lit(BACK))


def replaced_sql(column: str, rules) -> str:
    for p, to in rules:
        p = p.replace("(?di)", "(?i)").replace(r"\p{IsHan}", r"\p{Han}").replace("'", "''")
        column = f"regexp_replace({column}, '{p}', '{to.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2').replace('$3', chr(92) + '3')}', 'g')"
    return column


BOTH_ENDS = (r"^\s+|\s+$", "")
CLEAN_SQL = replaced_sql(NOISY, [*[(p, "") for p in Z.PROMPT_LEFTOVERS], (r"\n\s*\n\s*\n", "\n\n"), BOTH_ENDS])
MARKS_SQL = "regexp_replace(replace(regexp_replace(translate({}, '“”„「」『』‘’‚', '\"\"\"\"\"\"\"'''''''), '\\.{{2,}}', '...', 'g'), '……', '...'), '[-–—]{{2,}}', '——', 'g')"


@query(f"SELECT doc_id, {CLEAN_SQL} AS text FROM documents")
def prompt_cleanup(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", Z.without_prompts(noisy()).alias("text"))


@query(f"SELECT doc_id, {MARKS_SQL.format(NOISY)} AS text FROM documents")
def consistent_marks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", Z.consistent_marks(noisy()).alias("text"))


@query(f"SELECT doc_id, {replaced_sql(NOISY, Z.SPACING)} AS text FROM documents")
def mixed_spacing(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", Z.mixed_spacing(noisy()).alias("text"))


WORDS = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"


@query(f"WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents) SELECT doc_id, coalesce(array_to_string(list_transform(list_filter(range(1, len(words) + 1), lambda i: i = 1 OR words[i] <> words[i - 1]), lambda i: words[i]), ' '), '') AS text FROM w")
def repeated_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", Z.without_repeats(F.col("text")).alias("text"))


@query(f"SELECT doc_id, regexp_replace(replace({NOISY}, '苹果公司', 'Apple'), '(\\w+)的(\\w+)的(\\w+)', '\\1\\2\\3', 'g') AS text FROM documents")
def nouns_and_chains(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", Z.shorter_chains(Z.proper_nouns(noisy())).alias("text"))


CHAIN_SQL = "regexp_replace({}, '(\\w+)的(\\w+)的(\\w+)', '\\1\\2\\3', 'g')"


def nouns_sql(column: str) -> str:
    for wrong, right in Z.PROPER_NOUNS.items():
        column = f"replace({column}, '{wrong}', '{right}')"
    return column


POLISHED_SQL = (
    f"WITH a AS (SELECT doc_id, {CLEAN_SQL} AS t FROM documents), b AS (SELECT doc_id, {MARKS_SQL.format('t')} AS t FROM a), c AS (SELECT doc_id, {replaced_sql('t', Z.SPACING)} AS t FROM b), "
    f"w AS (SELECT doc_id, {WORDS.replace('text', 't')} AS words FROM c), d AS (SELECT doc_id, coalesce(array_to_string(list_transform(list_filter(range(1, len(words) + 1), lambda i: i = 1 OR words[i] <> words[i - 1]), lambda i: words[i]), ' '), '') AS t FROM w) "
    f"SELECT doc_id, {CHAIN_SQL.format(nouns_sql('t'))} AS text FROM d"
)


@query(POLISHED_SQL)
def polished(spark, sf_dir):
    """All steps of the clean-up in order."""
    return table(spark, sf_dir, "documents").select("doc_id", Z.polished(noisy()).alias("text"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS text, true AS had FROM documents")
def reasoning_anywhere(spark, sf_dir):
    put = F.concat(F.lit("<thinking>a\nb</thinking>"), "text", F.lit("[REASONING]x[/REASONING]"))
    return table(spark, sf_dir, "documents").select("doc_id", Z.without_reasoning_anywhere(put).alias("text"), Z.has_reasoning(put).alias("had"))


@query()
def format_wrapped(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", Z.formatted(F.col("text"), 80).alias("text"))


@query("SELECT doc_id, CASE WHEN t = '' THEN t ELSE t || chr(10) END AS text FROM (SELECT doc_id, regexp_replace(replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '(?m)[ \\t]+$', '', 'g'), chr(9), '    '), '^\\s+|\\s+$', '', 'g') AS t FROM documents)")
def format_plain(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", Z.formatted(F.col("text")).alias("text"))


@query("SELECT p_partkey, len(list_filter(range(1, least(length(p_name), length(p_type)) + 1), lambda i: p_name[i] = p_type[i]))::DOUBLE / greatest(length(p_name), length(p_type)) AS likeness FROM part")
def similarity_places(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", Z.same_places(F.col("p_name"), F.col("p_type")).alias("likeness"))


@query("SELECT page_id, list_reduce(list_transform(string_split(url, ''), lambda c: unicode(c)::BIGINT), lambda h, c: (h * 31 + c) % 4294967296) AS hash FROM pages WHERE url <> ''")
def hash31(spark, sf_dir):
    return table(spark, sf_dir, "pages").where("url <> ''").select("page_id", Z.hash31(F.col("url")).alias("hash"))


@query("SELECT event_id, least(0.1::DOUBLE * pow(2.0, event_id % 9), 5.0::DOUBLE) AS wait, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE (event_id % 7)::DOUBLE / (event_id % 3) * 100 END AS pct FROM events")
def retry_delay(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", Z.delay(e % 9, 0.1, 2, 5).alias("wait"), Z.percent(e % 7, e % 3).alias("pct"))


@query("SELECT page_id, trim(regexp_extract(html, '(?i)^\\s*<\\?xml[^>]*\\?>', 0)) AS declaration, regexp_extract(html, '^[ \\t\\r\\n]*', 0) AS lead FROM pages")
def xml_head(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", Z.xml_declaration(F.col("html")).alias("declaration"), Z.blank_ends(F.col("html"))["lead"].alias("lead"))


@query("SELECT lang, count(*) FILTER (len(regexp_extract_all(text, '\\p{Han}')) > len(regexp_extract_all(text, '[\\x00-\\x7F]'))) AS han, count(*) AS documents FROM documents GROUP BY lang")
def han_paragraphs(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(Z.is_han_paragraph(F.col("text"))).alias("han"), F.count(F.lit(1)).alias("documents"))


@query("SELECT doc_id, string_agg(text, chr(10) ORDER BY node_id) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS node_id FROM documents) WHERE trim(text, ' ') <> '' GROUP BY doc_id")
def assemble(spark, sf_dir):
    """Nodes of each document joined in order; a document is one group of its own lines."""
    from folio.operators import nodes as N

    made = N.lines(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "text"))).alias("nodes"))
    return made.select("doc_id", F.array_join(F.transform("nodes", lambda n: n["text"]), "\n").alias("text"))
