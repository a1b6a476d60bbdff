"""Queries over answers, rounds, records and clean-up of responses, and the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.functions import responses as R
from folio.functions.polish import formatted, trimmed
from folio.operators import nodes as N
from folio.operators import rounds
from folio.plans.catalogue import LINES, query, table

LINE = LINES + ", n AS (SELECT doc_id, lang, CAST(node_id AS BIGINT) AS node_id, text FROM l WHERE trim(text, ' ') <> '') "
T = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def nodes_of(spark, sf_dir):
    return N.lines(table(spark, sf_dir, "documents"))


def responses_of(spark, sf_dir):
    """An answer per document: nodes 7, 14 ... are lost, the end marks of 11, 22 ... are wrong, 5, 10 ... come again with other text."""
    n, t = F.col("node_id"), F.concat(F.lit("  "), "text", F.lit(" "))
    mark = lambda kind, i: F.concat(F.lit(f"@@NODE_{kind}_"), i.cast("string"), F.lit("@@"))
    piece = lambda t: F.concat(mark("START", n), F.lit("\n"), t, F.lit("\n"), mark("END", F.when(n % 11 == 0, n + 1).otherwise(n)))
    whole = F.when(n % 5 == 0, F.concat(piece(t), F.lit("\n\n"), piece(F.concat("text", F.lit(" again"))))).otherwise(piece(t))
    kept = nodes_of(spark, sf_dir).where(n % 7 != 0).select("doc_id", "lang", F.struct("node_id", whole.alias("piece")).alias("p"))
    return kept.groupBy("doc_id", "lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["piece"]), "\n\n").alias("response"))


BACK = T.format("CASE WHEN node_id % 5 = 0 THEN text || ' again' ELSE text END")


@query(LINE + f"SELECT doc_id, node_id, {BACK} AS text FROM n WHERE node_id % 7 <> 0 AND node_id % 11 <> 0")
def decode_nodes(spark, sf_dir):
    return rounds.answers(responses_of(spark, sf_dir), "response", "doc_id")


@query(LINE + f"SELECT doc_id, node_id, {BACK} AS text FROM n WHERE node_id % 7 <> 0")
def decode_lines(spark, sf_dir):
    return rounds.answers_by_line(responses_of(spark, sf_dir), "response", "doc_id")


@query(LINE + "SELECT lang, CASE WHEN node_id % 7 = 0 OR node_id % 11 = 0 THEN 'failed' ELSE 'success' END AS status, count(*) AS nodes, count(CASE WHEN node_id % 7 = 0 OR node_id % 11 = 0 THEN 1 END) AS errors FROM n GROUP BY ALL")
def results_met(spark, sf_dir):
    made = rounds.met(nodes_of(spark, sf_dir).drop("lang").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id"), decode_nodes(spark, sf_dir), "doc_id")
    return made.groupBy("lang", "status").agg(F.count(F.lit(1)).alias("nodes"), F.count("error").alias("errors"))


@query(LINE + "SELECT doc_id, node_id FROM n WHERE node_id % 7 = 0 OR node_id % 11 = 0")
def missing_nodes(spark, sf_dir):
    return rounds.missing(nodes_of(spark, sf_dir), decode_nodes(spark, sf_dir), "doc_id").select("doc_id", "node_id")


def flaky(text, k):
    """A provider that fails by doc_id, node_id and round."""
    return F.when((F.col("doc_id") + F.col("node_id") * 3 + k * F.col("node_id")) % 4 != 0, F.concat(F.lit("<"), text, F.lit(">")))


DONE = LINE + ", d AS (SELECT *, CASE WHEN (doc_id + node_id * 3) % 4 <> 0 THEN 1 WHEN (doc_id + node_id * 4) % 4 <> 0 THEN 2 WHEN (doc_id + node_id * 5) % 4 <> 0 THEN 3 END AS won FROM n) "


@query(DONE + "SELECT lang, CASE WHEN won IS NULL THEN 'failed' ELSE 'success' END AS status, CAST(coalesce(won, 3) AS BIGINT) AS attempts, count(*) AS nodes, CAST(sum(CASE WHEN won IS NULL THEN 0 ELSE length(text) END) AS BIGINT) AS chars FROM d GROUP BY ALL")
def translate_rounds(spark, sf_dir):
    done = rounds.in_rounds(nodes_of(spark, sf_dir), flaky, 3)
    return done.groupBy("lang", "status", "attempts").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.when(F.col("status") == "success", F.char_length("text")).otherwise(0).cast("long")).alias("chars"))


@query(DONE + "SELECT doc_id, CAST(r AS BIGINT) AS round, count(*) AS asked, count(*) FILTER (won = r) AS succeeded, count(*) FILTER (won IS NULL OR won > r) AS failed FROM d, (VALUES (1), (2), (3)) AS x(r) WHERE won IS NULL OR won >= r GROUP BY doc_id, r")
def round_results(spark, sf_dir):
    return rounds.by_round(rounds.in_rounds(nodes_of(spark, sf_dir), flaky, 3), 3, "doc_id")


@query(DONE + "SELECT doc_id, count(*) AS total, count(won) AS succeeded, count(*) - count(won) AS failed, count(won) * 100.0::DOUBLE / count(*) AS progress, CAST(sum(strlen(text)) // 2 AS BIGINT) AS tokens FROM d GROUP BY doc_id")
def document_summary(spark, sf_dir):
    good = F.count_if(F.col("status") == "success")
    done = rounds.in_rounds(nodes_of(spark, sf_dir), flaky, 3)
    return done.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), good.alias("succeeded"), (F.count(F.lit(1)) - good).alias("failed"), (good * 100.0 / F.count(F.lit(1))).alias("progress"), F.floor(F.sum(F.octet_length("text")) / 2).cast("long").alias("tokens"))


@query(DONE + ", s AS (SELECT doc_id, node_id, won IS NULL AS bad, lag(won IS NULL) OVER w AS b, lead(won IS NULL) OVER w AS a FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY node_id)) SELECT doc_id, node_id, NOT bad AS is_context FROM s WHERE bad OR coalesce(a, false) OR coalesce(b, false)")
def retry_context(spark, sf_dir):
    return rounds.retry_context(rounds.in_rounds(nodes_of(spark, sf_dir), flaky, 3), "doc_id", "node_id").select("doc_id", "node_id", "is_context")


@query(DONE + ", f AS (SELECT doc_id, node_id, row_number() OVER (PARTITION BY doc_id ORDER BY node_id) AS place FROM d WHERE won IS NULL) SELECT doc_id, node_id, place FROM f WHERE place <= 5")
def first_failed(spark, sf_dir):
    bad = rounds.in_rounds(nodes_of(spark, sf_dir), flaky, 3).where("status = 'failed'")
    return bad.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("node_id")).cast("long")).where("place <= 5").select("doc_id", "node_id", "place")


@query(DONE + "SELECT doc_id, string_agg(CASE WHEN won IS NULL THEN text ELSE '<' || text || '>' END, chr(10) || chr(10) ORDER BY node_id) AS text FROM d GROUP BY doc_id")
def assemble_fallback(spark, sf_dir):
    done = rounds.in_rounds(nodes_of(spark, sf_dir), flaky, 3).select("doc_id", F.struct("node_id", F.coalesce("translated", "text").alias("t")).alias("n"))
    return done.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("n")), lambda n: n["t"]), "\n\n").alias("text"))


MARKS = LINE + ", m AS (SELECT doc_id, count(*) AS all_, count(*) FILTER (node_id % 7 <> 0) + count(*) FILTER (node_id % 7 <> 0 AND node_id % 5 = 0) AS back, min(node_id) FILTER (node_id % 7 <> 0) AS first FROM n GROUP BY doc_id HAVING back > 0) "


@query(MARKS + "SELECT doc_id, all_ AS request_starts, all_ AS request_ends, back AS response_starts, back AS response_ends, true AS balanced, all_ = back AS preserved, false AS is_json, false AS is_empty, back AS bare_marks, first AS first_id FROM m")
def marker_diagnosis(spark, sf_dir):
    asked = nodes_of(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.collect_list(N.encoded(F.col("node_id"), F.col("text"))), "\n\n").alias("request"))
    both = responses_of(spark, sf_dir).join(asked, "doc_id")
    made = rounds.diagnosis(F.col("request"), F.col("response"))
    return both.select("doc_id", *[c.alias(k) for k, c in made.items() if k != "short"], rounds.marker_id(F.col("response")).alias("first_id"))


PARAGRAPHS = "WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), chr(10) || chr(10)), lambda x: " + T.format("x") + "), lambda x: x <> '') AS ps FROM documents) "


def paragraphs(spark, sf_dir):
    text = F.replace("text", F.lit(".\n"), F.lit(".\n\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.filter(F.transform(F.split(text, "\n\n", -1), trimmed), lambda x: x != "").alias("ps"))


@query(PARAGRAPHS + "SELECT doc_id, CAST(generate_subscripts(ps, 1) AS BIGINT) AS node_id, '/paragraph[' || generate_subscripts(ps, 1) || ']' AS path, unnest(ps) AS text FROM p")
def text_parse(spark, sf_dir):
    n = (F.col("pos") + 1).cast("long")
    return paragraphs(spark, sf_dir).select("doc_id", F.posexplode("ps").alias("pos", "text")).select("doc_id", n.alias("node_id"), F.concat(F.lit("/paragraph["), n.cast("string"), F.lit("]")).alias("path"), "text")


@query(PARAGRAPHS + "SELECT doc_id, array_to_string(ps, chr(10) || chr(10)) AS text FROM p")
def text_render(spark, sf_dir):
    return paragraphs(spark, sf_dir).select("doc_id", F.array_join("ps", "\n\n").alias("text"))


@query(PARAGRAPHS + "SELECT doc_id, CAST((generate_subscripts(ps, 1) - 1) // 10 AS BIGINT) AS batch, unnest(ps) AS text FROM p")
def fixed_batches(spark, sf_dir):
    return paragraphs(spark, sf_dir).select("doc_id", F.posexplode("ps").alias("pos", "text")).select("doc_id", F.floor(F.col("pos") / 10).cast("long").alias("batch"), "text")


TAG = "CASE node_id % 6 WHEN 0 THEN 'h1' WHEN 1 THEN 'title' WHEN 2 THEN 'p' WHEN 3 THEN 'div' WHEN 4 THEN 'li' ELSE 'span' END"


@query(LINE + f", p AS (SELECT doc_id, node_id, text, 1 + (CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END) + (CASE node_id % 6 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 3 WHEN 4 THEN 0 ELSE 1 END) AS priority FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY priority DESC, doc_id, node_id) AS k FROM p) SELECT doc_id, node_id, CAST(priority AS INTEGER) AS priority FROM r WHERE k = 1")
def dedup_by_priority(spark, sf_dir):
    """One node of each text: that of the highest priority, the first of equal ones."""
    made = nodes_of(spark, sf_dir).withColumn("priority", R.node_priority(F.expr(TAG), F.col("doc_id") % 2 == 0))
    best = made.groupBy("text").agg(F.min(F.struct((-F.col("priority")).alias("p"), "doc_id", "node_id")).alias("b"))
    return best.select("b.doc_id", "b.node_id", (-F.col("b.p")).cast("int").alias("priority"))


@query("WITH a AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'alt' WHEN 1 THEN 'title' WHEN 2 THEN 'aria-label' ELSE 'href' END AS name FROM documents) SELECT doc_id, name, CASE name WHEN 'alt' THEN 10 WHEN 'title' THEN 9 WHEN 'aria-label' THEN 7 ELSE 0 END AS priority FROM a")
def attribute_priority(spark, sf_dir):
    name = F.expr("CASE doc_id % 4 WHEN 0 THEN 'alt' WHEN 1 THEN 'title' WHEN 2 THEN 'aria-label' ELSE 'href' END")
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name")).withColumn("priority", R.attribute_priority(F.col("name")))


COLLAPSED = "regexp_replace({}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


@query(f"SELECT doc_id, CASE doc_id % 7 WHEN 4 THEN '' WHEN 1 THEN {T.format(COLLAPSED.format(T.format('text')))} || '<think>x</think>' WHEN 6 THEN {T.format(COLLAPSED.format(T.format(chr(39) + '[INTERNAL]b[/INTERNAL]' + chr(39) + ' || text')))} ELSE {T.format(COLLAPSED.format(T.format('text')))} END AS text FROM documents")
def reasoning_at_start(spark, sf_dir):
    t = trimmed(F.col("text"))
    put = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit(" <think>a\nb</think>\n"), t)).when(F.col("doc_id") % 7 == 1, F.concat(t, F.lit("<think>x</think>")))
    put = put.when(F.col("doc_id") % 7 == 2, F.concat(F.lit("<answer>\n"), t, F.lit("</answer> more"))).when(F.col("doc_id") % 7 == 3, F.concat(F.lit("[THINKING]x[/THINKING]"), t))
    put = put.when(F.col("doc_id") % 7 == 4, F.concat(F.lit("<reflection>never ends "), t)).when(F.col("doc_id") % 7 == 6, F.concat(F.lit("<analysis>a</analysis>[INTERNAL]b[/INTERNAL]"), t)).otherwise(t)
    return table(spark, sf_dir, "documents").select("doc_id", R.without_leading_reasoning(put).alias("text"))


@query("SELECT doc_id, 'first part|' || source AS parts FROM documents")
def reasoning_parts(spark, sf_dir):
    put = F.concat(F.lit("<think> first\tpart\n</think>"), F.col("lang"), F.lit("<think>\n"), F.col("source"), F.lit(" </think><think>open"))
    return table(spark, sf_dir, "documents").select("doc_id", F.replace(F.array_join(R.reasoning_parts(put, "<think>", "</think>"), "|"), F.lit("\t"), F.lit(" ")).alias("parts"))


@query(f"SELECT doc_id, {T.format('text')} AS text FROM documents")
def response_unwrap(spark, sf_dir):
    t = trimmed(F.col("text"))
    put = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" Here is the translation:\n"), t)).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("```text\n"), t, F.lit("\n```")))
    put = put.when(F.col("doc_id") % 4 == 2, F.concat(F.lit("Translation: Translated text: "), t)).otherwise(t)
    return table(spark, sf_dir, "documents").select("doc_id", R.unwrapped(put).alias("text"))


#: Messages, what kind they are and whether they may pass, written out by hand.
MESSAGES = (("Request Timeout", "timeout", True), ("rate limit reached", "rate_limit", True), ("context canceled", "context_error", False), ("Network is unreachable", "network_error", True), ("auth failed", "auth_error", False), ("quota used up", "quota_exceeded", False), ("HTTP 503", "unknown_error", True), ("odd", "unknown_error", False), ("context deadline exceeded", "context_error", True), ("write: broken pipe", "unknown_error", True))
EXPECTED = ", ".join(f"({i}, '{k}', {str(y).lower()})" for i, (_, k, y) in enumerate(MESSAGES))


@query(f"SELECT event_id, kind, retry FROM events JOIN (VALUES {EXPECTED}) AS x(i, kind, retry) ON event_id % {len(MESSAGES)} = i")
def error_class(spark, sf_dir):
    message = F.element_at(F.array(*[F.lit(m) for m, _, _ in MESSAGES]), (F.col("event_id") % len(MESSAGES) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", R.error_kind(message).alias("kind"), R.retryable(message).alias("retry"))


FORMAT_SQL = " OR ".join("regexp_matches({0}, '" + p.replace("'", "''").replace("{", "{{").replace("}", "}}") + "')" for p in R.FORMATTING)
PLAINER = "regexp_replace(text, '[*#`<$\\[]', '', 'g')"


@query(f"SELECT doc_id, {FORMAT_SQL.format('text')} AS has, ({FORMAT_SQL.format('text')}) AND NOT ({FORMAT_SQL.format(PLAINER)}) AS lost FROM documents")
def format_loss(spark, sf_dir):
    has, after = R.has_formatting(F.col("text")), R.has_formatting(F.regexp_replace("text", r"[*#`<$\[]", ""))
    return table(spark, sf_dir, "documents").select("doc_id", has.alias("has"), (has & ~after).alias("lost"))


@query("SELECT doc_id, md5('step:initial|provider:raw|model:' || source || '|src:' || lang || '|tgt:zh|temp:0.30|tokens:4096|text:' || text || CASE WHEN doc_id % 2 = 0 THEN '|context:' || lang ELSE '' END) AS cache_key FROM documents")
def cache_key(spark, sf_dir):
    key = R.cache_key(F.lit("initial"), F.lit("raw"), F.col("source"), F.col("lang"), F.lit("zh"), F.lit(0.3), F.lit(4096), F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("cache_key"))


NL2 = "chr(10) || chr(10)"


@query(f"SELECT doc_id, regexp_replace(regexp_replace(concat(lang, {NL2}, '![a](b.png)', {NL2}, CASE doc_id % 3 WHEN 0 THEN 'Figure ' || doc_id || {NL2} || chr(10) ELSE '' END, 'rest', {NL2}, '$$', chr(10), 'x + ' || doc_id, chr(10), '$$', {NL2}, source), '\\n{{3,}}', {NL2}, 'g'), '\\n\\s+\\n', {NL2}, 'g') AS text FROM documents")
def preformat(spark, sf_dir):
    """Images and display formulas in paragraphs of their own, runs of line ends shortened."""
    image = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("![a](b.png) Figure "), F.col("doc_id").cast("string"), F.lit("  \n"))).when(F.col("doc_id") % 3 == 1, F.lit("![a](b.png)\n\n.\n")).otherwise(F.lit("![a](b.png)  .\n"))
    put = F.concat("lang", image, F.lit("rest$$ x + "), F.col("doc_id").cast("string"), F.lit("\n$$"), "source")
    return table(spark, sf_dir, "documents").select("doc_id", R.fewer_newlines(R.formulas_apart(R.images_apart(put))).alias("text"))


@query(LINE + "SELECT doc_id, count(*) AS n, CAST(sum(node_id) AS BIGINT) AS total FROM n GROUP BY doc_id")
def protected_ids(spark, sf_dir):
    """Ids of element placeholders, read back from a text that holds one per node."""
    held = nodes_of(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.collect_list(F.concat(F.lit("@@PROTECTED_"), F.col("node_id").cast("string"), F.lit("@@ x"))), " ").alias("t"))
    ids = R.protected_ids(F.col("t"))
    return held.select("doc_id", F.size(ids).cast("long").alias("n"), F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT doc_id, CAST(len(list_filter(list_transform(range(1, greatest(len(x), len(y)) + 1), lambda i: x[i] IS DISTINCT FROM y[i]), lambda d: d)) AS BIGINT) AS changed FROM (SELECT doc_id, string_split(text, chr(10)) AS x, string_split(replace(replace(text, '. ', '.' || chr(10)), chr(9), '    '), chr(10)) AS y FROM documents)")
def changed_lines(spark, sf_dir):
    after = F.replace(F.replace("text", F.lit(". "), F.lit(".\n")), F.lit("\t"), F.lit("    "))
    return table(spark, sf_dir, "documents").select("doc_id", R.changed_lines(F.col("text"), after).alias("changed"))


RECORDS = "WITH r AS (SELECT doc_id AS id, lang AS src, CASE WHEN doc_id % 3 = 0 THEN 'fr' ELSE 'zh' END AS tgt, source AS format, n_chars AS chars, n_chars * 1000000 + doc_id AS ns, CASE WHEN doc_id % 10 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS failed_nodes, doc_id % 50 + 1 AS total_nodes FROM documents) "
BAD = "(status = 'failed' OR failed_nodes > 0)"


def records(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        d.alias("id"), F.col("lang").alias("src"), F.when(d % 3 == 0, "fr").otherwise("zh").alias("tgt"), F.col("source").alias("format"), F.col("n_chars").alias("chars"), (F.col("n_chars") * 1000000 + d).alias("ns"),
        F.when(d % 10 == 0, "failed").otherwise("completed").alias("status"), F.when(d % 7 == 0, 1).otherwise(0).alias("failed_nodes"), (d % 50 + 1).alias("total_nodes"),
    )


def totals():
    return [F.count(F.lit(1)).alias("translations"), F.sum("chars").alias("chars"), F.sum("ns").alias("ns"), F.count_if(F.expr(BAD)).alias("errors")]


@query(RECORDS + f"SELECT count(*) AS translations, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(ns) AS BIGINT) AS ns, count(*) FILTER {BAD.replace('(', '(WHERE ', 1)} AS errors FROM r")
def record_totals(spark, sf_dir):
    return records(spark, sf_dir).agg(*totals())


@query(RECORDS + f"SELECT src || '-' || tgt AS pair, count(*) AS translations, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(ns) AS BIGINT) AS ns, count(*) FILTER {BAD.replace('(', '(WHERE ', 1)} AS errors, avg(ns) AS mean_ns, max(id) AS last_used FROM r GROUP BY 1")
def language_pairs(spark, sf_dir):
    return records(spark, sf_dir).groupBy(F.concat("src", F.lit("-"), "tgt").alias("pair")).agg(*totals(), F.avg("ns").alias("mean_ns"), F.max("id").alias("last_used"))


@query(RECORDS + "SELECT format, count(*) AS files, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(chars) // count(*) AS BIGINT) AS mean_size, count(*) FILTER (WHERE status = 'completed' AND failed_nodes = 0) * 1.0::DOUBLE / count(*) AS success_rate, avg(ns) AS mean_ns FROM r GROUP BY format")
def format_rollup(spark, sf_dir):
    good = F.count_if(F.expr("status = 'completed' AND failed_nodes = 0"))
    return records(spark, sf_dir).groupBy("format").agg(F.count(F.lit(1)).alias("files"), F.sum("chars").alias("chars"), F.floor(F.sum("chars") / F.count(F.lit(1))).cast("long").alias("mean_size"), (good * 1.0 / F.count(F.lit(1))).cast("double").alias("success_rate"), F.avg("ns").alias("mean_ns"))


@query(RECORDS + "SELECT round(sum(chars / (ns / 1e9)) FILTER (WHERE ns > 0 AND chars > 0) / count(*), 6) AS chars_per_second, round(sum(total_nodes / (ns / 1e9)) FILTER (WHERE ns > 0 AND chars > 0) / count(*), 6) AS nodes_per_second, min(ns) FILTER (WHERE ns > 0 AND chars > 0) AS fastest, max(ns) FILTER (WHERE ns > 0 AND chars > 0) AS slowest FROM r")
def performance_rollup(spark, sf_dir):
    ok, sec = F.expr("ns > 0 AND chars > 0"), F.col("ns") / 1e9
    per = lambda c: F.round(F.sum(F.when(ok, F.col(c) / sec)) / F.count(F.lit(1)), 6)
    return records(spark, sf_dir).agg(per("chars").alias("chars_per_second"), per("total_nodes").alias("nodes_per_second"), F.min(F.when(ok, F.col("ns"))).alias("fastest"), F.max(F.when(ok, F.col("ns"))).alias("slowest"))


@query(RECORDS + "SELECT src || '-' || tgt AS pair, count(*) AS translations, row_number() OVER (ORDER BY count(*) DESC, src || '-' || tgt) AS place FROM r GROUP BY 1")
def pairs_by_count(spark, sf_dir):
    counts = records(spark, sf_dir).groupBy(F.concat("src", F.lit("-"), "tgt").alias("pair")).agg(F.count(F.lit(1)).alias("translations"))
    # a row per language pair, few by nature
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("translations"), "pair")).cast("long"))


REQUESTS = "WITH q AS (SELECT event_type AS provider, user_id % 3 AS model, event_id % 5 <> 0 AS ok, event_id % 1000 AS ms, event_id % 700 AS t_in, event_id % 500 AS t_out, (event_id % 90) / 4096.0::DOUBLE AS cost, event_id % 9 AS found, event_id % 4 = 0 AS lost, event_id % 6 = 0 AS format_issue, event_id % 8 = 0 AS reasoning, event_id % 11 = 0 AS alike, event_id % 13 = 0 AS again FROM events) "
COUNTERS = "SELECT provider, model, count(*) AS requests, count(*) FILTER (WHERE ok) AS good, count(*) FILTER (WHERE NOT ok) AS bad, CAST(sum(t_in) AS BIGINT) AS t_in, CAST(sum(t_out) AS BIGINT) AS t_out, sum(cost) AS cost, min(ms) AS least_ms, max(ms) AS most_ms, avg(ms) AS mean_ms, count(*) FILTER (WHERE found > 0 AND NOT lost) AS marks_kept, count(*) FILTER (WHERE lost) AS marks_lost, count(*) FILTER (WHERE format_issue) AS corrupted, count(*) FILTER (WHERE reasoning) AS reasoning, count(*) FILTER (WHERE alike) AS alike, count(*) FILTER (WHERE again) AS again FROM q GROUP BY provider, model"


def counters(spark, sf_dir):
    e = F.col("event_id")
    q = table(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), (F.col("user_id") % 3).alias("model"), (e % 5 != 0).alias("ok"), (e % 1000).alias("ms"), (e % 700).alias("t_in"), (e % 500).alias("t_out"), ((e % 90) / 4096.0).alias("cost"), (e % 9).alias("found"), (e % 4 == 0).alias("lost"), (e % 6 == 0).alias("format_issue"), (e % 8 == 0).alias("reasoning"), (e % 11 == 0).alias("alike"), (e % 13 == 0).alias("again"))
    n = F.count_if
    return q.groupBy("provider", "model").agg(
        F.count(F.lit(1)).alias("requests"), n("ok").alias("good"), n(~F.col("ok")).alias("bad"), F.sum("t_in").alias("t_in"), F.sum("t_out").alias("t_out"), F.sum("cost").alias("cost"), F.min("ms").alias("least_ms"), F.max("ms").alias("most_ms"), F.avg("ms").alias("mean_ms"),
        n((F.col("found") > 0) & ~F.col("lost")).alias("marks_kept"), n("lost").alias("marks_lost"), n("format_issue").alias("corrupted"), n("reasoning").alias("reasoning"), n("alike").alias("alike"), n("again").alias("again"),
    )


@query(REQUESTS + COUNTERS)
def provider_counters(spark, sf_dir):
    return counters(spark, sf_dir)


@query(REQUESTS + f", c AS ({COUNTERS}) SELECT provider, model, good * 100.0::DOUBLE / requests AS success_rate, bad * 100.0::DOUBLE / requests AS error_rate, marks_kept * 100.0::DOUBLE / nullif(marks_kept + marks_lost, 0) AS marker_rate, alike * 100.0::DOUBLE / requests AS alike_rate, again * 100.0::DOUBLE / requests AS retry_rate, t_out::DOUBLE / nullif(t_in, 0) AS token_efficiency, cost / nullif(t_out, 0) * 1000 AS cost_per_1k FROM c")
def provider_rates(spark, sf_dir):
    per = lambda a, b: F.try_divide(F.col(a) * 100.0, b)
    r = F.col("requests")
    return counters(spark, sf_dir).select("provider", "model", per("good", r).alias("success_rate"), per("bad", r).alias("error_rate"), per("marks_kept", F.col("marks_kept") + F.col("marks_lost")).alias("marker_rate"), per("alike", r).alias("alike_rate"), per("again", r).alias("retry_rate"), F.try_divide(F.col("t_out").cast("double"), "t_in").alias("token_efficiency"), (F.try_divide("cost", F.col("t_out")) * 1000).alias("cost_per_1k"))


@query("WITH s AS (SELECT user_id, event_id % 20 AS node, arg_max(event_type, event_id) AS status, max(event_id) AS at FROM events GROUP BY 1, 2) SELECT user_id, count(*) AS nodes, count(*) FILTER (status = 'purchase') AS completed, count(*) FILTER (status = 'error') AS failed, count(*) FILTER (status = 'purchase') * 100.0::DOUBLE / count(*) AS pct FROM s GROUP BY user_id")
def session_progress(spark, sf_dir):
    """Progress of each session by the last status of each of its nodes."""
    last = table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 20).alias("node")).agg(F.max_by("event_type", "event_id").alias("status"))
    done = F.count_if(F.col("status") == "purchase")
    return last.groupBy("user_id").agg(F.count(F.lit(1)).alias("nodes"), done.alias("completed"), F.count_if(F.col("status") == "error").alias("failed"), (done * 100.0 / F.count(F.lit(1))).cast("double").alias("pct"))


@query("SELECT event_type, count(*) FILTER (ts < TIMESTAMP '2024-01-20 00:00:00') AS expired, count(*) FILTER (ts >= TIMESTAMP '2024-01-20 00:00:00') AS kept FROM events GROUP BY event_type")
def cache_expiry(spark, sf_dir):
    """Entries older than ten days at the end of January 29th are expired."""
    old = F.col("ts") + F.expr("INTERVAL 10 DAYS") < F.lit("2024-01-30 00:00:00").cast("timestamp_ntz").cast("timestamp")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(old).alias("expired"), F.count_if(~old).alias("kept"))


@query("WITH n AS (SELECT event_id, event_id % 5 AS retries, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'success' ELSE 'pending' END AS status FROM events) SELECT status, count(*) AS nodes, count(*) FILTER (status = 'failed' AND retries < 3) AS to_retry, count(*) FILTER (status <> 'success') AS unfinished FROM n GROUP BY status")
def node_status(spark, sf_dir):
    n = table(spark, sf_dir, "events").select((F.col("event_id") % 5).alias("retries"), F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "success").otherwise("pending").alias("status"))
    return n.groupBy("status").agg(F.count(F.lit(1)).alias("nodes"), F.count_if((F.col("status") == "failed") & (F.col("retries") < 3)).alias("to_retry"), F.count_if(F.col("status") != "success").alias("unfinished"))
