"""Queries over HTML pages, and the SQL they must equal where pages are regular enough for patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.plans.catalogue import query, table
from folio.sources import html as H

BARE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>', '<!>', 'g'), '(?s)<style[^>]*>.*?</style>', '<!>', 'g'), '(?s)<(?:pre|code)[^>]*>.*?</(?:pre|code)>', '<!>', 'g'), '(?s)<!--.*?-->', '<!>', 'g')"
TEXTS = f"WITH t AS (SELECT page_id, list_filter(list_transform(regexp_extract_all({BARE}, '>([^<]+)', 1), lambda x: regexp_replace(x, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')), lambda x: x <> '') AS ts FROM pages) "


@query(TEXTS + "SELECT page_id, CAST(generate_subscripts(ts, 1) AS BIGINT) AS place, unnest(ts) AS text FROM t")
def html_texts(spark, sf_dir):
    """Text nodes of each page in order."""
    from pyspark.sql import Window

    made = H.html_nodes(table(spark, sf_dir, "pages")).where("not is_attribute")
    return made.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("node_id")).cast("long").alias("place"), "text")


@query("SELECT page_id, unnest(['/@alt', '/@title', '/@value']) AS name, unnest(['Picture ' || page_id, 'tip', 'Go']) AS text, unnest([10, 9, 5]) AS priority FROM pages WHERE contains(html, '<article>')")
def html_attributes(spark, sf_dir):
    """Attribute nodes of pages that get an image, a link and a button; addresses and identifiers are none."""
    put = F.concat(F.lit('<article><img alt="Picture '), F.col("page_id").cast("string"), F.lit('" src="x"><a title=" tip " href="#">x</a><input type="submit" value="Go" name="n"><input value="no">'))
    pages = table(spark, sf_dir, "pages").select("page_id", F.replace("html", F.lit("<article>"), put).alias("html"))
    made = H.html_nodes(pages).where("is_attribute")
    return made.select("page_id", F.regexp_extract("path", "/@[a-z-]+$", 0).alias("name"), "text", "priority")


@query("SELECT page_id, html FROM pages")
def html_round_trip(spark, sf_dir):
    """Every node put back as it was leaves the page as it was."""
    pages = table(spark, sf_dir, "pages")
    return H.html_render(pages, H.html_nodes(pages).where("not is_attribute").select("page_id", "node_id", "text"))


@query(TEXTS + "SELECT page_id, CAST(len(ts) AS BIGINT) AS n FROM t")
def html_translated(spark, sf_dir):
    """Marks around each text, put into the pages and counted there."""
    pages = table(spark, sf_dir, "pages")
    new = H.html_nodes(pages).where("not is_attribute").select("page_id", "node_id", F.concat(F.lit("\u00ab\u00ab"), "text", F.lit("\u00bb\u00bb")).alias("text"))
    return H.html_render(pages, new).select("page_id", F.regexp_count("html", F.lit("\u00ab\u00ab")).cast("long").alias("n"))


@query()
def html_markdown(spark, sf_dir):
    return H.html_markdown(table(spark, sf_dir, "pages"))


@query("SELECT doc_id, '<h2>' || lang || '</h2>' || chr(10) || '<ul><li>' || source || '</li><li><strong>b</strong></li></ul>' || chr(10) || '<p>x <em>' || lang || '</em> <code>c</code> <a href=\"u/' || doc_id || '\">l</a></p>' AS html FROM documents")
def markdown_html(spark, sf_dir):
    put = F.concat(F.lit("## "), "lang", F.lit("\n\n- "), "source", F.lit("\n- **b**\n\nx *"), "lang", F.lit("* `c` [l](u/"), F.col("doc_id").cast("string"), F.lit(")"))
    return table(spark, sf_dir, "documents").select("doc_id", H.markdown_html(put).alias("html"))


@query("SELECT page_id, regexp_extract(html, '(?is)^(.*?<body[^>]*>)', 1) || '<p>new</p></body></html>' AS html FROM pages WHERE regexp_matches(html, '(?is)<body[^>]*>.*</body></html>$')")
def html_new_body(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").where(F.col("html").rlike(r"(?is)<body[^>]*>.*</body></html>\z"))
    return pages.select("page_id", H.with_body(F.col("html"), F.lit("<p>new</p>")).alias("html"))


@query()
def chunk_texts(spark, sf_dir):
    """Chunks of documents by paragraphs, with an overlap."""
    from folio.operators.chunks import chunk_rows

    return chunk_rows(table(spark, sf_dir, "documents"))
