"""HTML nodes, attributes, rendering and Markdown on small pages."""

from pyspark.sql import functions as F

from folio.sources import html as H

PAGE = '<html><head><title>T &amp; x</title></head><body translate="yes"><h1> One <b>two</b> three</h1>\n<p title="tip">a<!-- c -->b</p><div translate="no">no <i>no</i></div><svg><text>no</text></svg><img alt="pic" src="x"><input type="submit" value="Go"><input type="text" value="no"><nav><ul><li>x<li>y</ul></nav><pre>no</pre>end'


def test_nodes_in_order():
    rows = list(H.nodes_of(PAGE))
    assert [(r[1], r[4], r[5]) for r in rows] == [
        ("T &amp; x", None, "title"), ("One", None, "h1"), ("two", None, "b"), ("three", None, "h1"), ("tip", "title", "p"), ("a", None, "p"), ("b", None, "p"),
        ("pic", "alt", "img"), ("Go", "value", "input"), ("x", None, "li"), ("y", None, "li"), ("end", None, "body"),
    ]
    assert rows[1][0] == "/html[1]/body[1]/h1[1]/text()" and (rows[1][2], rows[1][3]) == (" ", " ") and rows[9][6] == "nav" and rows[2][7:] == ("One", "three")


def test_texts_are_put_back_in_place():
    assert H.put_back(PAGE, {i: r[1] for i, r in enumerate(H.nodes_of(PAGE), 1) if r[4] is None}) == PAGE
    made = H.put_back(PAGE, {2: "Uno", 5: 'a "b"', 8: "Bild", 12: "fin"})
    assert made == PAGE.replace(" One ", " Uno ").replace('title="tip"', 'title="a &quot;b&quot;"').replace('alt="pic"', 'alt="Bild"').replace("end", "fin")


def test_pages_as_frames(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "plain")], "page_id long, html string")
    nodes = H.html_nodes(pages)
    assert {r.page_id: r["count"] for r in nodes.groupBy("page_id").count().collect()} == {1: 12, 4: 1}
    assert {r.text: r.priority for r in nodes.where("page_id = 1").collect()} | {"T &amp; x": 21, "One": 11, "pic": 10} == {r.text: r.priority for r in nodes.where("page_id = 1").collect()}
    back = {r.page_id: r.html for r in H.html_render(pages, nodes.where("text = 'two'").select("page_id", "node_id", F.lit("dos").alias("text"))).collect()}
    assert back == {1: PAGE.replace("two", "dos"), 2: None, 3: "", 4: "plain"}
    assert H.html_nodes(pages.limit(0)).count() == 0


def test_markdown_both_ways(spark):
    assert H.markdown_of(PAGE) == "# One **two** three\n\nab\n\nno *no*no![pic](x)\n\n- x\n- y\n\n```\nno\n```\n\nend"
    df = spark.createDataFrame([("## A **b**\n\ntext `c` ![i](s)\n\n* one\n* two",)], "t string")
    assert df.select(H.markdown_html(F.col("t"))).first()[0] == '<h2>A <strong>b</strong></h2>\n<p>text <code>c</code> <img src="s" alt="i"/></p>\n<ul><li>one</li><li>two</li></ul>'
    assert df.select(H.with_body(F.lit("<html><body class='x'>old</body></html>"), F.lit("new"))).first()[0] == "<html><body class='x'>new</body></html>"


def test_attribute_values(spark):
    df = spark.createDataFrame([("Press here",), ("main-menu",), ("https://x.org/a b",), ("x" * 30,)], "v string")
    assert [r[0] for r in df.select(H.translatable_attribute(F.col("v"))).collect()] == [True, False, False, True]
