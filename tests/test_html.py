import gc

import duckdb
import pyarrow as pa

from pagequarry.functions import html as H
from pagequarry.functions.html import extract_and_merge, parse, parse_many, parse_page
from pagequarry.plans import catalogue
from tests.compare import assert_same

ARTICLE = """<!DOCTYPE html><html lang="EN-gb"><head><title> Head </title><meta name="Description" content=" about "><meta property="og:title" content="Graph">
<meta property="og:image" content="i.png"><meta name="twitter:card" content="sum"><link rel="canonical" href=" /c "><link rel="shortcut icon" href="/f.ico">
<script type="application/ld+json">[{"a": 1}, {"b": 2}]</script><script type="application/ld+json">{bad</script></head>
<body><nav><a href="/menu">menu</a><ul><li>n1<li>n2</ul></nav><main><h1>Title</h1><p>One<p>Two &amp; three<a href="/x#f">x</a><a href="https://o.com/y">y</a><a href="/x#f">again</a>
<a href="mailto:m@x">m</a><a href="#top">t</a></p><script>var z = "<p>";</script><ul><li>a<li>b<li></ul><ol><li>solo</li></ol>
<table><thead><tr><th>k</th><th>v</th></tr></thead><tbody><tr><td>1<td>2<tr><td>only</tbody></table></main><footer>foot</footer></body></html>"""


def test_article():
    p = parse_page(ARTICLE, "https://e.com/d/")
    assert p["title"] == "Head" and p["language"] == "en"
    assert p["text"].startswith("Title One Two & three x y") and "foot" not in p["text"] and "var" not in p["text"]
    assert p["links"] == ["https://e.com/x#f", "https://o.com/y"]  # menu links went with the menu
    assert p["meta"] == {"description": "about", "og:title": "Graph", "og:image": "i.png", "twitter:card": "sum"}
    s = p["structured"]
    assert s["open_graph"] == {"title": "Graph", "image": "i.png"} and s["twitter_card"] == {"card": "sum"}
    assert s["json_ld"] == ['{"a": 1}', '{"b": 2}']
    assert s["tables"] == [[{"k": "1", "v": "2"}, {"col_0": "only"}]]
    assert s["lists"] == [["a", "b"]] and s["canonical"] == "/c" and s["favicon"] == "/f.ico"


def test_title_fallbacks():
    assert parse_page('<meta property="og:title" content=" g "><h1>h</h1>', "")["title"] == "g"
    assert parse_page("<h1> h <b>i</b></h1>", "")["title"] == "hi"
    assert parse_page("<p>x</p>", "")["title"] is None


def test_title_counts_as_text_without_a_container():
    assert parse_page("<title>T</title><body><p>b</p></body>", "")["text"] == "T b"


def test_empty_container_gives_no_text():
    assert parse_page("<main></main><p>text</p>", "")["text"] == ""


def test_container_order():
    assert parse_page('<div class="x content">c</div><div id="content">i</div><article>a</article>', "")["text"] == "a"
    assert parse_page('<div class="x content">c</div><div role="main">r</div>', "")["text"] == "r"


def test_table_without_body_repeats_its_header():
    s = parse_page("<table><tr><th>h</th></tr><tr><td>1</td></tr></table>", "")["structured"]
    assert s["tables"] == [[{"h": "h"}, {"h": "1"}]]


def test_short_and_missing_html():
    for html, least in ((None, 0), ("", 0), ("<p>abc</p>", 10)):
        p = parse_page(html, "u", least)
        assert p["text"] == "" and p["links"] == [] and p["title"] is None and p["structured"] is None


def test_broken_markup():
    p = parse_page("<div><p>a<div>b</p>c</span></div>d<br>e &nbsp; f", "")
    assert p["text"] == "a b c d e f"


def test_references_without_semicolon_stay_text():
    p = parse_page('<title>a &amp; b&amp</title><script type="application/ld+json">{"a": "&amp;&lt"}</script><p title="x">&notit; &lt &copy;&#65;</p><a href="/?a=1&copy=2&amp;d=3">x</a>', "http://e/")
    assert p["title"] == "a & b&amp" and p["links"] == ["http://e/?a=1&copy=2&d=3"]
    assert p["text"] == "a & b&amp &notit; &lt ©A x"
    assert p["structured"]["json_ld"] == ['{"a": "&amp;&lt"}']


def test_titles_cut_inside_a_reference_equal_the_sql(spark, tmp_path):
    rows = [(i, f"http://a/{i}", f"<html><head><title>{t}</title></head><body><p>x</p></body></html>") for i, t in enumerate(("Ly.&amp;&amp;&amp; and&amp", "a&amp;&lt;&amp", "&", "&lt;&gt;"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert_same(catalogue.queries()["extract_title"](spark, str(tmp_path)), con, catalogue.oracle_sql()["extract_title"])


def test_parse_many_drops_errors_and_blanks(spark):
    rows = [(1, "http://a/", "<p>x</p>", None), (2, "http://b/", "<p>y</p>", "timeout"), (3, "http://c/", "<p> </p>", None), (4, "http://d/", None, None)]
    df = spark.createDataFrame(rows, "ord long, url string, html string, error string")
    got = parse_many(df).collect()
    assert [(r.ord, r.text) for r in got] == [(1, "x")]
    assert parse_many(df.limit(0)).count() == 0


def test_parse_keeps_other_columns_and_nested_types(spark):
    df = spark.createDataFrame([(7, "https://e.com/d/", ARTICLE, "z")], "page_id int, url string, html string, extra string")
    r = parse(df).first()
    assert (r.page_id, r.extra, r.meta["description"]) == (7, "z", "about")
    assert r.structured.tables[0][0] == {"k": "1", "v": "2"}


def test_extract_and_merge_falls_back_to_text(spark):
    df = spark.createDataFrame([("", "<ul><li>a<li>b</ul>"), (None, "")], "html string, text string")
    a, b = [r.structured for r in extract_and_merge(df).collect()]
    assert a.lists == [["a", "b"]] and b.lists == [] and b.open_graph == {}


def test_pages_are_parsed_in_pieces():
    rows = [f"<p>{i} {'x' * 2000}</p>" for i in range(3000)] + [None, "<p>" + "y" * 3_000_000 + "</p>", ""]
    batch = pa.RecordBatch.from_arrays([pa.array(rows), pa.array(["http://a/"] * len(rows)), pa.array(range(len(rows)))], ["html", "url", "ord"])
    got = list(H.parsed_batches(iter([batch]), ["ord", "url"], 0))
    assert len(got) > 6 and max(b.num_rows for b in got) < 600
    assert [o for b in got for o in b.column("ord").to_pylist()] == list(range(len(rows)))
    assert [t for b in got for t in b.column("text").to_pylist()] == [parse_page(h, "http://a/")["text"] for h in rows]


def test_a_parsed_page_leaves_nothing_to_the_cycle_collector():
    gc.collect()
    gc.disable()
    try:
        parse_page(ARTICLE, "https://e.com/d/")
        assert gc.collect() < 10
    finally:
        gc.enable()
