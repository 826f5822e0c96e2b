"""Keys, entities, pages, feeds and the corpus."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import corpus
from tidemark.sources import pages, search


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize("url,want", [
    ("HTTPS://Example.COM/a/b/?q=1#x", "https://example.com/a/b"),
    ("http://Example.com", "http://example.com/"),
    ("https://e.com/a;p=1?x", "https://e.com/a"),
    ("example.com/a", "https:example.com/a"),
    ("  ", ""),
    (None, ""),
    ("//Host/x/", "https://host/x"),
])
def test_normalize_url(spark, url, want):
    assert one(spark, T.normalize_url, url) == want


def test_strip_is_unicode(spark):
    assert one(spark, T.strip, " \t a b  \n") == "a b"
    assert one(spark, T.blank_to_null, " ") is None
    assert one(spark, T.normalize_title, "  A \n b ") == "a b"


@pytest.mark.parametrize("text,company", [("A SABESP anuncia", "Sabesp"), ("companhia de saneamento do PARANÁ", "Companhia de Saneamento do Paraná"), ("csmg3 sobe", "Companhia de Saneamento Básico do Estado de Minas Gerais"), ("Sabespar", None), (None, None)])
def test_match_entity(spark, text, company):
    got = one(spark, lambda c: T.match_entity(c)["company"], text)
    assert got == company


@pytest.mark.parametrize("raw,want", [("2024-03-01", date(2024, 3, 1)), ("01/03/2024", date(2024, 3, 1)), ("2024-03-01T10:20:30-03:00", date(2024, 3, 1)), ("em 2024-03-05 às", date(2024, 3, 5)), ("x", None), (None, None)])
def test_parse_day(spark, raw, want):
    assert one(spark, T.parse_day, raw) == want


def test_feed_day_and_html(spark):
    assert one(spark, T.feed_day, "Fri, 01 Mar 2024 10:00:00 GMT") == "2024-03-01"
    assert one(spark, T.feed_day, "on 2024-03-02") == "2024-03-02"
    assert one(spark, T.feed_day, None) == ""
    assert one(spark, T.strip_html, "<p>A &amp; B</p>\n&nbsp;c") == "A & B c"


def test_date_patterns(spark):
    assert one(spark, lambda c: F.date_format(T.parse_date(c, "%d/%m/%Y %H:%M"), "yyyy-MM-dd HH:mm"), "1/2/2024 03:04") == "2024-02-01 03:04"
    assert one(spark, lambda c: T.parse_date(c, None, True).cast("date"), "03/02/2024") == date(2024, 2, 3)
    assert one(spark, lambda c: T.parse_date(c).cast("date"), "2024-02-03") == date(2024, 2, 3)
    with pytest.raises(ValueError):
        T.date_pattern("%Q")


def test_compose(spark):
    df = spark.createDataFrame([(" t ", None), (None, " ")], "title string, body string")
    got = [r[0] for r in df.select(T.compose("Title: {t} Body: {b}", {"t": "title", "b": "body"})).collect()]
    assert got == ["Title: t Body: ", None]
    with pytest.raises(ValueError):
        T.compose("{x}", {})


def test_dedupe_keeps_the_first(spark):
    rows = [(0, "1", "", "", "", "https://a.com/x/?q"), (1, "2", "", "", "", "http://A.com/y"), (2, "3", "", "", "", "https://a.com/x"), (3, "9", "", "", "", ""), (4, "9", "", "", "", None), (5, "", "2024-01-01", "F", " T  x", ""), (6, "", "2024-01-01", "f ", "t X", ""), (7, "", "", "", "", "")]
    df = spark.createDataFrame(rows, "row_id long, id string, data string, fonte string, titulo string, url string")
    assert sorted(r.row_id for r in corpus.dedupe(df).collect()) == [0, 1, 3, 5]


def test_merge_leaves_generic_records(spark):
    schema = "row_id long, id string, empresa string, ticker string, url string"
    a = spark.createDataFrame([(0, "1", "Saneamento", "SBSP3", "https://a/1"), (1, "2", "Sabesp", "setor", "https://a/2"), (2, "3", "Sabesp", "SBSP3", "https://a/3")], schema)
    b = spark.createDataFrame([(0, "4", "Copasa", "CSMG3", "https://a/3")], schema)
    assert [(r.id, r.noticia) for r in corpus.merge([a, b]).collect()] == [("3", "")]
    _, total, added = corpus.append(a, spark.createDataFrame([(0, "5", "x", "y", "https://a/1"), (1, "6", "x", "y", "https://a/9")], schema))
    assert (total, added) == (4, 1)


ARTICLE = """<html><head><title>Fallback</title><meta property="og:title" content="OG"><meta property="article:published_time" content="2024-03-01T09:00:00"></head>
<body><p>outside</p><article><h1>Sabesp <b>investe</b></h1><p>Primeiro &amp; forte.</p><p>Segundo<script>bad()</script> fim</p><a href="/x">l</a><a href="/x">m</a></article></body></html>"""


def test_article_page():
    got = pages.parse(ARTICLE, base_url="https://s.com/a/")
    assert got == {"title": "Sabesp investe", "body": "Primeiro & forte.\nSegundo fim", "published": "2024-03-01T09:00:00", "links": ["https://s.com/x"]}
    assert pages.parse("<title> only </title>")["title"] == "only" and pages.parse(None)["body"] == ""
    assert pages.parse('<meta property="og:title" content="OG"><title>t</title>')["title"] == "OG"
    assert pages.parse('<div class="a content-text__container"><p>x<p>y</div><p>z', containers=((None, "content-text__container"),))["body"] == "x\ny"


def test_accept_articles(spark):
    rows = [(0, "https://s.com/a", "Sabesp investe", "corpo longo " * 5, "2024-03-01"), (1, "https://s.com/a/", "again Sabesp", "corpo longo " * 5, "2024-03-01"), (2, "https://s.com/b", "Sabesp", "curto", "2024-03-01"), (3, "https://s.com/c", "Ninguém", "corpo longo " * 5, "2024-03-01"), (4, "https://s.com/d", "Copasa", "corpo longo " * 5, "2023-03-01"), (5, "https://s.com/e", "Copasa", "corpo longo " * 5, "2024-03-02")]
    df = spark.createDataFrame(rows, "position long, url string, title string, body string, day string")
    seen = spark.createDataFrame([("https://S.com/e?x",)], "url string")
    got = corpus.accept_articles(df, "2024-01-01", "2024-12-31", seen).collect()
    assert [r.url for r in got] == ["https://s.com/a"] and got[0].id.startswith("site_") and len(got[0].id) == 17 and got[0].ticker == "SBSP3"


def test_collection_budget(spark):
    rows = [("s", i, i % 2 == 0) for i in range(10)] + [("t", i, i == 0) for i in range(10)]
    df = spark.createDataFrame(rows, "site string, position long, accepted boolean")
    got = corpus.within_budget(df, max_articles=3, max_misses=4)
    assert {r.site: r.n for r in got.groupBy("site").agg(F.count(F.lit(1)).alias("n")).collect()} == {"s": 5, "t": 5}


def test_cron_window(spark):
    df = spark.createDataFrame([("2024-05-10",), ("bad",)], "data string")
    assert corpus.cron_window(df, ["2024-05-01"], "2024-01-01", date(2024, 6, 1)) == ("2024-05-11", "2024-06-01")
    assert corpus.cron_window(None, [], "2030-01-01", date(2024, 6, 1)) == ("2024-06-01", "2024-06-01")


FEED = """<?xml version="1.0"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>
<item><link>https://s.com/1</link><title>Sabesp sobe</title><description>d</description><content:encoded>c</content:encoded><pubDate>Fri, 01 Mar 2024 10:00:00 GMT</pubDate></item>
<item><link>https://s.com/2</link><title>Outra</title><pubDate>Thu, 29 Feb 2024 10:00:00 GMT</pubDate></item>
<item><link>https://s.com/3</link><title>Sabesp antiga</title><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item>
<item><link>https://s.com/4</link><title>Sabesp nova</title><pubDate>Fri, 01 Mar 2024 10:00:00 GMT</pubDate></item>
</channel></rss>"""


def test_rss_in_pages(spark):
    item = "<item><link>{}</link><title>Sabesp</title><pubDate>{}</pubDate></item>"
    page = lambda *rows: "<rss><channel>" + "".join(item.format(*r) for r in rows) + "</channel></rss>"
    new, old = "Fri, 01 Mar 2024 10:00:00 GMT", "Mon, 01 Jan 2024 10:00:00 GMT"
    rows = [("f", 1, page(("d", new), ("e", old), ("x", new))), ("f", 0, page(("a", new), ("b", new))), ("f", 2, page(("y", new), ("z", old))), ("g", 5, page(("a", new))), ("g", 7, page())]
    got = search.rss_hits(spark.createDataFrame(rows, "feed string, page int, payload string"), since="2024-02-01")
    assert sorted((r.feed, r.url) for r in got.collect()) == [("f", "a"), ("f", "b"), ("f", "d"), ("g", "a")]


def test_rss(spark):
    df = spark.createDataFrame([("f", FEED)], "feed string, payload string")
    got = search.rss_hits(df, ("Sabesp",), since="2024-02-01").collect()
    assert [(r.url, r.published) for r in got] == [("https://s.com/1", "2024-03-01")]  # an old item ends the feed
    assert sorted(r.url for r in search.rss_hits(df, ("sabesp",), exclude=("/4",)).collect()) == ["https://s.com/1", "https://s.com/3"]


def test_wordpress(spark):
    payload = '[{"link": "https://s.com/p", "date": "2024-03-01T01:02:03", "title": {"rendered": "A &amp; B"}}]'
    df = spark.createDataFrame([("q", 1, payload), ("q", 2, "[]"), ("q", 3, payload.replace("/p", "/late"))], "query string, page long, payload string")
    got = search.discover("wordpress_api", df).collect()
    assert [(r.url, r.title, r.published) for r in got] == [("https://s.com/p", "A & B", "2024-03-01")]


def test_html_links(spark):
    df = spark.createDataFrame([("q", "https://s.com/", '<a href="/n/1">x</a><a href="/video/2">y</a><a href="/n/1">z</a>')], "query string, url string, payload string")
    assert [r.url for r in search.discover("html", df, exclude=("/video/",)).collect()] == ["https://s.com/n/1"]


def test_fetch_records_failures(spark):
    df = spark.createDataFrame([("https://ok",), ("https://bad",)], "url string")

    def get(url):
        if "bad" in url:
            raise OSError
        return "page"

    assert {r.url: r.payload for r in search.fetch(df, get).collect()} == {"https://ok": "page", "https://bad": None}
