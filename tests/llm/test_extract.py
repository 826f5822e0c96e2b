"""Main text: whole pages against SQL, hand-made pages, and pages made of parts that are known to be article or not."""

import time

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import extract
from tidemark.llm.extract import main_text

A = "Lorem ipsum dolor, sit amet, consectetur adipiscing elit. " * 4
A_ = A.strip()


def test_tables_equal_sql(spark, duck, sf):
    got = extract.op11_html_extraction(spark, sf).collect()
    want = duck.execute(extract.ORACLE_SQL["op11_html_extraction"]).fetchall()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_odd_pages(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "plain  text &amp; more", "x"), (3, "u", "<p>twice</p>", "x"), (3, "u", "<p>twice</p>", "x"), (4, "u", "<nav><a href=x>Home</a></nav>", "x"), (5, "u", "<p>é 日本&nbsp;x</p>" * 2, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r["page_id"] or 0, r["text"]) for r in extract.extract(df).collect())
    assert got == [(0, "plain text & more"), (1, ""), (2, ""), (3, "twice"), (3, "twice"), (4, ""), (5, "é 日本 x\n\né 日本 x")]
    assert extract.extract(df.limit(0)).count() == 0


def test_marked_article():
    page = f"""<html><head><title>t</title></head><body><header><h1>Site</h1></header><div class="has-sidebar"><article><header><h1>Title</h1></header>
        <p>{A}</p><div class="share">Share this, now</div><ul><li>one<li>two</ul><form><label>Mail</label><input></form><p>See <a href=x>this</a>
        text.<section id="comments"><article class="comment"><p>{A * 9}</p></article></section><footer>By me</footer></article></div>
        <div><p>{A}</p></div></body></html>"""
    assert main_text(page) == "\n\n".join(["Title", A_, "one", "two", "See this text."])


def test_unmarked_article_and_its_siblings():
    page = f"""<body><div id=top><a href=/>Home</a> <a href=/b>News</a></div><div class="content"><h1>T</h1><p>{A}<p>{A}<p>short one.</div>
        <div class="part"><p>{A}</p></div><div class="sidebar"><p>{A}</p></div><div id="comments"><p>{A * 3}</p></div><div>Copyright 2020</div></body>"""
    assert main_text(page) == "\n\n".join(["T", A_, A_, "short one.", A_])
    flat = f"<body><div><a href=1>m</a> | <a href=2>n</a></div><h1>Title</h1><p>{A}</p><p>x.</p><h3>Sub</h3><p>{A}</p><h3>Related</h3><ul><li><a href=1>aa</a><li><a href=2>bb</a></ul><div>Copyright</div></body>"
    assert main_text(flat) == "\n\n".join(["Title", A_, "x.", "Sub", A_])
    wrapped = f"<form><div><p>{A}</p><p>{A}</p><input value=x><button>Go</button></div></form>"
    assert main_text(wrapped) == f"{A_}\n\n{A_}"
    assert main_text(f"<main><h1>Ti</h1><section><h2>A</h2><p>{A}</section><section><h2>B</h2><p>small</section></main><aside>{A}</aside>") == "\n\n".join(["Ti", "A", A_, "B", "small"])


def test_markup_that_is_broken():
    assert main_text("<p>a < b and c<d </p>") == "a < b and c"  # an open tag runs to the next >
    assert main_text("<p>x<!-- open <p>y") == "x"
    assert main_text("<script>var t='</p>';</script><p>x<script>y") == "x"
    assert main_text('<p title="a>b">x</p></div></p>') == "x"
    assert main_text("<p>1 &lt;2&gt; &copy; &#233; &#x65E5; &amp &am</p>") == "1 <2> © é 日 & &am"
    assert main_text("<p>a<span class=ad>b<span>c</span>d</span>e</p>") in ("a\n\ne", "ae", "a e")
    assert main_text("<p><b>One.<br><p>Two</p><p>Three") == "One.\n\nTwo\n\nThree"


def test_time_grows_with_the_page():
    for page in ("<div>" * 30_000 + "x, y" + "</div>" * 30_000, "<p>a<p>b <a " * 20_000, "<!--" * 50_000, "<a href='" * 50_000, "</b>" * 50_000 + "<ul><li>x" * 20_000, "<p>" + "word, " * 300_000):
        began = time.perf_counter()
        main_text(page)
        assert time.perf_counter() - began < 4


def test_a_form_is_no_article_however_short_the_article_is():
    form = "<form><p>Your mail</p><input></form>"
    assert main_text(f"<body><article><p>alpha</p>{form}</article></body>") == "alpha"
    assert main_text(f"<body>{form}<article><p>alpha</p></article></body>") == "alpha"
    assert main_text("<article><p>alpha</p><form><p>Please give us your mail.</p></form></article>") == "alpha"
    body = "<p>One sentence, and more of it.</p><p>Two of them, as well.</p>"
    whole = "One sentence, and more of it.\n\nTwo of them, as well."
    assert main_text(f"<body><form>{body}</form></body>") == whole
    assert main_text(f"<body><form><article>{body}</article></form></body>") == whole
    assert main_text(f"<body><article><form>{body}</form></article></body>") == whole


WORD = st.sampled_from(["alpha", "beta,", "gamma", "delta.", "&amp;", "<i>eps</i>", "日本"])
PARAGRAPH = st.lists(WORD, min_size=1, max_size=40).map(" ".join)
NOISE = st.sampled_from(["<nav><ul><li><a href=a>Go</a></li></ul></nav>", '<div class="ad">Buy this, now, please.</div>', "<script>var x='<p>no</p>';</script>", '<aside><p>Other, things, here.</p></aside>', "<style>p{}</style>", "<!-- <p>gone</p> -->", '<div class="cookie-notice">We set cookies, many.</div>', "<form><p>Your mail</p><input></form>"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(PARAGRAPH, NOISE), min_size=1, max_size=8), NOISE, NOISE)
def test_all_of_the_article_and_nothing_else(parts, before, after):
    page = f"<body>{before}<article>" + "".join(f"<p>{p}</p>{noise}" for p, noise in parts) + f"</article>{after}</body>"
    plain = lambda p: p.replace("<i>", "").replace("</i>", "").replace("&amp;", "&")
    assert main_text(page) == "\n\n".join(plain(p) for p, _ in parts)
