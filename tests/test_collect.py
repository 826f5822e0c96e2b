"""Collection runs with a client of their own, market and dataset configuration by their real setting names."""

import time
import uuid
from datetime import date

import pytest
import yaml
from pyspark.errors import PythonException

from tidemark.plans import collect, config, experiment
from tidemark.sources import files, search
from tidemark.sources.state import ScrapeState

FEED = "<rss><channel>" + "".join(
    f"<item><link>https://s.com{path}</link><title>{title}</title><pubDate>{day}</pubDate></item>"
    for path, title, day in (
        ("/a", "Sabesp investe em obras", "Fri, 01 Mar 2024 10:00:00 GMT"),
        ("/video/b", "Sabesp em video", "Fri, 01 Mar 2024 10:00:00 GMT"),
        ("/gone", "Sabesp sumiu", "Fri, 01 Mar 2024 10:00:00 GMT"),
        ("/a?utm_source=x", "Sabesp investe em obras", "Fri, 01 Mar 2024 10:00:00 GMT"),
        ("/short", "Sabesp", "Fri, 01 Mar 2024 10:00:00 GMT"),
        ("/c", "Copasa e Sabesp", "Thu, 29 Feb 2024 10:00:00 GMT"),
    )
) + "</channel></rss>"
SITES = {
    "defaults": {"delay_seconds": 0.0, "raw_dir": "raw", "corpus_path": "corpus", "state_path": "state"},
    "sites": {
        "feed": {"enabled": True, "order": 1, "display_name": "Feed", "scraping": {"search_strategy": "rss", "rss_url": "https://s.com/rss", "search_queries": ["sabesp"], "link_exclude_substrings": ["/video/"], "body_selector": "article p, .news-body p"}},
        "posts": {"enabled": True, "order": 2, "scraping": {"fonte": "Posts", "search_strategy": "wordpress_api", "api_url": "https://p.com/posts", "api_max_pages": 2, "search_queries": ["Copasa"]}},
        "off": {"scraping": {}},
    },
}


def client(url):
    if url == "https://s.com/rss":
        return FEED
    if url.startswith("https://p.com/posts"):
        assert "search=Copasa" in url and "after=2024-02-01" in url
        return '[{"link": "https://p.com/1", "date": "2024-02-20T00:00:00", "title": {"rendered": "Copasa cresce"}}]' if "page=1" in url else "[]"
    if url.endswith("/gone"):
        raise OSError
    if url.endswith("/short"):
        return "<article><p>x</p></article>"
    company = "Copasa" if "/1" in url or "/c" in url else "Sabesp"
    box = '<article>' if "p.com" in url else '<div class="news-body">'
    return f"<h1>{company} hoje</h1>{box}<p>{company} anuncia um plano bastante longo de obras.</p>"


def test_sites_of_a_configuration():
    plan = collect.collection(SITES, "/r")
    assert [s.key for s in plan.sites] == ["feed", "posts"] and plan.path("raw_dir") == "/r/raw"
    assert plan.settings["max_articles_per_site"] == 50 and plan.sites[1].name == "Posts" and plan.sites[1].output_file == "posts.csv"
    assert [s.key for s in collect.collection(SITES, site="posts").sites] == ["posts"]
    assert collect.containers("article p, .a-b p, div.c p") == (("article", None), (None, "a-b"), ("div", "c"))
    for broken, message in (
        ({"sites": {"x": {"enabled": True, "scraping": {"seed_urls": []}}}}, "unknown settings"),
        ({"defaults": {"delay": 1}}, "unknown settings"),
        ({"sites": {"x": {"enabled": True, "scraping": {"link_selector": "a.b"}}}}, "link_selector"),
        ({"sites": {"x": {"enabled": True, "scraping": {"body_selector": "div > p"}}}}, "selector"),
    ):
        with pytest.raises(ValueError, match=message):
            collect.collection(broken)
    with pytest.raises(ValueError, match="not enabled"):
        collect.collection(SITES, site="off")


def test_a_run_with_state(spark, tmp_path):
    plan = collect.collection(SITES, str(tmp_path))
    assert collect.window(spark, plan, date(2024, 3, 2)) == ("2020-01-01", "2024-03-02")
    assert collect.run(spark, plan, "2024-02-01", "2024-03-02", use_state=True, get=client) == {"feed": 2, "posts": 1}
    rows = {r.url: r for r in files.read_corpus(spark, str(tmp_path / "raw" / "feed.csv")).collect()}
    assert set(rows) == {"https://s.com/a", "https://s.com/c"}
    assert (rows["https://s.com/a"].data, rows["https://s.com/a"].empresa, rows["https://s.com/a"].fonte) == ("2024-03-01", "Sabesp", "Feed")
    # The same pages again give nothing new, with the state and without it.
    assert collect.run(spark, plan, "2024-02-01", "2024-03-02", use_state=True, get=client) == {"feed": 0, "posts": 0}
    assert collect.run(spark, plan, "2024-02-01", "2024-03-02", get=client) == {"feed": 0, "posts": 0}
    assert ScrapeState(spark, plan.path("state_path")).sites["posts"]["last_until"] == "2024-03-02"
    assert files.read_corpus(spark, collect.build_corpus(spark, plan)).count() == 3
    assert collect.window(spark, plan, date(2024, 3, 9)) == ("2024-03-03", "2024-03-09")


def test_limits_and_own_scrapers(spark, tmp_path):
    few = collect.collection({**SITES, "defaults": {**SITES["defaults"], "max_articles_per_site": 1}}, str(tmp_path), "feed")
    assert collect.run(spark, few, "2024-02-01", "2024-03-02", get=client) == {"feed": 1}
    impatient = collect.collection({**SITES, "defaults": {**SITES["defaults"], "raw_dir": "raw2", "max_fetch_misses": 2}}, str(tmp_path), "feed")
    assert collect.run(spark, impatient, "2024-02-01", "2024-03-02", get=client) == {"feed": 1}

    def own(spark, site, settings, since, until, work, seen, get):
        return collect.scrape(spark, site, settings, since, until, work, seen, get).limit(0)

    assert collect.run(spark, collect.collection(SITES, str(tmp_path), "posts"), "2024-02-01", "2024-03-02", get=client, adapters={"posts": own}) == {"posts": 0}
    with pytest.raises(ValueError):
        collect.run(spark, few, "01/02/2024", "2024-03-02", get=client)


def test_no_request_after_the_end_and_none_too_soon(spark, tmp_path):
    """A client that notes its requests: hosts are asked in turn and in order, and nothing is asked once a site is done."""
    log = tmp_path / "log"
    feed = "<rss><channel>" + "".join(f"<item><link>https://{'ab'[i % 2]}.com/{i}</link><title>Sabesp {i}</title><pubDate>Fri, 01 Mar 2024 10:00:00 GMT</pubDate></item>" for i in range(40)) + "</channel></rss>"

    def noting(good):
        def get(url):
            with log.open("a") as f:
                f.write(f"{time.time()} {url}\n")
            if url.endswith("rss"):
                return feed
            i = int(url.rsplit("/", 1)[1])
            return "<article><p>Sabesp anuncia um plano bastante longo de obras.</p></article>" if i in good else "<p>nada</p>"

        return get

    def collected(good, **limits):
        log.write_text("")
        plan = collect.collection({"defaults": {"delay_seconds": 0.3, **limits, "raw_dir": str(tmp_path / uuid.uuid4().hex)}, "sites": {"s": {"enabled": True, "scraping": {"search_strategy": "rss", "rss_url": "https://a.com/rss", "search_queries": ["sabesp"]}}}}, str(tmp_path))
        n = collect.run(spark, plan, "2024-02-01", "2024-03-02", get=noting(good))["s"]
        asked = [(float(t), url) for t, url in (line.split() for line in log.read_text().splitlines())]
        for host in ("a.com", "b.com"):
            own = sorted((t, url) for t, url in asked if f"//{host}/" in url)
            assert all(b[0] - a[0] >= 0.3 for a, b in zip(own, own[1:], strict=False)), host
            numbers = [int(url.rsplit("/", 1)[1]) for _, url in own if not url.endswith("rss")]
            assert numbers == sorted(numbers)
        return n, sorted(int(url.rsplit("/", 1)[1]) for _, url in asked if not url.endswith("rss"))

    # Three articles: the links up to the third one, and no other.
    assert collected({1, 2, 6, 9}, max_articles_per_site=3, max_fetch_misses=9) == (3, list(range(7)))
    # Four misses in a row after the article at 3.
    assert collected({3, 8}, max_articles_per_site=9, max_fetch_misses=4) == (1, list(range(8)))


def test_result_pages_end_with_the_first_empty_one(spark, tmp_path):
    log = tmp_path / "log"

    def get(url):
        with log.open("a") as f:
            f.write(url + "\n")
        if "/posts" in url:
            return '[{"link": "https://p.com/1", "date": "2024-02-20", "title": {"rendered": "Copasa"}}]' if "search=Copasa" in url and "&page=1&" in url else "[]"
        return "<article><p>Copasa anuncia um plano bastante longo de obras.</p></article>"

    site = {"enabled": True, "scraping": {"search_strategy": "wordpress_api", "api_url": "https://p.com/posts", "api_max_pages": 5, "search_queries": ["Copasa", "nada"]}}
    plan = collect.collection({"defaults": {"delay_seconds": 0.0, "raw_dir": "raw"}, "sites": {"posts": site}}, str(tmp_path))
    assert collect.run(spark, plan, "2024-02-01", "2024-03-02", get=get) == {"posts": 1}
    asked = sorted((u.split("search=")[1].split("&")[0], int(u.split("&page=")[1].split("&")[0])) for u in log.read_text().splitlines() if "/posts" in u)
    assert asked == [("Copasa", 1), ("Copasa", 2), ("nada", 1)]


def test_an_error_of_the_client_is_no_miss(spark):
    def get(url):
        raise TypeError("a mistake in the program")

    with pytest.raises(PythonException, match="a mistake in the program"):
        search.fetch(spark.createDataFrame([("https://a",)], "url string"), get).collect()


MARKET = {"defaults": {"format": "csv", "columns": {"date": "dia", "ticker": "ticker", "close": "fecho"}}, "market": {"local_path": "prices.csv", "reader": {"delimiter": ";"}, "source": {"provider": "yfinance", "tickers": ["A.SA"], "start": "2020-01-01"}}}


def test_market(spark, tmp_path):
    (tmp_path / "prices.csv").write_text("dia;ticker;fecho\n2024-01-01;A;10\n2024-01-02;A;11\n")
    m = config.market(MARKET, str(tmp_path))
    assert (m.enabled, m.tickers, m.start, m.returns) == (True, ("A.SA",), "2020-01-01", ("simple_return", "log_return"))
    assert [round(r.simple_return, 6) for r in files.read_prices(spark, m.path, m.columns, m.reader).where("simple_return is not null").collect()] == [0.1]
    for change, message in (({"source": {"provider": "x", "tickers": ["A"]}}, "provider"), ({"source": {"provider": "local", "tickers": []}}, "tickers"), ({"format": "xls"}, "csv"), ({"returns": {"compute": ["x"]}}, "returns")):
        with pytest.raises(ValueError, match=message):
            config.market({**MARKET, "market": {**MARKET["market"], **change}})


DATASETS = """
schema_version: "2.0"
defaults:
  language: pt
  format: csv
  reader: {encoding: utf-8, delimiter: ",", quotechar: '"', header: 0, low_memory: false, skip_blank_lines: true, on_bad_lines: error}
  validation: {strip_text: true, drop_empty_texts: true, fail_on_duplicate_ids: true, preserve_extra_columns: true}
  labels: {available: false, normalize_case: true, strip_whitespace: true, mapping: {}}
  dates: {available: false, format: null, dayfirst: false, fail_on_invalid: true, output_format: "%Y-%m-%d"}
  limits: {max_rows: 200}
datasets:
  noticias:
    order: 1
    dataset_name: as noticias
    path: n.csv
    columns: {news_id: id, text: noticia, date: data, company: empresa, true_label: sentimento}
    required_fields: [news_id, text]
    limits: {max_rows: max, date_from: "2024-01-02"}
    labels: {available: true, mapping: {positivo: POSITIVE, negativo: NEGATIVE}}
    dates: {available: true, format: "%Y-%m-%d", output_format: "%d/%m/%Y"}
    metadata: {country: Brazil}
"""


def test_datasets_models_and_rules(spark, tmp_path):
    (tmp_path / "n.csv").write_text("id,data,empresa,sentimento,noticia\n1,2024-01-01,A,positivo,x\n2,2024-01-02,A, Negativo ,y\n3,2024-01-03,A,positivo,z\n")
    raw = yaml.safe_load(DATASETS)
    (d, r), = config.datasets(raw, str(tmp_path))
    assert (d.name, d.fail_on_duplicate_ids, d.max_rows, d.start_date, r.separator) == ("as noticias", True, None, "2024-01-02", ",")
    report = experiment.check_datasets(spark, [(d, r)])["noticias"]
    assert (report["rows_read"], report["rows_dropped"], report["rows"], report["positive_labels"], report["first_date"]) == (3, 1, 2, 1, "02/01/2024")
    given = raw["datasets"]["noticias"]
    for section, change, message in (
        ("labels", {"map": {}}, "unknown settings"),
        ("reader", {"separator": ";"}, "unknown settings"),
        ("reader", {"header": 1}, "header"),
        ("dates", {"available": False}, "format needs"),
        ("columns", {"text": None}, "required fields"),
    ):
        with pytest.raises(ValueError, match=message):
            config.datasets(config.merged(raw, {"datasets": {"noticias": {section: change}}}))
    with pytest.raises(ValueError, match="unknown settings"):
        config.datasets({"datasets": {"noticias": {**given, "fail_on_duplicate_ids": True}}})
    off = config.merged(raw, {"datasets": {"noticias": {"labels": {"available": False}, "dates": {"available": False, "format": None}, "limits": {"date_from": None}}}})
    none = experiment.check_datasets(spark, config.datasets(off, str(tmp_path)))["noticias"]
    assert (none["rows"], none["missing_true_label"], none["missing_date"]) == (3, 3, 3)
    twice = tmp_path / "n.csv"
    twice.write_text(twice.read_text() + "3,2024-01-04,A,positivo,w\n")
    assert "duplicate id" in experiment.check_datasets(spark, [(d, r)])["noticias"]["error"]

    models = {"defaults": {"language": "pt"}, "models": {"bert": {"order": 1, "model_name": "Bert"}, "words": {"order": 2, "language": "en", "scorer": "lexicon"}}}
    rules = {"temporal_index": {"dimensions": {"heuristics": {"enabled": True, "event_keywords": {"obra": ["ponte"]}}}}}
    plan = config.experiment_plan(rules, models, raw, str(tmp_path), run="r")
    assert [(m.key, m.language, m.scorer, m.name) for m in plan.models] == [("bert", "pt", "bert", "Bert"), ("words", "en", "lexicon", "words")]
    assert plan.settings.event_keywords == {"obra": ("ponte",)} and "heuristics" in plan.settings.providers
    assert "model bert: no scorer 'bert'" in experiment.preflight(spark, plan)
    rules["temporal_index"]["dimensions"]["heuristics"]["enabled"] = False
    assert "heuristics" not in config.experiment_plan(rules, models, raw, str(tmp_path), run="r").settings.providers
