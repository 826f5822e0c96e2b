"""Collection runs: the sites of a configuration, their links, articles and records, and the corpus they add up to.

Requests go through ``search.fetch``; a client of one's own (``get``) takes the place of HTTP. What was fetched is
written down before it is used, so that no page is asked for twice within a run.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date
from functools import reduce
from urllib.parse import quote_plus

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, ranges
from ..sources import files, pages, search, sinks
from ..sources.state import ScrapeState
from .config import known_only, ordered

VERSION = "1.1"
# The settings of a site and of the run, and their defaults.
SITE_KEYS = ("enabled", "order", "display_name", "adapter", "output_file", "scraping")
SCRAPING_KEYS = (
    "fonte", "search_strategy", "search_queries", "base_url", "search_url", "link_selector", "body_selector", "article_url_pattern", "link_exclude_substrings",
    "rss_url", "rss_since", "rss_until", "api_url", "api_per_page", "api_max_pages", "api_after", "api_before", "playwright_wait_ms",
)
DEFAULTS = {
    "max_articles_per_site": 50,
    "max_fetch_misses": 25,
    "default_since": "2020-01-01",
    "delay_seconds": 2.0,
    "request_timeout": 30.0,
    "min_article_chars": 40,
    "raw_dir": "data/saneamento_corpus/raw",
    "corpus_path": "data/saneamento_corpus/noticias.csv",
    "state_path": "data/saneamento_corpus/.scrape_state.json",
}
QUERIES = ("Sabesp", "Copasa", "Sanepar", "saneamento")
BODY = "article p, .content-text__container p, .mc-article-body p"
ANY_LINK = ("a", "a[href]")

_SELECTOR = re.compile(r"([a-z][a-z0-9]*)?(?:\.([\w-]+))?")


@dataclass(frozen=True)
class Site:
    key: str
    name: str
    output_file: str
    strategy: str = "html"
    queries: tuple[str, ...] = QUERIES
    containers: tuple[tuple[str | None, str | None], ...] = (("article", None),)
    options: dict = field(default_factory=dict)

    @property
    def links(self) -> dict:
        """What a link must fulfil."""
        return {"exclude": tuple(self.options.get("link_exclude_substrings") or ()), "pattern": self.options.get("article_url_pattern")}


@dataclass(frozen=True)
class Collection:
    sites: tuple[Site, ...]
    settings: dict
    root: str = "."

    def path(self, name: str) -> str:
        p = self.settings[name]
        return p if "://" in p or os.path.isabs(p) else os.path.join(self.root, p)


def containers(selector: str) -> tuple[tuple[str | None, str | None], ...]:
    """``tag p`` and ``.class p`` (or ``tag.class p``), separated by commas, as (tag, class)."""
    out = []
    for part in selector.split(","):
        head, _, last = part.strip().rpartition(" ")
        found = _SELECTOR.fullmatch(head.strip())
        if last != "p" or not found or not head:
            raise ValueError(f"selector {part.strip()!r}: paragraphs of a tag or a class are expected")
        out.append((found[1], found[2]))
    return tuple(out)


def collection(config: dict, root: str = ".", site: str | None = None) -> Collection:
    """Enabled sites in order, or the one asked for; unknown settings are errors."""
    settings = {**DEFAULTS, **known_only(config.get("defaults") or {}, DEFAULTS, "defaults")}
    out = []
    for key, raw in ordered({k: {"enabled": False, **v} for k, v in (config.get("sites") or {}).items()}):
        known_only(raw, SITE_KEYS, f"site {key}")
        options = known_only(raw.get("scraping") or {}, SCRAPING_KEYS, f"site {key}, scraping")
        strategy = str(options.get("search_strategy", "html")).strip().lower()
        if strategy in ("html", "playwright") and options.get("link_selector", ANY_LINK[0]) not in ANY_LINK:
            raise ValueError(f"site {key}: links are chosen by article_url_pattern and link_exclude_substrings, not by link_selector")
        name = raw.get("display_name", key)
        out.append(Site(key, str(options.get("fonte") or name), raw.get("output_file", f"{key}.csv"), strategy, tuple(map(str, options.get("search_queries", QUERIES))), containers(options.get("body_selector", BODY)), options))
    if site and site not in [s.key for s in out]:
        raise ValueError(f"site {site!r} is unknown or not enabled")
    return Collection(tuple(s for s in out if site in (None, s.key)), settings, root)


def requests(site: Site, since: str, until: str) -> list[tuple[int, int, str]]:
    """(query, page, url) of a site's searches; a site without the address that its strategy needs has none."""
    o = site.options
    if site.strategy == "rss":
        return [(0, 0, o["rss_url"])] if o.get("rss_url") else []
    if site.strategy == "wordpress_api":
        window = f"&after={quote_plus(o.get('api_after') or f'{since}T00:00:00')}&before={quote_plus(o.get('api_before') or f'{until}T23:59:59')}"
        of = lambda q, page: f"{o['api_url']}?search={quote_plus(q)}&per_page={o.get('api_per_page', 20)}&page={page}{window}"
        return [(i, page, of(q, page)) for i, q in enumerate(site.queries) for page in range(1, int(o.get("api_max_pages", 3)) + 1)] if o.get("api_url") else []
    return [(i, 0, o["search_url"].replace("{query}", quote_plus(q))) for i, q in enumerate(site.queries)] if o.get("search_url") else []


def find(spark: SparkSession, site: Site, since: str, until: str, work: str, get=None, timeout: float = 30.0, delay: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """position, url, title, published of a site's links, in the order of queries, pages and places; and what was asked for.

    Pages of results are asked for one after the other, and those of a query end with its first page without posts.
    """
    asked, replies = requests(site, since, until), []
    live = {q for q, _, _ in asked}
    for page in sorted({page for _, page, _ in asked}):
        rows = spark.createDataFrame([r for r in asked if r[1] == page and r[0] in live], "query int, page int, url string")
        got = search.fetch(rows, get, timeout, delay, ("query",), replies[-1] if replies else None)
        replies.append(spark.read.parquet(sinks.write_table(got, f"{work}/results-{page}", ())))
        if site.strategy == "wordpress_api":
            live &= {r["query"] for r in replies[-1].where("coalesce(try_variant_get(try_parse_json(payload), '$[0]') is not null, false)").select("query").collect()}
        if not live:
            break
    got = reduce(DataFrame.unionByName, replies) if replies else spark.createDataFrame([], "query int, page int, url string, payload string, asked_at double")
    if site.strategy == "rss":
        hits = search.rss_hits(got.select(F.col("url").alias("feed"), "payload"), site.queries, site.options.get("rss_since") or since, site.options.get("rss_until") or until, **site.links)
    else:
        hits = search.discover(site.strategy, got, **site.links)
    return hits.select("position", "url", "title", "published"), got.select("url", "asked_at")


def scrape(spark: SparkSession, site: Site, settings: dict, since: str, until: str, work: str, seen: DataFrame | None = None, get=None) -> DataFrame:
    """Records of a site with their ``position``. ``work`` is a folder for what is fetched.

    A link that was seen, can't be fetched or is no article of the window is a miss; enough articles, or too many misses in
    a row, end the run. Links are taken in rounds of as many as must be looked at whatever they hold (a run can't end before
    the articles or the misses that are left have been met), so none is asked for after the end.
    """
    most, patience = int(settings["max_articles_per_site"]), int(settings["max_fetch_misses"])
    client = {"get": get, "timeout": float(settings["request_timeout"]), "delay": float(settings["delay_seconds"])}
    hits, asked = find(spark, site, since, until, work, **client)
    links = ranges.numbered(hits, [], ["position"], "place").withColumn("norm_url", T.normalize_url(F.col("url")))
    first = links.where("norm_url <> ''").groupBy("norm_url").agg(F.min("place").alias("place"))
    fresh = corpus.not_seen(first.withColumn("url", F.col("norm_url")), seen) if seen is not None else first
    links = links.join(fresh.select("place", F.lit(True).alias("fresh")), "place", "left").select("place", "url", F.col("title").alias("link_title"), F.col("published").alias("link_day"), F.coalesce("fresh", F.lit(False)).alias("fresh"))
    links = spark.read.parquet(sinks.write_table(links, f"{work}/links", ()))
    total, place, articles, misses, found = links.count(), 0, 0, 0, []
    while place < total and articles < most and misses < patience:
        step = min(most - articles, patience - misses)
        part = links.where(F.col("place").between(place, place + step - 1))
        got = spark.read.parquet(sinks.write_table(search.fetch(part.where("fresh"), order=("place",), asked=asked, **client), f"{work}/pages-{place}", ()))
        found.append(spark.read.parquet(sinks.write_table(_records(got.where("payload is not null"), site, settings, since, until, seen), f"{work}/articles-{place}", ())))
        met = {r["position"] for r in found[-1].select("position").collect()}  # of at most ``step`` links
        for at in range(place, min(place + step, total)):
            articles, misses = (articles + 1, 0) if at in met else (articles, misses + 1)
        asked, place = asked.unionByName(got.select("url", "asked_at")), place + step
    return reduce(DataFrame.unionByName, found) if found else _records(links.limit(0).withColumn("payload", F.lit("")), site, settings, since, until, seen)


def _records(fetched: DataFrame, site: Site, settings: dict, since: str, until: str, seen: DataFrame | None) -> DataFrame:
    """Pages (place, url, link_title, link_day, payload) to records, in which ``position`` is the place."""
    parsed = pages.parse_pages(fetched.withColumnRenamed("place", "position"), "payload", site.containers, keep=("position", "url", "link_title", "link_day"))
    articles = parsed.withColumns({
        "title": F.coalesce(F.nullif("title", F.lit("")), "link_title"),
        "day": F.coalesce(T.iso_day(F.col("link_day")), T.article_day(F.col("published"), F.col("url"), F.lit(until))),
    })
    return corpus.accept_articles(articles, since, until, seen, int(settings["min_article_chars"]), site.key, site.name)


Scraper = Callable[..., DataFrame]


def run(spark: SparkSession, plan: Collection, since: str, until: str, use_state: bool = False, get=None, adapters: dict[str, Scraper] | None = None) -> dict[str, int]:
    """New records of each site, which are added to its file; with a state, URLs seen in earlier runs are left alone.

    ``adapters`` has scrapers (with the parameters of ``scrape``) for sites that need one of their own.
    """
    date.fromisoformat(since), date.fromisoformat(until)
    state = ScrapeState(spark, plan.path("state_path")) if use_state else None
    added = {}
    for site in plan.sites:
        work = f"{plan.path('raw_dir')}/_fetched/{site.key}/{uuid.uuid4().hex}"
        scraper = (adapters or {}).get(site.key, scrape)
        found = scraper(spark, site, plan.settings, since, until, work, state.seen() if state else None, get)
        path = f"{plan.path('raw_dir')}/{site.output_file}"
        known = corpus.with_key(files.read_corpus(spark, path)).select("dedupe_key")
        new = corpus.with_key(corpus.dedupe(corpus.as_records(found.withColumn("row_id", F.col("position"))))).join(known, "dedupe_key", "left_anti")
        ready = spark.read.parquet(sinks.write_table(new, f"{work}/records", ()))
        added[site.key] = ready.count()
        sinks.write_corpus(ready, path, "append")
        if state:
            state.update(site.key, until, found.select("url"))
    return added


def window(spark: SparkSession, plan: Collection, today: date | None = None) -> tuple[str, str]:
    """The days that the state and the corpus leave to collect."""
    return ScrapeState(spark, plan.path("state_path")).window(str(plan.settings["default_since"]), files.read_corpus(spark, plan.path("corpus_path")), today)


def build_corpus(spark: SparkSession, plan: Collection) -> str:
    """All sites' records as one corpus, without generic ones, the first of each key in the order of the sites."""
    raw = [files.read_corpus(spark, f"{plan.path('raw_dir')}/{s.output_file}") for s in plan.sites]
    return sinks.write_corpus(corpus.merge(raw), plan.path("corpus_path"))
