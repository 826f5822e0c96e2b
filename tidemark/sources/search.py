"""Article links from fetched payloads: WordPress results, RSS feeds and HTML result pages.

Fetching is an I/O stage of its own (``fetch``); the parsers work on tables of payloads, so they are tested offline.
"""

from __future__ import annotations

import http.client
import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written

HIT = "url string, title string, published string"
STRATEGIES = ("wordpress_api", "rss", "playwright", "html")


#: A stage hands pages on once it holds this many characters of them.
HELD_CHARS = 1 << 22

#: What a site's failure looks like; other errors of a client are errors of its program.
MISSES = (OSError, http.client.HTTPException)


def _http_get(url: str, timeout: float) -> str:
    try:
        request = urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0 (compatible; news collector)"})
    except ValueError as e:  # not an address
        raise OSError(str(e)) from e
    with urllib.request.urlopen(request, timeout=timeout) as reply:  # noqa: S310
        return reply.read().decode(reply.headers.get_content_charset() or "utf-8", "replace")


def fetch(urls: DataFrame, get: Callable[[str], str] | None = None, timeout: float = 30.0, delay: float = 0.0, order: tuple[str, ...] = (), asked: DataFrame | None = None) -> DataFrame:
    """(url, ...) with ``payload``, null if the request failed, and ``asked_at``, when it ended (seconds). ``get`` replaces the HTTP client.

    A host's links are asked for one after the other, in ``order``, with ``delay`` seconds between the end of a request and
    the next one; hosts are dealt out to tasks. ``asked`` has what was asked for before, whose hosts are waited for as well.
    Pages leave in batches of bounded size, so a stage does not hold a host's pages.
    """
    names = urls.columns
    host = F.coalesce(F.lower(F.try_parse_url("url", F.lit("HOST"))), F.lit(""))
    rows = urls.withColumn("__host", host)
    if asked is not None:
        last = asked.select(host.alias("__host"), "asked_at").groupBy("__host").agg(F.max("asked_at").alias("__last"))
        rows = rows.join(last, "__host", "left")
    else:
        rows = rows.withColumn("__last", F.lit(None).cast("double"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last, held, size = None, 0.0, [], 0
        for frame in frames:
            for row in frame.to_dict("records"):
                if row["__host"] != at:
                    at, last = row["__host"], row["__last"] if row["__last"] == row["__last"] and row["__last"] is not None else 0.0
                time.sleep(max(0.0, last + delay - time.time()) if last else 0.0)
                try:
                    row["payload"] = get(row["url"]) if get else _http_get(row["url"], timeout)
                except MISSES:
                    row["payload"] = None
                row["asked_at"] = last = time.time()
                held.append({k: v for k, v in row.items() if k[:2] != "__"})
                size += len(row["payload"] or "")
                if size >= HELD_CHARS:
                    yield pd.DataFrame(held)
                    held, size = [], 0
        if held:
            yield pd.DataFrame(held)

    hosts = max(1, min(rows.select("__host").distinct().count(), 10_000))
    dealt = rows.repartition(hosts, "__host").sortWithinPartitions("__host", *order)
    fields = ", ".join(f"`{c}` {urls.schema[c].dataType.simpleString()}" for c in names)
    return dealt.mapInPandas(run, f"{fields}, payload string, asked_at double")


def _wanted(url: Column, exclude: tuple[str, ...], pattern: str | None) -> Column:
    ok = (url != "") & ~T.contains_any(url, exclude)
    return ok & url.rlike(pattern) if pattern else ok


def _first_seen(hits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Each URL where it comes first; ``position`` orders the hits."""
    return hits.groupBy(*by, "url").agg(F.min_by(F.struct("title", "published", "position"), "position").alias("h")).select(*by, "url", "h.*")


def wordpress_hits(payloads: DataFrame, exclude: tuple[str, ...] = (), pattern: str | None = None) -> DataFrame:
    """Payloads (query, page, payload) of the posts endpoint. A query ends at its first page without posts."""
    posts = F.from_json("payload", "array<struct<link:string,date:string,title:struct<rendered:string>>>")
    rows = payloads.withColumn("posts", posts)
    empty = F.max((F.coalesce(F.size("posts"), F.lit(0)) <= 0).cast("int")).over(Window.partitionBy("query").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    live = rows.withColumn("over", empty).where("over = 0")
    each = live.select("query", "page", F.posexplode("posts").alias("place", "p"))
    hits = each.select(F.struct("query", "page", "place").alias("position"), T.or_empty(F.trim("p.link")).alias("url"), T.strip_html(F.col("p.title.rendered")).alias("title"), F.substring(T.or_empty(F.col("p.date")), 1, 10).alias("published"))
    return _first_seen(hits.where(_wanted(F.col("url"), exclude, pattern)))


def rss_hits(payloads: DataFrame, queries: tuple[str, ...] = (), since: str | None = None, until: str | None = None, exclude: tuple[str, ...] = (), pattern: str | None = None) -> DataFrame:
    """Payloads (feed, payload), or (feed, page, payload) of feeds in pages. Items are in feed order; one older than ``since`` ends the feed, one after ``until`` is passed over."""
    item = "struct<link:string,title:string,description:string,encoded:string,pubDate:string>"
    flat = F.regexp_replace("payload", r"<(/?)content:encoded", "<$1encoded")
    channel = F.from_xml(flat, f"struct<channel:struct<item:array<{item}>>>")
    paged = "page" in payloads.columns
    rows = payloads.select("feed", *(["page"] if paged else []), F.posexplode(F.coalesce(channel["channel"]["item"], F.array().cast(f"array<{item}>"))).alias("position", "i"))
    rows = rows.withColumn("position", F.struct("page", "position")) if paged else rows
    rows = rows.select("feed", "position", T.or_empty(F.trim("i.link")).alias("url"), *(T.strip_html(F.col(f"i.{c}")).alias(c) for c in ("title", "description", "encoded")), T.feed_day(F.col("i.pubDate")).alias("published"))
    terms = [q.strip().lower() for q in queries if q.strip()]
    text = F.lower(F.concat_ws(" ", "title", "description", "encoded"))
    rows = rows.where(_wanted(F.col("url"), exclude, pattern))
    if terms:
        rows = rows.where(T.contains_any(text, terms))
    day = F.try_to_date("published")
    if since:
        # A feed's end is its first old item, so no task needs all items of a feed in order.
        rows = written(rows, "feed-items")
        ends = rows.where(day < F.lit(since).cast("date")).groupBy("feed").agg(F.min("position").alias("end"))
        rows = rows.alias("a").join(ends.alias("b"), F.col("a.feed").eqNullSafe(F.col("b.feed")), "left").where("b.end is null or a.position < b.end").select("a.*")
    if until:
        rows = rows.where(F.coalesce(day <= F.lit(until).cast("date"), F.lit(True)))
    return _first_seen(rows, ("feed",))


def html_hits(payloads: DataFrame, exclude: tuple[str, ...] = (), pattern: str | None = None, containers=((None, None),)) -> DataFrame:
    """Payloads (query, url, payload) of result pages: their absolute links, each once."""
    from .pages import parse_pages

    pages = parse_pages(payloads.withColumnRenamed("payload", "html"), containers=containers, keep=("query",))
    links = pages.select("query", F.posexplode("links").alias("place", "url"))
    hits = links.select(F.struct("query", "place").alias("position"), "url", F.lit("").alias("title"), F.lit("").alias("published"))
    return _first_seen(hits.where(_wanted(F.col("url"), exclude, pattern)))


def discover(strategy: str, payloads: DataFrame, **options) -> DataFrame:
    """Hits by strategy. A browser strategy's rendered pages are parsed like any HTML; the browser itself is outside."""
    parsers = {"wordpress_api": wordpress_hits, "rss": rss_hits, "playwright": html_hits, "html": html_hits}
    return parsers.get(strategy, html_hits)(payloads, **options)
