"""Queries over search payloads, feeds, snapshots and quotes that are made of the driver's tables, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import market
from ..session import shared_dir
from ..sources import formats, search
from . import views as V
from .queries import query


def _renamed(df: DataFrame, folder: str, name: str, form: str, by: str | None = None, order: str | None = None, **options: str) -> str:
    """Writes ``df`` and names its files ``name`` with their number, or after the value of ``by`` (a file each)."""
    spark = df.sparkSession
    dealt = df.repartition(by) if by else df
    parts = (dealt.sortWithinPartitions(by, order) if by and order else dealt).write
    parts = parts.partitionBy(by) if by else parts
    parts.mode("overwrite").options(**options).format(form).save(f"{folder}/_parts")
    jvm = spark.sparkContext._jvm
    store = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(r[0] for r in spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter="part-*").load(f"{folder}/_parts").select("path").collect())
    for number, path in enumerate(found):
        old = jvm.org.apache.hadoop.fs.Path(path)
        new = old.getParent().getName().split("=", 1)[1] if by else f"{name}-{number:05d}-of-{len(found):05d}"
        target = jvm.org.apache.hadoop.fs.Path(f"{folder}/{new}{'.' + {'json': 'jsonl'}.get(form, form)}")
        store.delete(target, False)
        if not store.rename(old, target):
            raise OSError(f"{path} can't be renamed")
    return folder


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/queries/{uuid.uuid4().hex}"


# ---- formats ----


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey > 100")
def snapshot_split(spark, sf_dir):
    """Orders as the parquet split of a dataset snapshot; rows and columns are chosen where they are read."""
    formats.register(spark)
    root = _folder(spark)
    _renamed(V.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), f"{root}/datasets--o--rders/snapshots/v1/default", "train", "parquet")
    return spark.read.format("snapshot").options(path=root, dataset="o/rders", revision="v1", columns="o_orderkey,o_orderstatus", where='[["o_orderpriority", "=", "1-URGENT"], ["o_orderkey", ">", 100]]').load()


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, CAST(user_id AS VARCHAR) AS user_id FROM events")
def snapshot_lines(spark, sf_dir):
    """Events as a CSV split of a snapshot's configuration; every column is text."""
    formats.register(spark)
    root = _folder(spark)
    _renamed(V.table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), f"{root}/snapshots/main/log", "test", "csv", header="true")
    return spark.read.format("snapshot").options(path=root, config="log", split="test").load()


_CLOSES = f"""{V.with_("order_prices")}, r AS (SELECT date, replace(ticker, ' ', '-') AS ticker, round(close, 6) AS close FROM prices WHERE date >= DATE '1993-01-01')"""


@query(f"""{_CLOSES} SELECT date, ticker, round(close, 4) AS close, round(close / lag(close) OVER w - 1, 7) AS simple_return, round(ln(close / lag(close) OVER w), 7) AS log_return
    FROM r WINDOW w AS (PARTITION BY ticker ORDER BY date)""")
def quote_download(spark, sf_dir):
    """Closes from a table of CSV for each ticker at an address, as one table of prices with returns."""
    formats.register(spark)
    p = V.order_prices(spark, sf_dir).select(F.date_format("date", "yyyy-MM-dd").alias("Date"), F.round("close", 6).alias("Close"), F.replace("ticker", F.lit(" "), F.lit("-")).alias("of"))
    root = _renamed(p, _folder(spark), "", "csv", by="of", header="true")
    got = spark.read.format("quotes").options(url=f"{root}/{{ticker}}.csv", tickers="1-URGENT,2-HIGH,3-MEDIUM,4-NOT-SPECIFIED,5-LOW", start="1993-01-01").load()
    out = market.returns(market.sanitize_prices(got.withColumn("row_id", F.monotonically_increasing_id())))
    return out.select("date", "ticker", F.round("close", 4).alias("close"), F.round("simple_return", 7).alias("simple_return"), F.round("log_return", 7).alias("log_return"))


#: Feeds of a kind of event: a feed is read by one task.
FEEDS = 64


@query("""SELECT 'https://e.org/' || event_id AS url, 'Event ' || event_type || ' & ' || user_id AS title, CAST(ts AS DATE) AS day, date_part('hour', ts) AS hour FROM events""")
def feed_stream(spark, sf_dir):
    """Feeds by kind of event and share of the users, read as a stream: first half of their items are there, then all of them; each comes once."""
    formats.register(spark)
    e = V.table(spark, sf_dir, "events")
    published = F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    items = e.select(
        F.concat_ws("-", "event_type", (F.col("user_id") % FEEDS).cast("string")).alias("feed"), "ts", F.concat(F.lit("https://e.org/"), F.col("event_id").cast("string")).alias("link"),
        F.concat(F.lit("Event "), "event_type", F.lit(" & "), F.col("user_id").cast("string")).alias("title"), published.alias("pubDate"),
    )
    root = _folder(spark)
    for until in ("2024-01-15", "2100-01-01"):
        _renamed(items.where(F.col("ts") < F.lit(until).cast("timestamp")).drop("ts"), f"{root}/feeds", "", "xml", by="feed", rowTag="item", rootTag="channel")
        stream = spark.readStream.format("feed").option("seen", f"{root}/seen").load(f"{root}/feeds/").writeStream.format("parquet").option("checkpointLocation", f"{root}/state")
        stream.trigger(availableNow=True).start(f"{root}/items").awaitTermination()
    got = spark.read.parquet(f"{root}/items")
    return got.select("url", "title", F.to_date("published").alias("day"), F.hour("published").cast("long").alias("hour"))


# ---- search payloads ----

_HOST = "regexp_extract(url, '^https?://[^/?#]+')"


@query(r"""
    WITH posts AS (SELECT page_id % 3 AS q, page_id // 90 AS p, page_id, 'https://w.org/' || page_id % 70 AS url, 'Post <b>' || page_id || '</b>' AS title FROM pages WHERE page_id % 3 <> 1 OR page_id < 90),
    -- A query ends at its first page without posts, and a link stays where it comes first; some are excluded.
    first AS (SELECT url, arg_min(title, [q, p, page_id]) AS title, arg_min(page_id, [q, p, page_id]) AS page_id FROM posts WHERE NOT contains(url, '/6') GROUP BY url)
    SELECT url, trim(regexp_replace(regexp_replace(title, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS title, '2024-01-' || printf('%02d', 1 + page_id % 28) AS published FROM first""")
def wordpress_search(spark, sf_dir):
    """Hits of result pages made of the table: JSON lists of posts by query and page, some of them empty."""
    p = V.table(spark, sf_dir, "pages").where("page_id % 3 <> 1 OR page_id < 90").select(
        (F.col("page_id") % 3).alias("query"), F.floor(F.col("page_id") / 90).alias("page"), "page_id",
        F.struct(
            F.concat(F.lit("https://w.org/"), (F.col("page_id") % 70).cast("string")).alias("link"),
            F.format_string("2024-01-%02dT00:00:00", F.col("page_id") % 28 + 1).alias("date"),
            F.struct(F.format_string("Post <b>%d</b>", "page_id").alias("rendered")).alias("title"),
        ).alias("post"),
    )
    full = p.groupBy("query", "page").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "post"))), lambda x: x["post"])).alias("payload"))
    after = full.groupBy("query").agg((F.max("page") + 1).alias("page")).select("query", "page", F.lit("[]").alias("payload"))
    beyond = after.select("query", (F.col("page") + 1).alias("page"), F.lit('[{"link": "https://w.org/beyond", "date": "", "title": {"rendered": "x"}}]').alias("payload"))
    return search.wordpress_hits(full.unionByName(after).unionByName(beyond), exclude=("/6",)).select("url", "title", "published")


@query("""
    WITH items AS (SELECT event_type AS feed, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS place, CAST(ts AS DATE) AS day, user_id FROM events),
    ended AS (SELECT *, max(CASE WHEN day < DATE '2024-01-10' THEN 1 ELSE 0 END) OVER (PARTITION BY feed ORDER BY place) AS over FROM items WHERE user_id % 10 = 7)
    SELECT feed, 'https://r.org/' || event_id AS url, 'News of 7' AS title, strftime(day, '%Y-%m-%d') AS published FROM ended WHERE over = 0 AND day <= DATE '2024-01-20'""")
def rss_search(spark, sf_dir):
    """Items of feeds made of the events, a page an hour, newest first: those that name the query, until the first one before the window."""
    e = V.table(spark, sf_dir, "events")
    item = F.concat(
        F.lit("<item><link>https://r.org/"), F.col("event_id").cast("string"), F.lit("</link><title>News of "), (F.col("user_id") % 10).cast("string"),
        F.lit("</title><pubDate>"), F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item>"),
    )
    newest = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("age"), "event_id", item.alias("item"))))
    page = -F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    feeds = e.groupBy(F.col("event_type").alias("feed"), page.alias("page")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.transform(newest, lambda x: x["item"]), ""), F.lit("</channel></rss>")).alias("payload"))
    return search.rss_hits(feeds, ("of 7",), "2024-01-10", "2024-01-20").select("feed", "url", "title", "published")


_LINKS = f"""WITH links AS (
        SELECT page_id, CASE WHEN h LIKE 'http%' THEN h WHEN h LIKE '/%' THEN {_HOST} || h END AS url, place
        FROM (SELECT page_id, url, unnest(hrefs) AS h, generate_subscripts(hrefs, 1) AS place FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages)))"""


@query(f"{_LINKS} SELECT DISTINCT url FROM links WHERE NOT contains(url, '/en') AND regexp_matches(url, '^https?://[^/]+/[A-Za-z]')")
def html_search(spark, sf_dir):
    """Links of all pages as result pages: absolute, of the wanted form, without excluded ones, each once."""
    p = V.table(spark, sf_dir, "pages").select(F.col("page_id").alias("query"), "url", F.col("html").alias("payload"))
    return search.html_hits(p, ("/en",), r"^https?://[^/]+/[A-Za-z]").select("url")
