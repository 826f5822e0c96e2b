"""The news corpus: records, de-duplication, acceptance of articles, collection windows."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# The columns of a corpus record.
COLUMNS = ("id", "data", "empresa", "setor", "ticker", "titulo", "noticia", "fonte", "url")


def as_records(df: DataFrame) -> DataFrame:
    """All columns of a record as text; missing ones are empty. A ``row_id`` is kept."""
    out = [(T.or_empty(F.col(c)) if c in df.columns else F.lit("")).alias(c) for c in COLUMNS]
    return df.select(*out, *(["row_id"] if "row_id" in df.columns else []))


def with_key(records: DataFrame) -> DataFrame:
    has = lambda c: F.col(c) if c in records.columns else F.lit("")
    return records.withColumn("dedupe_key", T.dedupe_key(has("url"), has("id"), has("data"), has("fonte"), has("titulo")))


def dedupe(records: DataFrame, row_order: str = "row_id") -> DataFrame:
    """The first record of each key; records without any key leave.

    ``min_by`` combines before the shuffle, so a key that many records share is no hot task.
    """
    keyed = with_key(records).where("dedupe_key <> ''")
    return keyed.groupBy("dedupe_key").agg(F.min_by(F.struct(*records.columns), row_order).alias("r")).select("r.*")


def is_generic(df: DataFrame) -> Column:
    """Records about the sector as a whole."""
    return (T.strip(T.or_empty(F.col("empresa"))) == "Saneamento") | (F.upper(T.strip(T.or_empty(F.col("ticker")))) == "SETOR")


def merge(frames: list[DataFrame], row_order: str = "row_id") -> DataFrame:
    """Union in the order of the frames, without generic records, the first of each key."""
    marked = [as_records(f).withColumn("source_order", F.lit(i)) for i, f in enumerate(frames)]
    rows = reduce(DataFrame.unionByName, marked)
    ordered = rows.withColumn("row_id", F.struct("source_order", row_order)).drop("source_order")
    return dedupe(ordered.where(~is_generic(ordered))).drop("row_id")


def append(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, int, int]:
    """Existing records first, then new ones: the merged records, their number and how many were added."""
    parts = [as_records(f).withColumn("row_id", F.struct(F.lit(i).alias("part"), (F.col("row_id") if "row_id" in f.columns else F.lit(0).cast("long")).alias("row"))) for i, f in enumerate((existing, new))]
    merged = dedupe(parts[0].unionByName(parts[1]))
    total, added = merged.agg(F.count(F.lit(1)), F.count_if(F.col("row_id.part") == 1)).first()
    return merged.drop("row_id"), total, added


def accept_articles(articles: DataFrame, since: str, until: str, seen: DataFrame | None = None, min_chars: int = 40, site: str = "site", source: str = "site", entities: tuple = T.ENTITIES) -> DataFrame:
    """Articles (position, url, title, body, day) to records: unseen, long enough, about one of ``entities``, within the window."""
    rows = articles.withColumns({"norm_url": T.normalize_url(F.col("url")), "title": T.or_empty(F.col("title")), "body": T.or_empty(F.col("body"))}).where("norm_url <> ''")
    rows = rows.groupBy("norm_url").agg(F.min_by(F.struct(*(c for c in rows.columns if c != "norm_url")), "position").alias("r")).select("norm_url", "r.*")
    if seen is not None:
        known = seen.select(T.normalize_url(F.col("url")).alias("norm_url")).distinct()
        rows = rows.join(known, "norm_url", "left_anti")
    both = T.strip(F.concat_ws(" ", "title", "body"))
    rows = rows.withColumns({"both": both, "entity": T.match_entity(both, entities), "day": F.col("day").cast("date")})
    good = (F.length("both") >= min_chars) & F.col("entity").isNotNull() & F.col("day").between(F.lit(since).cast("date"), F.lit(until).cast("date"))
    return rows.where(good).select(
        "position",
        T.stable_id(site, F.col("norm_url")).alias("id"),
        F.date_format("day", "yyyy-MM-dd").alias("data"),
        F.col("entity.company").alias("empresa"),
        F.col("entity.sector").alias("setor"),
        F.col("entity.ticker").alias("ticker"),
        F.when(F.col("title") != "", F.col("title")).otherwise(F.substring("both", 1, 120)).alias("titulo"),
        F.when(F.col("body") != "", F.col("body")).otherwise(F.col("both")).alias("noticia"),
        F.lit(source).alias("fonte"),
        "url",
    )


def within_budget(hits: DataFrame, accepted: str = "accepted", position: str = "position", site: str = "site", max_articles: int = 50, max_misses: int = 25) -> DataFrame:
    """The hits that a collector looks at: it stops at enough articles, or after a run of misses."""
    order = Window.partitionBy(site).orderBy(position)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ok = F.col(accepted).cast("int")
    rows = hits.withColumns({
        "articles_before": F.coalesce(F.sum(ok).over(before), F.lit(0)),
        "row": F.row_number().over(order),
    })
    last_hit = F.max(F.when(F.col(accepted), F.col("row"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("misses", F.col("row") - F.coalesce(last_hit, F.lit(0)))
    stopped = F.max((F.col("misses") >= max_misses).cast("int")).over(before)
    out = rows.withColumn("stopped", F.coalesce(stopped, F.lit(0)))
    return out.where((F.col("articles_before") < max_articles) & (F.col("stopped") == 0)).drop("articles_before", "row", "misses", "stopped")


def not_seen(hits: DataFrame, seen: DataFrame) -> DataFrame:
    keyed = hits.withColumn("norm_url", T.normalize_url(F.col("url")))
    return keyed.where("norm_url <> ''").join(seen.select(T.normalize_url(F.col("url")).alias("norm_url")).distinct(), "norm_url", "left_anti")


def seen_urls(*frames: DataFrame) -> DataFrame:
    """Normalized URLs of all frames, once each."""
    rows = reduce(DataFrame.union, [f.select(T.normalize_url(F.col("url")).alias("url")) for f in frames])
    return rows.where("url <> ''").distinct()


def cron_window(corpus: DataFrame | None, last_untils: list[str], default_since: str, today: date | None = None) -> tuple[str, str]:
    """(since, until): since is the latest of the default, a day after each site's last run and a day after the corpus' last day."""
    from datetime import timedelta

    until = today or date.today()
    starts = []
    for raw, ahead in [(default_since, 0), *((x, 1) for x in last_untils)]:
        try:
            starts.append(date.fromisoformat((raw or "").strip()[:10]) + timedelta(days=ahead))
        except ValueError:
            continue
    if corpus is not None and (last := corpus.agg(F.max(T.iso_day(F.col("data")))).first()[0]):
        starts.append(last + timedelta(days=1))
    since = max(starts).isoformat() if starts else default_since
    return min(since, until.isoformat()), until.isoformat()
