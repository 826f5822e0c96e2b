"""Incremental collection: unseen URLs, upserts into the corpus, daily windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import text as T
from .corpus_table import CorpusTable


def unseen(articles: DataFrame, time_column: str = "fetched_at", delay: str = "30 days") -> DataFrame:
    """The first article of each normalized URL within the watermark; state older than that is dropped."""
    keyed = articles.withColumn("norm_url", T.normalize_url(F.col("url"))).where("norm_url <> ''")
    return keyed.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(["norm_url"])


def upsert_corpus(records: DataFrame, path: str, checkpoint: str, compact_every: int = 50) -> DataStreamWriter:
    """Each micro-batch is added to the corpus table at ``path``: existing records win, new ones follow in batch order.

    A batch reads the keys of its own buckets and writes its new records; every ``compact_every`` batches the table is
    written anew as one base.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        table = CorpusTable(batch.sparkSession, path)
        table.add(batch, batch_id)
        if (batch_id + 1) % compact_every == 0:
            table.compact()

    return records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def daily_impact(impact: DataFrame, time_column: str = "ts", delay: str = "2 days") -> DataFrame:
    """Weighted daily impact over tumbling days; days close once the watermark has passed them."""
    rows = impact.withWatermark(time_column, delay).withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("UNKNOWN")) for k in ("company", "sector")})
    sums = rows.groupBy(F.window(time_column, "1 day").alias("w"), "company", "sector").agg(
        F.sum(F.col("I_n") * F.col("w_n")).alias("iw"), F.sum(F.col("R_n") * F.col("w_n")).alias("rw"), F.sum("w_n").alias("sw"), F.avg("I_n").alias("mi"), F.avg("R_n").alias("mr"), F.count("news_id").alias("news_count"), F.avg("h").alias("mean_horizon")
    )
    weighed = lambda a, b: F.when(F.col("sw") > 0, F.try_divide(a, "sw")).otherwise(F.col(b))
    return sums.select(F.to_date("w.start").alias("date"), "company", "sector", weighed("iw", "mi").alias("impacto_dia"), weighed("rw", "mr").alias("risco_dia"), "news_count", "mean_horizon")
