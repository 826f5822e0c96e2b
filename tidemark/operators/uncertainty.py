"""Disagreement between models on the same news."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_models(impacts: dict[str, DataFrame]) -> DataFrame:
    """The direction scores of all models, each row with its model_key."""
    frames = [df.select("news_id", "date", "company", "sector", "d", F.lit(key).alias("model_key")) for key, df in impacts.items()]
    return reduce(DataFrame.unionByName, frames)


def disagreement(scores: DataFrame) -> DataFrame:
    """Variance, count, standard deviation and mean of the direction per news item."""
    out = scores.groupBy("news_id", "date", "company", "sector").agg(
        F.var_samp("d").alias("disagreement_var"), F.count("d").alias("model_count"), F.stddev_samp("d").alias("disagreement_std"), F.avg("d").alias("direction_mean")
    )
    return out.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("UNKNOWN")) for k in ("company", "sector")})


def uncertainty_daily(news: DataFrame) -> DataFrame:
    return news.groupBy("date", "company", "sector").agg(
        F.avg("disagreement_var").alias("disagreement_mean"),
        F.max("disagreement_var").alias("disagreement_max"),
        F.count_distinct("news_id").alias("news_count"),
        F.max("model_count").alias("model_count"),
    )


def merge_uncertainty(impacts: dict[str, DataFrame], min_models: int = 2) -> tuple[DataFrame, DataFrame] | None:
    """Per news and per day; None if there are fewer than ``min_models`` models."""
    if len(impacts) < min_models:
        return None
    news = disagreement(union_models(impacts))
    return news, uncertainty_daily(news)
