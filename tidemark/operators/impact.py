"""Impact of news items, per company and day, and the simple daily baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dimensions
from ..functions.dimensions import DIMENSIONS
from ..functions.scores import finite

IMPACT_COLUMNS = ("news_id", "date", "company", "sector", "ticker", "d", "m", "r", "c", "e", "h", "q", "u", "I_n", "R_n", "w_n")


def _known(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN"))


def news_impact(predictions: DataFrame, defaults: dict[str, float] | None = None, keep: tuple[str, ...] = (), **resolve) -> DataFrame:
    """Impact, risk and weight of each item; an unreadable date is an error. ``keep`` names further columns to carry."""
    for column in ("news_id", "date", "continuous_sentiment", "confidence"):
        if column not in predictions.columns:
            raise ValueError(f"column {column!r} is required")
    day = F.col("date").try_cast("date")
    sized = dimensions.resolve(predictions, defaults, **resolve)
    out = sized.withColumns({
        "date": F.coalesce(day, F.raise_error(F.concat(F.lit("invalid date: "), F.coalesce(F.col("date").cast("string"), F.lit("null")))).cast("date")),
        "d": finite(F.col("continuous_sentiment")),
        "c": finite(F.col("confidence")),
        **{short: F.col(f"dim_{key}") for key, short in DIMENSIONS.items()},
        **{k: F.lit(None).cast("string") for k in ("company", "sector", "ticker") if k not in predictions.columns},
    })
    d, m, r, c, e, q, u = (F.col(k) for k in "dmrcequ")
    out = out.withColumns({"I_n": d * m * r * c * e * u, "R_n": F.greatest(F.lit(0.0), -d) * m * r * c * q, "w_n": c * r * u})
    return out.select(*keep, *IMPACT_COLUMNS)


def daily_impact(impact: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Weighted mean impact and risk by company, sector and day; the plain mean where weights add up to nothing."""
    keys = [*by, "company", "sector", "date"]
    rows = impact.withColumns({"company": _known("company"), "sector": _known("sector")})
    zero = F.lit(0.0)
    sums = rows.groupBy(*keys).agg(
        F.coalesce(F.sum(F.col("I_n") * F.col("w_n")), zero).alias("iw"),
        F.coalesce(F.sum(F.col("R_n") * F.col("w_n")), zero).alias("rw"),
        F.coalesce(F.sum("w_n"), zero).alias("sum_w"),
        F.avg("I_n").alias("mean_i"),
        F.avg("R_n").alias("mean_r"),
        F.count("news_id").alias("news_count"),
        F.avg("c").alias("mean_confidence"),
        F.avg("r").alias("mean_relevance"),
        F.avg("h").alias("mean_horizon"),
    )
    weighed = lambda total, mean: F.when(F.col("sum_w") > 0, F.try_divide(F.col(total), F.col("sum_w"))).otherwise(F.col(mean))
    return sums.select(*keys, weighed("iw", "mean_i").alias("impacto_dia"), weighed("rw", "mean_r").alias("risco_dia"), "news_count", "mean_confidence", "mean_relevance", "mean_horizon")


def baselines_daily(predictions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """News count, mean sentiment and confidence-weighted sentiment by company, sector and day."""
    d, c = finite(F.col("continuous_sentiment")), finite(F.col("confidence"))
    rows = predictions.select(*by, F.col("date").cast("date").alias("date"), _known("company").alias("company"), _known("sector").alias("sector"), "news_id", d.alias("d"), c.alias("c"))
    sums = rows.groupBy(*by, "date", "company", "sector").agg(
        F.count("news_id").alias("b0_news_count"), F.avg("d").alias("b1_mean_sentiment"), F.sum(F.col("d") * F.col("c")).alias("dc"), F.sum("c").alias("cs")
    )
    weighed = F.when(F.col("cs") > 0, F.try_divide("dc", "cs")).otherwise(F.col("b1_mean_sentiment"))
    return sums.select(*by, "date", "company", "sector", "b0_news_count", "b1_mean_sentiment", weighed.alias("b2_confidence_weighted_sentiment"))
