"""The index by sector and market, and by week, month and quarter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MEASURES = ("impacto_dia", "risco_dia", "iti_liquido", "iti_risco")


def level_daily(index: DataFrame, level: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Means over the companies that have a row that day; ``level`` is sector or market."""
    if level not in ("sector", "market"):
        raise ValueError(f"unknown level {level!r}")
    keys = [*by, "date", *(["sector"] if level == "sector" else [])]
    out = index.groupBy(*keys).agg(*(F.avg(m).alias(m) for m in _MEASURES), F.sum("news_count").alias("news_count"), F.count_distinct("company").alias("company_count"))
    return out.withColumn("aggregation_level", F.lit(level))


def period_label(day: Column, frequency: str) -> Column:
    """The last day of the week (Sunday), month or quarter: periods are named by their end."""
    if frequency == "weekly":
        return F.next_day(F.date_sub(day, 1), "SUN")
    if frequency == "monthly":
        return F.last_day(day)
    if frequency == "quarterly":
        return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))
    raise ValueError(f"unknown frequency {frequency!r}")


def statistics() -> list[Column]:
    """What a period says of the days in it; nulls take no part."""
    return [
        F.max("date").alias("period_end"),
        F.avg("impacto_dia").alias("impacto_dia_mean"),
        F.sum("impacto_dia").alias("impacto_dia_sum"),
        F.avg("iti_liquido").alias("iti_liquido_mean"),
        F.min("iti_liquido").alias("iti_liquido_min"),
        F.max("iti_liquido").alias("iti_liquido_max"),
        F.stddev_samp("iti_liquido").alias("iti_liquido_std"),
        F.avg("iti_risco").alias("iti_risco_mean"),
        F.sum("news_count").alias("news_count"),
    ]


def resample(index: DataFrame, frequency: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Statistics by series and period; periods without rows are left out."""
    rows = index.withColumn("period_start", period_label(F.col("date"), frequency))
    return rows.groupBy(*by, "company", "sector", "period_start").agg(*statistics()).withColumn("frequency", F.lit(frequency))
