"""Sentiment by company, sector and market day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import LABELS, finite
from ..functions.text import blank_to_null
from ..session import written
from . import ranges

LEVELS = {"company_day": ("date", "company"), "sector_day": ("date", "sector"), "market_day": ("date",)}
STATISTICS = {"mean": "sentiment_mean", "median": "sentiment_median", "sum": "sentiment_sum", "count": "sentiment_count"}


def aggregate_levels(
    predictions: DataFrame,
    levels: tuple[str, ...] = tuple(LEVELS),
    statistics: tuple[str, ...] = tuple(STATISTICS),
    minimum_news: int = 1,
    sentiment_column: str = "continuous_sentiment",
    class_counts: bool = True,
    mean_confidence: bool = True,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """All levels in one frame; rows without a level's dimensions are left out of that level.

    ``by`` carries the identity of a combination along. The predictions are read once: rows of the same dimensions and
    sentiment become one cell of counts and sums, from which all levels add up. A median is the middle of a group's value
    counts: in one buffer a group, or by running sums over ranges of values once a group has more than ``GROUP_VALUES``.
    """
    if bad := [*(x for x in levels if x not in LEVELS), *(x for x in statistics if x not in STATISTICS)]:
        raise ValueError(f"unknown levels or statistics: {bad}")
    rows = predictions.select(
        *by,
        F.date_format(F.col("date").cast("date"), "yyyy-MM-dd").alias("date"),
        *((blank_to_null(F.col(c)) if c in predictions.columns else F.lit(None).cast("string")).alias(c) for c in ("company", "sector")),
        finite(F.col(sentiment_column)).alias("d"),
        (finite(F.col("confidence")) if "confidence" in predictions.columns else F.lit(None).cast("double")).alias("confidence"),
        (F.col("predicted_label") if "predicted_label" in predictions.columns else F.lit(None).cast("string")).alias("predicted_label"),
    )
    labels = {f"{x.lower()}_count": F.count_if(F.col("predicted_label") == x) for x in reversed(LABELS)}
    cells = rows.groupBy(*by, "date", "company", "sector", "d").agg(
        F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("confidence"), F.count("confidence").alias("confident"), *(e.alias(c) for c, e in labels.items())
    )
    if "median" in statistics:
        cells = written(cells, "level-cells")  # read by the groups' sums and by the medians
    named = lambda level: [F.lit(level).alias("level"), *((F.col(c) if c in LEVELS[level] else F.lit(None).cast("string")).alias(c) for c in ("date", "company", "sector"))]
    held = F.filter(F.array(*(F.struct(*named(level), reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in LEVELS[level]]).alias("whole")) for level in levels)), lambda g: g["whole"])
    keys = [*by, "level", "date", "company", "sector"]
    spread = cells.withColumn("g", F.explode(held)).select(*by, "g.level", "g.date", "g.company", "g.sector", *(c for c in cells.columns if c not in keys))
    in_d = F.when(F.col("d").isNotNull(), F.col("n"))
    sums = spread.groupBy(*keys).agg(
        F.sum("n").alias("news_count"), F.sum(F.col("d") * F.col("n")).alias("total"), F.coalesce(F.sum(in_d), F.lit(0)).alias("held"), F.count("d").alias("values"),
        F.sum("confidence").alias("confidence"), F.sum("confident").alias("confident"), *(F.sum(c).alias(c) for c in labels),
    ).where(F.col("news_count") >= minimum_news)
    made = {"mean": F.try_divide("total", "held"), "median": F.col("median"), "sum": F.coalesce("total", F.lit(0.0)), "count": F.col("held")}
    if "median" in statistics:
        sums = _with_median(sums, spread.where("d is not null"), keys)
    out = sums.select(*keys, "news_count", *(made[x].alias(STATISTICS[x]) for x in statistics), *([F.try_divide("confidence", "confident").alias("mean_confidence")] if mean_confidence else []), *(labels if class_counts else ()))
    if class_counts:
        out = out.withColumns({f"{x.lower()}_percentage": F.col(f"{x.lower()}_count") / F.col("news_count") * 100.0 for x in LABELS})
    # A key names the dimensions of its level and no others.
    key = F.to_json(F.struct(*(F.col(k) for k in sorted(("company", "date", "level", "sector")))), {"ignoreNullFields": "true"})
    return out.withColumns({"group_key": key, "aggregation_level": F.col("level"), "ticker": F.lit(None).cast("string")}).drop("level")


#: Distinct values of a group that one buffer holds at most.
GROUP_VALUES = 1 << 20


def _with_median(sums: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """``sums`` (keys, held, values) with the median of the group's values (keys, d, n)."""
    sums = written(sums, "level-sums")
    most = sums.agg(F.max("values")).first()[0] or 0
    counts = values.groupBy(*keys, "d").agg(F.sum("n").alias("n"))
    if most <= GROUP_VALUES:
        middle = counts.groupBy(*keys).agg(F.percentile("d", F.lit(0.5), F.col("n")).alias("median"))
    else:
        below = ranges.summed_before(written(counts, "level-values"), keys, ["d"], "n", "below")
        sized = below.alias("a").join(sums.select(*keys, "held").alias("b"), ranges.same(keys)).select("a.*", "b.held")
        covers = lambda place: (F.col("below") <= place) & (place < F.col("below") + F.col("n"))
        low, high = F.floor((F.col("held") - 1) / 2), F.floor(F.col("held") / 2)
        middle = sized.where(covers(low) | covers(high)).groupBy(*keys).agg(((F.max(F.when(covers(low), F.col("d"))) + F.max(F.when(covers(high), F.col("d")))) / 2).alias("median"))
    return sums.alias("a").join(middle.alias("b"), ranges.same(keys), "left").select("a.*", "b.median")


def level_summary(predictions: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Per level: rows in, rows without its dimensions, groups out."""
    total = [F.count(F.lit(1)).alias("input_rows")] + [
        F.count_if(reduce(lambda a, b: a | b, [F.col(c).isNull() if c == "date" else blank_to_null(F.col(c)).isNull() for c in dims])).alias(level) for level, dims in LEVELS.items()
    ]
    counts = predictions.agg(*total).select("input_rows", F.explode(F.create_map(*[x for lv in LEVELS for x in (F.lit(lv), F.col(lv))])).alias("aggregation_level", "dropped_rows"))
    groups = aggregates.groupBy("aggregation_level").agg(F.count(F.lit(1)).alias("output_rows"))
    status = F.when(F.col("dropped_rows") == F.col("input_rows"), "unavailable").when(F.col("dropped_rows") > 0, "partial").otherwise("success")
    return counts.join(groups, "aggregation_level", "left").na.fill(0, ["output_rows"]).withColumn("status", status)


def sorted_aggregates(aggregates: DataFrame) -> DataFrame:
    order = F.element_at(F.create_map(*[x for i, lv in enumerate(LEVELS) for x in (F.lit(lv), F.lit(i))]), F.col("aggregation_level"))
    return aggregates.orderBy(order, *(F.col(c).asc_nulls_last() for c in ("date", "company", "sector", "group_key")))
