"""Daily prices: cleaning and returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import finite
from ..functions.text import blank_to_null


def sanitize_prices(raw: DataFrame, row_order: str = "row_id") -> DataFrame:
    """Readable date, ticker and close; of rows for the same day and ticker the last in ``row_order`` stays."""
    rows = raw.select(F.col("date").try_cast("date").alias("date"), blank_to_null(F.col("ticker")).alias("ticker"), finite(F.col("close")).alias("close"), F.col(row_order).alias("row_order"))
    valid = rows.where("date is not null and ticker is not null and close is not null")
    # max_by is a partial aggregate: no window over a hot ticker.
    return valid.groupBy("date", "ticker").agg(F.max_by("close", "row_order").alias("close"))


def rename_prices(raw: DataFrame, names: dict[str, str]) -> DataFrame:
    """``names`` maps date, ticker and close to the source's columns."""
    if missing := [v for v in names.values() if v not in raw.columns]:
        raise ValueError(f"price columns are missing: {missing}")
    return raw.withColumnsRenamed({v: k for k, v in names.items()})


def close_column(columns: list[tuple[str, ...] | str]) -> str | tuple[str, ...]:
    """Of flat or multi-level names the first that has a level ``close``, whatever its case."""
    for c in columns:
        if any(str(x).strip().lower() == "close" for x in (c if isinstance(c, tuple) else (c,))):
            return c
    raise ValueError("no close column")


def returns(prices: DataFrame) -> DataFrame:
    """Simple and log return against the ticker's row before; null on its first row."""
    before = F.lag("close").over(Window.partitionBy("ticker").orderBy("date"))
    ratio = F.try_divide(F.col("close"), before)
    return prices.withColumn("__ratio", ratio).select(*prices.columns, (F.col("__ratio") - 1).alias("simple_return"), F.when(F.col("__ratio") > 0, F.ln("__ratio")).alias("log_return"))
