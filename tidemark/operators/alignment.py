"""The index beside baselines and prices, with forward returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import finite, literal_map

HORIZONS = (1, 5, 21)
_KEYS = ("date", "company", "sector")


def join_baselines(index: DataFrame, baselines: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Full outer join; null keys meet each other. Clashing columns of the baselines get the suffix ``_baseline``."""
    keys = (*by, *_KEYS)
    a, b = index.alias("a"), baselines.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    out = a.join(b, on, "full_outer")
    return out.select(
        *(F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys),
        *(F.col(f"a.{c}") for c in index.columns if c not in keys),
        *(F.col(f"b.{c}").alias(f"{c}_baseline" if c in index.columns else c) for c in baselines.columns if c not in keys),
    )


def add_b3(panel: DataFrame) -> DataFrame:
    """The day's impact without memory, as a baseline."""
    if "impacto_dia" not in panel.columns:
        raise ValueError("column 'impacto_dia' is required")
    value = F.coalesce(finite(F.col("impacto_dia")), F.lit(0.0))
    return panel.withColumn("b3_daily_impact_no_memory", value)


def map_tickers(panel: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Companies to tickers; companies without one leave. The mapping is configuration, so it is a literal."""
    ticker = F.try_element_at(literal_map(mapping), F.col("company")) if mapping else F.lit(None).cast("string")
    return panel.withColumn("ticker", ticker).where(F.col("ticker").isNotNull())


def dropped_companies(panel: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return panel.where(F.col("company").isNotNull() & ~F.col("company").isin(*mapping)).select("company").distinct().orderBy("company")


def forward_return(column: str, horizon: int, mode: str, window) -> Column:
    """Return over the next ``horizon`` rows; null where there are fewer.

    Log returns that are missing count as 0, simple ones make the result missing.
    """
    r = finite(F.col(column))
    if mode == "point":
        return F.lead(r, horizon).over(window)
    ahead = window.rowsBetween(1, horizon)
    if column == "log_return":
        return F.when(F.count(F.lit(1)).over(ahead) == horizon, F.sum(F.coalesce(r, F.lit(0.0))).over(ahead))
    return F.when(F.count(r).over(ahead) == horizon, F.product(1 + r).over(ahead) - 1)


def add_forward_returns(panel: DataFrame, horizons: tuple[int, ...] = HORIZONS, column: str = "log_return", mode: str = "cumulative", by: tuple[str, ...] = ()) -> DataFrame:
    """Forward returns by row within the ticker, over the rows that the panel has."""
    ties = [c for c in ("company", "sector") if c in panel.columns]
    window = Window.partitionBy(*by, "ticker").orderBy("date", *ties)
    return panel.withColumns({f"future_{column}_{h}": forward_return(column, h, mode, window) for h in horizons})


def align(
    index: DataFrame,
    baselines: DataFrame,
    prices: DataFrame,
    mapping: dict[str, str],
    horizons: tuple[int, ...] = HORIZONS,
    column: str = "log_return",
    mode: str = "cumulative",
    calendar: str = "panel",
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Panel of index, baselines, prices and forward returns.

    ``calendar="market"`` takes the forward returns over trading days, before the join, instead of over panel rows.
    """
    panel = map_tickers(add_b3(join_baselines(index, baselines, by)), mapping)
    if calendar == "market":
        return panel.join(add_forward_returns(prices, horizons, column, mode), ["date", "ticker"])
    return add_forward_returns(panel.join(prices, ["date", "ticker"]), horizons, column, mode, by)


def overlap_days(panel: DataFrame) -> DataFrame:
    return panel.agg(F.count_distinct("date").alias("overlap_days"))


def check_overlap(panel: DataFrame, minimum: int) -> int:
    """Number of days; an error if there are too few."""
    days = overlap_days(panel).first()[0]
    if days < max(1, minimum):
        raise ValueError(f"only {days} days overlap, {minimum} are needed")
    return days


def as_of_next_trading_day(index: DataFrame, prices: DataFrame) -> DataFrame:
    """Index rows on days without trading move to the ticker's next trading day (extension).

    One window over the union of both; no range join.
    """
    both = index.select("ticker", "date", F.lit(None).cast("date").alias("trading_day"), F.struct(*index.columns).alias("row")).unionByName(
        prices.select("ticker", "date", F.col("date").alias("trading_day")).distinct(), allowMissingColumns=True
    )
    ahead = Window.partitionBy("ticker").orderBy("date", F.col("row").isNotNull().desc()).rowsBetween(0, Window.unboundedFollowing)
    moved = both.withColumn("next_day", F.first("trading_day", ignorenulls=True).over(ahead)).where("row is not null")
    return moved.select("row.*", F.col("next_day").alias("trading_day"))
