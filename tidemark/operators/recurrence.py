"""The persistent daily index: calendar filling and a linear recurrence with news-dependent decay.

    s[t] = a[t] * s[t-1] + (1 - a[t]) * x[t] on days with news, s[t] = alpha * s[t-1] on others.

The closed form exp(L) * (s0 + sum(b * exp(-L))) overflows on long series. So days are cut into blocks short enough
for any decay; within a block the closed form is taken, the blocks' last values are chained, and both are added. All of
it is window and array functions, without Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOWEST, HIGHEST = 0.01, 0.999
#: exp() stays finite up to about 709; a block's summed logarithms stay under this.
_LOG_ROOM = 600.0
SERIES = ("company", "sector")


def effective_alpha(alpha: float, horizon: Column, mode: str = "ewma_alpha") -> Column:
    """Longer horizons decay more slowly."""
    if mode != "ewma_alpha":
        return F.lit(float(alpha))
    power = F.pow(F.lit(float(alpha)), 1 / F.greatest(F.coalesce(horizon, F.lit(1.0)), F.lit(0.05)))
    return F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), power))


def fill_calendar(daily: DataFrame, series: tuple[str, ...] = SERIES, zero: tuple[str, ...] = ("impacto_dia", "risco_dia"), count: str = "news_count") -> DataFrame:
    """Every day from a series' first to its last; days without a row have zeros.

    Gaps are filled forward from each row, so a series is never joined with a calendar.
    """
    order = Window.partitionBy(*series).orderBy("date")
    until = F.coalesce(F.date_sub(F.lead("date").over(order), 1), F.col("date"))
    rows = daily.withColumn("until", until).withColumn("day", F.explode(F.sequence("date", "until"))).drop("until")
    here = F.col("day") == F.col("date")
    kept = {c: F.when(here, F.col(c)).otherwise(F.lit(0.0)) for c in zero if c in daily.columns}
    return rows.withColumns({**kept, count: F.when(here, F.col(count)).otherwise(F.lit(0).cast("long")), "has_news": here, "date": F.col("day")}).drop("day")


def index_daily(daily: DataFrame, alpha: float = 0.85, initial: float = 0.0, mode: str = "ewma_alpha", by: tuple[str, ...] = ()) -> DataFrame:
    """Net index and risk index of each series and day."""
    if not 0 < alpha < 1:
        raise ValueError("alpha lies between 0 and 1")
    keys = (*by, *SERIES)
    start = F.min("date").over(Window.partitionBy(*keys).orderBy("date"))  # the window that the gaps are filled by
    filled = fill_calendar(daily.withColumn("__first", start), keys)
    a = F.when(F.col("has_news"), effective_alpha(alpha, F.col("mean_horizon"), mode)).otherwise(F.lit(float(alpha)))
    rows = filled.withColumn("a", a).withColumns({
        "la": F.ln("a"),
        "bi": F.when(F.col("has_news"), (1 - F.col("a")) * F.coalesce("impacto_dia", F.lit(0.0))).otherwise(0.0),
        "br": F.when(F.col("has_news"), (1 - F.col("a")) * F.coalesce("risco_dia", F.lit(0.0))).otherwise(0.0),
    })
    block = max(1, math.floor(_LOG_ROOM / abs(math.log(min(alpha, LOWEST)))))
    rows = rows.withColumn("g", F.floor(F.datediff("date", "__first") / block).cast("int"))
    within = Window.partitionBy(*keys, "g").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("L", F.sum("la").over(within))
    for x in ("i", "r"):
        rows = rows.withColumn(f"y{x}", F.exp("L") * F.sum(F.col(f"b{x}") * F.exp(-F.col("L"))).over(within))
    # The last values of the blocks before a row's own: one entry per 130 days, so most lists are empty. Every window has
    # the series as its partition, so the whole recurrence needs one shuffle; blocks follow the days, so ordering by both
    # keeps the order within blocks and the filled rows are sorted once.
    order = Window.partitionBy(*keys).orderBy("g", "date")
    rows = rows.withColumn("ends", F.coalesce(F.lead("g").over(order) != F.col("g"), F.lit(True)))
    entry = F.when(F.col("ends"), F.struct(F.col("L").alias("l"), "yi", "yr"))
    rows = rows.withColumn("before", F.collect_list(entry).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    carry = lambda y: F.aggregate("before", F.lit(float(initial)), lambda acc, e: e[y] + F.exp(e["l"]) * acc)
    return rows.select(
        *by,
        "date",
        "company",
        "sector",
        "impacto_dia",
        "risco_dia",
        "news_count",
        (F.col("yi") + F.exp("L") * carry("yi")).alias("iti_liquido"),
        (F.col("yr") + F.exp("L") * carry("yr")).alias("iti_risco"),
    )
