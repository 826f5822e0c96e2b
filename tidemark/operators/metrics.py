"""Agreement of a predictor with a target, by series, from long tables of points.

A table of points has the series' key columns, x (predictor), y (target) and, for resamples, c (how often a point was
drawn). Points with a missing or infinite value take no part.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.scores import finite
from ..session import written
from . import ranges

METRICS = ("pearson", "spearman", "r2", "mse")


def clean(points: DataFrame) -> DataFrame:
    out = points.withColumns({"x": finite(F.col("x")), "y": finite(F.col("y"))})
    return out.where("x is not null and y is not null")


def _one_pass_ranks(points: DataFrame, keys: list[str], column: str, out: str) -> DataFrame:
    """Ranks by ``column`` within series that fit a task, ties averaged; a point counts ``c`` times."""
    upto = Window.partitionBy(*keys).orderBy(column)  # the default frame takes all peers in
    same = Window.partitionBy(*keys, column)
    return points.withColumn(out, F.sum("c").over(upto) - (F.sum("c").over(same) - 1) / 2.0)


#: What the metrics need of a series' points; each column's sum, least or greatest value over parts gives the whole's.
ADDED = {**dict.fromkeys(("n", "sx", "sy", "sxx", "syy", "sxy", "error"), F.sum), "min_x": F.min, "max_x": F.max, "min_y": F.min, "max_y": F.max}


def terms(x: str, y: str, times: Column) -> dict[str, Column]:
    """A point's share in each column of ``ADDED``, if it counts ``times``."""
    off = F.col("y") - F.col("x")
    sums = {"n": times, "sx": times * F.col(x), "sy": times * F.col(y), "sxx": times * F.col(x) ** 2, "syy": times * F.col(y) ** 2, "sxy": times * F.col(x) * F.col(y), "error": times * off * off}
    return sums | {"min_x": F.col("x"), "max_x": F.col("x"), "min_y": F.col("y"), "max_y": F.col("y")}


def sums_of(x: str, y: str) -> list[Column]:
    return [ADDED[name](e).alias(name) for name, e in terms(x, y, F.col("c")).items()]


def _correlation() -> Column:
    """Pearson from sums; null for constants (``corr`` would raise)."""
    n, mx, my = F.col("n"), F.col("sx") / F.col("n"), F.col("sy") / F.col("n")
    covariance = F.col("sxy") / n - mx * my
    vx, vy = F.col("sxx") / n - mx * mx, F.col("syy") / n - my * my
    varied = (F.col("min_x") < F.col("max_x")) & (F.col("min_y") < F.col("max_y")) & (vx > 0) & (vy > 0)
    return F.when(varied, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(covariance, F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))))))


def of_sums(metric: str) -> Column:
    """A metric from the columns of ``sums_of``; null where it is not defined."""
    n, error = F.col("n"), F.col("error")
    if metric in ("pearson", "spearman"):
        value = _correlation()
    elif metric == "r2":
        total = F.col("syy") - F.col("sy") ** 2 / n
        flat = (F.col("min_y") == F.col("max_y")) | (total <= 0)
        value = F.when(F.col("min_x") < F.col("max_x"), F.when(flat, F.when(error == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(error, total)))
    else:
        value = F.try_divide(error, n)
    return F.when(n >= 2, value)


#: A series of more points than this is ranked by ranges of values, and resampled by sums over its blocks.
SERIES_POINTS = 1 << 17


def metric_values(points: DataFrame, keys: list[str], metrics: tuple[str, ...] = METRICS, by_ranges: bool | None = None) -> DataFrame:
    """Per series: n and a column for each metric; null where it is not defined.

    Values are first centred on the series' means, so sums of squares keep their digits. Ranks come from one sorted pass a
    series, or by ranges of values (``by_ranges``) once a series has more than ``SERIES_POINTS`` points.
    """
    rows = points if "c" in points.columns else points.withColumn("c", F.lit(1).cast("long"))
    ranked = [m for m in metrics if m == "spearman"]
    if ranked and by_ranges is None:
        rows = written(rows, "points")
        by_ranges = (rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > SERIES_POINTS
    if "xc" not in rows.columns:
        rows = centred(rows, keys)
    out = rows.groupBy(*keys).agg(*sums_of("xc", "yc")).select(*keys, "n", *(of_sums(m).alias(m) for m in metrics if m != "spearman"))
    if not ranked:
        return out.select(*keys, "n", *metrics)
    rank = ranges.average_ranks if by_ranges else _one_pass_ranks
    both = rank(rank(rows.select(*keys, "c", "x", "y"), keys, "x", "rx"), keys, "y", "ry")
    spearman = both.groupBy(*keys).agg(*sums_of("rx", "ry")).select(*(F.col(k).alias(f"__{k}") for k in keys), of_sums("spearman").alias("spearman"))
    same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"__{k}")), keys, F.lit(True))
    return out.join(spearman, same).select(*keys, "n", *metrics)


def centred(points: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``xc`` and ``yc``, less their means in the series, which are looked up from a table of a row a series."""
    means = points.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.avg("x").alias("__mx"), F.avg("y").alias("__my"))
    same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"__{k}")), keys, F.lit(True))
    return points.join(means, same).withColumns({"xc": F.col("x") - F.col("__mx"), "yc": F.col("y") - F.col("__my")}).drop("__mx", "__my", *(f"__{k}" for k in keys))


def melted(values: DataFrame, keys: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """A row per series and metric that has a value."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    return values.select(*keys, "n", F.explode(each).alias("m")).select(*keys, "n", "m.metric", "m.value").where("value is not null")


def _beta_fraction(a, b, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    fix = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / fix(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 300):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / fix(1 + term * d), fix(1 + term / c)
            step = d * c
            out = out * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    return out


def correlation_p_values(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p-value of a correlation of n points: the incomplete beta of 1 - r**2 at (n - 2) / 2 and 1/2."""
    r, n = np.asarray(r, float), np.asarray(n, float)
    out = np.full(r.shape, np.nan)
    good = np.isfinite(r) & (n >= 3)
    a, x = (n[good] - 2) / 2, np.clip(1 - r[good] ** 2, 0, 1)
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(a * np.log(x) + 0.5 * np.log1p(-x) - (log_gamma(a) + math.lgamma(0.5) - log_gamma(a + 0.5)))
        direct = front * _beta_fraction(a, 0.5, x) / a
        swapped = 1 - front * _beta_fraction(0.5, a, 1 - x) / 0.5
    value = np.where(x < (a + 1) / (a + 2.5), direct, swapped)
    out[good] = np.clip(np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, value)), 0, 1)
    return out


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    p = pd.Series(correlation_p_values(r.to_numpy(float), n.to_numpy(float)))
    return p.where(p.notna(), None)
