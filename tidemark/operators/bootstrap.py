"""Block bootstrap of metrics.

A resample of a series of n points is a list of block starts: numbers 0 to n - block that the generator of the seed draws
one after the other, 32 bits each, so any part of the draws can be made anywhere by moving the generator on.

A series of up to ``metrics.SERIES_POINTS`` points becomes one row of arrays, and its resamples are dealt out in parts of
``PART`` to tasks that work on bounded slices of resamples x points. A longer series stays a table. Its draws are made in
slices of the generator's stream; its Pearson, R2 and MSE come from sums over the blocks drawn, which are formed once for
every start; and Spearman from its points' counts in each resample, ranked by ranges of values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import written
from . import metrics as M
from . import ranges as R

#: Resamples of one series in one task; resamples x points that are held at a time.
PART, CELLS = 100, 1 << 20

#: Numbers of the generator's stream in a slice; points of a long series in a chunk that block sums are formed in.
SLICE, CHUNK = 1 << 20, 1 << 14


@dataclass(frozen=True)
class Inference:
    enabled: bool = True
    n_bootstrap: int = 500
    block_size: int = 5
    ci_level: float = 0.95
    random_seed: int = 42


def _ranks(codes: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """Average ranks within each row of ``drawn`` positions; ``codes`` number the distinct values in their order."""
    picked, many = codes[drawn], int(codes.max()) + 1
    at = np.arange(len(drawn))[:, None] * many + picked
    counts = np.bincount(at.ravel(), minlength=len(drawn) * many).reshape(len(drawn), many)
    return np.take_along_axis(counts.cumsum(axis=1) - (counts - 1) / 2.0, picked, axis=1)


def _correlations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    varied = (a.min(axis=1) < a.max(axis=1)) & (b.min(axis=1) < b.max(axis=1))
    a, b = (m - m.mean(axis=1, keepdims=True) for m in (a, b))
    va, vb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    varied &= (va > 0) & (vb > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(varied, np.clip((a * b).sum(axis=1) / np.sqrt(va * vb), -1.0, 1.0), np.nan)


def values_of(x: np.ndarray, y: np.ndarray, drawn: np.ndarray, metrics: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Each metric for every row of drawn positions; nan where it is not defined."""
    if drawn.shape[1] < 2:
        return {m: np.full(len(drawn), np.nan) for m in metrics}
    xs, ys = x[drawn], y[drawn]
    error = ((ys - xs) ** 2).sum(axis=1)
    out = {}
    for m in metrics:
        if m == "pearson":
            out[m] = _correlations(xs, ys)
        elif m == "spearman":
            out[m] = _correlations(*(_ranks(np.unique(v, return_inverse=True)[1].reshape(-1), drawn) for v in (x, y)))
        elif m == "r2":
            total = ((ys - ys.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)
            flat = (ys.min(axis=1) == ys.max(axis=1)) | (total <= 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                fit = np.where(flat, np.where(error == 0, 1.0, 0.0), 1 - error / total)
            out[m] = np.where(xs.min(axis=1) < xs.max(axis=1), fit, np.nan)
        else:
            out[m] = error / drawn.shape[1]
    return out


def starts(seed: int, n: int, block_size: int, first: int, count: int) -> np.ndarray:
    """Draws ``first`` to ``first + count`` of block starts for a series of n points."""
    rng, high = np.random.default_rng(seed), max(n - block_size + 1, 1)
    for skipped in range(0, first, CELLS):
        rng.integers(0, high, size=min(CELLS, first - skipped))
    return rng.integers(0, high, size=count)


def stream_starts(seed: int, n: int, block_size: int, word: int, words: int) -> np.ndarray:
    """The block starts that these 32-bit words of the generator's stream give; fewer than words, for some give none.

    A 64-bit output is two words, the lower half first. A word w stands for floor(w * high / 2**32), unless the remainder
    lies below 2**32 mod high.
    """
    high = max(n - block_size + 1, 1)
    bits = np.random.PCG64(seed)
    bits.advance(word // 2)
    raw = bits.random_raw((word + words + 1) // 2 - word // 2).astype(np.uint64)
    halves = np.stack([raw & np.uint64(0xFFFFFFFF), raw >> np.uint64(32)], axis=1).ravel()[word % 2 :][:words]
    scaled = halves * np.uint64(high)
    kept = (scaled & np.uint64(0xFFFFFFFF)) >= np.uint64((1 << 32) % high)
    return (scaled[kept] >> np.uint64(32)).astype(np.int64)


def draws(lengths: DataFrame, inference: Inference, seed: int) -> DataFrame:
    """(n_points, rep, start, length) for each distinct ``n_points``: the blocks of every resample, the last one cut to n_points."""
    size, n = inference.block_size, F.col("n_points")
    total, lost = (F.ceil(n / size) * inference.n_bootstrap).cast("double"), n / float(1 << 32)
    enough = F.ceil(total / (1 - lost) + 12 * F.sqrt(total * lost + 1) + 64).cast("long")  # but for odds of less than one in 10**20
    ns = lengths.select("n_points").distinct().withColumn("n_points", F.when(n < (1 << 31), n).otherwise(F.raise_error(F.lit("a series of 2**31 points or more"))))
    slices = ns.withColumn("words", enough).select("n_points", "words", F.explode(F.sequence(F.lit(0).cast("long"), F.col("words") - 1, F.lit(SLICE).cast("long"))).alias("word")).repartition("n_points", "word")

    def words_of(row) -> np.ndarray:
        return stream_starts(seed, row.n_points, size, row.word, min(SLICE, row.words - row.word))

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(accepted=[len(words_of(r)) for r in f.itertuples()])

    def drawn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                blocks = -(-r.n_points // size)
                got = words_of(r)[: max(0, blocks * inference.n_bootstrap - r.first)]
                at = r.first + np.arange(len(got))
                yield pd.DataFrame({"n_points": r.n_points, "rep": (at // blocks).astype("int32"), "start": got, "length": np.minimum(size, r.n_points - at % blocks * size)})

    counts = written(slices.mapInPandas(counted, "n_points long, words long, word long, accepted long"), "draws-counts")
    before = F.sum("accepted").over(Window.partitionBy("n_points").orderBy("word").rowsBetween(Window.unboundedPreceding, -1))
    placed = counts.withColumn("first", F.coalesce(before, F.lit(0))).repartition("n_points", "word")
    return placed.mapInPandas(drawn, "n_points long, rep int, start long, length long")


def _block_sums(placed: DataFrame, blocks: DataFrame, series: list[str], size: int) -> DataFrame:
    """(series, rep, columns of ``metrics.ADDED``) from sums over the block of every start."""
    chunk = F.floor(F.col("place") / CHUNK)
    shared = (F.col("place") % CHUNK < size - 1) & (chunk > 0)  # the last blocks of the chunk before reach here
    near = placed.withColumn("chunk", F.explode(F.when(shared, F.array(chunk, chunk - 1)).otherwise(F.array(chunk))))
    each = near.select(*series, "chunk", "place", *(e.alias(c) for c, e in M.terms("xc", "yc", F.lit(1).cast("long")).items()))
    ahead = Window.partitionBy(*series, "chunk").orderBy("place").rowsBetween(0, size - 1)
    sums = each.select(*series, "chunk", F.col("place").alias("start"), *(how(c).over(ahead).alias(c) for c, how in M.ADDED.items()))
    sums = sums.where((F.floor(F.col("start") / CHUNK) == F.col("chunk")) & (F.col("start") <= F.col("n_points") - size))
    times = blocks.where(F.col("length") == size).groupBy("n_points", "rep", "start").agg(F.count(F.lit(1)).alias("times"))
    whole = sums.join(times, ["n_points", "start"]).select(*series, "rep", *((F.col(c) if c[:3] in ("min", "max") else F.col(c) * F.col("times")).alias(c) for c in M.ADDED))
    cut = _places(blocks.where(F.col("length") < size)).join(placed, ["n_points", "place"])
    rest = cut.select(*series, "rep", *(e.alias(c) for c, e in M.terms("xc", "yc", F.lit(1).cast("long")).items()))
    return whole.unionByName(rest).groupBy(*series, "rep").agg(*(how(c).alias(c) for c, how in M.ADDED.items()))


def _places(blocks: DataFrame) -> DataFrame:
    return blocks.select("n_points", "rep", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("place"))


def _long_values(points: DataFrame, keys: list[str], order: list[str], inference: Inference, seed: int, metrics: tuple[str, ...]) -> DataFrame:
    """(keys, n, rep, metric, value) of series too long for a row: of the series itself, and of each resample."""
    placed = written(R.numbered(M.centred(points, keys), keys, [*dict.fromkeys([*order, "x", "y"])], "place"), "places")
    lengths = R.small(written(placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points")), "series"))
    placed = placed.alias("a").join(lengths.alias("b"), R.same(keys)).select(*(f"a.{c}" for c in (*keys, "x", "y", "xc", "yc", "place")), "b.n_points")
    names, series = [*keys, "n", "rep", "metric", "value"], [*keys, "n_points"]
    found = [M.melted(M.metric_values(points, keys, metrics), keys, metrics).withColumn("rep", F.lit(-1)).select(*names)]
    if inference.enabled:
        placed, blocks, sampled = written(placed, "placed"), written(draws(lengths, inference, seed), "draws"), [*keys, "rep"]
        if sums := tuple(m for m in metrics if m != "spearman"):
            of = _block_sums(placed, blocks, series, inference.block_size)
            found.append(M.melted(of.select(*sampled, "n", *(M.of_sums(m).alias(m) for m in sums)), sampled, sums).select(*names))
        if "spearman" in metrics:
            counts = _places(blocks).groupBy("n_points", "rep", "place").agg(F.count(F.lit(1)).alias("c"))
            drawn = written(placed.join(counts, ["n_points", "place"]).select(*sampled, "c", "x", "y", "xc", "yc"), "drawn")
            found.append(M.melted(M.metric_values(drawn, sampled, ("spearman",), by_ranges=True), sampled, ("spearman",)).select(*names))
    return reduce(DataFrame.unionByName, found)


def resampled(points: DataFrame, keys: list[str], order: list[str], inference: Inference, seed: int, metrics: tuple[str, ...], base: str | None = None) -> DataFrame:
    """(keys, n, rep, metric, value), and with ``base`` the same metric of that predictor; rep -1 is the series itself.

    Points with a missing or infinite value take no part.
    """
    columns = ["x", "y", *([base] if base else [])]
    good = points.withColumns({c: M.finite(F.col(c)) for c in columns}).where(" and ".join(f"{c} is not null" for c in columns))
    good = written(good.select(*dict.fromkeys([*keys, *order, *columns])), "points")
    lengths = written(good.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points")), "lengths")
    is_long = F.col("n_points") > max(M.SERIES_POINTS, inference.block_size)
    if lengths.where(is_long).isEmpty():
        return _row_values(good, keys, order, columns, inference, seed, metrics, base)
    part = lambda which: good.alias("a").join(R.small(lengths.where(which)).alias("b"), R.same(keys)).select("a.*")
    ours = _row_values(part(~is_long), keys, order, columns, inference, seed, metrics, base)
    many = written(part(is_long), "long")
    values = lambda x: _long_values(many.select(*keys, *(c for c in order if c not in (*keys, *columns)), F.col(x).alias("x"), "y"), keys, [c for c in order if c not in columns], inference, seed, metrics)
    long_ones = values("x")
    if base:
        against = values(base).withColumnRenamed("value", "base")
        on = [*keys, "n", "rep", "metric"]
        long_ones = long_ones.alias("a").join(against.alias("b"), R.same(on)).select("a.*", "b.base")
    return ours.unionByName(long_ones.withColumn("rep", F.col("rep").cast("int")))


def _row_values(good: DataFrame, keys: list[str], order: list[str], columns: list[str], inference: Inference, seed: int, metrics: tuple[str, ...], base: str | None) -> DataFrame:
    """``resampled`` for series that fit a row."""
    lists = good.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*dict.fromkeys([*order, *columns])))).alias("p"))
    series = lists.select(*keys, *(F.col(f"p.{c}").alias(c) for c in columns))
    parts = max(1, -(-inference.n_bootstrap // PART)) if inference.enabled else 1
    dealt = series.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(*keys, "part")
    names = [*keys, "n", "rep", "metric", "value", *(["base"] if base else [])]

    def slices(n: int, part: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if part == 0:
            yield np.array([-1]), np.arange(n)[None, :]
        if not inference.enabled:
            return
        size = min(inference.block_size, n)
        blocks, lo, hi = -(-n // size), part * PART, min(inference.n_bootstrap, (part + 1) * PART)
        drawn, step = starts(seed, n, inference.block_size, lo * blocks, (hi - lo) * blocks).reshape(hi - lo, blocks), max(1, CELLS // n)
        for first in range(lo, hi, step):
            reps = np.arange(first, min(first + step, hi))
            yield reps, (drawn[reps - lo][:, :, None] + np.arange(size)[None, None, :]).reshape(len(reps), -1)[:, :n]

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                x, y, *other = (np.asarray(getattr(row, c), float) for c in columns)
                for reps, drawn in slices(len(x), int(row.part)):
                    own = values_of(x, y, drawn, metrics)
                    against = values_of(other[0], y, drawn, metrics) if base else {}
                    for m in metrics:
                        out = pd.DataFrame({"rep": reps, "value": own[m]})
                        if base:
                            out["base"] = against[m]
                        for k in keys:
                            out[k] = getattr(row, k)
                        out["n"], out["metric"] = len(x), m
                        yield out.dropna(subset=["value", *(["base"] if base else [])])[names]

    schema = StructType([*(f for f in series.schema.fields if f.name in keys), *StructType.fromDDL("n long, rep int, metric string, value double" + (", base double" if base else "")).fields])
    return dealt.mapInPandas(draw, schema)


def percentile_ci(column: str, level: float):
    tail = (1 - level) / 2
    return F.percentile(column, F.array(F.lit(tail), F.lit(1 - tail)))


def metric_inference(points: DataFrame, keys: list[str], order: list[str], inference: Inference = Inference(), metrics: tuple[str, ...] = M.METRICS) -> DataFrame:
    """Per series and metric: value, p_value, ci_low, ci_high, n, n_bootstrap.

    The p-value is that of the t test for correlations, else twice the share of resamples on the other side of 0.
    """
    rows = resampled(points, keys, order, inference, inference.random_seed, metrics)
    own, sample = F.col("rep") < 0, F.when(F.col("rep") >= 0, F.col("value"))
    value = F.max(F.when(own, F.col("value")))
    grouped = rows.groupBy(*keys, "metric", "n").agg(value.alias("value"), F.count(sample).alias("n_bootstrap"), percentile_ci(sample, inference.ci_level).alias("ci"), F.count_if(sample <= 0).alias("below"), F.count_if(sample >= 0).alias("above")).where("value is not null")
    correlation = F.when(F.col("metric").isin("pearson", "spearman") & (F.col("n") >= 3), F.col("value"))
    parametric = F.when(correlation.isNotNull(), M.correlation_p(correlation, F.col("n").cast("double")))
    share = F.try_divide(2.0 * F.when(F.col("value") >= 0, F.col("below")).otherwise(F.col("above")), F.col("n_bootstrap"))
    p_value = F.coalesce(parametric, F.least(F.lit(1.0), share))
    return grouped.select(*keys, "metric", "value", p_value.alias("p_value"), F.get("ci", F.lit(0)).alias("ci_low"), F.get("ci", F.lit(1)).alias("ci_high"), "n", "n_bootstrap")


def delta_inference(pairs: DataFrame, keys: list[str], order: list[str], inference: Inference = Inference(), metrics: tuple[str, ...] = M.METRICS) -> DataFrame:
    """Advantage of ``x`` over ``x_base`` for the same target, on points where all three are present.

    The p-value is the share of resamples without advantage. For mse a smaller error is the advantage.
    """
    rows = resampled(pairs, keys, order, inference, inference.random_seed + 17, metrics, base="x_base")
    gain = F.when(F.col("metric") == "mse", F.col("base") - F.col("value")).otherwise(F.col("value") - F.col("base"))
    own, sample = F.max(F.when(F.col("rep") < 0, gain)), F.when(F.col("rep") >= 0, gain)
    grouped = rows.groupBy(*keys, "metric", "n").agg(
        own.alias("delta"), F.count(sample).alias("n_bootstrap"), percentile_ci(sample, inference.ci_level).alias("ci"), F.try_divide(F.count_if(sample <= 0).cast("double"), F.count(sample)).alias("p_value")
    ).where("delta is not null")
    return grouped.select(*keys, "metric", "delta", "p_value", F.get("ci", F.lit(0)).alias("ci_low"), F.get("ci", F.lit(1)).alias("ci_high"), "n", "n_bootstrap")


def favourable(delta, ci_low, ci_high, p_value, alpha: float = 0.05):
    """An advantage that is significant by its p-value or by an interval without 0."""
    apart = ci_low.isNotNull() & ci_high.isNotNull() & ~((ci_low <= 0) & (ci_high >= 0))
    return F.coalesce((delta > 0) & (F.coalesce(p_value < alpha, F.lit(False)) | apart), F.lit(False))
