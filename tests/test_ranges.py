"""Places, sums and ranks over ranges, and resamples of long series, against numpy; keys that span many ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates, bootstrap, metrics, ranges

from .conftest import same
from .test_market import frame


@pytest.fixture
def many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_places_and_sums_of_a_key_over_many_ranges(spark, many_ranges):
    rows = [(("big" if i % 7 else None) if i % 5 else f"k{i % 3}", (i * 37) % 1009, i % 4) for i in range(1009)]
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(5)
    got = ranges.numbered(df, ["k"], ["o"], "place")
    assert got.withColumn("at", F.spark_partition_id()).where("k = 'big'").select("at").distinct().count() > 1
    want, sums = [], []
    for k in {r[0] for r in rows}:
        total = 0
        for place, (o, v) in enumerate(sorted((o, v) for kk, o, v in rows if kk == k)):
            want.append((k, o, v, place))
            sums.append((k, o, v, total))
            total += v
    same([tuple(r) for r in got.collect()], want)
    same([tuple(r) for r in ranges.summed_before(df, ["k"], ["o"], "v", "below").collect()], sums)
    assert ranges.numbered(df.limit(0), ["k"], ["o"], "place").count() == 0


def test_ranks_with_ties_and_weights(spark, many_ranges, monkeypatch):
    monkeypatch.setattr(ranges, "HOT_SHARE", 0.1)
    r = np.random.default_rng(3)
    values = np.concatenate([r.integers(0, 40, 600), np.zeros(300, int)])
    weights = r.integers(1, 4, 900)
    df = spark.createDataFrame([("a", i, float(v), int(c)) for i, (v, c) in enumerate(zip(values, weights, strict=True))], "k string, i long, x double, c long")
    got = {row.i: row.rank for row in ranges.average_ranks(df, ["k"], "x", "rank").collect()}
    for i, v in enumerate(values):
        below, held = weights[values < v].sum(), weights[values == v].sum()
        assert got[i] == below + (held + 1) / 2
    plain = {row.i: row.rank for row in metrics._one_pass_ranks(df, ["k"], "x", "rank").collect()}
    assert got == plain


def test_metrics_by_ranges_are_those_of_one_pass(spark, many_ranges):
    r = np.random.default_rng(1)
    points = frame(spark, {"a": (r.normal(size=400), r.normal(size=400)), "b": (r.integers(0, 4, 50), r.integers(0, 3, 50)), "c": (np.ones(5), np.arange(5)), "one": ([1.0], [2.0])})
    by_ranges, plain = (metrics.metric_values(metrics.clean(points), ["k"], by_ranges=b).collect() for b in (True, False))
    same([tuple(x) for x in by_ranges], [tuple(x) for x in plain])


@pytest.mark.parametrize(("n", "block"), [(1, 5), (7, 5), (1000, 5), (3_000_000_00, 7), (1 << 31, 3)])
def test_any_part_of_the_draws_is_that_of_one_generator(n, block):
    whole = np.random.default_rng(42).integers(0, max(n - block + 1, 1), size=3000)
    assert (bootstrap.starts(42, n, block, 700, 500) == whole[700:1200]).all()
    if n > block:
        pieces = np.concatenate([bootstrap.stream_starts(42, n, block, at, 501) for at in range(0, 6012, 501)])
        assert (pieces[:3000] == whole).all()


@pytest.mark.parametrize("block", [5, 4])
def test_long_series_are_resampled_like_short_ones(spark, many_ranges, monkeypatch, block):
    r = np.random.default_rng(9)
    x, y, z = r.normal(size=131), np.round(r.normal(size=131), 1), np.round(r.normal(size=131), 1)
    few = r.normal(size=12)
    rows = [("long", i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, z, strict=True))] + [("short", i, float(v), float(i), 1.0 * (i % 3)) for i, v in enumerate(few)] + [("long", 999, float("nan"), 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, i long, x double, y double, x_base double")
    inference = bootstrap.Inference(n_bootstrap=40, block_size=block)
    want = bootstrap.metric_inference(df, ["k"], ["i"], inference).collect()
    gains = bootstrap.delta_inference(df, ["k"], ["i"], inference).collect()
    monkeypatch.setattr(metrics, "SERIES_POINTS", 50)
    monkeypatch.setattr(bootstrap, "CHUNK", 16)
    monkeypatch.setattr(bootstrap, "SLICE", 100)
    same([tuple(r) for r in bootstrap.metric_inference(df, ["k"], ["i"], inference).collect()], [tuple(r) for r in want])
    same([tuple(r) for r in bootstrap.delta_inference(df, ["k"], ["i"], inference).collect()], [tuple(r) for r in gains])


def test_medians_by_ranges_and_one_scan(spark, many_ranges, monkeypatch):
    r = np.random.default_rng(11)
    rows = [("2024-01-0%d" % (1 + i % 2), "A" if i % 3 else " ", f"s{i % 2}" if i % 7 else None, float(round(r.normal(), 1)) if i % 11 else None, 0.5 if i % 5 else None, "POSITIVE" if i % 4 else "NEGATIVE") for i in range(401)]
    df = spark.createDataFrame(rows, "date string, company string, sector string, continuous_sentiment double, confidence double, predicted_label string").repartition(5)
    plain = aggregates.aggregate_levels(df).collect()
    for row in plain:
        own = [x for x in rows if x[0] == row.date and (row.company is None or x[1] == row.company) and (row.sector is None or x[2] == row.sector)]
        d = [x[3] for x in own if x[3] is not None]
        assert (row.news_count, row.sentiment_count) == (len(own), len(d))
        assert row.sentiment_median == pytest.approx(float(np.median(d))) and row.sentiment_mean == pytest.approx(float(np.mean(d))) and row.sentiment_sum == pytest.approx(sum(d))
        assert row.negative_count == sum(x[5] == "NEGATIVE" for x in own)
    assert len(plain) == 2 + 2 + 2 and {x.company for x in plain} == {None, "A"}
    monkeypatch.setattr(aggregates, "GROUP_VALUES", 5)
    by_ranges = aggregates.aggregate_levels(df)
    same([tuple(x[c] for c in by_ranges.columns) for x in by_ranges.collect()], [tuple(x[c] for c in by_ranges.columns) for x in plain])
    assert "Expand" not in aggregates.aggregate_levels(df, statistics=("mean",))._jdf.queryExecution().executedPlan().toString()
    assert aggregates.aggregate_levels(df.limit(0)).count() == 0
