"""Prices, alignment, forward returns, metrics, bootstrap and validation."""

import math
from datetime import date, timedelta

import numpy as np
import pytest

from tidemark.operators import alignment, bootstrap, market, metrics, validation


def prices(spark, n=13):
    days = [date(2024, 1, 2) + timedelta(days=i) for i in range(n)]
    return spark.createDataFrame([(d, "T", 100.0 + i) for i, d in enumerate(days)], "date date, ticker string, close double")


def test_returns(spark):
    rows = market.returns(prices(spark)).orderBy("date").collect()
    assert len(rows) == 13 and sum(r.simple_return is not None for r in rows) == 12
    assert rows[1].simple_return == pytest.approx(0.01) and rows[1].log_return == pytest.approx(math.log(1.01))


def test_prices_are_cleaned(spark):
    raw = spark.createDataFrame([("NaN", "SBSP3.SA", "NaN", 0), ("2024-01-01", "AAA", "10", 1), ("2024-01-02", "AAA", "not-a-number", 2), ("2024-01-03", "AAA", "12", 3), ("2024-01-03", "AAA", "13", 4), ("2024-01-04", None, "1", 5)], "date string, ticker string, close string, row_id long")
    rows = market.sanitize_prices(raw).orderBy("date").collect()
    assert [(str(r.date), r.close) for r in rows] == [("2024-01-01", 10.0), ("2024-01-03", 13.0)]


def test_close_column_of_wide_frames():
    assert market.close_column([("Open", "T"), ("Close", "T")]) == ("Close", "T")
    with pytest.raises(ValueError):
        market.close_column(["open"])


def test_forward_returns(spark):
    df = spark.createDataFrame([("T", date(2024, 1, 1) + timedelta(days=i), r) for i, r in enumerate([0.01, 0.02, 0.03, None])], "ticker string, date date, log_return double")
    rows = alignment.add_forward_returns(df, (2,)).orderBy("date").collect()
    assert rows[0].future_log_return_2 == pytest.approx(0.05) and rows[1].future_log_return_2 == pytest.approx(0.03) and rows[2].future_log_return_2 is None
    assert alignment.add_forward_returns(df, (2,), mode="point").orderBy("date").first().future_log_return_2 == pytest.approx(0.03)
    simple = df.withColumnRenamed("log_return", "simple_return")
    out = alignment.add_forward_returns(simple, (2,), "simple_return").orderBy("date").collect()
    assert out[0].future_simple_return_2 == pytest.approx(1.02 * 1.03 - 1) and out[1].future_simple_return_2 is None


def index_rows(spark, n=8):
    days = [date(2024, 1, 2) + timedelta(days=i) for i in range(n)]
    index = spark.createDataFrame([(d, "Sabesp", "S", 0.1 * i, 0.0, 1, 0.1 * i, 0.05) for i, d in enumerate(days)], "date date, company string, sector string, impacto_dia double, risco_dia double, news_count long, iti_liquido double, iti_risco double")
    base = spark.createDataFrame([(d, "Sabesp", "S", 1, 0.2, 0.3) for d in days[:-1]] + [(days[0], "Nobody", None, 1, 0.0, 0.0)], "date date, company string, sector string, b0_news_count long, b1_mean_sentiment double, b2_confidence_weighted_sentiment double")
    return index, base


def test_alignment(spark):
    index, base = index_rows(spark)
    panel = alignment.align(index, base, market.returns(prices(spark)), {"Sabesp": "T"}, (1, 5))
    assert panel.count() == 8 and alignment.check_overlap(panel, 8) == 8
    assert [r.company for r in alignment.dropped_companies(base, {"Sabesp": "T"}).collect()] == ["Nobody"]
    with pytest.raises(ValueError):
        alignment.check_overlap(panel, 9)
    by_market = alignment.align(index, base, market.returns(prices(spark)), {"Sabesp": "T"}, (5,), calendar="market")
    assert by_market.where("future_log_return_5 is not null").count() == 8


def test_null_keys_meet(spark):
    index, base = index_rows(spark)
    none = index.limit(1).selectExpr("date", "company", "cast(null as string) sector", *index.columns[3:])
    same = none.selectExpr("date", "company", "sector", "1L b0_news_count", "0.1D b1_mean_sentiment", "0.1D b2_confidence_weighted_sentiment")
    assert alignment.join_baselines(none, same).count() == 1


def test_weekend_news_moves_to_the_next_trading_day(spark):
    news = spark.createDataFrame([("T", date(2024, 1, 6), 1.0), ("T", date(2024, 1, 9), 2.0)], "ticker string, date date, x double")
    days = spark.createDataFrame([("T", date(2024, 1, 5)), ("T", date(2024, 1, 8))], "ticker string, date date")
    got = {r.x: r.trading_day for r in alignment.as_of_next_trading_day(news, days).collect()}
    assert got == {1.0: date(2024, 1, 8), 2.0: None}


# ---- metrics ----


def rank(a):
    _, inv, counts = np.unique(a, return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    return (ends - (counts - 1) / 2)[inv]


def numpy_metric(name, x, y):
    if len(x) < 2:
        return None
    if name == "mse":
        return float(np.mean((y - x) ** 2))
    if x.min() == x.max():
        return None
    if name == "r2":
        total = np.sum((y - y.mean()) ** 2)
        return 1 - float(np.sum((y - x) ** 2) / total) if y.min() < y.max() else float(np.all(x == y))
    if y.min() == y.max():
        return None
    return float(np.corrcoef(x, y)[0, 1]) if name == "pearson" else float(np.corrcoef(rank(x), rank(y))[0, 1])


def frame(spark, series):
    rows = [(k, i, float(a) if a is not None else None, float(b)) for k, (x, y) in series.items() for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "k string, i long, x double, y double")


def test_metrics_against_numpy(spark):
    r = np.random.default_rng(1)
    series = {"a": (r.normal(size=60), r.normal(size=60)), "b": (r.integers(0, 4, 50), r.integers(0, 3, 50)), "c": (np.ones(5), np.arange(5)), "one": ([1.0], [2.0]), "flat": (np.arange(5), np.ones(5))}
    got = {x.k: x for x in metrics.metric_values(metrics.clean(frame(spark, series)), ["k"]).collect()}
    for k, (x, y) in series.items():
        for m in metrics.METRICS:
            want = numpy_metric(m, np.asarray(x, float), np.asarray(y, float))
            assert got[k][m] == (None if want is None else pytest.approx(want, abs=1e-9)), (k, m)


def test_p_values():
    p = metrics.correlation_p_values(np.array([0.5, 0.0, 1.0, 0.3]), np.array([10, 10, 10, 2]))
    assert p[0] == pytest.approx(0.14111328, abs=1e-7) and p[1] == pytest.approx(1) and p[2] == 0 and np.isnan(p[3])


@pytest.mark.parametrize("n", [40, 7, 3])
def test_bootstrap_against_numpy(spark, n):
    inference = bootstrap.Inference(n_bootstrap=60)
    r = np.random.default_rng(n)
    x, y = r.normal(size=n), r.normal(size=n)
    got = {row.metric: row for row in bootstrap.metric_inference(frame(spark, {"a": (x, y)}), ["k"], ["i"], inference).collect()}
    rng = np.random.default_rng(42)
    samples = {m: [] for m in metrics.METRICS}
    for _ in range(60):
        idx = []
        while len(idx) < n:
            start = int(rng.integers(0, max(n - 5 + 1, 1)))
            idx += range(start, min(start + 5, n))
        idx = np.array(idx[:n])
        for m in samples:
            if (v := numpy_metric(m, x[idx], y[idx])) is not None:
                samples[m].append(v)
    for m, values in samples.items():
        lo, hi = np.percentile(values, [2.5, 97.5])
        assert got[m].ci_low == pytest.approx(lo, abs=1e-8) and got[m].ci_high == pytest.approx(hi, abs=1e-8) and got[m].n_bootstrap == len(values) and got[m].n == n
    value = numpy_metric("mse", x, y)
    assert got["mse"].p_value == pytest.approx(min(1, 2 * np.mean(np.array(samples["mse"]) <= 0))) and got["mse"].value == pytest.approx(value)


def panel(spark, rows, columns):
    out = spark.createDataFrame(rows, columns)
    return out.selectExpr("'m' model_key", "'d' dataset_key", "*")


def test_delta_uses_the_rows_of_the_baseline(spark):
    cols = "date date, ticker string, news_count long, iti_liquido double, iti_risco double, b0_news_count double, future_log_return_1 double"
    rows = [(date(2024, 1, 1) + timedelta(days=i), "T", int(i < 3), 0.1 * i, 0.1, float(i) if i < 3 else None, 0.11 * i + (0.01 if i == 2 else 0)) for i in range(6)]
    v = validation.Validation(horizons=(1,), baselines=("b0",), metrics=("pearson",), inference=bootstrap.Inference(n_bootstrap=20))
    p = panel(spark, rows, cols)
    scored = validation.incremental(p, v)
    assert {r.predictor: r.n for r in scored.collect()}["iti_liquido"] == 6
    d = validation.deltas(p, scored, v).first()
    assert d.n == 3 and d.baseline == "b0" and d.iti_predictor == "iti_liquido"


def test_risk_index_is_held_against_absolute_returns(spark):
    cols = "date date, ticker string, news_count long, iti_liquido double, iti_risco double, b0_news_count double, future_log_return_1 double"
    rows = [(date(2024, 1, 1) + timedelta(days=i), "T", 1, 0.1 * i, abs(i - 3) * 1.0, float(i), float(i - 3)) for i in range(7)]
    v = validation.Validation(horizons=(1,), baselines=("b0",), metrics=("pearson", "r2"), inference=bootstrap.Inference(enabled=False))
    got = {(r.predictor, r.metric): r for r in validation.incremental(panel(spark, rows, cols), v).collect()}
    assert got["iti_risco", "pearson"].target_mode == "abs" and got["iti_risco", "pearson"].value == pytest.approx(1)
    assert ("iti_liquido", "r2") not in got  # fewer than 30 rows
    every = {(r.series, r.metric) for r in validation.market(panel(spark, rows, cols), v).collect()}
    assert ("iti_liquido", "r2") in every


def test_wins_and_conclusion(spark):
    rows = [("m", "d", "iti_liquido", "pearson", 0.2, True), ("m", "d", "iti_liquido", "mse", -0.1, False), ("m", "e", "iti_liquido", "pearson", 0.1, False)]
    d = spark.createDataFrame(rows, "model_key string, dataset_key string, iti_predictor string, metric string, delta double, significant boolean")
    w = validation.wins(d, ("pearson",))
    assert validation.conclusion(w, ("pearson",)) == "iti_liquido (pearson): 2/2 vitórias (100.0%), 1 significativas (50.0%)"
    assert validation.conclusion(w.limit(0), ("pearson",)).startswith("Nenhuma")


def test_favourable(spark):
    from pyspark.sql import functions as F

    rows = [(0.1, 0.01, 0.2, 0.2), (0.1, -0.1, 0.2, 0.01), (0.1, -0.1, 0.2, 0.3), (-0.1, -0.2, -0.05, 0.01), (0.1, None, None, None)]
    df = spark.createDataFrame(rows, "d double, l double, h double, p double")
    assert [r[0] for r in df.select(bootstrap.favourable(F.col("d"), F.col("l"), F.col("h"), F.col("p"))).collect()] == [True, True, False, False, False]


def test_uncertainty_needs_its_column(spark):
    daily = spark.createDataFrame([(date(2024, 1, 1), "A", 0.1)], "date date, company string, disagreement_mean double")
    assert validation.uncertainty(daily, daily) is None
