"""Impact, recurrence, levels, resampling and disagreement against hand-computed numbers."""

import json
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import impact, levels, recurrence, uncertainty

PRED = "news_id string, date string, company string, sector string, continuous_sentiment double, confidence double, prediction_metadata string"


def test_impact_of_plain_predictions(spark):
    df = spark.createDataFrame([("1", "2024-01-01", "A", "S", 0.5, 0.9, None), ("2", "2024-01-01", "A", "S", -0.2, 0.8, None)], PRED)
    rows = {r.news_id: r for r in impact.news_impact(df, providers=("prediction_metadata",)).collect()}
    assert rows["1"].I_n == pytest.approx(0.45) and rows["1"].R_n == 0
    assert rows["2"].R_n == pytest.approx(0.16)


def test_impact_with_metadata(spark):
    meta = json.dumps({"magnitude": 2, "relevance": 0.5, "event_weight": 1.5, "novelty": 0.8, "risk": 1.2})
    df = spark.createDataFrame([("1", "2024-01-01", "A", "S", 0.4, 0.7, meta), ("2", "2024-01-01", "A", "S", 0.4, 0.7, "not json"), ("3", "2024-01-01", "A", "S", 0.4, 0.7, '["a"]')], PRED)
    rows = {r.news_id: r.I_n for r in impact.news_impact(df, providers=("prediction_metadata",)).collect()}
    assert rows["1"] == pytest.approx(0.4 * 2 * 0.5 * 0.7 * 1.5 * 0.8)
    assert rows["2"] == rows["3"] == pytest.approx(0.28)


def test_bad_date_is_an_error(spark):
    df = spark.createDataFrame([("1", "soon", "A", "S", 0.5, 0.9, None)], PRED)
    with pytest.raises(Exception, match="invalid date"):
        impact.news_impact(df, providers=()).collect()


def test_daily_impact_falls_back_to_the_mean(spark):
    df = spark.createDataFrame([("1", "2024-01-01", None, None, 0.5, 0.0, None), ("2", "2024-01-01", None, None, 0.1, 0.0, None)], PRED)
    row = impact.daily_impact(impact.news_impact(df, providers=())).first()
    assert (row.company, row.sector, row.impacto_dia, row.news_count) == ("UNKNOWN", "UNKNOWN", 0.0, 2)


def test_baselines(spark):
    df = spark.createDataFrame([("1", "2024-01-01", "A", "S", 0.4, 0.9, None), ("2", "2024-01-01", "A", "S", -0.2, 0.8, None), ("3", "2024-01-02", "A", "S", 0.3, 0.5, None)], PRED)
    row = impact.baselines_daily(df).where("date = '2024-01-01'").first()
    assert row.b0_news_count == 2 and row.b1_mean_sentiment == pytest.approx(0.1)
    assert row.b2_confidence_weighted_sentiment == pytest.approx((0.36 - 0.16) / 1.7)


DAILY = "company string, sector string, date date, impacto_dia double, risco_dia double, news_count long, mean_horizon double"


def test_recurrence_with_a_gap_day(spark):
    df = spark.createDataFrame([("A", "S", date(2024, 1, 1), 1.0, 0.0, 1, 1.0), ("A", "S", date(2024, 1, 3), -1.0, 1.0, 1, 1.0)], DAILY)
    rows = recurrence.index_daily(df, alpha=0.5).orderBy("date").collect()
    assert [r.iti_liquido for r in rows] == pytest.approx([0.5, 0.25, -0.375])
    assert [r.news_count for r in rows] == [1, 0, 1]


def test_horizon_slows_decay(spark):
    df = spark.createDataFrame([("A", "S", date(2024, 1, 1), 1.0, 0.0, 1, 2.0)], DAILY)
    assert recurrence.index_daily(df, alpha=0.5).first().iti_liquido == pytest.approx(1 - 0.5**0.5)


def loop(days, alpha, initial):
    """The recurrence day by day."""
    out, s, r, day = [], initial, initial, min(days)
    while day <= max(days):
        if day in days:
            x, q, h = days[day]
            a = max(0.01, min(0.999, alpha ** (1 / max(h, 0.05))))
            s, r = a * s + (1 - a) * x, a * r + (1 - a) * q
        else:
            s, r = alpha * s, alpha * r
        out.append((day, s, r))
        day += timedelta(days=1)
    return out


@pytest.mark.parametrize("alpha,initial", [(0.85, 0.0), (0.3, 0.7), (0.02, -0.4)])
def test_recurrence_over_many_blocks(spark, alpha, initial):
    rnd, rows, want = random.Random(3), [], {}
    for k in range(4):
        start = date(2000 + k, 1, 1)
        days = {start + timedelta(days=rnd.randrange(900)): (rnd.uniform(-1, 1), rnd.random(), rnd.choice([0.01, 0.5, 1.0, 2.0])) for _ in range(250)}
        rows += [(f"C{k}", None if k == 3 else "S", d, x, q, 1, h) for d, (x, q, h) in days.items()]
        want[f"C{k}"] = loop(days, alpha, initial)
    got = recurrence.index_daily(spark.createDataFrame(rows, DAILY), alpha, initial).orderBy("company", "date").collect()
    flat = [(c, *w) for c in sorted(want) for w in want[c]]
    assert len(got) == len(flat)
    for g, (c, d, s, r) in zip(got, flat, strict=True):
        assert (g.company, g.date) == (c, d) and g.iti_liquido == pytest.approx(s, abs=1e-12) and g.iti_risco == pytest.approx(r, abs=1e-12)


def test_alpha_is_checked(spark):
    with pytest.raises(ValueError):
        recurrence.index_daily(spark.createDataFrame([], DAILY), alpha=1.5)
    assert recurrence.index_daily(spark.createDataFrame([], DAILY)).count() == 0


def test_levels_count_companies(spark):
    df = spark.createDataFrame([(date(2024, 1, 1), c, s, 1.0 * k, 0.0, 1, 1.0 * k, 0.0) for k, (c, s) in enumerate([("A", "S"), ("A", "T"), ("B", "S")])], "date date, company string, sector string, impacto_dia double, risco_dia double, news_count long, iti_liquido double, iti_risco double")
    market = levels.level_daily(df, "market").first()
    assert (market.company_count, market.news_count, market.iti_liquido) == (2, 3, 1.0)
    assert levels.level_daily(df, "sector").count() == 2


def test_weeks_are_named_by_their_sunday(spark):
    df = spark.createDataFrame([(date(2024, 1, 1) + timedelta(days=i), "A", "S", 1.0, 0.0, 1, float(i), 0.0) for i in range(10)], "date date, company string, sector string, impacto_dia double, risco_dia double, news_count long, iti_liquido double, iti_risco double")
    rows = levels.resample(df, "weekly").orderBy("period_start").collect()
    assert [r.period_start for r in rows] == [date(2024, 1, 7), date(2024, 1, 14)]
    assert [r.period_end for r in rows] == [date(2024, 1, 7), date(2024, 1, 10)] and [r.news_count for r in rows] == [7, 3]
    assert levels.resample(df, "quarterly").first().period_start == date(2024, 3, 31)


def test_disagreement(spark):
    schema = "news_id string, date string, company string, sector string, d double"
    a, b = (spark.createDataFrame([("1", "2024-01-01", "A", None, d)], schema) for d in (0.2, 0.6))
    news, daily = uncertainty.merge_uncertainty({"m1": a, "m2": b})
    row = news.first()
    assert row.disagreement_var == pytest.approx(0.08) and row.model_count == 2 and row.sector == "UNKNOWN"
    assert daily.first().disagreement_max == pytest.approx(0.08)
    assert uncertainty.merge_uncertainty({"m1": a}) is None


def test_dimension_providers(spark):
    from tidemark.functions import dimensions

    df = spark.createDataFrame(
        [(1, "Sabesp recebe multa", "A SBSP3 investiga", "Sabesp", "SBSP3", -0.5, 0.9, "1.5"), (2, "Sabesp  RECEBE multa", "hoje", "Outra", None, 0.5, 0.9, None), (3, " ", None, "Sabesp", None, -0.5, 0.9, "x")],
        "row_id long, title string, text string, company string, ticker string, continuous_sentiment double, confidence double, m string",
    )
    rows = {r.row_id: r for r in dimensions.resolve(df, {"relevance": 0.4}).collect()}
    assert rows[1].dim_relevance == 1.0 and rows[1].dim_event_weight == 1.15 and rows[1].dim_risk == 1.1 and rows[1].dim_novelty == 1.0 and rows[1].dim_magnitude == 1.5
    assert rows[2].dim_novelty == 0.75 and rows[2].dim_relevance == 0.65 and rows[2].dim_horizon == 0.75
    assert rows[3].dim_relevance == 0.4 and rows[3].dim_risk == 1.0 and rows[3].dim_magnitude == 1.0
    seen = spark.createDataFrame([("sabesp recebe multa",)], "title string")
    again = {r.row_id: r for r in dimensions.resolve(df, prior_titles=seen).collect()}
    assert again[1].dim_novelty == 0.75


def test_last_provider_wins(spark):
    from tidemark.functions import dimensions

    df = spark.createDataFrame([(1, "0.4", '{"r": 1.7, "m": "bad"}')], "row_id long, r string, prediction_metadata string")
    both = df.withColumn("continuous_sentiment", F.lit(0.0)).withColumn("confidence", F.lit(0.0))
    assert dimensions.resolve(both, providers=("dataset_columns", "prediction_metadata")).first().dim_relevance == 1.7
    assert dimensions.resolve(both, providers=("prediction_metadata", "dataset_columns")).first().dim_relevance == 0.4


def test_filled_days_are_sorted_once(spark):
    """One sort of the days that came and one of the filled ones, whatever windows go over them."""
    made = recurrence.index_daily(spark.range(3).selectExpr("date_add(date'2024-01-01', cast(id as int)) AS date", "'A' AS company", "'S' AS sector", "1.0D AS impacto_dia", "0.0D AS risco_dia", "1L AS news_count", "1.0D AS mean_horizon"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 2, plan
