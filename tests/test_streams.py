"""Streams with state: the index with late days and silent series, calendar periods, against their batch forms."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import levels, recurrence
from tidemark.streaming import index as stream_index
from tidemark.streaming import periods

from .conftest import same

DAILY = "date date, company string, sector string, impacto_dia double, risco_dia double, news_count long, mean_horizon double"
D0 = date(2024, 1, 1)


def fed(spark, tmp_path, make, schema, batches):
    """What a stream has written after each of ``batches``, one micro-batch each."""
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out"))


def day(d, company="A", impact=None, horizon=1.0):
    return (D0 + timedelta(days=d), company, "S", 0.1 * d if impact is None else impact, 0.05 * d, 1, horizon)


def batch(spark, rows):
    return sorted((r.company, r.date, round(r.iti_liquido, 9), round(r.iti_risco, 9)) for r in recurrence.index_daily(spark.createDataFrame(rows, DAILY)).collect())


def test_days_in_any_order_give_the_batch_index(spark, tmp_path):
    rows = [day(d, c, horizon=1.0 + d % 3) for c in "AB" for d in range(0, 60, 2 if c == "A" else 7)]
    np.random.default_rng(4).shuffle(rows)
    rows = [(r[0], *map(str, r[1:3]), *map(float, r[3:5]), int(r[5]), float(r[6])) for r in rows]
    out = fed(spark, tmp_path, stream_index.index_stream, DAILY, [rows[:5], rows[5:20], rows[20:]])
    got = sorted((r.company, r.date, round(r.iti_liquido, 9), round(r.iti_risco, 9)) for r in stream_index.newest(out).collect())
    assert got == batch(spark, rows)
    assert {r.kind for r in out.select("kind").distinct().collect()} == {"day", "late", "corrected"}


def test_late_days_say_what_they_change(spark, tmp_path):
    come = [day(0), day(1), day(6), day(30)]
    out = fed(spark, tmp_path, lambda s: stream_index.index_stream(s, window=28), DAILY, [come, [day(4, impact=3.0), day(8, impact=-2.0), day(1, impact=9.0)]])
    rows = out.collect()
    assert [(r.date, r.kind) for r in rows if r.kind == "too_late"] == [(D0 + timedelta(days=1), "too_late")]
    late = {r.date: r for r in rows if r.kind == "late"}
    assert set(late) == {D0 + timedelta(days=4), D0 + timedelta(days=8)}
    last = D0 + timedelta(days=30)
    before, after = (next(r for r in rows if r.date == last and r.version == v) for v in (1, 2))
    assert sum(r.net_correction for r in late.values()) == pytest.approx(after.iti_liquido - before.iti_liquido, abs=1e-12)
    assert sum(r.risk_correction for r in late.values()) == pytest.approx(after.iti_risco - before.iti_risco, abs=1e-12)
    got = sorted((r.company, r.date, round(r.iti_liquido, 9), round(r.iti_risco, 9)) for r in stream_index.newest(out).collect())
    assert got == batch(spark, [*come, day(4, impact=3.0), day(8, impact=-2.0)])


def test_silent_series_decay_to_the_watermark(spark, tmp_path):
    out = fed(spark, tmp_path, lambda s: stream_index.index_stream(s, window=5, decay_silent=True), DAILY, [[day(0, impact=1.0), day(1, impact=1.0), day(0, "B")], [day(20, "B")], [day(21, "B")], [day(22, "B")]])
    rows = {r.date: r for r in stream_index.newest(out).where("company = 'A'").collect()}
    # The watermark stands at day 20 - 5 or later: days before it are over.
    assert max(rows) >= D0 + timedelta(days=14)
    for d in range(2, 14):
        r = rows[D0 + timedelta(days=d)]
        assert r.news_count == 0 and r.iti_liquido == pytest.approx(rows[D0 + timedelta(days=1)].iti_liquido * 0.85 ** (d - 1))


def test_series_of_a_bucket_keep_their_own_calendars(spark, tmp_path):
    rows = [day(d, f"C{c}", impact=float(c) - d, horizon=1.0 + c % 3) for c in range(12) for d in range(c, 30, 1 + c % 4)]
    rows = sorted(rows, key=lambda r: (r[0].day * 7 + int(r[1][1:]) * 5) % 11)
    out = fed(spark, tmp_path, lambda s: stream_index.index_stream(s, buckets=1), DAILY, [rows[:40], rows[40:]])
    got = sorted((r.company, r.date, round(r.iti_liquido, 9), round(r.iti_risco, 9)) for r in stream_index.newest(out).collect())
    assert got == batch(spark, rows)


def test_levels_over_many_blocks():
    r = np.random.default_rng(2)
    a, b = r.uniform(0.01, 0.999, 5000), r.normal(size=5000)
    want, s = [], 2.0
    for x, y in zip(a, b, strict=True):
        s = x * s + y
        want.append(s)
    assert np.allclose(stream_index.levels(2.0, a, b), want, rtol=1e-9, atol=1e-12)


INDEX = "date date, company string, sector string, impacto_dia double, risco_dia double, news_count long, iti_liquido double, iti_risco double"


@pytest.mark.parametrize("frequency", ["weekly", "monthly", "quarterly"])
def test_periods_close_with_the_watermark(spark, tmp_path, frequency):
    r = np.random.default_rng(7)
    rows = [(D0 + timedelta(days=int(d)), c, "S", float(r.normal()) if d % 9 else None, 0.1, int(d % 4), float(r.normal()), float(r.normal())) for c in "AB" for d in range(0, 120)]
    by_day = sorted(rows, key=lambda x: x[0])
    closing = [(D0 + timedelta(days=400 + k), "end", "S", 0.0, 0.0, 0, 0.0, 0.0) for k in range(2)]
    out = fed(spark, tmp_path, lambda s: periods.resample_stream(s, frequency), INDEX, [by_day[:100], by_day[100:], closing[:1], closing[1:]])
    want = levels.resample(spark.createDataFrame(rows, INDEX), frequency)
    cols = ["company", "period_start", "period_end", "impacto_dia_mean", "impacto_dia_sum", "iti_liquido_mean", "iti_liquido_min", "iti_liquido_max", "iti_liquido_std", "iti_risco_mean", "news_count", "frequency"]
    same([tuple(x) for x in out.where("company <> 'end'").select(*cols).collect()], [tuple(x) for x in want.select(*cols).collect()])
    assert out.select(F.count_distinct("company", "period_start"), F.count(F.lit(1))).first()[0] == out.count()


@pytest.mark.parametrize("frequency", ["monthly", "quarterly"])
def test_late_days_of_open_periods_count(spark, tmp_path, frequency):
    row = lambda d, c="A": (D0 + timedelta(days=d), c, "S", 1.0 + d, 0.1, 1, 0.5 * d, 0.2)
    rows = [row(0), row(25), row(3), row(20)]  # the watermark stands at day 23 when days 3 and 20 come
    out = fed(spark, tmp_path, lambda s: periods.resample_stream(s, frequency), INDEX, [rows[:2], rows[2:], [row(400, "end")], [row(401, "end"), row(5)]])
    want = levels.resample(spark.createDataFrame(rows, INDEX), frequency)  # without day 5, which comes after its period
    got = out.where("company <> 'end'").select(*want.columns)
    same([tuple(x) for x in got.collect()], [tuple(x) for x in want.collect()])
