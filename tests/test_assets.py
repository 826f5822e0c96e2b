"""Presence checks, samples, quotes and run times."""

import pandas as pd
import pytest

from tidemark.plans.monitor import Monitor
from tidemark.sources import assets


def test_missing_and_samples(spark, tmp_path):
    df = spark.range(10)
    path = assets.materialize_sample(df, str(tmp_path / "s"), max_rows=3, order="id")
    assert sorted(r.id for r in spark.read.json(path).collect()) == [0, 1, 2]
    assets.materialize_sample(df, str(tmp_path / "c"), "csv", 2)
    assert assets.missing(spark, {"datasets": {"a": path, "b": str(tmp_path / "no")}}) == ["datasets:b"]
    with pytest.raises(ValueError):
        assets.materialize_sample(df, path, "xml")


def test_quotes(spark):
    tickers = spark.createDataFrame([("A",), ("B",)], "ticker string")

    def client(ticker, start, end):
        index = pd.to_datetime(["2024-01-02", "2024-01-03"])
        return pd.DataFrame({("Open", ticker): [1.0, 2.0], ("Close", ticker): [3.0, float("nan")]}, index=index)

    got = assets.fetch_quotes(tickers, "2024-01-01", "2024-02-01", client).collect()
    assert sorted((str(r.date), r.ticker, r.close) for r in got) == [("2024-01-02", "A", 3.0), ("2024-01-02", "B", 3.0)]
    with pytest.raises(Exception, match="no quotes"):
        assets.fetch_quotes(tickers, "", "", lambda *a: pd.DataFrame()).collect()


def test_fetch_stops_at_the_first_failure(spark, tmp_path):
    def fail(path):
        raise OSError("offline")

    (tmp_path / "here").write_text("x")
    steps = [("m", "a", str(tmp_path / "here"), fail), ("m", "b", str(tmp_path / "new"), lambda p: open(p, "w").close()), ("d", "c", str(tmp_path / "x"), fail), ("d", "e", str(tmp_path / "y"), fail)]
    assert [(r.key, r.status) for r in assets.fetch_all(spark, steps)] == [("a", "present"), ("b", "fetched"), ("c", "failed")]


def test_monitor(spark):
    m = Monitor()
    with m.phase("inference", 10):
        pass
    row = m.execution_metrics(spark, "failed", ValueError("x"), model_key="m").first()
    assert row.status == "failed" and row.error_type == "ValueError" and row.texts_per_second > 0 and row.load_time_seconds is None
