"""Assets of a configuration: what is missing, samples written down, quotes fetched through a given client."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import market
from . import files, sinks


@dataclass(frozen=True)
class Report:
    key: str
    kind: str
    status: str  # present, fetched or failed
    path: str
    detail: str = ""


def missing(spark: SparkSession, assets: dict[str, dict[str, str]]) -> list[str]:
    """``kind:key`` of each path (by kind, then key) that is not there."""
    return [f"{kind}:{key}" for kind, paths in assets.items() for key in files.missing(spark, paths)]


def materialize_sample(rows: DataFrame, path: str, fmt: str = "jsonl", max_rows: int = 200, order: str | None = None) -> str:
    """The first rows of a source as CSV or lines of JSON."""
    first = (rows.orderBy(order) if order else rows).limit(max_rows)
    if fmt == "csv":
        return sinks.write_csv(first, path, overwrite=True)
    if fmt != "jsonl":
        raise ValueError(f"format {fmt!r} is neither csv nor jsonl")
    first.write.mode("overwrite").json(path)
    return path


def fetch_quotes(tickers: DataFrame, start: str, end: str, client: Callable[[str, str, str], pd.DataFrame], close: str = "close") -> DataFrame:
    """Daily closes of each ticker by ``client(ticker, start, end)``; an error or an empty answer stops the job.

    Wide frames may have several column levels: the first with a level named close counts.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for ticker in frame["ticker"]:
                got = client(ticker, start, end)
                if got is None or got.empty:
                    raise ValueError(f"no quotes for {ticker}")
                flat = got.reset_index()
                column = market.close_column(list(got.columns))
                yield pd.DataFrame({"date": pd.to_datetime(flat.iloc[:, 0]).dt.strftime("%Y-%m-%d"), "ticker": ticker, close: got[column].to_numpy(float)})

    raw = tickers.select("ticker").mapInPandas(run, f"date string, ticker string, {close} double")
    numbered = raw.withColumnRenamed(close, "close").withColumn("row_id", F.monotonically_increasing_id())
    return market.sanitize_prices(numbered)


def fetch_all(spark: SparkSession, steps: list[tuple[str, str, str, Callable[[str], None]]], force: bool = False) -> list[Report]:
    """(kind, key, path, fetch) in order; what is there stays, the first failure ends the list."""
    out = []
    for kind, key, path, fetch in steps:
        if not force and files.exists(spark, path):
            out.append(Report(key, kind, "present", path))
            continue
        try:
            fetch(path)
            out.append(Report(key, kind, "fetched", path))
        except Exception as e:  # noqa: BLE001  the report carries the failure
            out.append(Report(key, kind, "failed", path, f"{type(e).__name__}: {e}"))
            break
    return out
