"""The persistent index as a stateful operator with late days, corrections and decay of silent series.

The state of a series is its last ``window`` days: what each day added and how it decayed, and the level before them. A
batch of days, in any order, is laid into that calendar; levels are computed again from the first day that changed, by a
closed form over blocks of days. So a late day within the window changes the levels after it as if it had come in time.

Series are dealt out to ``buckets`` by a hash, and a bucket is a key with its series' calendars as one value, so a batch costs
a few calls a bucket and none a series; their number stays the same for the life of a checkpoint.

Rows of the output, by ``kind``: ``day``, a day after the series' last one (or a day between two of them without news);
``late``, a day that came after a later one, with the correction of the last level before this batch that it causes;
``corrected``, another day whose level changed; ``too_late``, a day before the window, which changes nothing. ``version``
counts the batches of a series: of the rows of a day the one of the highest version holds.

With ``decay_silent`` a series without news goes on: its bucket's timer, set to the end of the day after the first last one
of a series, fills the calendars up to the watermark. Days are event times then, and ``window`` is the watermark's delay.

The state is kept by RocksDB, which this kind of operator needs; ``index_stream`` asks the session for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.recurrence import HIGHEST, LOWEST

OUTPUT = (
    "date date, company string, sector string, impacto_dia double, risco_dia double, news_count bigint, iti_liquido double, iti_risco double, "
    "kind string, version bigint, net_correction double, risk_correction double"
)
_STATE = (
    "company array<string>, sector array<string>, first array<int>, net array<double>, risk array<double>, trimmed array<boolean>, version array<bigint>, days array<int>, "
    "a binary, impact binary, risk_impact binary, news binary"
)
#: A series' arrays by day, each one binary column of doubles in a bucket's state.
_BY_DAY = ("a", "impact", "risk_impact", "news")
_DAY_MS = 86_400_000

#: The summed logarithms of a block's decays stay under this, so that exp() stays finite.
LOG_ROOM = 600.0


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def decays(alpha: float, horizons: np.ndarray, mode: str = "ewma_alpha") -> np.ndarray:
    if mode != "ewma_alpha":
        return np.full(len(horizons), alpha)
    h = np.where(np.isnan(horizons), 1.0, horizons)
    return np.clip(alpha ** (1 / np.maximum(h, 0.05)), LOWEST, HIGHEST)


def levels(before: float, a: np.ndarray, added: np.ndarray) -> np.ndarray:
    """s[t] = a[t] * s[t-1] + added[t] from s[-1] = ``before``: exp(L) * (s + sum(added * exp(-L))), block by block."""
    out = np.empty(len(a))
    logs = np.log(a)
    block = np.floor(np.cumsum(-logs) / LOG_ROOM).astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(a)]
    for lo, hi in zip(edges, edges[1:], strict=False):
        grown = np.cumsum(logs[lo:hi])
        out[lo:hi] = np.exp(grown) * (before + np.cumsum(added[lo:hi] * np.exp(-grown)))
        before = out[hi - 1] if hi > lo else before
    return out


def _number(day: date) -> int:
    return day.toordinal()


class Calendar:
    """A series' days from ``first`` on: decay, impacts and news of each; ``net`` and ``risk`` are the levels before them."""

    def __init__(self, alpha: float, initial: float, state: tuple | None = None) -> None:
        self.alpha = alpha
        if state is None:
            self.first, self.net, self.risk, self.trimmed, self.version = None, initial, initial, False, 0
            self.a, self.impact, self.risk_impact, self.news = (np.empty(0) for _ in range(4))
        else:
            self.first, self.net, self.risk, self.trimmed, self.version = state[:5]
            self.a, self.impact, self.risk_impact, self.news = (np.asarray(x, float) for x in state[5:])

    @property
    def last(self) -> int | None:
        return None if self.first is None else self.first + len(self.a) - 1

    def reach(self, low: int, high: int) -> None:
        """Days without news so that the calendar goes from ``low`` at the latest to ``high`` at the earliest."""
        if self.first is None:
            self.first = low
        ahead, behind = max(0, self.first - low), max(0, high - self.first + 1 - len(self.a))
        self.first -= ahead
        self.a = np.concatenate([np.full(ahead, self.alpha), self.a, np.full(behind, self.alpha)])
        for name in ("impact", "risk_impact", "news"):
            setattr(self, name, np.concatenate([np.zeros(ahead), getattr(self, name), np.zeros(behind)]))

    def levels(self) -> tuple[np.ndarray, np.ndarray]:
        gain = 1 - self.a
        return levels(self.net, self.a, gain * self.impact), levels(self.risk, self.a, gain * self.risk_impact)

    def trim(self, window: int, net: np.ndarray, risk: np.ndarray) -> None:
        if (cut := len(self.a) - window) > 0:
            self.net, self.risk, self.trimmed, self.first = float(net[cut - 1]), float(risk[cut - 1]), True, self.first + cut
            self.a, self.impact, self.risk_impact, self.news = (x[cut:] for x in (self.a, self.impact, self.risk_impact, self.news))



def _packed(series: dict[tuple, Calendar]) -> tuple:
    """The state of a bucket's series: lists of one entry a series, and their days end to end."""
    held = series.values()
    of = lambda name: [getattr(c, name) for c in held]
    return ([k[0] for k in series], [k[1] for k in series], *(of(n) for n in ("first", "net", "risk", "trimmed", "version")), [len(c.a) for c in held], *(np.concatenate(of(n)).tobytes() for n in _BY_DAY))


def _unpacked(alpha: float, initial: float, state: tuple) -> dict[tuple, Calendar]:
    company, sector, *values, days = state[:8]
    ends = np.cumsum(days)[:-1]
    by_day = (np.split(np.frombuffer(x), ends) for x in state[8:])
    return {key: Calendar(alpha, initial, s) for key, *s in zip(zip(company, sector, strict=True), *values, *by_day, strict=True)}


class Rows:
    """Rows of the output, collected by series."""

    def __init__(self) -> None:
        self.keys, self.sizes, self.columns = [], [], []

    def add(self, key: tuple, *columns) -> None:
        """From ``date``, as numbers, on; without the keys."""
        self.keys.append(key)
        self.sizes.append(len(columns[0]))
        self.columns.append(columns)

    def frame(self) -> Iterator[pd.DataFrame]:
        if self.keys:
            numbers, *values = (np.concatenate(c) for c in zip(*self.columns, strict=True))
            days, at = np.unique(numbers, return_inverse=True)
            named = {n: np.repeat(np.array([k[i] for k in self.keys], object), self.sizes) for i, n in enumerate(("company", "sector"))}
            names = [c.split()[0] for c in OUTPUT.split(", ") if c.split()[0] not in named and not c.startswith("date")]
            made = pd.DataFrame({"date": np.array([date.fromordinal(int(d)) for d in days], object)[at], **named, **dict(zip(names, values, strict=True))})
            yield made.astype({"news_count": "int64", "version": "int64"})


class IndexProcessor(StatefulProcessor):
    def __init__(self, alpha: float, initial: float, mode: str, window: int, decay_silent: bool) -> None:
        self.alpha, self.initial, self.mode, self.window, self.decay_silent = alpha, initial, mode, window, decay_silent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("calendars", _STATE)

    def close(self) -> None:
        pass

    def _series(self) -> dict[tuple, Calendar]:
        state = self.kept.get()
        return _unpacked(self.alpha, self.initial, tuple(state)) if state is not None else {}

    def _keep(self, series: dict[tuple, Calendar]) -> None:
        self.kept.update(_packed(series))
        if self.decay_silent:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((min(c.last for c in series.values()) + 2 - _number(date(1970, 1, 1))) * _DAY_MS)

    @staticmethod
    def _add(out: Rows, key: tuple, calendar: Calendar, at: np.ndarray, net: np.ndarray, risk: np.ndarray, kinds, corrections=None) -> None:
        none = np.full(len(at), np.nan)
        out.add(
            key, calendar.first + at, calendar.impact[at], calendar.risk_impact[at], calendar.news[at], net[at], risk[at],
            np.asarray(kinds, object), np.full(len(at), calendar.version), *(corrections or (none, none)),
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows))
        days = np.array([_number(d) for d in came["date"]])
        horizons = came["mean_horizon"].to_numpy(float)
        values = tuple(came[c].fillna(0).to_numpy(float) for c in ("impacto_dia", "risco_dia", "news_count"))
        given = tuple(came[c].to_numpy(float) for c in ("impacto_dia", "risco_dia", "news_count"))
        places: dict[tuple, list[int]] = {}
        for i, k in enumerate(zip(came["company"].tolist(), came["sector"].tolist(), strict=True)):
            places.setdefault(k, []).append(i)
        series, out = self._series(), Rows()
        for k, at in places.items():
            calendar = series.get(k)
            if calendar is None:
                calendar = series[k] = Calendar(self.alpha, self.initial)
            self._take(out, k, calendar, np.array(at), days, horizons, values, given)
        self._keep(series)
        yield from out.frame()

    def _take(self, out: Rows, key: tuple, calendar: Calendar, came: np.ndarray, days: np.ndarray, horizons: np.ndarray, values: tuple, given: tuple) -> None:
        """Lays the rows ``came`` of a batch into their series' calendar."""
        calendar.version += 1
        if calendar.first is not None and calendar.trimmed:
            lost = days[came] < calendar.first
            if lost.any():
                gone = came[lost]
                none = np.full(len(gone), np.nan)
                out.add(key, days[gone], *(np.nan_to_num(v[gone]) if v is given[2] else v[gone] for v in given), none, none, np.full(len(gone), "too_late", object), np.full(len(gone), calendar.version), none, none)
                came = came[~lost]
                if not len(came):
                    return
        last_before = calendar.last
        days = days[came]
        calendar.reach(int(days.min()), int(days.max()))
        old_a, old_impact, old_risk = calendar.a.copy(), calendar.impact.copy(), calendar.risk_impact.copy()
        at = days - calendar.first
        calendar.a[at] = decays(self.alpha, horizons[came], self.mode)
        calendar.impact[at], calendar.risk_impact[at], calendar.news[at] = (v[came] for v in values)
        net, risk = calendar.levels()
        end = -1 if last_before is None else last_before - calendar.first
        changed = np.arange(at.min() if end < 0 else min(at.min(), end + 1), len(calendar.a))  # with the days without news before a new one
        kinds, effects = np.full(len(changed), "day", object), None
        if changed[0] <= end:
            new = np.zeros(len(calendar.a), bool)
            new[at] = True
            late = (changed <= end) & new[changed]
            kinds[changed <= end], kinds[late] = "corrected", "late"
            # What each late day does to the last level before: its own change, decayed by all days from it to that one.
            later = np.concatenate([np.cumsum(np.log(calendar.a[: end + 1])[::-1])[::-1][1:], [0.0]])
            moved, effects = changed[late], []
            for level, base, old in ((net, calendar.net, old_impact), (risk, calendar.risk, old_risk)):
                jump = level - (old_a * np.concatenate([[base], level[:-1]]) + (1 - old_a) * old)
                effects.append(np.full(len(changed), np.nan))
                effects[-1][late] = jump[moved] * np.exp(later[moved])
        self._add(out, key, calendar, changed, net, risk, kinds, effects)
        calendar.trim(self.window, net, risk)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        series, out = self._series(), Rows()
        until = timerValues.getCurrentWatermarkInMs() // _DAY_MS + _number(date(1970, 1, 1)) - 1  # the last day that is over
        for k, calendar in series.items():
            if (start := len(calendar.a)) <= until - calendar.first:
                calendar.reach(calendar.first, until)
                calendar.version += 1
                net, risk = calendar.levels()
                at = np.arange(start, len(calendar.a))
                self._add(out, k, calendar, at, net, risk, ["day"] * len(at))
                calendar.trim(self.window, net, risk)
        self._keep(series)
        yield from out.frame()


def index_stream(daily: DataFrame, alpha: float = 0.85, initial: float = 0.0, mode: str = "ewma_alpha", window: int = 60, decay_silent: bool = False, buckets: int = 1024) -> DataFrame:
    """``daily``: date, company, sector, impacto_dia, risco_dia, news_count, mean_horizon; a day's row may come once or be replaced."""
    if not 0 < alpha < 1:
        raise ValueError("alpha lies between 0 and 1")
    use_rocksdb(daily.sparkSession)
    rows = daily.withColumn("day_at", F.col("date").cast("timestamp")).withWatermark("day_at", f"{window} days") if decay_silent else daily
    processor = IndexProcessor(alpha, initial, mode, window, decay_silent)
    return rows.withColumn("bucket", F.pmod(F.xxhash64("company", "sector"), F.lit(buckets))).groupBy("bucket").transformWithStateInPandas(processor, outputStructType=OUTPUT, outputMode="append", timeMode="EventTime" if decay_silent else "None")


def newest(made: DataFrame) -> DataFrame:
    """The rows that hold: each day's of the highest version."""
    columns = ("impacto_dia", "risco_dia", "news_count", "iti_liquido", "iti_risco")
    held = made.where("kind <> 'too_late'").groupBy("date", "company", "sector").agg(F.max_by(F.struct(*columns), "version").alias("r"))
    return held.select("date", "company", "sector", *(f"r.{c}" for c in columns))
