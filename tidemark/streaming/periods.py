"""Weeks, months and quarters of a stream: sessions that end with their period, closed by the watermark.

Windows of event time have one length, which months do not. A session's gap may be an expression, though: that of a day
reaches to just before the end of its period, so the days of a series and period are one session, which the next period's
does not touch, and a series' state is looked up once a batch. A session comes out once the watermark has passed its end; rows of a period that is closed come after the watermark and are dropped
by Spark, while a late row of one that is still open counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.levels import period_label, statistics
from .index import use_rocksdb


def resample_stream(index: DataFrame, frequency: str, delay: str = "2 days") -> DataFrame:
    """A row for each series and period of a stream of index days (``date``), after the watermark has passed the period's end."""
    use_rocksdb(index.sparkSession)
    rows = index.withColumn("day_at", F.col("date").cast("timestamp")).withWatermark("day_at", delay)
    rest = F.make_interval(days=F.datediff(period_label(F.col("date"), frequency), "date") + 1, secs=F.lit(-1e-6))
    made = rows.groupBy("company", "sector", F.session_window("day_at", rest)).agg(*statistics())
    return made.drop("session_window").withColumns({"period_start": period_label(F.col("period_end"), frequency), "frequency": F.lit(frequency)})
