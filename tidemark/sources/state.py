"""What a collector remembers between runs: a small document on sites, and a growing table of URLs."""

from __future__ import annotations

import json
import uuid
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus
from . import files, sinks


class ScrapeState:
    """``state.json`` under ``path`` has a site's last day and run; ``seen_urls`` has normalized URLs, a part for each run.

    The URLs stay a table, since they grow with the corpus; a run adds those that are not there yet.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.sites: dict[str, dict[str, str]] = {}
        if files.exists(spark, f"{self.path}/state.json"):
            held = json.loads(spark.read.text(f"{self.path}/state.json", wholetext=True).first()[0])
            self.sites = held.get("sites", {}) if isinstance(held, dict) else {}

    def seen(self) -> DataFrame:
        """url, once each."""
        folder = f"{self.path}/seen_urls"
        if not files.exists(self.spark, folder):
            return self.spark.createDataFrame([], "url string")
        return self.spark.read.schema("url string").option("recursiveFileLookup", "true").parquet(folder)

    def update(self, site: str, last_until: date | str, urls: DataFrame | None = None) -> None:
        """Notes a site's run; ``urls`` (column url) are added first, so a run that fails in between is only looked at again."""
        if urls is not None:
            corpus.seen_urls(urls).join(self.seen(), "url", "left_anti").write.parquet(f"{self.path}/seen_urls/{uuid.uuid4().hex}")
        self.sites[site] = {"last_until": str(last_until), "last_run": datetime.now().isoformat(timespec="seconds")}
        sinks.write_json(self.spark, f"{self.path}/state.json", {"sites": self.sites})

    def unseen(self, hits: DataFrame) -> DataFrame:
        return corpus.not_seen(hits, self.seen())

    def window(self, default_since: str, records: DataFrame | None = None, today: date | None = None) -> tuple[str, str]:
        """(since, until) of the next run."""
        return corpus.cron_window(records, [s.get("last_until", "") for s in self.sites.values()], default_since, today)
