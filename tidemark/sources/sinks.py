"""Results to files: one layout for runs, CSV with fixed decimals, JSON without NaN."""

from __future__ import annotations

import json
import math
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, MapType, StructType

STATUSES = ("pending", "running", "success", "failed", "skipped")


def csv_ready(df: DataFrame, decimals: int = 8) -> DataFrame:
    """Doubles with fixed decimals, nested values as JSON; nulls stay empty."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.when(~F.isnan(c), F.format_string(f"%.{decimals}f", c))
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, overwrite: bool = False, single: bool = False) -> str:
    """A folder of CSV parts; Spark's committer makes it appear whole or not at all. ``single`` is for small results."""
    ready = csv_ready(df)
    (ready.coalesce(1) if single else ready).write.mode("overwrite" if overwrite else "errorifexists").option("header", "true").option("escape", '"').option("emptyValue", "").csv(path)
    return path


def write_daily(df: DataFrame, path: str, overwrite: bool = False) -> str:
    """A daily table as CSV, its parts in the order of days and keys: the days are dealt to parts by ranges."""
    keys = [c for c in ("date", "company", "sector") if c in df.columns]
    return write_csv(df.repartitionByRange(*keys).sortWithinPartitions(*keys), path, overwrite)


def confusion_table(rows: DataFrame) -> DataFrame:
    """A confusion matrix (true_label, then a column a predicted label) as (true_label, predicted_label, count)."""
    predicted = [c for c in rows.columns if c != "true_label"]
    each = F.array(*[F.struct(F.lit(c.upper()).alias("predicted_label"), F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(0)).alias("count")) for c in predicted])
    return rows.select("true_label", F.explode(each).alias("c")).select("true_label", "c.*")


def write_table(df: DataFrame, path: str, partition: tuple[str, ...] = ("model_key", "dataset_key"), overwrite: bool = False) -> str:
    """Parquet, partitioned by combination where it has one."""
    by = [c for c in partition if c in df.columns]
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*by).parquet(path)
    return path


def write_corpus(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    from ..operators import corpus

    corpus.as_records(df).drop("row_id").write.mode(mode).options(header="true", quote='"', escape='"', emptyValue="").csv(path)
    return path


def serializable(value):
    """Values that JSON can hold: NaN is null, dates are ISO text."""
    if isinstance(value, dict):
        return {str(k): serializable(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [serializable(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    if hasattr(value, "item"):
        return serializable(value.item())
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """A small driver-side document through Hadoop: written beside, then renamed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    fs = target.getFileSystem(conf)
    fs.mkdirs(target.getParent())
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"cannot write {path}")
    return path


def write_json(spark: SparkSession, path: str, value) -> str:
    return write_text(spark, path, json.dumps(serializable(value), ensure_ascii=False, indent=2, sort_keys=True))


def write_yaml(spark: SparkSession, path: str, value) -> str:
    import yaml

    return write_text(spark, path, yaml.safe_dump(serializable(value), allow_unicode=True, sort_keys=False))


class RunStore:
    """Folder layout and status of a run's combinations."""

    def __init__(self, spark: SparkSession, root: str, run_id: str, overwrite: bool = False):
        from .files import exists

        self.spark, self.run_id, self.path = spark, run_id, f"{root.rstrip('/')}/{run_id}"
        if exists(spark, f"{self.path}/summary.json") and not overwrite:
            raise FileExistsError(self.path)
        self.overwrite = overwrite
        self.combinations: dict[str, dict] = {}

    def models(self, model: str, dataset: str) -> str:
        return f"{self.path}/models/{model}/{dataset}"

    def indices(self, model: str, dataset: str) -> str:
        return f"{self.path}/indices/{model}/{dataset}"

    def merged(self, dataset: str) -> str:
        return f"{self.path}/indices/merged/{dataset}"

    def mark(self, key: str, status: str, **extra) -> dict:
        if status not in STATUSES:
            raise ValueError(f"unknown status {status!r}")
        now = datetime.now(timezone.utc).isoformat()
        row = self.combinations.setdefault(key, {"status": "pending", "files": {}})
        row |= {"status": status, **extra}
        row["started_at" if status == "running" else "finished_at"] = now
        self.save()
        return row

    def save_frames(self, key: str, folder: str, frames: dict[str, DataFrame | None]) -> dict[str, str]:
        """Writes each frame that is there as CSV, daily ones in the order of their days."""
        write = lambda name, df: write_daily if name.endswith("_daily") and "date" in df.columns else write_csv
        files = {name: write(name, df)(df, f"{folder}/{name}.csv", overwrite=self.overwrite) for name, df in frames.items() if df is not None}
        self.combinations.setdefault(key, {"status": "pending", "files": {}})["files"] |= files
        return files

    def status(self) -> str:
        n = [c["status"] for c in self.combinations.values()]
        if any(s in ("pending", "running") for s in n):
            return "incomplete"
        if "failed" in n:
            return "partial_failure" if "success" in n else "failed"
        return "success"

    def summary(self) -> dict:
        counts = {s: sum(c["status"] == s for c in self.combinations.values()) for s in STATUSES}
        return {"run_id": self.run_id, "status": self.status(), "counts": counts, "combinations": self.combinations}

    def save(self) -> str:
        return write_json(self.spark, f"{self.path}/summary.json", self.summary())
