"""Tables from files. Text formats are read with every column as text, so leading zeros survive."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from ..operators.standardize import BAD

#: Bad lines: an error, or left out.
MODES = {"error": "FAILFAST", "warn": "DROPMALFORMED", "skip": "DROPMALFORMED"}
FORMATS = ("csv", "jsonl", "parquet", "huggingface")


@dataclass(frozen=True)
class Reader:
    path: str
    format: str = "csv"
    encoding: str = "UTF-8"
    separator: str = ","
    quote: str = '"'
    on_bad_lines: str = "error"
    max_rows: int | None = None
    multiline: bool = True  # quoted fields may hold line breaks; without, Spark splits large files into tasks
    options: dict[str, str] = field(default_factory=dict)
    names: tuple[str, ...] = ()  # of the columns of CSV without a header; else the first line of one of the files numbers them


def with_row_id(df: DataFrame, column: str = "row_id", split: bool = False) -> DataFrame:
    """A number that follows the rows of a scan by file name, and within a file from front to back.

    Parquet has row numbers of its own. A text file that is read whole has its rows in order in one task. Of one that is
    ``split`` the rows of each block are counted from the block's first one, whose number a pass over the files finds; a
    block has fewer rows than bytes, so its start and the count stay below the next block's.
    """
    at = F.monotonically_increasing_id()
    plain = r"^(\w+):///"  # an address without a host is written in two ways
    paths = sorted({re.sub(plain, r"\1:/", p) for p in df.inputFiles()}, key=lambda p: (p.rsplit("/", 1)[-1], p))
    if not paths:
        return df.withColumn(column, at)
    names = df.columns
    ranks = F.broadcast(df.sparkSession.createDataFrame([(p, i) for i, p in enumerate(paths)], "__file string, __rank long"))
    within = F.col("_metadata.row_index") if paths[0].endswith(".parquet") else at.bitwiseAND(F.lit((1 << 33) - 1))
    rows = df.select("*", F.regexp_replace("_metadata.file_path", plain, "$1:/").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), within.alias("__at"))
    if split and not paths[0].endswith(".parquet"):
        # All columns are asked for, so that this pass drops the lines that the other one drops.
        parsed = F.bit_xor(F.xxhash64(*(F.col(f"`{c}`") for c in names)))
        firsts = rows.groupBy("__file", "__block").agg(F.min("__at").alias("__first"), parsed.alias("__parsed")).drop("__parsed")
        rows = rows.join(F.broadcast(firsts), ["__file", "__block"]).withColumn("__at", F.col("__block") + F.col("__at") - F.col("__first"))
    number = F.shiftleft("__rank", 43).bitwiseOR(F.col("__at"))
    return rows.join(ranks, "__file").select(*(F.col(f"`{c}`") for c in names), number.alias(column))


def read_csv(spark: SparkSession, r: Reader, keep_bad: bool = False) -> DataFrame:
    """With ``keep_bad`` lines that can't be read stay, with their text in the column ``BAD``."""
    if r.on_bad_lines not in MODES:
        raise ValueError(f"on_bad_lines is one of {sorted(MODES)}")
    base = {"header": "true", "sep": r.separator, "quote": r.quote, "escape": r.quote, "encoding": r.encoding, "multiLine": str(r.multiline).lower(), "maxCharsPerColumn": "10000000", **r.options}
    if r.names and str(base["header"]).lower() == "true":
        raise ValueError("columns are named by the header or by names, not both")
    names = list(r.names) or [c.strip() for c in spark.read.options(**base).csv(r.path).columns]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"columns appear more than once: {twice}")
    keep_bad = keep_bad and r.on_bad_lines != "error"
    schema = StructType([StructField(n, StringType()) for n in [*names, *([BAD] if keep_bad else [])]])
    mode = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD} if keep_bad else {"mode": MODES[r.on_bad_lines]}
    rows = with_row_id(spark.read.options(**base, **mode, enforceSchema="true").schema(schema).csv(r.path), split=not r.multiline)
    return rows.select(*(T.na_to_null(F.col(f"`{c}`")).alias(c) for c in names), *([BAD] if keep_bad else []), "row_id")


def read_jsonl(spark: SparkSession, r: Reader, keep_bad: bool = False) -> DataFrame:
    keep_bad = keep_bad and r.on_bad_lines != "error"
    options = {"primitivesAsString": "true", "encoding": r.encoding, **r.options}
    schema = spark.read.options(**options, mode="DROPMALFORMED").json(r.path).schema
    schema = StructType([f for f in schema.fields if f.name not in ("_corrupt_record", BAD)] + ([StructField(BAD, StringType())] if keep_bad else []))
    mode = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD} if keep_bad else {"mode": MODES[r.on_bad_lines]}
    rows = with_row_id(spark.read.options(**options, **mode).schema(schema).json(r.path), split=True)
    return rows.select(*((F.col(f"`{f.name}`") if isinstance(f.dataType, StringType) else F.to_json(f"`{f.name}`")).alias(f.name) for f in rows.schema if f.name != "row_id"), "row_id")


def read_parquet(spark: SparkSession, r: Reader, keep_bad: bool = False) -> DataFrame:
    return with_row_id(spark.read.options(**r.options).parquet(r.path))


def read_hub(spark: SparkSession, r: Reader, keep_bad: bool = False) -> DataFrame:
    """A hub dataset's split that lies on disk as parquet or lines of JSON; snapshots have a format of their own."""
    inner = "jsonl" if r.path.endswith((".json", ".jsonl")) else "parquet"
    return read(spark, Reader(**{**r.__dict__, "format": inner}), keep_bad)


def read(spark: SparkSession, r: Reader, keep_bad: bool = False) -> DataFrame:
    readers = {"csv": read_csv, "jsonl": read_jsonl, "parquet": read_parquet, "huggingface": read_hub}
    if r.format not in readers:
        raise ValueError(f"format {r.format!r} is none of {FORMATS}")
    rows = readers[r.format](spark, r, keep_bad)
    return rows if r.max_rows is None else rows.orderBy("row_id").limit(r.max_rows)


def inspect_columns(spark: SparkSession, r: Reader) -> tuple[str, ...]:
    """Column names; reads no rows of parquet, the header of CSV."""
    if r.format == "csv":
        return tuple(c.strip() for c in spark.read.option("header", "true").option("sep", r.separator).csv(r.path).columns)
    if r.format == "parquet":
        return tuple(spark.read.options(**r.options).parquet(r.path).columns)
    return tuple(c for c in read(spark, r).columns if c != "row_id")


def exists(spark: SparkSession, path: str) -> bool:
    """Through Hadoop, so any store that Spark reads will do."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def validate_file(spark: SparkSession, r: Reader) -> None:
    if r.format not in FORMATS:
        raise ValueError(f"format {r.format!r} is none of {FORMATS}")
    if not exists(spark, r.path):
        raise FileNotFoundError(r.path)


def missing(spark: SparkSession, paths: dict[str, str]) -> list[str]:
    """Keys of assets that are not there."""
    return sorted(k for k, p in paths.items() if not exists(spark, p))


def read_prices(spark: SparkSession, path: str, columns: dict[str, str] | None = None, reader: Reader | None = None) -> DataFrame:
    """Price files, cleaned, with returns."""
    from ..operators import market

    raw = read_csv(spark, reader or Reader(path))
    named = market.rename_prices(raw, columns) if columns else raw
    if lacking := [c for c in ("date", "ticker", "close") if c not in named.columns]:
        raise ValueError(f"price columns are missing: {lacking}")
    return market.returns(market.sanitize_prices(named))


def read_index(spark: SparkSession, path: str, doubles: tuple[str, ...] = ("impacto_dia", "risco_dia", "iti_liquido", "iti_risco"), longs: tuple[str, ...] = ("news_count",)) -> DataFrame:
    """A daily table written by a run; rows whose date cannot be read leave."""
    rows = spark.read.option("header", "true").csv(path)
    typed = {c: F.col(c).try_cast("double") for c in doubles if c in rows.columns} | {c: F.col(c).try_cast("long") for c in longs if c in rows.columns}
    return rows.withColumns({"date": F.try_to_date("date"), **typed}).where("date is not null")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Corpus records of a file or a folder, in the order of file names; an absent path gives none."""
    from ..operators import corpus

    if not exists(spark, path):
        return spark.createDataFrame([], StructType([StructField(c, StringType()) for c in corpus.COLUMNS])).withColumn("row_id", F.lit(0).cast("long"))
    schema = StructType([StructField(c, StringType()) for c in corpus.COLUMNS])
    rows = spark.read.schema(schema).options(header="true", multiLine="true", quote='"', escape='"', maxCharsPerColumn="10000000").csv(path)
    return corpus.as_records(with_row_id(rows))


def list_combinations(spark: SparkSession, run_dir: str, model_key: str | None = None, dataset_key: str | None = None) -> DataFrame:
    """Models and datasets of a run that have both daily tables, from the files' own paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(f"{run_dir}/indices").select("path")
    parts = files.select(F.regexp_extract("path", r"/indices/([^/]+)/([^/]+)/(iti_daily|baselines_daily|iti_uncertainty_daily)\.csv", 1).alias("model_key"), F.regexp_extract("path", r"/indices/([^/]+)/([^/]+)/", 2).alias("dataset_key"), F.regexp_extract("path", r"/(iti_daily|baselines_daily|iti_uncertainty_daily)\.csv", 1).alias("kind"))
    found = parts.where("model_key not in ('', 'merged')").groupBy("model_key", "dataset_key").agg(F.collect_set("kind").alias("kinds"))
    both = found.where(F.array_contains("kinds", "iti_daily") & F.array_contains("kinds", "baselines_daily"))
    if model_key:
        both = both.where(F.col("model_key") == model_key)
    if dataset_key:
        both = both.where(F.col("dataset_key") == dataset_key)
    return both.select("model_key", "dataset_key", F.array_contains("kinds", "iti_uncertainty_daily").alias("has_uncertainty")).orderBy("model_key", "dataset_key")


def latest_run(spark: SparkSession, root: str, run_id: str | None = None) -> str:
    """The named run, or the one whose summary was written last."""
    if run_id:
        if not exists(spark, f"{root}/{run_id}"):
            raise FileNotFoundError(f"{root}/{run_id}")
        return f"{root}/{run_id}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "summary.json").load(root).select(F.max_by("path", "modificationTime").alias("p")).first()
    if not found or not found.p:
        raise FileNotFoundError(f"no run under {root}")
    return os.path.dirname(found.p)


def read_summary(spark: SparkSession, run_dir: str) -> dict:
    if not exists(spark, f"{run_dir}/summary.json"):
        return {}
    return json.loads(spark.read.text(f"{run_dir}/summary.json", wholetext=True).first()[0])
