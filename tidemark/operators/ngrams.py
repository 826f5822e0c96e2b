"""A trained scorer: multinomial weights of hashed word n-grams.

A text's words, alone and in pairs, fall into buckets by their digests. Fitting counts the buckets by label; a weight is
the logarithm of a bucket's smoothed share in a label. Scoring adds up the weights of a text's buckets: a join with at most
``buckets`` rows of weights, and a sum, all in the JVM. Weights of buckets that were never met are one number a label, so
they need no rows.

A fitted scorer is a folder: the weights as Parquet, and ``manifest.json`` with labels, settings, totals and a checksum of
the weights, which ``load`` compares.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..session import written
from ..sources import files, sinks

#: In the order of probabilities everywhere: negative, neutral, positive.
LABELS = ("NEGATIVE", "NEUTRAL", "POSITIVE")
VERSION = 1
_WEIGHTS = "bucket long, w0 double, w1 double, w2 double"


@dataclass(frozen=True)
class Manifest:
    buckets: int
    alpha: float
    priors: tuple[float, ...]  # logarithms, by label
    unseen: tuple[float, ...]  # weights of a bucket that the label never had
    rows: int
    checksum: int
    labels: tuple[str, ...] = LABELS
    version: int = VERSION


@dataclass
class Scorer:
    """Calls of it give (news_id, probabilities) for rows (news_id, text)."""

    manifest: Manifest
    weights: DataFrame

    def __call__(self, df: DataFrame) -> DataFrame:
        m = self.manifest
        found = features(df.select("news_id", "text"), "news_id", "text", m.buckets).join(F.broadcast(self.weights), "bucket", "left")  # at most ``buckets`` rows
        sums = found.groupBy("news_id").agg(*(F.sum(F.col("n") * F.coalesce(F.col(f"w{i}"), F.lit(m.unseen[i]))).alias(f"s{i}") for i in range(3)))
        logits = F.array(*(F.coalesce(F.col(f"s{i}"), F.lit(0.0)) + m.priors[i] for i in range(3)))
        return df.select("news_id").distinct().join(sums, "news_id", "left").select("news_id", S.softmax(logits).alias("probabilities"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def features(df: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    """(key, bucket, n): how many of a text's words and pairs of words fall into each bucket."""
    alone = words(F.col(text))
    rows = df.select(key, alone.alias("w"))
    pairs = F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    # ``zip_with`` goes on to the longer list's end, where there is no second word.
    both = F.concat("w", F.slice(pairs, 1, F.greatest(F.size("w") - 1, F.lit(0))))
    grams = rows.select(key, F.explode(both).alias("gram"))
    bucket = F.conv(F.substring(F.md5(F.col("gram").cast("binary")), 1, 12), 16, 10).cast("long") % buckets
    return grams.groupBy(key, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def fit(rows: DataFrame, buckets: int = 1 << 18, alpha: float = 1.0) -> Scorer:
    """From rows (news_id, text, true_label). Every label must occur; other labels are errors."""
    labelled = rows.where("true_label is not null").select("news_id", "text", F.upper("true_label").alias("label"))
    texts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if {*texts} != {*LABELS}:
        raise ValueError(f"labels {sorted(texts)} are not {sorted(LABELS)}")
    met = features(labelled, "news_id", "text", buckets).join(labelled.select("news_id", "label"), "news_id")
    of = [F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0)).alias(f"n{i}") for i, label in enumerate(LABELS)]
    counts = written(met.groupBy("bucket").agg(*of), "ngram-counts")
    totals = [int(x or 0) for x in counts.agg(*(F.sum(f"n{i}") for i in range(3))).first()]
    below = [math.log(t + alpha * buckets) for t in totals]
    weights = written(counts.select("bucket", *((F.log(F.col(f"n{i}") + F.lit(float(alpha))) - below[i]).alias(f"w{i}") for i in range(3))), "ngram-weights")
    all_texts = sum(texts.values())
    n, checksum = _sum(weights)
    return Scorer(Manifest(buckets, alpha, tuple(math.log(texts[x] / all_texts) for x in LABELS), tuple(math.log(alpha) - b for b in below), n, checksum), weights)


def _sum(weights: DataFrame) -> tuple[int, int]:
    n, x = weights.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("bucket", "w0", "w1", "w2"))).first()
    return n, x or 0


def save(scorer: Scorer, path: str) -> str:
    spark = scorer.weights.sparkSession
    sinks.write_table(scorer.weights, f"{path}/weights", ())
    sinks.write_json(spark, f"{path}/manifest.json", asdict(scorer.manifest))
    return path


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    """The manifest of a scorer's folder; an error names what is wrong with it."""
    name = f"{path}/manifest.json"
    if not files.exists(spark, name):
        raise FileNotFoundError(name)
    held = json.loads(spark.read.text(name, wholetext=True).first()[0])
    if absent := sorted({*Manifest.__dataclass_fields__} - {*held}):
        raise ValueError(f"{name} lacks {absent}")
    if (held["version"], tuple(held["labels"])) != (VERSION, LABELS):
        raise ValueError(f"{name} is of version {held['version']} with labels {held['labels']}")
    return Manifest(**{k: tuple(v) if isinstance(v, list) else v for k, v in held.items() if k in Manifest.__dataclass_fields__})


def load(spark: SparkSession, path: str) -> Scorer:
    manifest = read_manifest(spark, path)
    weights = spark.read.schema(_WEIGHTS).parquet(f"{path}/weights")
    if _sum(weights) != (manifest.rows, manifest.checksum):
        raise ValueError(f"the weights under {path} are not those of its manifest")
    return Scorer(manifest, weights)
