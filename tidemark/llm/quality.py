"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of the whole text are binned; trees are grown on gradient histograms in numpy and flattened into arrays,
which tasks traverse for all rows of a batch at once, one level at a time.

The model is fitted on a bounded sample of labelled rows: the ``FIT_ROWS`` with the smallest hash of their doc_id among
those that are not held out (crc32 of the doc_id as text, modulo 3, is 1 for held-out rows). The driver holds the
statistics of those rows alone. Labels, language, source and doc_id are no inputs of a score.

Defined results: a null or empty text has statistics of zeros and is scored like any other; a null doc_id is not held
out; several labels of one doc_id count by their majority (ties: 1); without any usable label, or with one label
value only, every score is that share (0.5 without labels); an empty table gives no rows; extra columns pass through
``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, with_fields

#: Labelled rows to fit on, at most.
FIT_ROWS = 20_000

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "distinct_words", "repeated_words", "top_word", "longest_run", "line_words",
    "distinct_lines", "upper", "digits", "spaces", "non_ascii", "commas_stops", "bars", "marks", "other_symbols",
    "symbols_per_word", "capital_words", "byte_entropy", "pair_repeats",
)

_CLASSES = np.zeros((256, 8), np.float64)
for _k, _set in enumerate((range(65, 91), range(48, 58), b" \t\n\r\x0b\x0c", range(128, 256), b",.", b"|", b"!?")):
    _CLASSES[list(_set), _k] = 1
_CLASSES[[b for b in range(33, 127) if not chr(b).isalnum() and b not in b",.|!?'-"], 7] = 1


def statistics(text: str | None) -> np.ndarray:
    """The features of one whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, digits, spaces, wide, stops, bars, marks, other = (counts @ _CLASSES) / n
    words = data.split()
    w = max(1, len(words))
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(x, len(codes)) for x in words), np.int64, len(words))
    top = np.bincount(ids).max() / w if words else 0
    same = ids[1:] == ids[:-1]
    edges = np.flatnonzero(np.concatenate([[True], ~same, [True]])) if words else np.zeros(1, int)
    run = np.diff(edges).max() if words else 0
    pairs = ids[1:] * (len(codes) + 1) + ids[:-1]
    lines = data.split(b"\n")
    p = counts[counts > 0] / n
    return np.array([
        np.log1p(len(data)), np.log1p(len(words)), (n - spaces * n) / w, len(codes) / w, same.sum() / w, top, np.log1p(run), np.log1p(w / len(lines)),
        len(set(lines)) / len(lines), upper, digits, spaces, wide, stops, bars, marks, other,
        (bars + marks + other) * n / w, sum(map(bytes.isupper, words)) / w, -(p * np.log2(p)).sum(), 1 - len(np.unique(pairs)) / len(pairs) if len(pairs) else 0,
    ], np.float64)


@dataclass
class Forest:
    """Trees as arrays, one row per tree; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                right = x[rows, self.feature[t][node]] > self.threshold[t][node]
                node = np.where(right, self.right[t][node], self.left[t][node])
            total += self.value[t][node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int | None = None, l2: float = 1.0) -> Forest:
    """Gradient boosting on log loss, level by level, over binned features."""
    n, m = x.shape if len(x) else (0, len(FEATURES))
    size = 2 ** (depth + 1) - 1
    empty = Forest(np.zeros((0, size), np.int32), np.zeros((0, size)), np.zeros((0, size), np.int32), np.zeros((0, size), np.int32), np.zeros((0, size)), depth, 0.0)
    if not n:
        return empty
    share = y.mean()
    base = float(np.log(share / (1 - share))) if 0 < share < 1 else (40.0 if share else -40.0)
    if not 0 < share < 1:
        empty.base = base
        return empty
    least = least or max(5, min(40, n // 100))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    raw = np.full(n, base)
    out = Forest(np.zeros((trees, size), np.int32), np.full((trees, size), np.inf), np.tile(np.arange(size, dtype=np.int32), (trees, 1)), np.tile(np.arange(size, dtype=np.int32), (trees, 1)), np.zeros((trees, size)), depth, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            here = node >= first
            at = node[here] - first
            best = np.full(wide, 1e-6)
            choice = np.full((wide, 2), -1)
            for j in range(m):
                cell = at * bins + binned[here, j]
                gs, hs, cs = (np.bincount(cell, weights=v, minlength=wide * bins).reshape(wide, bins).cumsum(1) for v in (g[here], h[here], np.ones(here.sum())))
                gt, ht, ct = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(cs < least) | (ct - cs < least)] = -1
                gain[:, len(edges[j]) :] = -1
                k = gain.argmax(1)
                top = gain[np.arange(wide), k]
                better = top > best
                best[better], choice[better] = top[better], np.stack([np.full(wide, j), k], 1)[better]
            for i in np.flatnonzero(choice[:, 0] >= 0):
                v, (j, k) = first + i, choice[i]
                out.feature[t, v], out.threshold[t, v], out.left[t, v], out.right[t, v] = j, edges[j][k], 2 * v + 1, 2 * v + 2
                own = node == v
                node[own] = np.where(binned[own, j] > k, 2 * v + 2, 2 * v + 1)
        sums_g, sums_h = np.bincount(node, weights=g, minlength=size), np.bincount(node, weights=h, minlength=size)
        out.value[t] = rate * sums_g / (sums_h + l2)
        raw += out.value[t][node]
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(3)) == 1, F.lit(False))


def with_statistics(df: DataFrame, text_column: str = "text", column: str = "statistics") -> DataFrame:
    keep = [c for c in df.columns if c != text_column]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(x.as_py()) for x in b.column(text_column)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(rows, pa.list_(pa.float64()))], [*keep, column])

    return map_arrow(df, measure, ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"{column} array<double>"]))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Forest:
    """Fits on at most ``rows`` labelled rows that are not held out."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).where(~held_out(F.col("doc_id")))
    marked = usable.groupBy("doc_id").agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("int").alias("y"))
    picked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # at most FIT_ROWS ids: small enough to broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = with_statistics(texts.join(F.broadcast(picked), "doc_id")).orderBy("doc_id", "statistics").limit(2 * rows).toPandas()
    x = np.array(sample["statistics"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, sample["y"].to_numpy(np.float64))


def score(docs: DataFrame, forest: Forest, text_column: str = "text", column: str = "score") -> DataFrame:
    """Adds the score of the whole text; all columns stay, but for one of the score's name."""
    model = docs.sparkSession.sparkContext.broadcast(forest)  # a fixed number of small trees
    keep, schema = with_fields(docs, f"`{column}` double")
    tmp = "__quality_text"

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(tmp)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(model.value.scores(x), pa.float64())], [*keep, column])

    return map_arrow(docs.withColumn(tmp, F.col(text_column).cast("string")), rate, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score reaches ``threshold``, with the columns they came with."""
    scored = score(docs, train(docs, labels), column="__quality")
    return scored.where(F.col("__quality") >= threshold).drop("__quality")


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every whole document's score by a model fitted on labelled rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    forest = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("doc_id", "text"), forest)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
