"""Exact top-k search by inner product, with norm-bucketed retrieval.

All candidates are grouped by length (norm) into classes, each of which is dealt into parts; queries are dealt into
blocks, and each pair of part and block is one bounded task. Classes are searched in waves from the longest down, each of
about twice the rows of the one before. After a wave a query's k-th best product so far, divided by its own length and a
class' largest, is its local cosine threshold for that class; above 1 the query is not sent to the class at all. Within a
task candidates are cut into buckets in the same way, and start from the threshold that the query brings along: a bucket
above 1 and all shorter ones are done, a high threshold prunes by coordinates (the query's largest coordinates bound where
those of a match can lie), a low one by length. What is left is verified by full products.

Queries and candidates are a stated query set against all rows, in blocks; only each part's best k per query are
shuffled on.

Defined results: vectors that are null, or hold null or non-finite components, take no part; vectors are compared with
those of the same number of components; rows that repeat a vec_id and its vector count once; rows with the query's own
vec_id are no candidates for it; a null vec_id takes no part; products beyond 64 bits are cut off there; a query
without candidates gives no rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Candidates of one part and queries of one block, about.
PART_ROWS, BLOCK_ROWS = 8192, 32_768
#: Queries worked on together within a task.
STEP = 256
#: A bucket holds vectors at least this long, of its longest, and so many at most.
BUCKET_RATIO, BUCKET_ROWS = 0.9, 2048
#: From this local cosine threshold on, coordinates prune better than lengths.
COORDINATE_FROM = 0.8
FOCUS = 4
_SLACK = 1e-9


def scaled(column: str, factor: int = 256) -> Column:
    """Components to floor(factor * x), each x as double; null if the vector takes no part."""
    x = F.col(column).cast("array<double>")
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(F.col(column).isNotNull() & fit, F.transform(x, lambda v: F.floor(v * F.lit(float(factor)))))


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = t.column("vec_id").to_numpy()
    flat = t.column("v").combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    m = flat.to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    # Repeated rows count once.
    order = np.lexsort((*m.T[::-1], ids)) if m.shape[1] else np.argsort(ids, kind="stable")
    ids, m = ids[order], m[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (m[1:] != m[:-1]).any(axis=1)
    return ids[new], m[new]


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, best_ids: np.ndarray, best: np.ndarray, k: int) -> None:
    """Merges found (query row, id, score) into the running best k of each query; ties to smaller ids."""
    touched = np.unique(rows)
    old = np.repeat(touched, k)
    rows, ids, scores = np.concatenate([rows, old]), np.concatenate([ids, best_ids[touched].ravel()]), np.concatenate([scores, best[touched].ravel()])
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    start = np.searchsorted(rows, touched)
    take = start[:, None] + np.arange(k)[None, :]  # every touched row has its k old entries at least
    best_ids[touched], best[touched] = ids[take], scores[take]


def search(query_ids, queries, ids, vectors, k: int, bars=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact best k of ``vectors`` for each query: (query id, id, score). Products under a query's bar need not be found."""
    bars = np.full(len(queries), -np.inf) if bars is None else np.asarray(bars, np.float64) * (1 - np.sign(bars) * _SLACK)
    exact = vectors.shape[1] * max(1.0, float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(vectors.astype(float)).max(initial=0))) < 2**53
    kind = np.float64 if exact else object  # whole numbers below 2**53 are exact as doubles
    queries, vectors = queries.astype(kind), vectors.astype(kind)
    q_norm, norm = (np.sqrt((m.astype(np.float64) ** 2).sum(axis=1)) for m in (queries, vectors))
    order = np.lexsort((ids, -norm))
    ids, vectors, norm = ids[order], vectors[order], norm[order]
    unit = np.asfortranarray(vectors.astype(np.float64) / np.maximum(norm, 1e-300)[:, None])
    q_unit = queries.astype(np.float64) / np.maximum(q_norm, 1e-300)[:, None]
    focus = np.argsort(-np.abs(q_unit), axis=1)[:, : min(FOCUS, q_unit.shape[1])]
    buckets, lo = [], 0
    while lo < len(ids):
        hi = min(lo + BUCKET_ROWS, int(np.searchsorted(-norm, -norm[lo] * BUCKET_RATIO, side="right")))
        buckets.append((lo, max(hi, lo + 1)))
        lo = max(hi, lo + 1)
    all_ids, all_scores = np.full((len(queries), k), np.iinfo(np.int64).max), np.full((len(queries), k), -np.inf, np.float64 if exact else object)
    for s in range(0, len(queries), STEP):
        own = slice(s, s + STEP)
        own_ids, qs, qn, qu, best_ids, best = query_ids[own], queries[own], q_norm[own], q_unit[own], all_ids[own], all_scores[own]
        for lo, hi in buckets:
            theta = np.maximum(best[:, -1].astype(np.float64), bars[own])
            with np.errstate(divide="ignore", invalid="ignore"):
                local = np.where(theta > 0, theta / (qn * norm[lo]), -1.0)
            local = np.nan_to_num(local, nan=-1.0, posinf=2.0)
            alive = local <= 1 + _SLACK
            if not alive.any():
                break
            by_coordinate = np.flatnonzero(alive & (local >= COORDINATE_FROM))
            by_length = np.flatnonzero(alive & (local < COORDINATE_FROM))
            for i in by_coordinate:
                spread = math.acos(min(1.0, local[i] - 1e-7))
                fits = np.ones(hi - lo, bool)
                for f in focus[s + i]:
                    at = math.acos(max(-1.0, min(1.0, qu[i, f])))
                    column = unit[lo:hi, f]
                    fits &= (column <= math.cos(max(0.0, at - spread)) + 1e-7) & (column >= math.cos(min(math.pi, at + spread)) - 1e-7)
                found = lo + np.flatnonzero(fits & (norm[lo:hi] * qn[i] * (1 + _SLACK) >= theta[i]))
                found = found[ids[found] != own_ids[i]]
                if len(found):
                    products = vectors[found] @ qs[i]
                    good = products >= theta[i]
                    if good.any():
                        _best(np.full(good.sum(), i), ids[found][good], products[good], best_ids, best, k)
            if len(by_length):
                with np.errstate(divide="ignore", invalid="ignore"):
                    least = np.where(theta > 0, theta / np.maximum(qn, 1e-300), -np.inf)[by_length].min()
                hi = lo + int((norm[lo:hi] * (1 + _SLACK) >= least).sum())
                if hi > lo:
                    products = qs[by_length] @ vectors[lo:hi].T
                    mine = ids[None, lo:hi] == own_ids[by_length][:, None]
                    products[mine] = -np.inf
                    kth = np.partition(products, -k, axis=1)[:, -k] if exact and hi - lo > k else np.full(len(by_length), -np.inf)
                    bar = np.maximum(kth.astype(np.float64), theta[by_length])
                    r, c = np.nonzero((products >= bar[:, None]) & ~mine)
                    if len(r):
                        _best(by_length[r], ids[lo + c], products[r, c], best_ids, best, k)
        all_ids[own], all_scores[own] = best_ids, best
    r, c = np.nonzero(all_scores > -np.inf)
    limit = np.iinfo(np.int64)
    scores = np.array([min(limit.max, max(limit.min, int(x))) for x in all_scores[r, c]], np.int64)
    return query_ids[r], all_ids[r, c], scores


#: The first wave has this share of all candidates.
FIRST_WAVE = 1 / 16


def _waves(classes: list, part_rows: int) -> list[list[tuple[int, float, int, int]]]:
    """Classes (class, longest, rows) from the longest down in waves of (class, longest, first part, parts)."""
    total = sum(r["rows"] for r in classes)
    room = max(4 * part_rows, int(total * FIRST_WAVE))
    waves, held, part = [[]], 0, 0
    for r in classes:
        if waves[-1] and held + r["rows"] > room:
            waves, held, room = [*waves, []], 0, 2 * room
        parts = max(1, -(-r["rows"] // part_rows))
        waves[-1].append((r["class"], r["longest"], part, parts))
        held, part = held + r["rows"], part + parts
    return waves


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, part_rows: int = PART_ROWS, block_rows: int = BLOCK_ROWS, cells: list | None = None) -> DataFrame:
    """Both frames have vec_id and v (array<bigint>). Returns query_id, rank, vec_id, score.

    ``cells`` takes, for each wave, how many (query, class) cells there are and how many of them are searched.
    """
    spark = vectors.sparkSession
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda n, x: n + x.cast("double") * x.cast("double")))
    kind = F.when(norm > 0, F.floor(F.log(norm) / math.log(1 / BUCKET_RATIO))).otherwise(-1_000_000).cast("int")
    usable = [df.where("vec_id is not null and v is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.size("v").alias("d"), norm.alias("norm")) for df in (vectors, queries)]
    candidates, asked = usable[0].withColumn("class", kind), usable[1]
    classes = candidates.groupBy("class").agg(F.count(F.lit(1)).alias("rows"), F.max("norm").alias("longest")).orderBy(F.desc("class")).collect()  # few: lengths grow by a ninth
    m = asked.count()
    blocks = max(1, -(-m // block_rows))
    dealt = lambda seed, count: F.pmod(F.xxhash64("vec_id", F.lit(seed)), count).cast("int")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def match(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        if not candidates.num_rows or not asked.num_rows:
            return schema.empty_table()
        ids, m = _matrix(asked)
        bar = dict(zip(asked.column("vec_id").to_pylist(), asked.column("bar").to_pylist(), strict=True))
        bars = np.array([-np.inf if bar[i] is None else bar[i] for i in ids.tolist()])
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in search(ids, m, *_matrix(candidates), k, bars)], schema=schema)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    waves, found = _waves(classes, part_rows), None
    if len(waves) > 1:
        candidates = written(candidates, "topk-candidates")
    asked = asked.withColumn("block", dealt(2, F.lit(blocks)))
    for number, wave in enumerate(waves):
        told = F.broadcast(spark.createDataFrame(wave, "class int, longest double, first int, parts int"))
        if found is None:
            live = asked.withColumn("bar", F.lit(None).cast("double"))
        else:
            bars = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("bar"))
            live = asked.join(bars, "vec_id", "left")
        # Rows of one query id share its best k, and so its bar.
        sent = live.join(told, F.col("bar").isNull() | (F.col("bar") <= F.col("norm") * F.col("longest") * (1 + 1e-9) + 1e-6))
        if cells is not None:
            cells.append((m * len(wave), sent.count()))
        right = sent.select("vec_id", "v", "d", "bar", "block", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("part"))
        left = candidates.join(told, "class").select("vec_id", "v", "d", (F.col("first") + dealt(1, F.col("parts"))).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        keys = ("d", "part", "block")
        left, right = (df.toDF(*df.columns) for df in (left, right))  # columns of their own: both may come from one table
        got = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(match, "query_id long, vec_id long, score long")
        found = ranked(got if found is None else found.drop("rank").unionByName(got))
        if number < len(waves) - 1:
            found = written(found, "topk-wave")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The 5 best products for every vec_id divisible by 50, among all other vectors."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", scaled("embedding").alias("v"))
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0))


ORACLE_SQL = {
    "op1_exact_topk": """
        WITH ok AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
            FROM ok q JOIN ok c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
        ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
}
