"""Vector codes: each part of a vector is replaced by the nearest entry of its part's codebook, fitted by Elkan's Lloyd.

A round is one pass over a written table that holds, per vector, its integer components and its bounds: for each part the
entry it is assigned to, an upper bound of its distance to that entry, and one lower bound per entry. A pass shifts the
bounds by how far the entries have moved since, drops an entry where its lower bound, or half of its distance from the
assigned one, lies strictly above the upper bound, and measures the rest in integers, so ties are exact and go to the
smaller index. Bounds are integers as well, rounded to their safe side. Each task adds up its parts by entry and leaves one
row of sums; Spark adds those up by place, and only a codebook's worth of numbers reaches the driver between rounds. A
round's table replaces the one before it, which is deleted.

Components become floor(scale * x). Vectors that are null, hold null or non-finite components, or have another length than
that of the smallest kept vec_id take no part (nor does any, if that length is no multiple of the number of parts, and none
with a component of 2^27 or more in size, whose error might not fit a long). Rows that share a vec_id are rows of their own
and ordered by their components; a null vec_id comes after all others; with fewer vectors than entries the codebook is
smaller; a null label is a label; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, own_dir, sized, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
MOST = 1 << 27

_STATE = "vec_id long, label int, v binary, bounds binary, sums binary"
_FIELDS = pa.schema([("vec_id", pa.int64()), ("label", pa.int32()), ("v", pa.binary()), ("bounds", pa.binary()), ("sums", pa.binary())])


def integer_vector(vector: Column, scale: int = SCALE) -> Column:
    """Integer components, or null where a vector takes no part."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    sound = ~F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= MOST / scale))
    return F.when(sound, F.transform(doubles, lambda x: F.floor(x * scale).cast("int")))


def root_down(squares: np.ndarray) -> np.ndarray:
    """The integer square root of each, exactly."""
    root = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    root -= root * root > squares
    return root + ((root + 1) * (root + 1) <= squares)


def root_up(squares: np.ndarray) -> np.ndarray:
    root = root_down(squares)
    return root + (root * root < squares)


@dataclass
class Codebooks:
    """Entries by part, as (parts, entries, components), and how far each moved since the round before."""

    entries: np.ndarray
    moved: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        if self.moved is None:
            self.moved = np.zeros(self.entries.shape[:2], np.int64)
        apart = ((self.entries[:, :, None, :] - self.entries[:, None, :, :]) ** 2).sum(-1)
        self.apart = root_down(apart)  # rounded down: half of it is what an entry must lie beyond

    def replaced(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Each entry becomes the floor of its parts' mean; unused ones stay."""
        means = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], self.entries)
        return Codebooks(means, root_up(((means - self.entries) ** 2).sum(-1)))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


@dataclass
class Bounds:
    """Of a batch: the entry assigned, an upper bound, and a lower bound per entry, for each vector and part."""

    assigned: np.ndarray  # (vectors, parts)
    upper: np.ndarray
    lower: np.ndarray  # (vectors, parts, entries)

    @classmethod
    def none(cls, n: int, books: Codebooks) -> Bounds:
        """Nothing is known: every entry has to be measured."""
        parts, entries, _ = books.entries.shape
        return cls(np.zeros((n, parts), np.int64), np.full((n, parts), 1 << 31, np.int64), np.zeros((n, parts, entries), np.int64))

    @classmethod
    def unpacked(cls, blobs: list[bytes], books: Codebooks) -> Bounds:
        parts, entries, _ = books.entries.shape
        flat = np.frombuffer(b"".join(blobs), np.int32).reshape(len(blobs), parts, entries + 2).astype(np.int64)
        return cls(flat[:, :, 0], flat[:, :, 1], flat[:, :, 2:])

    def packed(self) -> list[bytes]:
        flat = np.concatenate([self.assigned[..., None], self.upper[..., None], self.lower], axis=2).astype(np.int32)
        return [row.tobytes() for row in flat]


def assign(vectors: np.ndarray, bounds: Bounds, books: Codebooks) -> tuple[np.ndarray, int]:
    """Moves ``bounds`` on to these codebooks. Returns the squared distances to the entries assigned, and how many were measured.

    ``vectors``: (vectors, parts, components).
    """
    n, parts, _ = vectors.shape
    squares, measured = np.zeros((n, parts), np.int64), 0
    for p in range(parts):
        x, entries = vectors[:, p, :], books.entries[p]
        assigned, upper = bounds.assigned[:, p], bounds.upper[:, p] + books.moved[p][bounds.assigned[:, p]]
        lower = np.maximum(bounds.lower[:, p, :] - books.moved[p], 0)
        own = ((x - entries[assigned]) ** 2).sum(-1)  # the assigned entry is always measured: errors are exact, the upper bound is tight
        measured += n
        upper = np.minimum(upper, root_up(own))
        open_ = (lower <= upper[:, None]) & (books.apart[p][assigned] <= 2 * upper[:, None])
        open_[np.arange(n), assigned] = False
        lower[np.arange(n), assigned] = root_down(own)
        rows, others = np.nonzero(open_)
        measured += len(rows)
        away = ((x[rows] - entries[others]) ** 2).sum(-1)
        lower[rows, others] = root_down(away)
        # The nearest of all measured; of equal ones the smaller index.
        far = np.iinfo(np.int64).max
        table = np.full((n, len(entries)), far, np.int64)
        table[np.arange(n), assigned] = own
        table[rows, others] = away
        nearest = table.argmin(1)
        squares[:, p] = table[np.arange(n), nearest]
        bounds.assigned[:, p], bounds.upper[:, p], bounds.lower[:, p, :] = nearest, root_up(squares[:, p]), lower
    return squares, measured


def _vectors(column: pa.Array, books: Codebooks) -> np.ndarray:
    parts, _, width = books.entries.shape
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(len(column), parts, width).astype(np.int64)


def _round(state: DataFrame, books: Codebooks) -> DataFrame:
    """Vectors with their bounds moved on to ``books``, and per task one row of sums and counts by part and entry."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.entries.shape
        sums = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _vectors(batch.column(2), books)
            blobs = batch.column(3)
            bounds = Bounds.none(len(vectors), books) if blobs.null_count else Bounds.unpacked(blobs.to_pylist(), books)
            assign(vectors, bounds, books)
            for p in range(parts):
                np.add.at(sums[p], bounds.assigned[:, p], np.concatenate([vectors[:, p, :], np.ones((len(vectors), 1), np.int64)], axis=1))
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(bounds.packed(), pa.binary()), pa.nulls(len(vectors), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=_FIELDS)
        if sums[..., -1].any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in list(_FIELDS)[:-1]] + [pa.array([sums.tobytes()], pa.binary())], schema=_FIELDS)

    return map_arrow(state, step, _STATE)


def _sums(done: DataFrame, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """The tasks' rows of sums, added up by place."""
    parts, entries, width = books.entries.shape

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                got = np.frombuffer(blob, np.int64)
                total = got.copy() if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "value"])

    rows = done.where("sums IS NOT NULL").select("sums").mapInArrow(numbers, "place long, value long").groupBy("place").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(parts * entries * (width + 1), np.int64)
    for r in rows:
        flat[r["place"]] = r["value"]
    flat = flat.reshape(parts, entries, width + 1)
    return flat[..., :-1], flat[..., -1]


@dataclass
class Fit:
    """Final codebooks and the table of coded vectors: vec_id, label, code, error."""

    books: Codebooks | None
    coded: DataFrame


def fit_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Fit:
    """Codes of ``vectors`` (vec_id long, label int, v array<int>; null v: no part taken)."""
    spark = vectors.sparkSession
    kept = vectors.where("v IS NOT NULL")
    none = spark.createDataFrame([], "vec_id long, label int, code string, error long")
    smallest = kept.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v")
    head = smallest.limit(1).collect()
    width = len(head[0]["v"]) if head else 0
    if not width or width % parts:
        return Fit(None, none)
    kept = kept.where(F.size("v") == width)
    seeds = np.array([r["v"] for r in smallest.where(F.size("v") == width).limit(entries).collect()], np.int64)
    books = Codebooks(seeds.reshape(len(seeds), parts, width // parts).transpose(1, 0, 2))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.asarray(b.column(2).flatten()).astype(np.int32).reshape(-1, width) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in v], pa.binary()), pa.nulls(b.num_rows, pa.binary()), pa.nulls(b.num_rows, pa.binary())], schema=_FIELDS)

    state, before = map_arrow(kept.select("vec_id", "label", "v"), packed, _STATE), None
    for number in range(rounds):
        done = written(_round(state, books), f"codes-round-{number}")
        books = books.replaced(*_sums(done, books))
        state = done.where("v IS NOT NULL")
        if before is not None:
            _deleted(before)
        before = done

    final = books

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, errors = [], []
            if b.num_rows:
                x = _vectors(b.column(2), final)
                bounds = Bounds.none(len(x), final) if b.column(3).null_count else Bounds.unpacked(b.column(3).to_pylist(), final)
                squares, _ = assign(x, bounds, final)
                codes, errors = [row.tobytes().hex() for row in bounds.assigned.astype(np.uint8)], squares.sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    coded = written(map_arrow(state.select("vec_id", "label", "v", "bounds"), code, "vec_id long, label int, code string, error long"), "codes")
    if before is not None:
        _deleted(before)
    return Fit(books, coded)


def _deleted(table: DataFrame) -> None:
    """Removes a round's table, which the next one has replaced."""
    spark = table.sparkSession
    for name in table.inputFiles()[:1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name).getParent()
        if f"/{spark.sparkContext.applicationId}/tables/codes-round-" in path.toString() and own_dir(spark):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes, errors and final codebooks of all vectors."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    fit = fit_codes(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), integer_vector(F.col("embedding")).alias("v")))
    totals = sized(written(fit.coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "codes-labels"))
    digest = fit.books.digest() if fit.books else hashlib.sha256(b"").hexdigest()
    return fit.coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """Plain Lloyd: every part against every entry, round by round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
        near{r} AS MATERIALIZED (
            SELECT x.row, x.part, arg_min(b.entry, [d, b.entry]) AS entry, min(d) AS d
            FROM (SELECT x.row, x.part, b.entry, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
                  FROM parts x JOIN book{r} b USING (part)) b JOIN parts x USING (row, part)
            GROUP BY x.row, x.part)""")
        if r < rounds:
            steps.append(f"""
        book{r + 1} AS MATERIALIZED (
            SELECT b.part, b.entry, coalesce(m.v, b.v) AS v
            FROM book{r} b LEFT JOIN (
                SELECT part, entry, list(mean ORDER BY place) AS v
                FROM (SELECT part, entry, place, CAST(floor_div AS BIGINT) AS mean
                      FROM (SELECT part, entry, place, (sum(c) - (((sum(c) % count(*)) + count(*)) % count(*))) // count(*) AS floor_div
                            FROM (SELECT n.part, n.entry, unnest(x.v) AS c, generate_subscripts(x.v, 1) AS place FROM near{r} n JOIN parts x USING (row, part))
                            GROUP BY part, entry, place))
                GROUP BY part, entry) m USING (part, entry))""")
    chain = ",".join(steps)
    return f"""
        WITH kept AS (
            SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label,
                   list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS MATERIALIZED (
            SELECT row, p AS part, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v FROM kept, range({parts}) t(p)),
        book0 AS (SELECT part, row - 1 AS entry, v FROM parts WHERE row <= {entries}),{chain},
        sums AS (
            SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY row),
        digest AS (
            SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(x AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256
            FROM book{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM kept JOIN sums USING (row), digest
    """


ORACLE_SQL = {"op13_vector_codes": _oracle()}
