"""Sharding by sampled splitters.

Records are ordered by the key (64-bit text hash, doc_id), so equal texts are neighbours. Size-weighted key
samples give quantile boundaries; records are range-partitioned between them; ranges that turn out overfull are
subdivided; exact prefix sums over the small per-range totals then place the shard borders so that shard sizes are
near equal (law ``bytes``): they differ by at most about twice the largest record or 1 % of a shard, whichever is more.

Defined results: a null text has size 1 and the CRC of nothing; a null doc_id is a key like any other (it sorts
first); rows that repeat (same doc_id, same text) are counted once with their number and dealt out again at the end,
so a hot key never sits in one task; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, written

#: Rows of one range, about; ranges are sorted within one task each.
ROWS_PER_RANGE = 20_000
MIN_RANGES, MAX_RANGES = 1024, 65_536
#: Samples per range. With MAX_RANGES this bounds what the driver gathers: 2 M keys of 16 bytes.
SAMPLES_PER_RANGE = 32
#: A border moves to the edge of a group of equal texts if the group is no larger than this part of a shard.
SNAP = 0.01


def _ranges(splitters_h: np.ndarray, splitters_d: np.ndarray):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column("h").to_numpy(zero_copy_only=False)
            d = b.column("d").to_numpy(zero_copy_only=False)
            low = np.searchsorted(splitters_h, h, side="left")
            high = np.searchsorted(splitters_h, h, side="right")
            r = low.astype(np.int32)
            for i in np.flatnonzero(high > low):  # a hot hash has several splitters: its doc_ids decide
                r[i] = low[i] + np.searchsorted(splitters_d[low[i] : high[i]], d[i], side="right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r, pa.int32())], [*b.schema.names, "range"])

    return assign


def shard(docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per record: id, size, text_crc32, text hash, shard, slot (gapless from 0 in each shard)."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.when(F.col(text_column).isNull(), F.lit(None)).otherwise(F.xxhash64(text)).alias("hash"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("crc"),
    )
    least = F.lit(-(2**63))
    keys = (
        rows.groupBy("id", "hash", "size", "crc")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumns({"h": F.coalesce("hash", least), "d": F.coalesce("id", least), "no_id": F.col("id").isNull()})
    )
    keys = written(keys, "shard-keys")
    n, total = keys.agg(F.count(F.lit(1)), F.sum(F.col("size") * F.col("n"))).first()
    if not n:
        return keys.select("id", "size", "crc", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).limit(0)

    ranges = int(min(MAX_RANGES, max(MIN_RANGES, n // ROWS_PER_RANGE)))
    wanted = ranges * SAMPLES_PER_RANGE
    # A key is drawn with a chance in proportion to its bytes; the draw is a hash, so a retried task draws the same.
    chance = F.least(F.lit(1.0), F.col("size") * F.col("n") * F.lit(wanted / total))
    draw = F.pmod(F.xxhash64("h", "d", F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = keys.where(draw < chance).select("h", "d", (F.col("size") * F.col("n") / chance).alias("w")).toArrow()
    sh, sd, sw = (sample.column(c).to_numpy() for c in ("h", "d", "w"))
    order = np.lexsort((sd, sh))
    sh, sd, upto = sh[order], sd[order], np.cumsum(sw[order])
    at = np.searchsorted(upto, np.arange(1, ranges) * (upto[-1] / ranges)) if len(upto) else np.zeros(0, int)
    at = np.unique(np.minimum(at, len(upto) - 1))

    ranged = map_arrow(keys, _ranges(sh[at], sd[at]), "id long, hash long, size long, crc long, n long, h long, d long, no_id boolean, range int")
    # Overfull ranges (samples can miss) are subdivided by key hash bits below the border: each part sorts on its own.
    count = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("keys"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    count = written(count, "shard-counts")
    full = {r.range: r for r in count.where(F.col("keys") > 4 * max(ROWS_PER_RANGE, n // ranges)).collect()}
    part = F.lit(0)
    if full:
        cells = F.create_map(*[x for k, r in full.items() for x in (F.lit(k), F.struct(F.lit(float(r.lo)).alias("lo"), F.lit(max(1.0, float(r.hi) - float(r.lo))).alias("width"), F.lit(int(r["keys"] // max(ROWS_PER_RANGE, n // ranges))).alias("parts")))])
        cell = cells[F.col("range")]
        part = F.coalesce(F.floor((F.col("h").cast("double") - cell["lo"]) / cell["width"] * cell["parts"]).cast("int"), F.lit(0))
    ranged = ranged.withColumn("part", part)

    key_order = [F.col("h"), F.col("d"), F.col("no_id").desc(), F.col("hash").asc_nulls_first(), F.col("size"), F.col("crc")]
    before = Window.partitionBy("range", "part").orderBy(*key_order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumns({
        "bytes_in": F.coalesce(F.sum(F.col("size") * F.col("n")).over(before), F.lit(0)),
        "rows_in": F.coalesce(F.sum("n").over(before), F.lit(0)),
    })
    placed = written(placed.drop("d", "no_id"), "shard-placed")

    # At most MAX_RANGES rows of totals (and their subdivisions): prefix sums on the driver, sent back as a small table.
    totals = placed.groupBy("range", "part").agg(F.sum(F.col("size") * F.col("n")).alias("b"), F.sum("n").alias("k")).toPandas().sort_values(["range", "part"])
    totals["b0"], totals["k0"] = totals.b.cumsum() - totals.b, totals.k.cumsum() - totals.k
    starts = docs.sparkSession.createDataFrame(totals[["range", "part", "b0", "k0"]], "range int, part int, b0 long, k0 long")
    placed = placed.join(F.broadcast(starts), ["range", "part"]).withColumns({"byte0": F.col("b0") + F.col("bytes_in"), "row0": F.col("k0") + F.col("rows_in")})

    bytes_total = int(totals.b.sum())
    ideal = [bytes_total * j // shards for j in range(1, shards)]
    borders = _snapped(placed, ideal, bytes_total / shards)
    marks = F.array(*[F.lit(x).cast("long") for x in borders]) if borders else F.array().cast("array<long>")
    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    start = F.col("byte0") + F.col("copy") * F.col("size")
    dealt = copies.withColumn("shard", F.size(F.filter(marks, lambda m: m <= start)).cast("int")).withColumn("rank", F.col("row0") + F.col("copy"))
    dealt = written(dealt.select("id", "size", "crc", "shard", "rank"), "shard-dealt")
    first = {r.shard: r.first for r in dealt.groupBy("shard").agg(F.min("rank").alias("first")).collect()}
    base = F.array(*[F.lit(first.get(s, 0)).cast("long") for s in range(shards)])
    return dealt.select("id", "size", "crc", "shard", (F.col("rank") - F.element_at(base, F.col("shard") + 1)).alias("slot"))


def _snapped(placed: DataFrame, ideal: list[int], share: float) -> list[int]:
    """Borders moved to the edge of the group of equal texts that they cut, where the group is small."""
    if not ideal:
        return []
    end = F.col("byte0") + F.col("size") * F.col("n")
    crossed = F.filter(F.array(*[F.lit(x).cast("long") for x in ideal]), lambda m: (m > F.col("byte0")) & (m < end) | (m == F.col("byte0")))
    cut = [r.h for r in placed.where(F.size(crossed) > 0).select("h").distinct().collect()]  # a row per border at most
    groups = placed.where(F.col("h").isin(cut)).groupBy("h").agg(F.min("byte0").alias("lo"), F.max(end).alias("hi"), F.max("size").alias("most")).collect()
    out = []
    for x in ideal:
        g = next((g for g in groups if g.lo < x < g.hi), None)
        if g and g.hi - g.lo <= max(SNAP * share, g.most):
            x = g.lo if x - g.lo <= g.hi - x else g.hi
        out.append(x)
    return sorted(out)


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 15 under the law ``bytes``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs, 16).select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
