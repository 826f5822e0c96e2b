"""The corpus as a table that batches are added to without rewriting it.

Records lie in hash buckets of their keys. A batch is joined with the keys of its own buckets only, and what is new is
written as a delta of its own, named after the batch: a batch that is repeated after a failure overwrites itself. Records
are unique over base and deltas, so reading is a union. ``compact`` writes base and deltas as a new base; a small document
names the base that holds and the last batch in it, and is replaced as a whole.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators import corpus
from ..sources import files, sinks

SCHEMA = StructType([*(StructField(c, StringType()) for c in corpus.COLUMNS), StructField("dedupe_key", StringType()), StructField("batch", LongType()), StructField("row", LongType())])


class CorpusTable:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        held = self._held()
        self.buckets = held.get("buckets", buckets)  # a table keeps the number it was made with

    def _held(self) -> dict:
        name = f"{self.path}/table.json"
        return json.loads(self.spark.read.text(name, wholetext=True).first()[0]) if files.exists(self.spark, name) else {}

    def _deltas(self, above: int, below: int | None) -> list[int]:
        """Complete deltas after the base, and before a batch."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        store = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(root):
            return []
        names = [s.getPath() for s in store.listStatus(root) if s.getPath().getName().startswith("delta-") and store.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        numbers = sorted(int(p.getName().removeprefix("delta-")) for p in names)
        return [n for n in numbers if n > above and (below is None or n < below)]

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _whole(self, below: int | None = None) -> DataFrame:
        held = self._held()
        parts = [f"{self.path}/{held['base']}"] if held.get("base") else []
        parts += [f"{self.path}/delta-{n:012d}" for n in self._deltas(held.get("upto", -1), below)]
        schema = StructType([*SCHEMA.fields, *StructType.fromDDL("bucket int").fields])
        if not parts:
            return self.spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(p) for p in parts])

    def read(self) -> DataFrame:
        """Records with ``row_id``, which follows batches and the order within them."""
        return self._whole().select(*corpus.COLUMNS, F.struct("batch", "row").alias("row_id"))

    def add(self, records: DataFrame, batch: int) -> int:
        """The records of a batch whose keys are new, the first of each key; returns how many there are."""
        if batch <= self._held().get("upto", -1):
            return 0  # a batch that the base holds already
        keyed = corpus.with_key(corpus.dedupe(corpus.as_records(records.withColumn("row_id", F.monotonically_increasing_id())))).withColumn("bucket", self._bucket(F.col("dedupe_key")))
        keyed = self.spark.read.parquet(sinks.write_table(keyed.select(*corpus.COLUMNS, "dedupe_key", F.col("row_id").cast("long").alias("row"), "bucket"), f"{self.path}/_incoming/{batch:012d}", (), True))
        touched = [r[0] for r in keyed.select("bucket").distinct().collect()]  # at most as many as there are buckets
        known = self._whole(batch).where(F.col("bucket").isin(touched)).select("bucket", "dedupe_key")
        new = keyed.join(known, ["bucket", "dedupe_key"], "left_anti").withColumn("batch", F.lit(batch).cast("long"))
        sinks.write_table(new.select(*(f.name for f in SCHEMA.fields), "bucket"), f"{self.path}/delta-{batch:012d}", ("bucket",), True)
        return self.spark.read.schema("bucket int").parquet(f"{self.path}/delta-{batch:012d}").count()

    def compact(self) -> None:
        """Base and deltas become one base. Readers see the old one until the document names the new one."""
        held = self._held()
        deltas = self._deltas(held.get("upto", -1), None)
        if not deltas:
            return
        base = f"base-{deltas[-1]:012d}"
        sinks.write_table(self._whole().repartition("bucket"), f"{self.path}/{base}", ("bucket",), True)
        sinks.write_json(self.spark, f"{self.path}/table.json", {"base": base, "upto": deltas[-1], "buckets": self.buckets})
        jvm = self.spark.sparkContext._jvm
        store = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for old in [*(f"delta-{n:012d}" for n in deltas), *([held["base"]] if held.get("base") else [])]:
            store.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{old}"), True)
