"""Queries that run as streams over parts of the driver's tables, and over folders of files, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import impact, standardize
from ..session import written
from ..sources import files
from ..streaming import index as stream_index
from ..streaming import ingest, periods
from ..streaming.corpus_table import CorpusTable
from . import views as V
from .queries import _INDEX_VIEWS, _LABELS, _ROUND_INDEX, _URL, _impact, _index, _resample_sql, query, rounded
from .source_queries import _folder, _renamed


def _streamed(parts: list[DataFrame], make, root: str) -> DataFrame:
    """What a stream over ``parts`` has written, each a micro-batch of all the files that a part has."""
    spark = parts[0].sparkSession
    for part in parts:
        part.write.mode("append").parquet(f"{root}/in")
        made = make(spark.readStream.schema(part.schema).parquet(f"{root}/in"))
        made.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{root}/out")


@query(f"{_INDEX_VIEWS} SELECT date, company, sector, news_count, {_ROUND_INDEX} FROM iti")
def index_stream(spark, sf_dir):
    """The daily index by the stateful operator; its days come in three batches in no order, so many are late."""
    daily = impact.daily_impact(_impact(spark, sf_dir, "U")).select("date", "company", "sector", "impacto_dia", "risco_dia", "news_count", "mean_horizon")
    dealt = written(daily.withColumn("part", F.pmod(F.xxhash64("date", "company", "sector"), F.lit(3))), "daily")
    made = _streamed([dealt.where(F.col("part") == i).drop("part") for i in range(3)], stream_index.index_stream, _folder(spark))
    return rounded(stream_index.newest(made))


def _period_stream(frequency: str):
    @query(_resample_sql(frequency), f"{frequency}_stream")
    def run(spark, sf_dir):
        columns = ("date", "company", "sector", "impacto_dia", "risco_dia", "news_count", "iti_liquido", "iti_risco")
        index = written(_index(spark, sf_dir).select(*columns), "index")
        # Two batches of days in order, then one of another series so much later that its day closes all periods.
        days = [index.where("date < '2024-01-15'"), index.where("date >= '2024-01-15'")]
        later = [spark.range(1).select(F.to_date(F.lit(f"2030-01-0{k}")).alias("date"), F.lit("end").alias("company"), F.lit("end").alias("sector"), *(F.lit(0.0).cast(index.schema[c].dataType).alias(c) for c in columns[3:])) for k in (1, 2)]
        made = _streamed([*days, *later], lambda s: periods.resample_stream(s, frequency), _folder(spark))
        return rounded(made.where("company <> 'end'"))

    run.__doc__ = f"The {frequency} index by a stream whose periods close with the watermark."


for _frequency in _LABELS:
    _period_stream(_frequency)


@query(f"""WITH k AS (SELECT page_id, page_id % 3 AS batch, {_URL} AS u FROM pages)
    SELECT CAST(page_id AS VARCHAR) AS id, batch FROM k WHERE u <> '' QUALIFY row_number() OVER (PARTITION BY u ORDER BY batch, page_id) = 1""")
def upsert_stream(spark, sf_dir):
    """Pages as records in three batches: of each URL the first one stays, and the table is made anew in between."""
    root = _folder(spark)
    p = V.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), "url", (F.col("page_id") % 3).alias("part"), "page_id").sort("page_id")
    parts = [p.where(F.col("part") == i).select("id", "url") for i in range(3)]
    for part in parts:
        part.coalesce(1).sortWithinPartitions(F.col("id").cast("long")).write.mode("append").parquet(f"{root}/in")
    source = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    ingest.upsert_corpus(source, f"{root}/corpus", f"{root}/state", compact_every=2).start().awaitTermination()
    return CorpusTable(spark, f"{root}/corpus").read().select("id", F.col("row_id.batch").alias("batch"))


# ---- files ----


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, 'f' || (2 - o_orderkey % 3) AS file, row_number() OVER (ORDER BY 2 - o_orderkey % 3, o_orderkey) + 1 AS row FROM orders""")
def folder_rows(spark, sf_dir):
    """Orders in three files of a folder, numbered through it after the header."""
    file = F.concat(F.lit("f"), (2 - F.col("o_orderkey") % 3).cast("string"))
    o = V.table(spark, sf_dir, "orders").select("o_orderkey", file.alias("file"), file.alias("of"))
    root = _renamed(o, _folder(spark), "", "csv", by="of", order="o_orderkey", header="true")
    rows = files.read(spark, files.Reader(f"{root}/f*.csv"))
    return standardize.with_row_number(rows, "row_id").select("o_orderkey", "file", F.col("source_row_number").alias("row"))


@query("""WITH r AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'soon' ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS day, event_id % 5 = 0 AS blank, event_id % 11 = 5 AS bad FROM events),
    c AS (SELECT CASE WHEN bad THEN 'bad_line' WHEN day IS NULL THEN 'missing_date' WHEN day = 'soon' THEN 'unreadable_date' WHEN day NOT BETWEEN '2024-01-05' AND '2024-01-20' THEN 'out_of_range' WHEN blank THEN 'empty_text' ELSE 'rows_kept' END AS cause FROM r)
    SELECT cause, count(*) AS rows FROM c GROUP BY cause UNION ALL SELECT 'rows_read', count(*) FROM c""")
def load_counters(spark, sf_dir):
    """Rows of a CSV file of events by what became of them, counted in the pass that loads it."""
    k = F.col("event_id")
    day = F.when(k % 7 == 0, "").when(k % 7 == 1, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    line = F.concat_ws(",", k.cast("string"), day, F.when(k % 5 == 0, "").otherwise("text"), F.when(k % 11 == 5, "more,and more"))
    root = f"{_folder(spark)}/lines"
    V.table(spark, sf_dir, "events").select(F.when(k.isNotNull(), line)).write.text(root)
    d = standardize.Dataset("d", "d", {"news_id": "id", "text": "text", "date": "day"}, start_date="2024-01-05", end_date="2024-01-20")
    reader = files.Reader(root, on_bad_lines="skip", multiline=False, options={"header": "false"}, names=("id", "day", "text"))
    rows = files.read(spark, reader, keep_bad=True)
    counters = Observation()
    standardize.standardize(rows, d, counters=counters).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(sorted((c, n) for c, n in counters.get.items() if n or c == "rows_read"), "cause string, rows long")
