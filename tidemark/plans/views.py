"""News-like views of the driver's tables, as DataFrames and as DuckDB SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def predictions(spark: SparkSession, sf_dir: str, company: str = "C") -> DataFrame:
    """Every event as a scored news item. ``company`` C: ten companies; U: one per user."""
    e = table(spark, sf_dir, "events")
    owner = F.col("user_id") % 10 if company == "C" else F.col("user_id")
    return e.select(
        F.col("event_id").alias("news_id"),
        F.col("event_id").alias("row_id"),
        F.to_date("ts").alias("date"),
        F.concat(F.lit(company), owner.cast("string")).alias("company"),
        F.col("event_type").alias("sector"),
        F.lit(None).cast("string").alias("ticker"),
        (F.least(F.col("value"), F.lit(100.0)) / 50 - 1).alias("continuous_sentiment"),
        (F.lit(0.5) + F.col("event_id") % 50 / F.lit(100.0)).alias("confidence"),
        (F.lit(0.5) + F.col("event_id") % 4 * F.lit(0.5)).alias("h"),
        F.when(F.col("value") < 30, "NEGATIVE").when(F.col("value") < 70, "NEUTRAL").otherwise("POSITIVE").alias("predicted_label"),
    )


def second_model(preds: DataFrame) -> DataFrame:
    d = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.col("continuous_sentiment") * 0.5 + F.col("news_id") % 7 / F.lit(10.0)))
    return preds.withColumn("continuous_sentiment", d)


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ticker per company of the C kind: the day's mean event value plus 1."""
    e = table(spark, sf_dir, "events")
    ticker = F.concat(F.lit("C"), (F.col("user_id") % 10).cast("string"))
    return e.groupBy(F.to_date("ts").alias("date"), ticker.alias("ticker")).agg((F.avg("value") + 1).alias("close"))


def order_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long daily series per order priority."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("ticker")).agg(F.avg("o_totalprice").alias("close"))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a true label where there is one, and a predicted one."""
    labels = table(spark, sf_dir, "labels")
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    true = F.when(F.col("toxic") == 1, "NEGATIVE").when(F.col("quality") == 1, "POSITIVE").when(F.col("quality") == 0, "NEUTRAL")
    predicted = F.when(F.col("n_chars") % 3 == 0, "NEGATIVE").when(F.col("n_chars") % 3 == 1, "NEUTRAL").otherwise("POSITIVE")
    return d.join(labels, "doc_id", "left").select("doc_id", "lang", true.alias("true_label"), predicted.alias("predicted_label"))


#: CTEs of the same views.
SQL = {
    "pred": """pred AS (SELECT event_id AS news_id, CAST(ts AS DATE) AS date, 'C' || CAST(user_id % 10 AS VARCHAR) AS company, event_type AS sector,
        least(value, 100.0::DOUBLE) / 50 - 1 AS d, 0.5::DOUBLE + event_id % 50 / 100.0::DOUBLE AS c, 0.5::DOUBLE + event_id % 4 * 0.5::DOUBLE AS h,
        CASE WHEN value < 30 THEN 'NEGATIVE' WHEN value < 70 THEN 'NEUTRAL' ELSE 'POSITIVE' END AS predicted_label FROM events)""",
    "pred_u": """pred AS (SELECT event_id AS news_id, CAST(ts AS DATE) AS date, 'U' || CAST(user_id AS VARCHAR) AS company, event_type AS sector,
        least(value, 100.0::DOUBLE) / 50 - 1 AS d, 0.5::DOUBLE + event_id % 50 / 100.0::DOUBLE AS c, 0.5::DOUBLE + event_id % 4 * 0.5::DOUBLE AS h FROM events)""",
    "impact": """impact AS (SELECT *, d * c AS i_n, greatest(0.0::DOUBLE, -d) * c AS r_n, c AS w_n FROM pred)""",
    "daily": """daily AS (SELECT company, sector, date,
        CASE WHEN sum(w_n) > 0 THEN sum(i_n * w_n) / sum(w_n) ELSE avg(i_n) END AS impacto_dia,
        CASE WHEN sum(w_n) > 0 THEN sum(r_n * w_n) / sum(w_n) ELSE avg(r_n) END AS risco_dia,
        count(news_id) AS news_count, avg(c) AS mean_confidence, 1.0::DOUBLE AS mean_relevance, avg(h) AS mean_horizon
        FROM impact GROUP BY company, sector, date)""",
    "baselines": """baselines AS (SELECT date, company, sector, count(news_id) AS b0_news_count, avg(d) AS b1_mean_sentiment,
        CASE WHEN sum(c) > 0 THEN sum(d * c) / sum(c) ELSE avg(d) END AS b2_confidence_weighted_sentiment FROM pred GROUP BY date, company, sector)""",
    # The unblocked closed form; exact enough over the month that the events span.
    "index": """days AS (SELECT company, sector, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM daily GROUP BY company, sector),
        filled AS (SELECT d.company, d.sector, d.date, coalesce(x.impacto_dia, 0.0::DOUBLE) AS impacto_dia, coalesce(x.risco_dia, 0.0::DOUBLE) AS risco_dia, coalesce(x.news_count, 0) AS news_count,
            CASE WHEN x.date IS NOT NULL THEN greatest(0.01::DOUBLE, least(0.999::DOUBLE, pow(0.85::DOUBLE, 1 / greatest(x.mean_horizon, 0.05::DOUBLE)))) ELSE 0.85::DOUBLE END AS a,
            x.date IS NOT NULL AS news FROM days d LEFT JOIN daily x USING (company, sector, date)),
        logs AS (SELECT *, sum(ln(a)) OVER w AS l, CASE WHEN news THEN (1 - a) * impacto_dia ELSE 0 END AS bi, CASE WHEN news THEN (1 - a) * risco_dia ELSE 0 END AS br
            FROM filled WINDOW w AS (PARTITION BY company, sector ORDER BY date)),
        iti AS (SELECT date, company, sector, impacto_dia, risco_dia, news_count, exp(l) * sum(bi * exp(-l)) OVER w AS iti_liquido, exp(l) * sum(br * exp(-l)) OVER w AS iti_risco
            FROM logs WINDOW w AS (PARTITION BY company, sector ORDER BY date))""",
    "prices": """prices AS (SELECT CAST(ts AS DATE) AS date, 'C' || CAST(user_id % 10 AS VARCHAR) AS ticker, avg(value) + 1 AS close FROM events GROUP BY ALL)""",
    "order_prices": """prices AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS ticker, avg(o_totalprice) AS close FROM orders GROUP BY ALL)""",
    "returns": """returns AS (SELECT *, close / lag(close) OVER w - 1 AS simple_return, ln(close / lag(close) OVER w) AS log_return FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date))""",
    "panel": """panel AS (SELECT coalesce(i.date, b.date) AS date, coalesce(i.company, b.company) AS company, coalesce(i.sector, b.sector) AS sector, i.company AS own, impacto_dia, risco_dia, news_count, iti_liquido, iti_risco,
            b0_news_count, b1_mean_sentiment, b2_confidence_weighted_sentiment, coalesce(impacto_dia, 0.0::DOUBLE) AS b3_daily_impact_no_memory, coalesce(i.company, b.company) AS ticker
            FROM iti i FULL JOIN baselines b ON i.date = b.date AND i.company = b.company AND i.sector = b.sector WHERE coalesce(i.company, b.company) <> 'C9'),
        aligned AS (SELECT p.*, r.close, r.simple_return, r.log_return FROM panel p JOIN returns r ON p.date = r.date AND p.ticker = r.ticker),
        ahead AS (SELECT *, %s FROM aligned)""",
    "classified": """cls AS (SELECT d.doc_id, d.lang, CASE WHEN toxic = 1 THEN 'NEGATIVE' WHEN quality = 1 THEN 'POSITIVE' WHEN quality = 0 THEN 'NEUTRAL' END AS true_label,
        CASE WHEN n_chars % 3 = 0 THEN 'NEGATIVE' WHEN n_chars % 3 = 1 THEN 'NEUTRAL' ELSE 'POSITIVE' END AS predicted_label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
}

#: Companies of the C kind that have a ticker; C9 has none.
TICKERS = {f"C{k}": f"C{k}" for k in range(9)}


def cumulative(h: int, order: str = "date, company, sector") -> str:
    w = f"(PARTITION BY ticker ORDER BY {order} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return f"CASE WHEN count(*) OVER {w} = {h} THEN sum(coalesce(log_return, 0)) OVER {w} END AS future_log_return_{h}"


def with_(*names: str, **filled: str) -> str:
    """A WITH clause of the named views."""
    return "WITH " + ",\n".join(SQL[n] % filled[n] if n in filled else SQL[n] for n in names)
