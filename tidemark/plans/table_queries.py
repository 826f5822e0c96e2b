"""Queries that write tables and read them back, hold runs and state, and check rules, each beside its SQL."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from ..functions import dimensions
from ..operators import aggregates, classification, corpus, impact, market, ngrams, predictions, validation
from ..session import shared_dir
from ..sources import assets, files, sinks
from ..sources.state import ScrapeState
from . import views as V
from .queries import _GAINS, _INFERRED, _ROUND, _TWO, _URL, _deltas, _resampled_sql, _scores_rounded, _uncertain, query, rounded


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/queries/{uuid.uuid4().hex}"


# ---- files ----


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority, printf('%.8f', o_totalprice) AS o_totalprice FROM orders")
def csv_orders(spark, sf_dir):
    """Orders written as CSV with fixed decimals and read as text."""
    path = sinks.write_csv(V.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("double").alias("o_totalprice")), _folder(spark))
    return files.read(spark, files.Reader(path)).drop("row_id")


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, CAST(user_id AS VARCHAR) AS user_id, props FROM events")
def jsonl_events(spark, sf_dir):
    """Events written as lines of JSON and read as text."""
    e = V.table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "props")
    path = assets.materialize_sample(e, _folder(spark), max_rows=2**31 - 1)
    return files.read(spark, files.Reader(path, format="jsonl")).drop("row_id")


@query("SELECT o_orderkey, o_custkey FROM orders LIMIT 200")
def first_orders(spark, sf_dir):
    """The default number of first rows of a file, in its order."""
    return files.read(spark, files.Reader(f"{sf_dir}/orders.parquet", format="parquet", max_rows=200)).select("o_orderkey", "o_custkey")


@query("SELECT column_name AS name, true AS present FROM (DESCRIBE SELECT * FROM lineitem)")
def table_header(spark, sf_dir):
    """Column names without a row read; the file's validation and presence checks."""
    r = files.Reader(f"{sf_dir}/lineitem.parquet", format="parquet")
    files.validate_file(spark, r)
    absent = assets.missing(spark, {"table": {"lineitem": r.path, "nothing": f"{sf_dir}/nothing.parquet"}})
    return spark.createDataFrame([(c, absent == ["table:nothing"]) for c in files.inspect_columns(spark, r)], "name string, present boolean")


@query(f"""{V.with_("order_prices")}, r AS (SELECT date, ticker, CAST(printf('%.8f', close) AS DOUBLE) AS close FROM prices)
    SELECT date, ticker, round(close, 4) AS close, round(close / lag(close) OVER w - 1, 7) AS simple_return, round(ln(close / lag(close) OVER w), 7) AS log_return FROM r WINDOW w AS (PARTITION BY ticker ORDER BY date)""")
def price_file(spark, sf_dir):
    """Prices written as CSV under other names, read back, cleaned, with returns."""
    p = V.order_prices(spark, sf_dir).select(F.col("date").alias("Date"), F.col("ticker").alias("Symbol"), F.col("close").alias("Close"))
    out = files.read_prices(spark, sinks.write_csv(p, _folder(spark)), {"date": "Date", "ticker": "Symbol", "close": "Close"})
    return out.select("date", "ticker", F.round("close", 4).alias("close"), F.round("simple_return", 7).alias("simple_return"), F.round("log_return", 7).alias("log_return"))


@query(f"""{V.with_("pred", "impact", "daily")} SELECT * FROM (VALUES ('m1', 'd1', true), ('m1', 'd2', false), ('m2', 'd1', false)) AS v(model_key, dataset_key, has_uncertainty)
    CROSS JOIN (SELECT count(*) AS index_rows, CAST(sum(news_count) AS BIGINT) AS news, min(date) AS first_day FROM daily) CROSS JOIN (SELECT 'partial_failure' AS status, 3 AS successes, 1 AS failures)""")
def run_store(spark, sf_dir):
    """A run of four combinations is written, found again as the latest one, and its tables and summary are read."""
    p = V.predictions(spark, sf_dir)
    daily, base = impact.daily_impact(impact.news_impact(p, providers=("dataset_columns",))), impact.baselines_daily(p)
    root = _folder(spark)
    store = sinks.RunStore(spark, root, "run")
    for model, dataset in (("m1", "d1"), ("m1", "d2"), ("m2", "d1"), ("m2", "d2")):
        key, folder = f"{model}/{dataset}", store.indices(model, dataset)
        store.mark(key, "running")
        whole = (model, dataset) != ("m2", "d2")
        store.save_frames(key, folder, {"iti_daily": daily, "baselines_daily": base if whole else None, "iti_uncertainty_daily": base if key == "m1/d1" else None})
        store.mark(key, "success" if whole else "failed")
    run = files.latest_run(spark, root)
    summary = files.read_summary(spark, run)
    index = files.read_index(spark, f"{run}/indices/m1/d1/iti_daily.csv").agg(F.count(F.lit(1)).alias("index_rows"), F.sum("news_count").alias("news"), F.min("date").alias("first_day"))
    told = {"status": F.lit(summary["status"]), "successes": F.lit(summary["counts"]["success"]), "failures": F.lit(summary["counts"]["failed"])}
    return files.list_combinations(spark, run).crossJoin(F.broadcast(index)).withColumns(told)


# ---- the collector's memory, the corpus ----


@query(f"SELECT DISTINCT {_URL} AS url FROM pages WHERE {_URL} <> ''")
def seen_urls(spark, sf_dir):
    """URLs of two runs that overlap, remembered once each."""
    p, state = V.table(spark, sf_dir, "pages").select("page_id", "url"), ScrapeState(spark, _folder(spark))
    state.update("first", "2024-01-31", p.where("page_id % 2 = 0"))
    state.update("second", "2024-02-29", p)
    return ScrapeState(spark, state.path).seen()


@query("""SELECT CAST(CAST(max(ts) AS DATE) + 1 AS VARCHAR) AS since, '2030-01-01' AS until, count(DISTINCT event_type) AS sites FROM events""")
def next_window(spark, sf_dir):
    """The days that a collector has to look at next, from what the state keeps of each site."""
    state = ScrapeState(spark, _folder(spark))
    for r in V.table(spark, sf_dir, "events").groupBy("event_type").agg(F.max(F.to_date("ts")).alias("last")).collect():  # one row a site
        state.update(r.event_type, r["last"])
    kept = ScrapeState(spark, state.path)
    since, until = kept.window("2020-01-01", today=date(2030, 1, 1))
    return spark.createDataFrame([(since, until, len(kept.sites))], "since string, until string, sites long")


@query("""WITH rows AS (SELECT 'e' || CAST(s_suppkey % 40 AS VARCHAR) AS id, s_name AS titulo, CASE WHEN s_suppkey % 7 = 0 THEN ' Saneamento ' ELSE 'X' END AS empresa, CASE WHEN s_suppkey % 5 = 0 THEN 'setor' ELSE 'T' END AS ticker, 0 AS part, s_suppkey AS row FROM supplier
        UNION ALL SELECT 'e' || CAST(c_custkey AS VARCHAR), c_name, 'X', 'T', 1, c_custkey FROM customer)
    SELECT id, titulo FROM rows WHERE NOT (trim(empresa) = 'Saneamento' OR upper(trim(ticker)) = 'SETOR') QUALIFY row_number() OVER (PARTITION BY id ORDER BY part, row) = 1""")
def merged_corpus(spark, sf_dir):
    """Two tables of records in order, without generic ones, the first of each key."""
    s, c = V.table(spark, sf_dir, "supplier"), V.table(spark, sf_dir, "customer")
    first = s.select(F.concat(F.lit("e"), F.col("s_suppkey") % 40).alias("id"), F.col("s_name").alias("titulo"), F.when(F.col("s_suppkey") % 7 == 0, " Saneamento ").otherwise("X").alias("empresa"), F.when(F.col("s_suppkey") % 5 == 0, "setor").otherwise("T").alias("ticker"), F.col("s_suppkey").cast("long").alias("row_id"))
    second = c.select(F.concat(F.lit("e"), F.col("c_custkey")).alias("id"), F.col("c_name").alias("titulo"), F.lit("X").alias("empresa"), F.lit("T").alias("ticker"), F.col("c_custkey").cast("long").alias("row_id"))
    return corpus.merge([first, second]).select("id", "titulo")


# ---- rules and groups ----

_PRED = """SELECT CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST(event_id % 900 AS VARCHAR) END AS news_id, CASE WHEN event_id % 17 = 0 THEN 'BAD' ELSE 'NEUTRAL' END AS predicted_label,
    CASE WHEN event_id % 23 = 0 THEN 'BAD' WHEN event_id % 2 = 0 THEN 'POSITIVE' END AS true_label, event_id % 11 / 20.0::DOUBLE AS pos, event_id % 7 / 20.0::DOUBLE AS neg, event_id FROM events"""


@query(f"""WITH p AS ({_PRED}), q AS (SELECT *, 1 - pos - neg + CASE WHEN event_id % 29 = 0 THEN 0.5::DOUBLE ELSE 0 END AS neu FROM p),
    r AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN 1.5::DOUBLE ELSE greatest(pos, neg, neu) END AS c, pos - neg + CASE WHEN event_id % 31 = 0 THEN 2 ELSE 0 END AS s FROM q)
    SELECT count_if(news_id IS NULL)::BIGINT AS missing_id, count_if(predicted_label = 'BAD')::BIGINT AS bad_label, count_if(true_label = 'BAD')::BIGINT AS bad_true_label, count_if(c > 1 + 1e-6)::BIGINT AS confidence_range, count_if(abs(s) > 1 + 1e-6)::BIGINT AS sentiment_range,
        count_if(neu > 1 + 1e-6 OR neu < -1e-6)::BIGINT AS probability_range, count_if(event_id % 29 = 0)::BIGINT AS probability_total, count_if(abs(greatest(pos, neg, neu) - c) > 1e-6)::BIGINT AS confidence_is_top, count_if(event_id % 31 = 0)::BIGINT AS sentiment_is_difference, count(*) - count(DISTINCT news_id) AS repeated_key FROM r""")
def prediction_rules(spark, sf_dir):
    """How many rows break each rule of a table of predictions, some of them broken on purpose."""
    k = F.col("event_id")
    e = V.table(spark, sf_dir, "events").select("event_id", (k % 11 / F.lit(20.0)).alias("prob_positive"), (k % 7 / F.lit(20.0)).alias("prob_negative"))
    e = e.withColumn("prob_neutral", 1 - F.col("prob_positive") - F.col("prob_negative") + F.when(k % 29 == 0, 0.5).otherwise(0.0))
    top = F.greatest("prob_positive", "prob_negative", "prob_neutral")
    rows = e.select(
        "prob_positive", "prob_negative", "prob_neutral", F.when(k % 19 != 0, (k % 900).cast("string")).alias("news_id"), F.when(k % 17 == 0, "BAD").otherwise("NEUTRAL").alias("predicted_label"),
        F.when(k % 23 == 0, "BAD").when(k % 2 == 0, "POSITIVE").alias("true_label"), F.when(k % 13 == 0, 1.5).otherwise(top).alias("confidence"),
        (F.col("prob_positive") - F.col("prob_negative") + F.when(k % 31 == 0, 2.0).otherwise(0.0)).alias("continuous_sentiment"), *(F.lit("x").alias(c) for c in ("run_id", "model_key", "dataset_key")),
    )
    return predictions.violations(rows)


@query(f"""{V.with_("pred")}, p AS (SELECT date, CASE WHEN news_id % 3 = 0 THEN ' ' ELSE company END AS company, sector, d, c FROM pred),
    g AS (SELECT 'company_day' AS aggregation_level, count(*) AS n FROM p WHERE trim(company) <> '' GROUP BY date, company UNION ALL SELECT 'sector_day', count(*) FROM p GROUP BY date, sector UNION ALL SELECT 'market_day', count(*) FROM p GROUP BY date)
    SELECT aggregation_level, count(*) AS groups, CAST(sum(n) AS BIGINT) AS news FROM g WHERE n >= 5 GROUP BY aggregation_level""")
def busy_groups(spark, sf_dir):
    """Groups of at least five news; rows without a company are left out of its level."""
    p = V.predictions(spark, sf_dir).withColumn("company", F.when(F.col("news_id") % 3 == 0, " ").otherwise(F.col("company")))
    out = aggregates.aggregate_levels(p, minimum_news=5)
    return aggregates.sorted_aggregates(out).groupBy("aggregation_level").agg(F.count(F.lit(1)).alias("groups"), F.sum("news_count").alias("news"))


@query("""SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY lower(trim(source)) ORDER BY doc_id) = 1 THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END AS novelty FROM documents WHERE source IS NOT NULL""")
def title_novelty(spark, sf_dir):
    """A title is new at its first row only; every provider has its say."""
    d = V.table(spark, sf_dir, "documents").where("source is not null").select("doc_id", F.col("doc_id").alias("row_id"), F.col("source").alias("title"), F.lit("words").alias("text"), F.lit("c").alias("company"), F.lit(0.5).alias("continuous_sentiment"), F.lit(0.8).alias("confidence"))
    return dimensions.resolve(d).select("doc_id", F.col("dim_novelty").alias("novelty"))


@query("""WITH c AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'NEGATIVE' WHEN quality = 1 THEN 'POSITIVE' WHEN quality = 0 THEN 'NEUTRAL' END AS true_label, CASE WHEN n_chars % 3 = 0 THEN 'NEGATIVE' WHEN n_chars % 3 = 1 THEN 'NEUTRAL' ELSE 'POSITIVE' END AS predicted_label FROM documents JOIN labels USING (doc_id)),
    l AS (SELECT unnest(['NEGATIVE', 'NEUTRAL', 'POSITIVE']) AS label)
    SELECT a.label AS true_label, b.label AS predicted_label, count(doc_id) AS count FROM l a CROSS JOIN l b LEFT JOIN c ON true_label = a.label AND predicted_label = b.label GROUP BY a.label, b.label""")
def confusion_long(spark, sf_dir):
    """The confusion matrix as rows."""
    out = classification.confusion(V.classified(spark, sf_dir))
    return sinks.confusion_table(out.toDF("true_label", "negative", "neutral", "positive"))


# ---- validation ----

@query(f"{_GAINS} SELECT horizon, iti_predictor, baseline, metric, {_ROUND.format('delta')}, n FROM deltas")
def validation_deltas(spark, sf_dir):
    """Advantages of the index over each baseline on the points that both have, by all metrics."""
    return _scores_rounded(_deltas(spark, sf_dir).select("horizon", "iti_predictor", "baseline", "metric", "delta", "n"))


@query(f"""{_GAINS} SELECT iti_predictor, CAST(count_if(delta > 0) AS BIGINT) AS wins, CAST(count_if(significant) AS BIGINT) AS significant_wins, count(*) AS comparisons
    FROM deltas WHERE metric IN ('pearson', 'spearman') GROUP BY iti_predictor""")
def validation_wins(spark, sf_dir):
    """How often the index is ahead, and how often that is significant, by the metrics of the conclusion."""
    return validation.wins(_deltas(spark, sf_dir), validation.Validation().conclusion_metrics).select("iti_predictor", "wins", "significant_wins", "comparisons")


@query(f"""{_GAINS}, t AS (SELECT iti_predictor, count_if(delta > 0) AS w, count_if(significant) AS s, count(*) AS n FROM deltas WHERE metric IN ('pearson', 'spearman') GROUP BY iti_predictor)
    SELECT iti_predictor, printf('%s (pearson, spearman): %d/%d vitórias (%.1f%%), %d significativas (%.1f%%)', iti_predictor, w::BIGINT, n, w * 100.0::DOUBLE / n, s::BIGINT, s * 100.0::DOUBLE / n) AS said FROM t""")
def conclusion_sentences(spark, sf_dir):
    """What a research run says of each index."""
    v = validation.Validation()
    return validation.conclusions(validation.wins(_deltas(spark, sf_dir), v.conclusion_metrics), v.conclusion_metrics)


@query(f"""{_TWO}, dis AS (SELECT date, company, sector, avg(disagreement_var) AS x FROM news GROUP BY date, company, sector),
    p AS (SELECT CAST(ts AS DATE) AS date, 'C' || CAST(user_id % 10 AS VARCHAR) AS company, avg(value) + 1 AS close FROM events GROUP BY ALL),
    r AS (SELECT date, company, abs(ln(close / lag(close) OVER (PARTITION BY company ORDER BY date))) AS y FROM p),
    good AS (SELECT 1 AS horizon, 'u' AS predictor, 'abs' AS target_mode, '' AS ticker, date, company, '' AS sector, x, y FROM dis JOIN r USING (date, company) WHERE x IS NOT NULL AND y IS NOT NULL),
    {_resampled_sql("good")}
    SELECT metric, {_INFERRED} FROM inferred""")
def uncertainty_validation(spark, sf_dir):
    """Model disagreement against the same day's absolute return."""
    daily = _uncertain(spark, sf_dir)[1]
    panel = market.returns(V.prices(spark, sf_dir)).withColumnRenamed("ticker", "company")
    return _scores_rounded(validation.uncertainty(daily, panel, validation.Validation(), column="disagreement_mean"))


# ---- a trained scorer ----

_GRAMS = """
    rows AS (SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS news_id, CASE role WHEN 'user' THEN 'POSITIVE' WHEN 'assistant' THEN 'NEUTRAL' ELSE 'NEGATIVE' END AS label,
                    regexp_extract_all(lower(coalesce(text, '')), '([\\p{L}\\p{N}]+)', 1) AS w FROM conversations),
    grams AS (SELECT news_id, label, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM rows),
    met AS (SELECT news_id, label, CAST('0x' || substr(md5(gram), 1, 12) AS BIGINT) % 4096 AS bucket, count(*) AS n FROM grams GROUP BY ALL)"""


@query(f"""WITH {_GRAMS},
    totals AS (SELECT l.label, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT label FROM rows) l LEFT JOIN met USING (label) GROUP BY l.label),
    priors AS (SELECT label, ln(count(*) / (SELECT count(*) FROM rows)::DOUBLE) AS prior FROM rows GROUP BY label),
    counts AS (SELECT label, bucket, sum(n) AS n FROM met GROUP BY ALL),
    scores AS (
        SELECT m.news_id, t.label, sum(m.n * (ln(coalesce(c.n, 0) + 1.0::DOUBLE) - ln(t.total + 4096.0::DOUBLE))) AS s
        FROM (SELECT news_id, bucket, n FROM met) m CROSS JOIN totals t LEFT JOIN counts c ON c.label = t.label AND c.bucket = m.bucket GROUP BY ALL),
    logits AS (SELECT r.news_id, p.label, p.prior + coalesce(s.s, 0) AS z FROM rows r CROSS JOIN priors p LEFT JOIN scores s ON s.news_id = r.news_id AND s.label = p.label),
    top AS (SELECT news_id, max(z) AS m FROM logits GROUP BY news_id),
    e AS (SELECT news_id, label, exp(z - m) AS e FROM logits JOIN top USING (news_id))
    SELECT news_id, round(max(CASE label WHEN 'NEGATIVE' THEN e END) / sum(e), 6) AS prob_negative, round(max(CASE label WHEN 'NEUTRAL' THEN e END) / sum(e), 6) AS prob_neutral,
           round(max(CASE label WHEN 'POSITIVE' THEN e END) / sum(e), 6) AS prob_positive FROM e GROUP BY news_id""")
def ngram_scores(spark, sf_dir):
    """A scorer fitted on the turns of all conversations by role, kept, loaded again and used on all of them."""
    c = V.table(spark, sf_dir, "conversations")
    label = F.when(F.col("role") == "user", "positive").when(F.col("role") == "assistant", "neutral").otherwise("negative")
    rows = c.select((F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("news_id"), "text", label.alias("true_label"))
    path = ngrams.save(ngrams.fit(rows, buckets=4096), f"{_folder(spark)}/scorer")
    registry = predictions.Registry()
    registry.load(spark, "roles", path)
    out = registry.score("roles", rows)
    return out.select("news_id", *(F.round(F.get("probabilities", F.lit(i)), 6).alias(f"prob_{n}") for i, n in enumerate(("negative", "neutral", "positive"))))
