"""Files to standard tables, scorer output to predictions, metrics, sinks."""

import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidemark.functions import scores as S
from tidemark.operators import aggregates, classification, predictions, standardize
from tidemark.sources import files, sinks

CSV = '''id,data,empresa,titulo,noticia,sentimento,url,extra
001,01/02/2024,Sabesp,T1,"Texto, com ""aspas""
e linha",positivo,https://a,x
002,03/02/2024,NA,T2,Outro,negativo,https://b,
002,bad,Copasa,T3,Mais,neutro,https://c,z
004,05/02/2024,Copasa,T4,   ,neutro,https://d,z
'''

DATASET = standardize.Dataset(
    "d", "D", {"news_id": "id", "text": "noticia", "date": "data", "company": "empresa", "title": "titulo", "true_label": "sentimento", "url": None},
    constants={"source": "const"}, date_format="%d/%m/%Y", label_map={"Positivo": "positive", "negativo": "NEGATIVE", "neutro": "neutral"}, labels_available=True,
)


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "n.csv"
    path.write_text(CSV, encoding="utf-8")
    return str(path)


def test_csv_to_standard(spark, csv):
    raw = files.read(spark, files.Reader(csv))
    got = standardize.standardize(raw, DATASET)
    rows = got.orderBy("source_row_number").collect()
    assert [r.news_id for r in rows] == ["001", "002", "002__dup1"]
    assert rows[0].text == 'Texto, com "aspas"\ne linha' and rows[0].date == "2024-02-01" and rows[0].source == "const"
    assert rows[1].company is None and rows[2].date is None
    assert [r.true_label for r in rows] == ["POSITIVE", "NEGATIVE", "NEUTRAL"]
    assert [r.source_row_number for r in rows] == [2, 3, 4] and got.columns == [*standardize.COLUMNS, "source__url", "extra"]
    stats = standardize.load_statistics(got).first()
    assert stats.rows == 3 and stats.missing_date == 1 and stats.renumbered_ids == 1
    assert files.inspect_columns(spark, files.Reader(csv))[:2] == ("id", "data")


def test_limit_comes_before_the_date_filter(spark, csv):
    from dataclasses import replace

    raw = files.read(spark, files.Reader(csv))
    limited = replace(DATASET, max_rows=1, start_date="2024-02-02")
    assert standardize.standardize(raw, limited).count() == 0
    ranged = replace(DATASET, start_date="2024-02-02", end_date="2024-02-03")
    assert [(r.news_id, r.source_row_number) for r in standardize.standardize(raw, ranged).collect()] == [("002", 2)]


def test_strict_modes(spark, csv):
    from dataclasses import replace

    raw = files.read(spark, files.Reader(csv))
    for changed, message in ((replace(DATASET, fail_on_duplicate_ids=True), "duplicate id"), (replace(DATASET, date_errors="raise"), "invalid date"), (replace(DATASET, label_map={"positivo": "positive"}), "unknown label"), (replace(DATASET, drop_empty_text=False), "empty")):
        with pytest.raises(Exception, match=message):
            standardize.standardize(raw, changed).collect()
    with pytest.raises(ValueError, match="missing"):
        standardize.standardize(raw, replace(DATASET, columns={"text": "nope"}))


def test_composed_text_is_an_extra_column(spark, csv):
    from dataclasses import replace

    raw = files.read(spark, files.Reader(csv))
    d = replace(DATASET, compose_template="Title: {t} Body: {b}", compose_fields={"t": "titulo", "b": "noticia"})
    got = standardize.standardize(raw, d)
    assert got.count() == 4 and "__composed_text__" in got.columns and got.where("news_id = '004'").first().text == "Title: T4 Body:"


def test_extra_names_avoid_clashes():
    names = standardize.extra_names(["id", "url", "x"], {"id"})
    assert names == {"url": "source__url", "x": "x"}


def test_jsonl_and_parquet(spark, tmp_path):
    p = tmp_path / "n.jsonl"
    p.write_text('{"id": 1, "t": "a", "o": {"x": 1}}\n{"id": "02", "t": null}\n')
    rows = files.read(spark, files.Reader(str(p), "jsonl")).orderBy("row_id").collect()
    assert [(r.id, r.t) for r in rows] == [("1", "a"), ("02", None)]
    spark.range(5).write.parquet(str(tmp_path / "p"))
    assert files.read(spark, files.Reader(str(tmp_path / "p"), "parquet", max_rows=2)).count() == 2
    with pytest.raises(ValueError):
        files.read(spark, files.Reader("x", "xls"))
    with pytest.raises(FileNotFoundError):
        files.validate_file(spark, files.Reader(str(tmp_path / "none.csv")))


def test_labels_and_scores(spark):
    df = spark.createDataFrame([(" pos ", 0.7, 0.1), ("", None, 0.1), ("LABEL_0", 0.5, 0.5)], "l string, p double, n double")
    rows = df.select(S.normalize_label(F.col("l"), S.label_ids({0: "negative"})), S.continuous(F.col("p"), F.col("n"))).collect()
    assert [r[0] for r in rows] == ["POSITIVE", None, "NEGATIVE"] and rows[0][1] == pytest.approx(0.6) and rows[1][1] is None
    with pytest.raises(Exception, match="unknown sentiment"):
        df.select(S.normalize_label(F.lit("?"))).collect()
    with pytest.raises(Exception, match="outside"):
        df.select(S.continuous(F.lit(1.5), F.lit(0.0))).collect()


def test_softmax_is_stable(spark):
    row = spark.range(1).select(S.softmax(F.array(F.lit(1000.0), F.lit(1000.0), F.lit(-1000.0))).alias("s"), S.scores_from_logits(F.array(F.lit(0.0), F.lit(0.0)), "multi_label_classification").alias("g")).first()
    assert row.s == pytest.approx([0.5, 0.5, 0]) and row.g == pytest.approx([0.5, 0.5])


def test_probability_checks(spark):
    df = spark.createDataFrame([("1", 0.2, 0.3, 0.5, "POS"), ("2", 0.2, 0.3, 0.505, None)], "news_id string, prob_negative double, prob_neutral double, prob_positive double, label string")
    rows = {r.news_id: r for r in predictions.standard_scores(df).collect()}
    assert rows["1"].predicted_label == "POSITIVE" and not rows["1"].probability_normalized
    assert rows["2"].probability_normalized and rows["2"].probability_sum == pytest.approx(1)
    for bad in [("1", 0.2, 0.3, 0.6, None), ("1", None, 0.3, 0.7, None), ("1", -0.1, 0.4, 0.7, None), ("1", 0.2, 0.3, 0.5, "NEG")]:
        with pytest.raises(Exception):
            predictions.standard_scores(spark.createDataFrame([bad], df.schema)).collect()
    lax = predictions.standard_scores(spark.createDataFrame([("1", 0.2, 0.3, 0.6, None)], df.schema), strict=False).first()
    assert lax.confidence is None


def test_sequences_follow_id2label(spark):
    df = spark.createDataFrame([("1", [0.7, 0.2, 0.1])], "news_id string, scores array<double>")
    row = predictions.standard_scores(df, {0: "positive", 1: "neutral", 2: "negative"}).first()
    assert row.predicted_label == "POSITIVE" and row.continuous_sentiment == pytest.approx(0.6)


def test_build_and_check_predictions(spark, csv):
    data = standardize.standardize(files.read(spark, files.Reader(csv)), DATASET)
    combo = predictions.Combination("r", 0, "lexicon", "d")
    out = predictions.build_predictions(data, predictions.Registry().score("lexicon", data), combo)
    assert out.columns[: len(predictions.OUTPUT)] == list(predictions.OUTPUT) and out.count() == 3
    predictions.check(out)
    with pytest.raises(ValueError, match="confidence_range"):
        predictions.check(out.withColumn("confidence", F.lit(2.0)))
    assert predictions.singleton_identity(out)["model_key"] == "lexicon"
    with pytest.raises(ValueError):
        predictions.singleton_identity(out.withColumn("run_id", F.col("news_id")))


def shout(texts):
    return [{"prob_negative": 0.1, "prob_neutral": 0.2, "prob_positive": 0.7} for _ in texts]


def make_shout():
    return shout


def test_registry(spark):
    r = predictions.Registry()
    r.register_path("shout", "tests.test_loading:make_shout", batch_size=2)
    df = spark.createDataFrame([(str(i), "t") for i in range(5)], "news_id string, text string")
    rows = predictions.standard_scores(r.score("shout", df)).collect()
    assert len(rows) == 5 and all(x.predicted_label == "POSITIVE" and x.processing_time_ms >= 0 for x in rows)
    with pytest.raises(KeyError):
        r.score("none", df)
    with pytest.raises(ValueError):
        r.register_path("bad", "tests.test_loading:nothing")


def test_ensemble_is_the_mean_of_logits(spark):
    df = spark.createDataFrame([("1", "a", [2.0, 0.0, 0.0]), ("1", "b", [0.0, 0.0, 2.0])], "news_id string, checkpoint string, logits array<double>")
    p = predictions.ensemble_scores(df).first().probabilities
    assert p[0] == pytest.approx(p[2]) and sum(p) == pytest.approx(1) and p[0] > p[1]


def classified(spark, pairs):
    return spark.createDataFrame(pairs, "true_label string, predicted_label string")


def test_classification(spark):
    df = classified(spark, [("POSITIVE", "POSITIVE"), ("POSITIVE", "NEGATIVE"), ("NEGATIVE", "NEGATIVE"), ("NEUTRAL", "POSITIVE"), (None, "NEUTRAL")])
    s = classification.summary(df).first()
    assert (s.total_rows, s.evaluated_rows, s.ignored_unlabeled_rows, s.correct_predictions) == (5, 4, 1, 2)
    assert s.accuracy == s.precision_micro == s.f1_micro == 0.5
    per = {r.label: r for r in classification.per_class(df).collect()}
    assert per["POSITIVE"].precision == 0.5 and per["NEUTRAL"].precision == 0 and per["NEUTRAL"].support == 1 and per["NEGATIVE"].f1 == pytest.approx(2 / 3)
    assert s.f1_macro == pytest.approx((0.5 + 0 + 2 / 3) / 3) and s.recall_weighted == pytest.approx((1 * 1 + 0 * 1 + 0.5 * 2) / 4)
    assert [tuple(r) for r in classification.confusion(df).collect()] == [("NEGATIVE", 1, 0, 0), ("NEUTRAL", 0, 0, 1), ("POSITIVE", 1, 0, 1)]
    dist = {(r.distribution_type, r.label): r["count"] for r in classification.distribution(df).collect()}
    assert dist["true", "POSITIVE"] == 2 and dist["predicted", "NEUTRAL"] == 1
    none = classification.summary(classified(spark, [(None, "NEUTRAL")])).first()
    assert none.status == "unavailable" and none.accuracy is None
    assert classification.distribution(classified(spark, [(None, "NEUTRAL")])).count() == 3


def test_aggregate_levels(spark):
    rows = [("2024-01-01", "A", "S", 0.5, 0.9, "POSITIVE"), ("2024-01-01", "A", "S", -0.1, 0.7, "NEGATIVE"), ("2024-01-01", " ", "S", 0.2, None, "NEUTRAL"), (None, "A", "S", 1.0, 0.5, "POSITIVE")]
    df = spark.createDataFrame(rows, "date string, company string, sector string, continuous_sentiment double, confidence double, predicted_label string")
    out = aggregates.aggregate_levels(df)
    by = {(r.aggregation_level): r for r in out.collect()}
    assert by["company_day"].news_count == 2 and by["company_day"].sector is None and by["company_day"].sentiment_median == pytest.approx(0.2)
    assert by["company_day"].group_key == '{"company":"A","date":"2024-01-01","level":"company_day"}'
    assert by["market_day"].news_count == 3 and by["market_day"].positive_percentage == pytest.approx(100 / 3)
    assert aggregates.aggregate_levels(df, ("company_day",), minimum_news=3).count() == 0
    summary = {r.aggregation_level: (r.dropped_rows, r.output_rows, r.status) for r in aggregates.level_summary(df, out).collect()}
    assert summary["company_day"] == (2, 1, "partial") and summary["market_day"] == (1, 1, "partial")
    assert [r.aggregation_level for r in aggregates.sorted_aggregates(out).collect()] == ["company_day", "sector_day", "market_day"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, {"k": "v"}), (None, float("nan"), None)], "s string, d double, m map<string,string>")
    path = sinks.write_csv(df, str(tmp_path / "o.csv"), single=True)
    assert sorted(r.value for r in spark.read.text(path).collect()) == [",,", 'a,1.50000000,"{""k"":""v""}"', "s,d,m"]
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_csv(df, path)
    where = sinks.write_json(spark, str(tmp_path / "x" / "s.json"), {"n": float("nan"), "l": {1}})
    assert json.loads(open(where).read()) == {"n": None, "l": [1]}
    store = sinks.RunStore(spark, str(tmp_path), "run")
    store.mark("m/d", "running")
    assert store.status() == "incomplete"
    store.mark("m/d", "success")
    store.mark("m/e", "failed", error="x")
    assert store.summary()["status"] == "partial_failure"
    with pytest.raises(FileExistsError):
        sinks.RunStore(spark, str(tmp_path), "run")
    assert files.latest_run(spark, str(tmp_path)).endswith("/run") and files.read_summary(spark, str(tmp_path / "run"))["run_id"] == "run"


def test_rows_of_several_files_follow_the_names_of_the_files(spark, tmp_path):
    """Small files are packed into tasks by their sizes; their rows are still numbered by name and place."""
    folder = tmp_path / "some files"
    folder.mkdir()
    (folder / "a.csv").write_text("id,x\n0,first\n")
    (folder / "b.csv").write_text("id,x\n" + "".join(f"{i},b\n" for i in range(1, 2000)))
    (folder / "c.csv").write_text("id,x\n" + "".join(f"{i},c\n" for i in range(2000, 2010)))
    for multiline in (True, False):
        r = files.Reader(str(folder), multiline=multiline)
        assert [x.id for x in files.read(spark, r).orderBy("row_id").collect()] == [str(i) for i in range(2010)]
        assert [x.id for x in files.read(spark, files.Reader(str(folder), multiline=multiline, max_rows=1)).collect()] == ["0"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # b.csv is read in several blocks
    try:
        rows = files.read(spark, files.Reader(str(folder), multiline=False))
        assert rows.select("row_id").distinct().count() == 2010
        assert [x.id for x in rows.orderBy("row_id").collect()] == [str(i) for i in range(2010)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for k, part in enumerate((range(3), range(3, 2000), range(2000, 2004))):
        spark.range(part.start, part.stop).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        next((tmp_path / f"p{k}").glob("*.parquet")).rename(tmp_path / f"{k}.parquet")
    whole = files.read(spark, files.Reader(str(tmp_path / "[0-9].parquet"), format="parquet"))
    assert [x.id for x in whole.orderBy("row_id").collect()] == list(range(2004))


def test_counters_by_cause(spark, tmp_path):
    lines = ["1,2024-01-01,x", "2,2024-03-01,late", "3,,none", "4,nonsense,y", "5,2024-01-02,", "6,2024-01-03,z,too,many", "7,2024-01-04,w"]
    (tmp_path / "n.csv").write_text("id,day,text\n" + "\n".join(lines) + "\n")
    d = standardize.Dataset("d", "d", {"news_id": "id", "text": "text", "date": "day"}, start_date="2024-01-01", end_date="2024-02-01")
    reader = files.Reader(str(tmp_path / "n.csv"), on_bad_lines="skip", multiline=False)
    counters = Observation()
    kept = standardize.standardize(files.read(spark, reader, keep_bad=True), d, counters=counters)
    assert [(r.news_id, r.source_row_number) for r in kept.orderBy("news_id").collect()] == [("1", 2), ("7", 4)]  # after the header; the empty text has a number
    assert counters.get == {"rows_read": 7, "rows_kept": 2, "bad_line": 1, "missing_date": 1, "unreadable_date": 1, "out_of_range": 1, "empty_text": 1}
    (tmp_path / "n.jsonl").write_text('{"id": "1", "day": "2024-01-01", "text": "x"}\n{"id": oops\n{"id": "2", "day": "2024-01-05", "text": null}\n')
    counters = Observation()
    assert standardize.standardize(files.read(spark, files.Reader(str(tmp_path / "n.jsonl"), format="jsonl", on_bad_lines="skip"), keep_bad=True), d, counters=counters).count() == 1
    assert counters.get == {"rows_read": 3, "rows_kept": 1, "bad_line": 1, "missing_date": 0, "unreadable_date": 0, "out_of_range": 0, "empty_text": 1}
