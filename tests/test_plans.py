"""End-to-end runs, configuration, streaming."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bootstrap, recurrence, standardize, validation
from tidemark.plans import config, experiment, research
from tidemark.sources import files
from tidemark.streaming import ingest
from tidemark.streaming.corpus_table import CorpusTable


def news_file(folder, name, days=25):
    path = folder / name
    words = ["lucro recorde", "queda e prejuízo", "nada de novo"]
    lines = ["id,date,company,sector,title,text,label"] + [f"{i},{date(2024, 1, 1) + timedelta(days=i % days)},{'Sabesp' if i % 2 else 'Copasa'},S,t{i},{words[i % 3]} {i},{['positive', 'negative', 'neutral'][i % 3]}" for i in range(80)]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def dataset(key, language):
    names = {"news_id": "id", "text": "text", "date": "date", "company": "company", "sector": "sector", "title": "title", "true_label": "label"}
    return standardize.Dataset(key, key, names, language=language, labels_available=True, date_format="%Y-%m-%d", label_map={x: x for x in ("positive", "negative", "neutral")})


def test_experiment_then_research(spark, tmp_path):
    path = news_file(tmp_path, "n.csv")
    plan = experiment.Experiment(
        "r1", (experiment.Model("a", "pt"), experiment.Model("b", "pt"), experiment.Model("c", "en")), ((dataset("d", "pt"), files.Reader(path)),), output_root=str(tmp_path / "out"),
        settings=experiment.IndexSettings(frequencies=("weekly",)),
    )
    assert experiment.preflight(spark, plan) == []
    summary = experiment.run(spark, plan)
    assert summary["status"] == "success", summary
    assert summary["counts"]["success"] == 2 and summary["counts"]["skipped"] == 1
    prices = tmp_path / "prices.csv"
    prices.write_text("date,ticker,close\n" + "".join(f"{date(2024, 1, 1) + timedelta(days=i)},{t},{100 + (i * 7) % 11}\n" for i in range(25) for t in ("SBSP3", "CSMG3")))
    r = research.Research(
        str(tmp_path / "out"), str(prices), {"Sabesp": "SBSP3", "Copasa": "CSMG3", "Outra": "XXXX3"}, research_root=str(tmp_path / "res"), model_key="a",
        validation=validation.Validation(horizons=(1,), metrics=("pearson", "mse"), inference=bootstrap.Inference(n_bootstrap=10)),
    )
    errors, warnings = research.check_inputs(spark, r)
    assert not errors and warnings == ["no prices for XXXX3"]
    out = research.run(spark, r)
    assert out["combination_count"] == 1 and out["combinations"][0]["overlap_days"] == 25 and "vitórias" in out["conclusion"]
    assert files.exists(spark, str(tmp_path / "res" / "r1" / "research_summary.json"))


def test_a_failed_combination_is_recorded(spark, tmp_path):
    plan = experiment.Experiment("r", (experiment.Model("a", "pt"),), ((dataset("d", "pt"), files.Reader(str(tmp_path / "none.csv"))),), output_root=str(tmp_path))
    assert experiment.preflight(spark, plan)[0].startswith("dataset d: FileNotFoundError")
    summary = experiment.run(spark, plan)
    assert summary["status"] == "failed" and "FileNotFound" in summary["combinations"]["a/d"]["error"]


def test_dry_run_and_languages(spark, tmp_path):
    models = tuple(experiment.Model(k, lang) for k, lang in (("m1", "pt"), ("m2", "pt"), ("m3", "en")))
    data = tuple((dataset(k, lang), files.Reader("x")) for k, lang in (("d1", "pt"), ("d2", "pt"), ("d3", "en")))
    kept, skipped = experiment.pairs_of(experiment.Experiment("r", models, data))
    assert (len(kept), len(skipped)) == (5, 4)
    assert experiment.run(spark, experiment.Experiment("r", models, data, str(tmp_path), dry_run=True))["counts"]["skipped"] == 9


def test_config(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text('schema_version: "2.0"\na: 1\n')
    assert config.load(str(p))["a"] == 1
    p.write_text('schema_version: "2.0"\na: 1\na: 2\n')
    with pytest.raises(ValueError, match="more than once"):
        config.load(str(p))
    p.write_text("a: 1\n")
    with pytest.raises(ValueError, match="schema_version"):
        config.load(str(p))
    assert config.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert config.selected("b, a", ["a", "b", "c"]) == ["a", "b"] and config.selected(None, ["a"]) == ["a"]
    with pytest.raises(ValueError):
        config.selected("z", ["a"])
    assert config.row_limit("max") is None and config.row_limit(3) == 3
    raw = {"defaults": {"limits": {"max_rows": 200}}, "datasets": {"z": {"order": 1, "path": "n.csv", "columns": {"text": "t"}}, "y": {"order": 2, "path": "/n.jsonl", "format": "jsonl"}, "off": {"enabled": False}}}
    got = config.datasets(raw, "/root")
    assert [(d.key, r.path, d.max_rows, d.header_rows) for d, r in got] == [("z", "/root/n.csv", 200, 1), ("y", "/n.jsonl", 200, 0)]
    r = config.research_plan({"mapping": {"company_to_ticker": {"A": "B"}}}, "p")
    assert r.validation.horizons == (1, 5, 21) and r.company_to_ticker == {"A": "B"}
    with pytest.raises(ValueError):
        config.research_plan({"defaults": {"iti_predictors": ["x"], "abs_return_predictors": ["y"]}}, "p")
    e = config.experiment_plan({}, {"models": {"m": {"language": "en"}}}, raw, run="r")
    assert e.run_id == "r" and e.models[0].language == "en" and len(e.datasets) == 2


def test_upsert_stream(spark, tmp_path):
    schema = "id string, url string, noticia string"
    for k in range(4):
        spark.createDataFrame([(f"{k}", f"https://a/{k}", f"t{k}"), ("x", "https://a/0?q", "later")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = ingest.upsert_corpus(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "corpus"), str(tmp_path / "cp"), compact_every=3).start()
        q.awaitTermination(120)
    table = CorpusTable(spark, str(tmp_path / "corpus"))
    assert [(r.id, r.noticia) for r in table.read().orderBy("row_id").collect()] == [(f"{k}", f"t{k}") for k in range(4)]
    assert sorted(p.name for p in (tmp_path / "corpus").iterdir() if p.name[0] not in "_.") == ["base-000000000002", "delta-000000000003", "table.json"]


def test_a_batch_writes_what_is_new_and_reads_its_buckets(spark, tmp_path):
    table = CorpusTable(spark, str(tmp_path / "t"), buckets=8)
    frame = lambda ids, text="t": spark.createDataFrame([(str(i), f"https://a/{i}", f"{text}{i} " * 30) for i in ids], "id string, url string, noticia string")
    size = lambda name: sum(f.stat().st_size for f in (tmp_path / "t" / name).rglob("*.parquet"))
    assert table.add(frame(range(3000)), 0) == 3000
    assert table.add(frame([5, 6, 3000], "other"), 1) == 1
    assert size("delta-000000000001") < size("delta-000000000000") / 20
    # A repeated batch overwrites itself; one that the base holds already is left alone.
    assert table.add(frame([5, 6, 3000], "other"), 1) == 1
    before = sorted(r.noticia for r in table.read().collect())
    assert len(before) == 3001 and not any(x.startswith("other5 ") for x in before)
    table.compact()
    assert sorted(r.noticia for r in table.read().collect()) == before
    assert table.add(frame([7777]), 1) == 0 and table.add(frame([1, 7777]), 2) == 1
    assert CorpusTable(spark, str(tmp_path / "t"), buckets=99).buckets == 8
    assert CorpusTable(spark, str(tmp_path / "t")).read().count() == 3002


def test_daily_windows_and_unseen_urls(spark, tmp_path):
    t0 = datetime(2024, 1, 1, 10)
    rows = [(str(i), "A", None, 0.2, 0.1, 0.5, 1.0, t0 + timedelta(days=i // 2), f"https://a/{i % 3}") for i in range(8)]
    schema = "news_id string, company string, sector string, I_n double, R_n double, w_n double, h double, ts timestamp, url string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = ingest.daily_impact(stream).writeStream.format("memory").queryName("daily_out").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("daily_out").collect()
    assert len(got) == 4 and all(r.news_count == 2 and r.impacto_dia == pytest.approx(0.2) for r in got)
    q = ingest.unseen(stream, "ts").writeStream.format("memory").queryName("unseen_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("unseen_out").select(F.count_distinct("norm_url"), F.count(F.lit(1))).first()[:] == (3, 3)
