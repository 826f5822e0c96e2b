"""A trained scorer: weights against a plain count, its folder, and an experiment from YAML files end to end."""

import json
import math
from collections import Counter
from dataclasses import replace
from hashlib import md5

import pytest
import yaml

from tidemark.operators import ngrams, predictions
from tidemark.plans import config, experiment
from tidemark.sources import files

TRAIN = [
    ("1", "Lucro recorde da empresa", "positivo"), ("2", "Receita cresce e lucro sobe", "positivo"), ("3", "Prejuízo e queda na receita", "negativo"), ("4", "Multa e fraude, queda forte", "negativo"),
    ("5", "Empresa mantém política atual", "neutro"), ("6", "Reunião da empresa marcada", "neutro"), ("7", None, "neutro"),
]
NAMES = {"positivo": "POSITIVE", "negativo": "NEGATIVE", "neutro": "NEUTRAL"}


def frame(spark):
    return spark.createDataFrame([(i, t, NAMES[x].lower()) for i, t, x in TRAIN], "news_id string, text string, true_label string")


def grams(text):
    import re

    w = re.findall(r"\w+", (text or "").lower())
    return [int(md5(g.encode()).hexdigest()[:12], 16) % 512 for g in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]


def test_scores_are_those_of_plain_counts(spark):
    got = {r.news_id: r.probabilities for r in ngrams.fit(frame(spark), buckets=512, alpha=0.5)(frame(spark).union(spark.createDataFrame([("8", "nunca vista", "neutral"), ("9", "", "neutral")], frame(spark).schema))).collect()}
    counts = {x: Counter() for x in ngrams.LABELS}
    for _, t, x in TRAIN:
        counts[NAMES[x]].update(grams(t))
    share = {x: sum(NAMES[y] == x for _, _, y in TRAIN) / len(TRAIN) for x in ngrams.LABELS}
    for i, t in [*((i, t) for i, t, _ in TRAIN), ("8", "nunca vista"), ("9", "")]:
        z = [math.log(share[x]) + sum(math.log(counts[x][g] + 0.5) - math.log(sum(counts[x].values()) + 0.5 * 512) for g in grams(t)) for x in ngrams.LABELS]
        e = [math.exp(v - max(z)) for v in z]
        assert list(got[i]) == pytest.approx([v / sum(e) for v in e], abs=1e-9), i


def test_a_folder_must_be_sound(spark, tmp_path):
    path = ngrams.save(ngrams.fit(frame(spark), buckets=512), str(tmp_path / "s"))
    registry = predictions.Registry()
    registry.load(spark, "own", path)
    assert registry.score("own", frame(spark)).count() == 7
    registry.unload("own")
    assert "own" not in registry.keys()
    name = next((tmp_path / "s" / "manifest.json").glob("*.txt"), tmp_path / "s" / "manifest.json") if (tmp_path / "s" / "manifest.json").is_dir() else tmp_path / "s" / "manifest.json"
    held = json.loads(name.read_text())
    for change, message in (({"checksum": 1}, "not those of its manifest"), ({"labels": ["A"]}, "labels"), ({"version": 9}, "version")):
        (tmp_path / "s" / ".manifest.json.crc").unlink(missing_ok=True)
        name.write_text(json.dumps({**held, **change}))
        with pytest.raises(ValueError, match=message):
            ngrams.load(spark, path)
    name.write_text(json.dumps({k: v for k, v in held.items() if k != "priors"}))
    with pytest.raises(ValueError, match="priors"):
        ngrams.load(spark, path)
    with pytest.raises(FileNotFoundError):
        ngrams.load(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="labels"):
        ngrams.fit(frame(spark).where("true_label <> 'neutral'"))


DATASETS = """
schema_version: "2.0"
defaults:
  language: pt
  format: csv
  validation: {strip_text: true, drop_empty_texts: true, fail_on_duplicate_ids: true, preserve_extra_columns: true}
  labels: {available: true, mapping: {positivo: POSITIVE, negativo: NEGATIVE, neutro: NEUTRAL, positive: POSITIVE, negative: NEGATIVE, neutral: NEUTRAL}}
  dates: {available: true, format: "%Y-%m-%d", output_format: "%Y-%m-%d"}
datasets:
  pt: {order: 1, path: pt.csv, columns: {news_id: id, text: noticia, date: data, company: empresa, sector: setor, true_label: sentimento}}
  en: {order: 2, path: en.csv, language: en, columns: {news_id: id, text: noticia, date: data, company: empresa, sector: setor, true_label: sentimento}}
"""
MODELS = """
schema_version: "2.0"
models:
  grams_pt: {order: 1, language: pt, weights: %s}
  grams_en: {order: 2, language: en, weights: %s}
"""


def test_an_experiment_from_its_files(spark, tmp_path):
    """Two datasets of two languages and two fitted models: two combinations run, two are left out for their language."""
    lines = [f"{i},2024-01-0{1 + k % 5},E{k % 2},S,{t or 'sem texto'},{x}" for k, (i, t, x) in enumerate(TRAIN)]
    for name in ("pt", "en"):
        (tmp_path / f"{name}.csv").write_text("id,data,empresa,setor,noticia,sentimento\n" + "\n".join(line.replace(", queda", " queda") for line in lines) + "\n")
    weights = ngrams.save(ngrams.fit(frame(spark), buckets=512), str(tmp_path / "weights"))
    plan = config.experiment_plan({}, yaml.safe_load(MODELS % (weights, weights)), yaml.safe_load(DATASETS), str(tmp_path), run="r1")
    plan = replace(plan, output_root=str(tmp_path / "out"))
    assert experiment.preflight(spark, plan) == []
    summary = experiment.run(spark, plan)
    assert summary["status"] == "success" and summary["counts"]["success"] == 2 and summary["counts"]["skipped"] == 2, summary
    made = summary["combinations"]["grams_pt/pt"]["files"]
    matrix = spark.read.option("header", "true").csv(made["confusion_matrix"]).collect()
    assert {(x, x) for x in ngrams.LABELS} <= {(r.true_label, r.predicted_label) for r in matrix if r["count"] != "0"} and len(matrix) == 9  # its own training texts
    days = [r.date for r in spark.read.option("header", "true").csv(made["iti_daily"]).collect()]
    assert days == sorted(days) and len(days) > 4
    broken = config.experiment_plan({}, yaml.safe_load(MODELS % (weights, tmp_path / "none")), yaml.safe_load(DATASETS), str(tmp_path), run="r2")
    assert [e for e in experiment.preflight(spark, broken) if "grams_en: FileNotFoundError" in e]
    assert files.exists(spark, weights)
