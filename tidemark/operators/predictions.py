"""Scorer output to the standard prediction table, with its checks; and the scorers themselves."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from importlib import import_module

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.scores import LABELS
from .standardize import COLUMNS as DATASET_COLUMNS

# The columns of a prediction table.
IDENTIFICATION = ("run_id", "environment", "combination_id", "combination_index", "model_key", "model_name", "model_display_name", "dataset_key", "dataset_name", "dataset_display_name")
CORE = ("news_id", "date", "company", "sector", "ticker", "title", "text", "true_label", "source", "url", "source_row_number")
PREDICTION = ("prediction_index", "predicted_label", "confidence", "prob_positive", "prob_negative", "prob_neutral", "continuous_sentiment", "probability_sum", "processing_time_ms", "prediction_metadata")
EXECUTION = ("batch_size", "max_length", "device_used")
OUTPUT = (*IDENTIFICATION, *CORE, *PREDICTION, *EXECUTION)


@dataclass(frozen=True)
class Combination:
    """A model on a dataset, as part of a run."""

    run_id: str
    index: int
    model_key: str
    dataset_key: str
    environment: str = "local"
    model_name: str = ""
    model_display_name: str = ""
    dataset_name: str = ""
    dataset_display_name: str = ""
    batch_size: int = 32
    max_length: int = 512
    device: str = "cpu"
    id2label: dict[int, str] = field(default_factory=dict)

    @property
    def id(self) -> str:
        return f"{self.model_key}__{self.dataset_key}"


def canonical_json(c: Column) -> Column:
    """A map as JSON with sorted keys; an empty one is null."""
    entries = F.array_sort(F.map_entries(c))
    return F.when(F.size(c) > 0, F.to_json(F.map_from_entries(entries)))


def standard_scores(df: DataFrame, id2label: dict[int, str] | None = None, strict: bool = True) -> DataFrame:
    """Adds the prediction columns from whatever names the scorer used."""
    columns, kinds = df.columns, dict(df.dtypes)
    order = tuple(S.LABEL_ALIASES[str(id2label[k]).strip().upper()] for k in sorted(id2label)) if id2label else LABELS
    p = {label: S.first_present(columns, names) for label, names in S.PROBABILITY_FIELDS.items()}
    if all(v is not None for v in p.values()):
        p = {k: S.finite(v) for k, v in p.items()}
    else:
        box = next((c for c in S.PROBABILITY_CONTAINERS if c in columns), None)
        if box is None:
            raise ValueError("the scorer gave no class probabilities")
        p = S.probabilities_from_container(F.col(box), "map" if kinds[box].startswith("map") else "array", order)
    df = df.withColumn("__p", S.normalize_probabilities(p, strict))
    n = {label: F.col(f"__p.{label.lower()}") for label in LABELS}
    derived = S.argmax_label(n["NEGATIVE"], n["NEUTRAL"], n["POSITIVE"])
    given = S.first_present(columns, S.LABEL_FIELDS)
    label = derived if given is None else F.coalesce(S.normalize_label(given, S.label_ids(id2label or {}), strict), derived)
    top = F.greatest(*n.values())
    if strict:
        label = F.when(S.label_is_argmax(label, n, S.RANGE_TOLERANCE), label).otherwise(F.raise_error(F.lit("the predicted label has not the largest probability")))
        if (said := S.first_present(columns, S.CONFIDENCE_FIELDS)) is not None:
            top = F.when(said.isNull() | (F.abs(said.cast("double") - top) <= S.CONFIDENCE_TOLERANCE), top).otherwise(F.raise_error(F.lit("confidence is not the largest probability")).cast("double"))
    time, meta = S.first_present(columns, S.TIME_FIELDS), S.first_present(columns, S.METADATA_FIELDS)
    if meta is not None:
        name = next(c for c in S.METADATA_FIELDS if c in columns)
        meta = canonical_json(F.col(name)) if kinds[name].startswith("map") else meta
    return df.withColumns({
        "predicted_label": label,
        "confidence": top,
        **{f"prob_{x.lower()}": n[x] for x in LABELS},
        "continuous_sentiment": n["POSITIVE"] - n["NEGATIVE"],
        "probability_sum": reduce(lambda a, b: a + b, n.values()),
        "processing_time_ms": time.cast("double") if time is not None else F.lit(None).cast("double"),
        "prediction_metadata": meta if meta is not None else F.lit(None).cast("string"),
        "probability_normalized": F.col("__p.normalized"),
    }).drop("__p")


def build_predictions(dataset: DataFrame, scored: DataFrame, combination: Combination, strict: bool = True) -> DataFrame:
    """Joins dataset rows and scorer output by news_id; nothing relies on row positions."""
    made = standard_scores(scored, combination.id2label, strict)
    clash = [c for c in made.columns if c in dataset.columns and c != "news_id"]
    joined = dataset.join(made.drop(*clash), "news_id")
    identity = {
        "run_id": combination.run_id, "environment": combination.environment, "combination_id": combination.id, "combination_index": combination.index,
        "model_key": combination.model_key, "model_name": combination.model_name, "model_display_name": combination.model_display_name,
        "dataset_key": combination.dataset_key, "dataset_name": combination.dataset_name, "dataset_display_name": combination.dataset_display_name,
        "batch_size": combination.batch_size, "max_length": combination.max_length, "device_used": combination.device,
    }
    out = joined.withColumns({k: F.lit(v) for k, v in identity.items()} | {"prediction_index": F.col("source_row_number")})
    extras = [c for c in dataset.columns if c not in OUTPUT and c not in DATASET_COLUMNS]
    return out.select(*OUTPUT, *extras)


def violations(predictions: DataFrame) -> DataFrame:
    """One row with the number of rows against each rule, in one pass over the table; all 0 if it is sound."""
    c = F.col
    p = [c(f"prob_{x.lower()}") for x in LABELS]
    unit = lambda x: ~((x >= -1e-6) & (x <= 1 + 1e-6))
    rules = {
        "missing_id": c("news_id").isNull(),
        "bad_label": ~c("predicted_label").isin(*LABELS),
        "bad_true_label": c("true_label").isNotNull() & ~c("true_label").isin(*LABELS),
        "confidence_range": unit(c("confidence")),
        "sentiment_range": ~((c("continuous_sentiment") >= -1 - 1e-6) & (c("continuous_sentiment") <= 1 + 1e-6)),
        "probability_range": unit(p[0]) | unit(p[1]) | unit(p[2]),
        "probability_total": F.abs(p[0] + p[1] + p[2] - 1) > 1e-6,
        "confidence_is_top": F.abs(F.greatest(*p) - c("confidence")) > 1e-6,
        "sentiment_is_difference": F.abs(c("prob_positive") - c("prob_negative") - c("continuous_sentiment")) > 1e-6,
    }
    counts = [F.count_if(F.coalesce(bad, F.lit(True)) if name != "bad_true_label" else bad).alias(name) for name, bad in rules.items()]
    return predictions.agg(*counts, (F.count(F.lit(1)) - F.count_distinct("run_id", "model_key", "dataset_key", "news_id")).alias("repeated_key"))


def check(predictions: DataFrame) -> None:
    found = {k: v for k, v in violations(predictions).first().asDict().items() if v}
    if found:
        raise ValueError(f"prediction table is not sound: {found}")


def singleton_identity(df: DataFrame, columns: tuple[str, ...] = IDENTIFICATION) -> dict:
    """The one value of each identity column; an error if there are several."""
    row = df.agg(*(F.min(c).alias(c) for c in columns), *(F.count_distinct(c).alias(f"__{c}") for c in columns)).first()
    if several := [c for c in columns if row[f"__{c}"] > 1]:
        raise ValueError(f"columns have more than one value: {several}")
    return {c: row[c] for c in columns}


# ---- scorers ----

Batch = Callable[[list[str]], list[dict]]

#: Word lists of the default scorer, in Portuguese and English.
POSITIVE_WORDS = ("alta", "lucro", "cresce", "crescimento", "recorde", "aprova", "expansão", "ganho", "melhora", "positivo", "growth", "profit", "gain", "record", "rise", "approval", "beat", "strong")
NEGATIVE_WORDS = ("queda", "prejuízo", "perda", "multa", "fraude", "crise", "risco", "cai", "piora", "negativo", "loss", "fall", "drop", "fine", "fraud", "crisis", "risk", "weak")


def lexicon_logits(text: Column) -> Column:
    """Three logits (negative, neutral, positive) from word counts; built-in functions only."""
    words = F.split(F.lower(text), r"(?U)\W+")
    hits = lambda known: F.size(F.filter(words, lambda w: w.isin(*known))).cast("double")
    return F.array(hits(NEGATIVE_WORDS), F.lit(0.5), hits(POSITIVE_WORDS))


def lexicon_scores(df: DataFrame, text_column: str = "text") -> DataFrame:
    return df.select("news_id", S.softmax(lexicon_logits(F.col(text_column))).alias("probabilities"))


def ensemble_scores(logits: DataFrame, problem_type: str | None = None) -> DataFrame:
    """Several checkpoints' logits (news_id, checkpoint, logits): the mean of the raw logits, then probabilities."""
    mean = [F.avg(F.get("logits", F.lit(i))).alias(f"l{i}") for i in range(3)]
    out = logits.groupBy("news_id").agg(*mean)
    return out.select("news_id", S.scores_from_logits(F.array("l0", "l1", "l2"), problem_type).alias("probabilities"))


class Registry:
    """Scorers by key: functions of a DataFrame, or batch functions that a Python worker loads once."""

    def __init__(self) -> None:
        self._scorers: dict[str, Callable[[DataFrame], DataFrame]] = {"lexicon": lexicon_scores}

    def register(self, key: str, scorer: Callable[[DataFrame], DataFrame]) -> None:
        if key in self._scorers:
            raise ValueError(f"scorer {key!r} is registered")
        self._scorers[key] = scorer

    def register_path(self, key: str, dotted: str, batch_size: int = 32, **parameters) -> None:
        """``package.module:factory``; the factory gives a function from texts to result dictionaries."""
        module, _, name = dotted.partition(":")
        if not name or not callable(getattr(import_module(module), name, None)):
            raise ValueError(f"{dotted!r} names no factory")
        self.register(key, lambda df: score_batches(df, dotted, batch_size, parameters))

    def load(self, spark, key: str, path: str) -> None:
        """Registers the fitted scorer of a folder, after its manifest and weights are found sound."""
        from . import ngrams

        self.register(key, ngrams.load(spark, path))

    def unload(self, key: str) -> None:
        """Forgets a scorer; an unknown key is an error."""
        del self._scorers[key]

    def keys(self) -> tuple[str, ...]:
        return tuple(self._scorers)

    def score(self, key: str, df: DataFrame) -> DataFrame:
        if key not in self._scorers:
            raise KeyError(f"no scorer {key!r}; there are {sorted(self._scorers)}")
        return self._scorers[key](df)


def score_batches(df: DataFrame, dotted: str, batch_size: int, parameters: dict) -> DataFrame:
    """Contiguous batches through a Python model; the time of a batch is shared out over its texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from time import perf_counter

        module, _, name = dotted.partition(":")
        model: Batch = getattr(import_module(module), name)(**parameters)
        for frame in frames:
            for i in range(0, len(frame), batch_size):
                part = frame.iloc[i : i + batch_size]
                began = perf_counter()
                found = model(part["text"].tolist())
                if len(found) != len(part):
                    raise ValueError("the scorer gave another number of results than texts")
                each = (perf_counter() - began) * 1000 / len(part)
                yield pd.DataFrame({"news_id": part["news_id"].to_numpy(), **{k: [r[k] for r in found] for k in ("prob_negative", "prob_neutral", "prob_positive")}, "processing_time_ms": each})

    return df.select("news_id", "text").mapInPandas(run, "news_id string, prob_negative double, prob_neutral double, prob_positive double, processing_time_ms double")
