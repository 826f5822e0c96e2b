"""A run from datasets and scorers to indices. A combination is scored and written on its own; its index is one plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import dimensions
from ..operators import aggregates, classification, impact, levels, ngrams, predictions, recurrence, standardize, uncertainty
from ..sources import files, sinks


def combination_matrix(models: DataFrame, datasets: DataFrame, require_language: bool = True) -> DataFrame:
    """All models with all datasets, both (key, language) and configuration-sized; ``compatible`` where languages agree."""
    m = models.select("model_key", F.col("language").alias("model_language"))
    d = datasets.select("dataset_key", F.col("language").alias("dataset_language"))
    pairs = m.join(F.broadcast(d))
    agree = F.col("model_language") == F.col("dataset_language") if require_language else F.lit(True)
    return pairs.select("model_key", "dataset_key", agree.alias("compatible"))


@dataclass(frozen=True)
class IndexSettings:
    enabled: bool = True
    alpha: float = 0.85
    initial_value: float = 0.0
    horizon_mode: str = "ewma_alpha"
    defaults: dict[str, float] = field(default_factory=dict)
    providers: tuple[str, ...] = dimensions.PROVIDERS
    event_keywords: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(dimensions.EVENT_KEYWORDS))
    frequencies: tuple[str, ...] = ("weekly", "monthly", "quarterly")
    baselines: bool = True
    min_models: int = 2


def build_index(preds: DataFrame, settings: IndexSettings = IndexSettings(), row_order: str = "source_row_number", by: tuple[str, ...] = ("model_key", "dataset_key")) -> dict[str, DataFrame]:
    """All tables of the index for all combinations at once; ``by`` tells them apart."""
    news = impact.news_impact(preds, settings.defaults, keep=by, providers=settings.providers, row_order=row_order, partition=by, event_keywords=settings.event_keywords)
    daily = impact.daily_impact(news, by)
    index = recurrence.index_daily(daily, settings.alpha, settings.initial_value, settings.horizon_mode, by)
    out = {"news_impact": news, "daily_company_impact": daily, "iti_daily": index}
    out |= {f"iti_{level}_daily": levels.level_daily(index, level, by) for level in ("sector", "market")}
    out |= {f"iti_{f}": levels.resample(index, f, by) for f in settings.frequencies}
    if settings.baselines:
        out["baselines_daily"] = impact.baselines_daily(preds, by)
    return out


@dataclass(frozen=True)
class Model:
    key: str
    language: str
    scorer: str = "lexicon"
    name: str = ""
    weights: str = ""  # folder of a fitted scorer, which is loaded for the model's runs


@dataclass(frozen=True)
class Experiment:
    run_id: str
    models: tuple[Model, ...]
    datasets: tuple[tuple[standardize.Dataset, files.Reader], ...]
    output_root: str = "outputs"
    settings: IndexSettings = IndexSettings()
    require_language: bool = True
    fail_fast: bool = False
    overwrite: bool = False
    dry_run: bool = False


def preflight(spark: SparkSession, plan: Experiment, registry: predictions.Registry | None = None) -> list[str]:
    """What would stop a run: nothing to do, unknown scorers, absent or unreadable datasets, columns that are not there."""
    known = (registry or predictions.Registry()).keys()
    kept, _ = pairs_of(plan)
    errors = [] if kept else ["no model fits any dataset"]
    errors += [f"model {m.key}: no scorer {m.scorer!r}" for m in plan.models if not m.weights and m.scorer not in known]
    for m in plan.models:
        if m.weights:
            try:
                ngrams.read_manifest(spark, m.weights)
            except (ValueError, FileNotFoundError) as e:
                errors.append(f"model {m.key}: {type(e).__name__}: {e}")
    for d, reader in plan.datasets:
        try:
            files.validate_file(spark, reader)
            standardize.check_columns(spark.createDataFrame([], ", ".join(f"`{c}` string" for c in files.inspect_columns(spark, reader))), d)
        except (ValueError, FileNotFoundError) as e:
            errors.append(f"dataset {d.key}: {type(e).__name__}: {e}")
    return errors


def check_datasets(spark: SparkSession, datasets: list[tuple[standardize.Dataset, files.Reader]]) -> dict[str, dict]:
    """The counters of each dataset, by cause, in the pass that reads and standardizes it, or the error that this ends with."""
    out: dict[str, dict] = {}
    for d, reader in datasets:
        try:
            files.validate_file(spark, reader)
            causes = Observation()
            counted = standardize.load_statistics(standardize.standardize(files.read(spark, reader, keep_bad=True), d, counters=causes)).first().asDict()
            met = causes.get
            out[d.key] = {"rows_read": met["rows_read"], "rows_dropped": met["rows_read"] - met["rows_kept"], **{f"dropped_{c}": met[c] for c in standardize.CAUSES}, **counted}
        except Exception as e:  # noqa: BLE001  a dataset's failure is its report
            out[d.key] = {"error": f"{type(e).__name__}: {str(e)[:300]}"}
    return out


def run(spark: SparkSession, plan: Experiment, registry: predictions.Registry | None = None) -> dict:
    """Loads, scores, measures, aggregates, indexes and writes each compatible combination; returns the summary."""
    registry = registry or predictions.Registry()
    store = sinks.RunStore(spark, plan.output_root, plan.run_id, plan.overwrite)
    kept, skipped = pairs_of(plan)
    for m, (d, _) in skipped:
        store.mark(f"{m.key}/{d.key}", "skipped", reason="languages differ")
    if plan.dry_run:
        for m, (d, _) in kept:
            store.mark(f"{m.key}/{d.key}", "skipped", reason="dry run")
        return store.summary()
    impacts: dict[str, dict[str, DataFrame]] = {}
    for i, (m, (d, reader)) in enumerate(kept):
        key = f"{m.key}/{d.key}"
        store.mark(key, "running")
        own = f"{m.key}#weights"
        try:
            if m.weights:
                registry.load(spark, own, m.weights)
            files.validate_file(spark, reader)
            data = standardize.standardize(files.read(spark, reader), d)
            combo = predictions.Combination(plan.run_id, i, m.key, d.key, model_name=m.name or m.key, dataset_name=d.name)
            # The scored table is written once; everything else reads it, so no text is scored twice.
            path = sinks.write_table(predictions.build_predictions(data, registry.score(own if m.weights else m.scorer, data), combo), f"{store.models(m.key, d.key)}/predictions", (), plan.overwrite)
            preds = spark.read.parquet(path)
            predictions.check(preds)
            frames = {
                "classification_metrics": classification.summary(preds),
                "per_class_metrics": classification.per_class(preds),
                "confusion_matrix": sinks.confusion_table(classification.confusion(preds).toDF("true_label", "negative", "neutral", "positive")),
                "class_distribution": classification.distribution(preds),
                "aggregates": aggregates.sorted_aggregates(aggregates.aggregate_levels(preds)),
            }
            store.save_frames(key, store.models(m.key, d.key), frames)
            if plan.settings.enabled:
                made = build_index(preds, plan.settings)
                store.save_frames(key, store.indices(m.key, d.key), made)
                impacts.setdefault(d.key, {})[m.key] = made["news_impact"]
            store.mark(key, "success")
        except Exception as error:  # noqa: BLE001  one combination's failure is recorded, the others go on
            store.mark(key, "failed", error=f"{type(error).__name__}: {str(error)[:500]}")
            if plan.fail_fast:
                for n, (e, _) in kept[i + 1 :]:
                    store.mark(f"{n.key}/{e.key}", "skipped", reason="an earlier combination failed")
                break
        finally:
            if own in registry.keys():
                registry.unload(own)
    for dataset, frames in impacts.items():
        if merged := uncertainty.merge_uncertainty(frames, plan.settings.min_models):
            for name, df in zip(("disagreement_news", "iti_uncertainty_daily"), merged, strict=True):
                sinks.write_csv(df, f"{store.merged(dataset)}/{name}.csv", plan.overwrite)
    return store.summary()


def pairs_of(plan: Experiment) -> tuple[list, list]:
    """Combinations to run and those left out for their languages, in order."""
    pairs = [(m, d) for m in plan.models for d in plan.datasets]
    fits = lambda p: not plan.require_language or p[0].language == p[1][0].language
    return [p for p in pairs if fits(p)], [p for p in pairs if not fits(p)]
