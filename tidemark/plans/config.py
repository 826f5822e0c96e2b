"""YAML configuration, version 2.0: unique keys, merged over defaults, to the plans' dataclasses."""

from __future__ import annotations

import os
from dataclasses import dataclass
from datetime import datetime, timezone

import yaml

from ..functions import dimensions
from ..functions import text as T
from ..operators import bootstrap, standardize, validation
from ..sources import files
from . import experiment, research

VERSION = "2.0"


class UniqueKeys(yaml.SafeLoader):
    """A loader that rejects repeated keys."""

    def construct_mapping(self, node, deep=False):
        keys = [self.construct_object(k, deep=deep) for k, _ in node.value]
        if twice := sorted({str(k) for k in keys if keys.count(k) > 1}):
            raise ValueError(f"keys appear more than once: {twice}")
        return super().construct_mapping(node, deep)


def load(path: str, version: str = VERSION) -> dict:
    with open(path, encoding="utf-8") as f:
        value = yaml.load(f, UniqueKeys)  # noqa: S506  a safe loader
    if not isinstance(value, dict):
        raise ValueError(f"{path}: an object is expected")
    if str(value.get("schema_version")) != version:
        raise ValueError(f"{path}: schema_version {version!r} is expected")
    return value


def merged(base: dict, over: dict) -> dict:
    """``over`` on ``base``, deeply; neither is changed."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def selected(keys: str | list[str] | None, known: list[str]) -> list[str]:
    """Requested keys (a list, or text with commas) in the known order; unknown ones are errors."""
    if not keys:
        return known
    wanted = [x.strip() for k in ([keys] if isinstance(keys, str) else keys) for x in str(k).split(",") if x.strip()]
    if bad := [w for w in wanted if w not in known]:
        raise ValueError(f"unknown keys: {bad}; there are {known}")
    return [k for k in known if k in wanted]


def ordered(section: dict) -> list[tuple[str, dict]]:
    """Enabled entries by (order, key)."""
    return sorted(((k, v) for k, v in section.items() if v.get("enabled", True)), key=lambda kv: (kv[1].get("order", 0), kv[0]))


def row_limit(value) -> int | None:
    if value in (None, "max"):
        return None
    if isinstance(value, bool) or int(value) < 1:
        raise ValueError("max_rows is a positive number or 'max'")
    return int(value)


# The settings of a dataset, by section. Others are refused, so that none is passed over without a word.
SECTIONS = {
    "reader": ("encoding", "delimiter", "quotechar", "header", "low_memory", "skip_blank_lines", "on_bad_lines", "multiline"),
    "validation": ("strip_text", "drop_empty_texts", "fail_on_duplicate_ids", "preserve_extra_columns"),
    "labels": ("available", "normalize_case", "strip_whitespace", "mapping"),
    "dates": ("available", "format", "dayfirst", "fail_on_invalid", "output_format"),
    "limits": ("max_rows", "date_from", "date_to"),
    "text_compose": ("template", "fields", "skip_if_all_empty"),
}
DATASET_KEYS = ("enabled", "order", "dataset_name", "display_name", "language", "path", "format", "source", "columns", "constants", "required_fields", "metadata", *SECTIONS)
# Settings that only have one value here: texts and labels are always stripped, labels read in any case, blank lines skipped.
ONLY = {
    ("reader", "header"): 0,
    ("reader", "skip_blank_lines"): True,
    ("validation", "strip_text"): True,
    ("labels", "normalize_case"): True,
    ("labels", "strip_whitespace"): True,
}


def known_only(raw: dict, known, where: str) -> dict:
    if bad := sorted(set(raw) - set(known)):
        raise ValueError(f"{where}: unknown settings {bad}; there are {sorted(known)}")
    return raw


def datasets(config: dict, root: str = ".") -> list[tuple[standardize.Dataset, files.Reader]]:
    return [_dataset(key, merged(config.get("defaults", {}), raw), root) for key, raw in ordered(config.get("datasets", {}))]


def _dataset(key: str, raw: dict, root: str) -> tuple[standardize.Dataset, files.Reader]:
    known_only(raw, DATASET_KEYS, f"dataset {key}")
    part = {name: known_only(raw.get(name) or {}, keys, f"dataset {key}, {name}") for name, keys in SECTIONS.items()}
    for (section, name), value in ONLY.items():
        if part[section].get(name, value) != value:
            raise ValueError(f"dataset {key}, {section}: {name} can only be {value}")
    reader, checks, labels, dates, limits, compose = part.values()
    columns = {k: v for k, v in (raw.get("columns") or {}).items()}
    unmapped = [f for f in raw.get("required_fields") or () if not columns.get(f) and not (f == "text" and compose)]
    if unmapped:
        raise ValueError(f"dataset {key}: required fields without a column: {unmapped}")
    if dates.get("format") and not dates.get("available", False):
        raise ValueError(f"dataset {key}, dates: a format needs available dates")
    path = raw["path"] if "://" in raw["path"] or os.path.isabs(raw["path"]) else os.path.join(root, raw["path"])
    fmt = raw.get("format", "csv")
    dataset = standardize.Dataset(
        key,
        raw.get("dataset_name", key),
        columns,
        {k: str(v) for k, v in (raw.get("constants") or {}).items()},
        language=raw.get("language", "pt"),
        drop_empty_text=checks.get("drop_empty_texts", True),
        compose_template=compose.get("template"),
        compose_fields=dict(compose.get("fields", {})),
        skip_if_all_empty=compose.get("skip_if_all_empty", True),
        max_rows=row_limit(limits.get("max_rows")),
        start_date=limits.get("date_from"),
        end_date=limits.get("date_to"),
        dates_available=dates.get("available", False),
        date_format=dates.get("format"),
        dayfirst=dates.get("dayfirst", False),
        date_errors="raise" if dates.get("fail_on_invalid", True) else "null",
        output_date=T.date_pattern(dates.get("output_format", "%Y-%m-%d"), padded=True),
        label_map={str(k): str(v) for k, v in (labels.get("mapping") or {}).items()},
        labels_available=labels.get("available", False),
        fail_on_duplicate_ids=checks.get("fail_on_duplicate_ids", True),
        header_rows=1 if fmt == "csv" else 0,
        keep_extra_columns=checks.get("preserve_extra_columns", True),
    )
    return dataset, files.Reader(path, fmt, reader.get("encoding", "UTF-8"), reader.get("delimiter", ","), reader.get("quotechar", '"'), reader.get("on_bad_lines", "error"), multiline=reader.get("multiline", True))


def models(config: dict) -> list[experiment.Model]:
    """A model's scorer is the fitted one in the folder ``weights``, or the one registered under ``scorer`` or the model's own key; ``preflight`` and the run name those that are not there."""
    entries = [(k, merged(config.get("defaults", {}), v)) for k, v in ordered(config.get("models", {}))]
    return [experiment.Model(k, v.get("language", "pt"), v.get("scorer", k), v.get("model_name", k), v.get("weights", "")) for k, v in entries]


@dataclass(frozen=True)
class Market:
    enabled: bool
    path: str
    reader: files.Reader
    columns: dict[str, str]
    returns: tuple[str, ...] = ("simple_return", "log_return")
    provider: str | None = None
    tickers: tuple[str, ...] = ()
    start: str | None = None
    end: str | None = None


# Where quotes may come from, the returns there are, and the columns that prices need.
PROVIDERS, RETURNS, PRICES = ("local", "yfinance"), ("simple_return", "log_return"), ("date", "ticker", "close")


def market(config: dict, root: str = ".") -> Market:
    raw = merged(config.get("defaults") or {}, config["market"])
    if raw.get("format", "csv") != "csv":
        raise ValueError("market: format can only be csv")
    path = raw["local_path"] if "://" in raw["local_path"] or os.path.isabs(raw["local_path"]) else os.path.join(root, raw["local_path"])
    columns = {k: str(v) for k, v in raw["columns"].items()}
    if lacking := [c for c in PRICES if c not in columns]:
        raise ValueError(f"market, columns: {lacking} are not mapped")
    returns = tuple(raw.get("returns", {}).get("compute", RETURNS))
    if bad := [r for r in returns if r not in RETURNS]:
        raise ValueError(f"market, returns: {bad} are none of {RETURNS}")
    source = raw.get("source") or {}
    if source and source.get("provider") not in PROVIDERS:
        raise ValueError(f"market, source: provider {source.get('provider')!r} is none of {PROVIDERS}")
    if source and not source.get("tickers"):
        raise ValueError("market, source: tickers are needed")
    reader = raw.get("reader") or {}
    return Market(bool(raw.get("enabled", True)), path, files.Reader(path, "csv", reader.get("encoding", "UTF-8"), reader.get("delimiter", ",")), columns, returns, source.get("provider"), tuple(map(str, source.get("tickers", ()))), source.get("start"), source.get("end"))


def run_id(configured: str | None = None) -> str:
    return configured or datetime.now(timezone.utc).strftime("run_%Y%m%d_%H%M%S")


def experiment_plan(config: dict, model_config: dict, dataset_config: dict, root: str = ".", model_keys=None, dataset_keys=None, dry_run: bool | None = None, run: str | None = None) -> experiment.Experiment:
    ms, ds = models(model_config), datasets(dataset_config, root)
    chosen_m, chosen_d = selected(model_keys, [m.key for m in ms]), selected(dataset_keys, [d.key for d, _ in ds])
    index, execution = config.get("temporal_index", {}), config.get("execution", {})
    size = index.get("dimensions", {})
    rules = size.get("heuristics", {})
    settings = experiment.IndexSettings(
        enabled=index.get("enabled", True),
        alpha=float(index.get("alpha", 0.85)),
        initial_value=float(index.get("initial_value", 0.0)),
        horizon_mode=index.get("horizon", {}).get("mode", "ewma_alpha"),
        defaults={k: float(v) for k, v in index.get("defaults", {}).items()},
        providers=tuple(p for p in size.get("provider_order", dimensions.PROVIDERS) if p != "heuristics" or rules.get("enabled", True)),
        event_keywords={k: tuple(v) for k, v in (rules.get("event_keywords") or dimensions.EVENT_KEYWORDS).items()},
        frequencies=tuple(index.get("resample", {}).get("frequencies", ())) if index.get("resample", {}).get("enabled", True) else (),
        baselines=index.get("baselines", {}).get("enabled", True),
        min_models=int(index.get("uncertainty", {}).get("min_models", 2)),
    )
    return experiment.Experiment(
        run_id(run or execution.get("run_id")),
        tuple(m for m in ms if m.key in chosen_m),
        tuple(d for d in ds if d[0].key in chosen_d),
        output_root=config.get("paths", {}).get("output_root", "outputs"),
        settings=settings,
        require_language=config.get("compatibility", {}).get("require_language_match", True),
        fail_fast=execution.get("fail_fast", False),
        dry_run=execution.get("dry_run", False) if dry_run is None else dry_run,
    )


def research_plan(config: dict, prices: str, run: str | None = None, model_key: str | None = None, dataset_key: str | None = None) -> research.Research:
    d, v, e = config.get("defaults", {}), config.get("validation", {}), config.get("experiment_run", {})
    indices = tuple(d.get("iti_predictors", ("iti_liquido", "iti_risco")))
    absolute = tuple(d.get("abs_return_predictors", ("iti_risco",)))
    if extra := [x for x in absolute if x not in indices]:
        raise ValueError(f"abs_return_predictors are not among the indices: {extra}")
    inference = v.get("inference", {})
    return research.Research(
        output_root=e.get("output_root", "outputs"),
        prices=prices,
        company_to_ticker=dict(config.get("mapping", {}).get("company_to_ticker", {})),
        run_id=run or e.get("run_id"),
        model_key=model_key or e.get("model_key"),
        dataset_key=dataset_key or e.get("dataset_key"),
        return_mode=d.get("return_mode", "cumulative"),
        min_overlap_days=int(v.get("min_overlap_days", 10)),
        validation=validation.Validation(
            horizons=tuple(d.get("horizons", (1, 5, 21))),
            indices=indices,
            absolute=absolute,
            baselines=tuple(v.get("baselines", validation.BASELINES)),
            news_only=tuple(v.get("baseline_news_only", ("b0", "b1", "b2"))),
            metrics=tuple(v.get("metrics", validation.Validation.metrics)),
            conclusion_metrics=tuple(v.get("conclusion_metrics", ("pearson", "spearman"))),
            min_samples_r2=int(v.get("min_samples_for_r2", 30)),
            return_column=d.get("return_column", "log_return"),
            inference=bootstrap.Inference(inference.get("enabled", True), int(inference.get("n_bootstrap", 500)), int(inference.get("block_size", 5)), float(inference.get("ci_level", 0.95)), int(inference.get("random_seed", 42))),
        ),
    )
