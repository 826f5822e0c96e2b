"""From a run's indices and market prices to the verdict on their predictive value."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import alignment, validation
from ..sources import files, sinks


@dataclass(frozen=True)
class Research:
    output_root: str
    prices: str
    company_to_ticker: dict[str, str]
    run_id: str | None = None
    model_key: str | None = None
    dataset_key: str | None = None
    research_root: str = "outputs/research"
    return_mode: str = "cumulative"
    calendar: str = "panel"
    min_overlap_days: int = 10
    price_columns: dict[str, str] = field(default_factory=dict)
    validation: validation.Validation = validation.Validation()


def check_inputs(spark: SparkSession, r: Research) -> tuple[list[str], list[str]]:
    """Errors that stop a run, and warnings, such as tickers without prices."""
    errors, warnings = [], []
    if not files.exists(spark, r.prices):
        errors.append(f"no prices at {r.prices}")
    else:
        wanted = spark.createDataFrame([(t,) for t in sorted(set(r.company_to_ticker.values()))], "ticker string")
        have = files.read_prices(spark, r.prices, r.price_columns or None).select("ticker").distinct()
        warnings += [f"no prices for {x.ticker}" for x in wanted.join(have, "ticker", "left_anti").orderBy("ticker").collect()]
    try:
        run_dir = files.latest_run(spark, r.output_root, r.run_id)
        if files.list_combinations(spark, run_dir, r.model_key, r.dataset_key).isEmpty():
            errors.append(f"no indices in {run_dir}")
    except FileNotFoundError as e:
        errors.append(str(e))
    return errors, warnings


def run(spark: SparkSession, r: Research) -> dict:
    """Aligns and validates every combination; writes reports and a summary."""
    run_dir = files.latest_run(spark, r.output_root, r.run_id)
    run_id = run_dir.rstrip("/").split("/")[-1]
    combinations = files.list_combinations(spark, run_dir, r.model_key, r.dataset_key).collect()  # a row per model and dataset
    if not combinations:
        raise ValueError(f"no indices in {run_dir}")
    prices = files.read_prices(spark, r.prices, r.price_columns or None)
    v, done, wins = r.validation, [], []
    for c in combinations:
        root = f"{run_dir}/indices/{c.model_key}/{c.dataset_key}"
        index = files.read_index(spark, f"{root}/iti_daily.csv")
        baselines = files.read_index(spark, f"{root}/baselines_daily.csv", ("b1_mean_sentiment", "b2_confidence_weighted_sentiment"), ("b0_news_count",))
        panel = alignment.align(index, baselines, prices, r.company_to_ticker, v.horizons, v.return_column, r.return_mode, r.calendar)
        panel = panel.withColumns({"model_key": F.lit(c.model_key), "dataset_key": F.lit(c.dataset_key)})
        out = f"{r.research_root}/{run_id}/{c.model_key}/{c.dataset_key}"
        panel = spark.read.parquet(sinks.write_table(panel, f"{out}/aligned_panel", (), overwrite=True))
        days = alignment.check_overlap(panel, r.min_overlap_days)
        scored = spark.read.parquet(sinks.write_table(validation.incremental(panel, v), f"{out}/incremental", (), overwrite=True))
        frames = {"market_metrics": validation.market(panel, v), "deltas": validation.deltas(panel, scored, v), "sample_warnings": validation.sparse(panel, v)}
        merged = f"{run_dir}/indices/merged/{c.dataset_key}/iti_uncertainty_daily.csv"
        if files.exists(spark, merged):
            daily = files.read_index(spark, merged, ("disagreement_mean", "disagreement_max", "iti_uncertainty"), ("model_count",))
            if (u := validation.uncertainty(daily, panel, v)) is not None:
                frames["uncertainty_metrics"] = u
        for name, df in frames.items():
            sinks.write_table(df, f"{out}/{name}", (), overwrite=True)
        deltas = spark.read.parquet(f"{out}/deltas")
        wins.append(validation.wins(deltas, v.conclusion_metrics))
        dropped = [x.company for x in alignment.dropped_companies(index, r.company_to_ticker).collect()]
        done.append({"model_key": c.model_key, "dataset_key": c.dataset_key, "overlap_days": days, "dropped_companies": dropped, "output_dir": out, "predictor_stats": {x.iti_predictor: {"wins": x.wins, "significant_wins": x.significant_wins, "comparisons": x.comparisons} for x in wins[-1].collect()}})
    summary = {"run_id": run_id, "combination_count": len(done), "combinations": done, "conclusion_metrics": list(v.conclusion_metrics), "conclusion": validation.conclusion(validation.union(wins), v.conclusion_metrics)}
    sinks.write_json(spark, f"{r.research_root}/{run_id}/research_summary.json", summary)
    return summary
