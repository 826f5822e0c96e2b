"""Do indices predict returns better than the baselines? All series of a panel at once, in long form."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bootstrap as B
from . import metrics as M

# Baselines and their columns.
BASELINES = {"b0": "b0_news_count", "b1": "b1_mean_sentiment", "b2": "b2_confidence_weighted_sentiment", "b3": "b3_daily_impact_no_memory"}
ORDER = ("ticker", "date", "company", "sector")
IDENTITY = ("model_key", "dataset_key")


@dataclass(frozen=True)
class Validation:
    horizons: tuple[int, ...] = (1, 5, 21)
    indices: tuple[str, ...] = ("iti_liquido", "iti_risco")
    absolute: tuple[str, ...] = ("iti_risco",)
    baselines: tuple[str, ...] = tuple(BASELINES)
    news_only: tuple[str, ...] = ("b0", "b1", "b2")
    metrics: tuple[str, ...] = M.METRICS
    conclusion_metrics: tuple[str, ...] = ("pearson", "spearman")
    min_samples_r2: int = 30
    return_column: str = "log_return"
    inference: B.Inference = field(default_factory=B.Inference)

    def column(self, predictor: str) -> str:
        return predictor if predictor in self.indices else BASELINES[predictor]

    def mode(self, predictor: str) -> str:
        return "abs" if predictor in self.absolute else "signed"


def _subset(panel: DataFrame, predictor: str, v: Validation) -> Column:
    """Which rows count for a predictor: some baselines are held against days with news only."""
    if predictor not in v.news_only:
        return F.lit(True)
    if "news_count" in panel.columns:
        return F.coalesce(F.col("news_count"), F.lit(0)) > 0
    column = v.column(predictor)
    return F.col(column).isNotNull() if column in panel.columns else F.lit(False)


def _target(horizon: int, mode: str, v: Validation) -> Column:
    y = F.col(f"future_{v.return_column}_{horizon}")
    return F.abs(y) if mode == "abs" else y


def points(panel: DataFrame, v: Validation, subsets: bool = True) -> DataFrame:
    """A row per panel row, horizon and predictor: x, y and whether the row counts."""
    each = [
        F.struct(F.lit(h).alias("horizon"), F.lit(p).alias("predictor"), F.lit(v.mode(p)).alias("target_mode"), F.col(v.column(p)).cast("double").alias("x"), _target(h, v.mode(p), v).alias("y"), (_subset(panel, p, v) if subsets else F.lit(True)).alias("counts"))
        for h in v.horizons
        if f"future_{v.return_column}_{h}" in panel.columns
        for p in (*v.baselines, *v.indices)
        if v.column(p) in panel.columns
    ]
    order = [c for c in ORDER if c in panel.columns]
    return panel.select(*IDENTITY, *order, F.explode(F.array(*each)).alias("p")).select(*IDENTITY, *order, "p.*").where("counts").drop("counts")


def _scored(rows: DataFrame, v: Validation, order: list[str]) -> DataFrame:
    return B.metric_inference(rows, [*IDENTITY, "horizon", "predictor", "target_mode"], order, v.inference, v.metrics)


def _column_of(v: Validation) -> Column:
    return F.element_at(_literal_map({p: v.column(p) for p in (*v.baselines, *v.indices)}), F.col("predictor"))


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def incremental(panel: DataFrame, v: Validation = Validation()) -> DataFrame:
    """Every predictor's metrics by horizon; R2 only where enough rows count."""
    rows = points(panel, v)
    order = [c for c in ORDER if c in panel.columns]
    scored = _scored(rows, v, order)
    few = sparse(panel, v).select(*IDENTITY, "horizon", "predictor", F.lit("r2").alias("metric"))
    kept = scored.join(few, [*IDENTITY, "horizon", "predictor", "metric"], "left_anti")
    return kept.select(*IDENTITY, "horizon", "predictor", _column_of(v).alias("predictor_column"), "target_mode", "metric", "value", "p_value", "ci_low", "ci_high", "n", "n_bootstrap")


def sparse(panel: DataFrame, v: Validation) -> DataFrame:
    """Predictors with too few rows for R2, as warnings."""
    counts = points(panel, v).groupBy(*IDENTITY, "horizon", "predictor").agg(F.count(F.lit(1)).alias("rows"))
    return counts.where(F.col("rows") < v.min_samples_r2)


def deltas(panel: DataFrame, scored: DataFrame, v: Validation = Validation()) -> DataFrame:
    """Indices against baselines of the same horizon, metric and target, on the rows that count for the baseline."""
    order = [c for c in ORDER if c in panel.columns]
    pairs = [
        F.struct(F.lit(h).alias("horizon"), F.lit(i).alias("iti_predictor"), F.lit(b).alias("baseline"), F.lit(v.mode(i)).alias("target_mode"), F.col(v.column(i)).cast("double").alias("x"), F.col(v.column(b)).cast("double").alias("x_base"), _target(h, v.mode(i), v).alias("y"), _subset(panel, b, v).alias("counts"))
        for h in v.horizons
        if f"future_{v.return_column}_{h}" in panel.columns
        for i in v.indices
        for b in v.baselines
        if v.mode(i) == v.mode(b) and v.column(i) in panel.columns and v.column(b) in panel.columns
    ]
    if not pairs:
        raise ValueError("no index and baseline share a target")
    rows = panel.select(*IDENTITY, *order, F.explode(F.array(*pairs)).alias("p")).select(*IDENTITY, *order, "p.*").where("counts").drop("counts")
    keys = [*IDENTITY, "horizon", "iti_predictor", "baseline", "target_mode"]
    found = B.delta_inference(rows, keys, order, v.inference, v.metrics)
    side = lambda name, out: scored.select(*IDENTITY, "horizon", F.col("predictor").alias(name), "target_mode", "metric", F.col("value").alias(out))
    joined = found.join(side("iti_predictor", "iti_value"), [*IDENTITY, "horizon", "iti_predictor", "target_mode", "metric"]).join(
        side("baseline", "baseline_value"), [*IDENTITY, "horizon", "baseline", "target_mode", "metric"]
    )
    return joined.select(*keys, "metric", "iti_value", "baseline_value", "delta", "p_value", "ci_low", "ci_high", "n", "n_bootstrap", B.favourable(F.col("delta"), F.col("ci_low"), F.col("ci_high"), F.col("p_value")).alias("significant"))


def market(panel: DataFrame, v: Validation = Validation()) -> DataFrame:
    """Every series over the whole panel, without news-only rows or a minimum for R2."""
    order = [c for c in ORDER if c in panel.columns]
    scored = _scored(points(panel, v, subsets=False), v, order)
    target = F.concat(F.lit(f"future_{v.return_column}_"), F.col("horizon").cast("string"))
    return scored.select(*IDENTITY, "horizon", F.col("predictor").alias("series"), _column_of(v).alias("series_column"), target.alias("target_column"), "target_mode", "metric", "value", "p_value", "ci_low", "ci_high", "n", "n_bootstrap")


def uncertainty(daily: DataFrame, panel: DataFrame, v: Validation = Validation(), column: str = "iti_uncertainty") -> DataFrame | None:
    """Model disagreement against the same day's absolute return; None if the column is not there."""
    if column not in daily.columns:
        return None
    rows = daily.select("date", "company", F.col(column).alias("x")).join(panel.select("date", "company", F.abs(F.col(v.return_column)).alias("y")), ["date", "company"])
    return B.metric_inference(rows.withColumn("series", F.lit(column)), ["series"], ["date", "company", "x", "y"], v.inference, v.metrics).drop("series")


def wins(delta_rows: DataFrame, metrics: tuple[str, ...] | None = None) -> DataFrame:
    rows = delta_rows.where(F.col("metric").isin(*metrics)) if metrics else delta_rows
    return rows.groupBy(*IDENTITY, "iti_predictor").agg(F.count_if(F.col("delta") > 0).alias("wins"), F.count_if("significant").alias("significant_wins"), F.count(F.lit(1)).alias("comparisons"))


# What a conclusion says of a predictor, and what it says if there was nothing to compare.
VERDICT = "%s (%s): %d/%d vitórias (%.1f%%), %d significativas (%.1f%%)"
NO_VERDICT = "Nenhuma comparação ITI vs baseline disponível."


def conclusions(win_rows: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """(iti_predictor, said): a sentence for each predictor over all combinations."""
    totals = win_rows.groupBy("iti_predictor").agg(*(F.sum(c).alias(c) for c in ("wins", "significant_wins", "comparisons"))).where("comparisons > 0")
    percent = lambda c: F.col(c) * 100.0 / F.col("comparisons")
    said = F.format_string(VERDICT, "iti_predictor", F.lit(", ".join(metrics)), "wins", "comparisons", percent("wins"), "significant_wins", percent("significant_wins"))
    return totals.select("iti_predictor", said.alias("said"))


def conclusion(win_rows: DataFrame, metrics: tuple[str, ...]) -> str:
    """The sentences of all predictors in one line."""
    line = conclusions(win_rows, metrics).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("iti_predictor", "said"))), lambda x: x["said"]), "; ")).first()[0]
    return line or NO_VERDICT


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
