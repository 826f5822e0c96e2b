"""Classification metrics of labelled predictions, from one count table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import LABELS


def _counts(predictions: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """One row: for each label true positives, true and predicted rows."""
    t, p = F.col("true_label"), F.col("predicted_label")
    rows = predictions.where(t.isNotNull())
    each = F.array(*[F.struct(F.lit(x).alias("label"), F.count_if((t == x) & (p == x)).alias("tp"), F.count_if(t == x).alias("support"), F.count_if(p == x).alias("predicted")) for x in labels])
    return rows.agg(F.count(F.lit(1)).alias("evaluated_rows"), F.count_if(t == p).alias("correct_predictions"), each.alias("each"))


def _ratio(a: Column, b: Column, zero_division: int) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(float(zero_division)))


def _scores(e: Column, zero_division: int) -> Column:
    return F.struct(
        e["label"].alias("label"),
        _ratio(e["tp"], e["predicted"], zero_division).alias("precision"),
        _ratio(e["tp"], e["support"], zero_division).alias("recall"),
        _ratio(2 * e["tp"], e["support"] + e["predicted"], zero_division).alias("f1"),
        e["support"].alias("support"),
        e["predicted"].alias("predicted_count"),
    )


def per_class(predictions: DataFrame, labels: tuple[str, ...] = LABELS, zero_division: int = 0) -> DataFrame:
    scored = _counts(predictions, labels).select(F.explode(F.transform("each", lambda e: _scores(e, zero_division))).alias("s"))
    return scored.select("s.*")


def summary(predictions: DataFrame, labels: tuple[str, ...] = LABELS, zero_division: int = 0) -> DataFrame:
    """One row: accuracy and macro, weighted and micro scores; null without labelled rows."""
    total = predictions.agg(F.count(F.lit(1)).alias("total_rows"))
    one = _counts(predictions, labels).withColumn("s", F.transform("each", lambda e: _scores(e, zero_division)))
    n = F.col("evaluated_rows")
    add = lambda f: F.aggregate("s", F.lit(0.0), lambda a, x: a + f(x))
    out = {}
    for name in ("precision", "recall", "f1"):
        out[f"{name}_macro"] = F.when(n > 0, add(lambda x, k=name: x[k]) / len(labels))
        out[f"{name}_weighted"] = F.when(n > 0, F.try_divide(add(lambda x, k=name: x[k] * x["support"]), add(lambda x: x["support"])))
        out[f"{name}_micro"] = F.try_divide(F.col("correct_predictions").cast("double"), n)
    made = one.withColumns({"accuracy": F.try_divide(F.col("correct_predictions").cast("double"), n), **out}).drop("each", "s")
    # Two tables of one row each.
    return made.join(F.broadcast(total)).withColumn("ignored_unlabeled_rows", F.col("total_rows") - n).withColumn("status", F.when(n > 0, "success").otherwise("unavailable"))


def confusion(predictions: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """A row per true label in order, a column per predicted label; absent ones are 0."""
    t, p = F.col("true_label"), F.col("predicted_label")
    rows = F.array(*[F.struct(F.lit(a).alias("true_label"), *(F.count_if((t == a) & (p == b)).alias(b) for b in labels)) for a in labels])
    return predictions.agg(rows.alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def distribution(predictions: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Counts and percentages of predicted and, if there are any, true labels."""
    t, p = F.col("true_label"), F.col("predicted_label")
    of = lambda c, kind, total: [F.struct(F.lit(kind).alias("distribution_type"), F.lit(x).alias("label"), F.count_if(c == x).alias("count"), total.alias("total")) for x in labels]
    rows = F.array(*of(p, "predicted", F.count(p)), *of(t, "true", F.count(t)))
    out = predictions.agg(rows.alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
    out = out.where((F.col("distribution_type") == "predicted") | (F.col("total") > 0))
    return out.withColumn("percentage", F.coalesce(F.try_divide(F.col("count") * 100.0, F.col("total")), F.lit(0.0)))


def statistics(predictions: DataFrame) -> DataFrame:
    """One row about the predictions: counts by class, and the range of confidence and sentiment."""
    s, c = F.col("continuous_sentiment"), F.col("confidence")
    counts = [F.count_if(F.col("predicted_label") == x).alias(f"{x.lower()}_count") for x in LABELS]
    return predictions.agg(F.count(F.lit(1)).alias("row_count"), *counts, *(f(x).alias(f"{n}_{name}") for name, x in (("confidence", c), ("sentiment", s)) for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))))
