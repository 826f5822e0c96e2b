"""Labels, class probabilities and scores from logits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

LABELS = ("NEGATIVE", "NEUTRAL", "POSITIVE")

# Spellings of the labels.
LABEL_ALIASES = {
    "NEGATIVE": "NEGATIVE", "NEGATIVO": "NEGATIVE", "NEGATIVA": "NEGATIVE", "NEG": "NEGATIVE",
    "NEUTRAL": "NEUTRAL", "NEUTRO": "NEUTRAL", "NEUTRA": "NEUTRAL", "NEU": "NEUTRAL",
    "POSITIVE": "POSITIVE", "POSITIVO": "POSITIVE", "POSITIVA": "POSITIVE", "POS": "POSITIVE",
}

# Names under which scorers give a field; the first that is present counts.
PROBABILITY_FIELDS = {
    "POSITIVE": ("prob_positive", "positive_probability", "probability_positive", "positive_score", "score_positive"),
    "NEGATIVE": ("prob_negative", "negative_probability", "probability_negative", "negative_score", "score_negative"),
    "NEUTRAL": ("prob_neutral", "neutral_probability", "probability_neutral", "neutral_score", "score_neutral"),
}
PROBABILITY_CONTAINERS = ("probabilities", "scores", "class_probabilities", "label_scores")
LABEL_FIELDS = ("predicted_label", "label", "class_label", "prediction", "sentiment")
CONFIDENCE_FIELDS = ("confidence", "score", "max_probability")
TIME_FIELDS = ("processing_time_ms", "elapsed_time_ms", "inference_time_ms")
METADATA_FIELDS = ("metadata", "extra", "details")

#: How far a probability may lie outside [0, 1]; how far a sum may be from 1 and still be scaled; agreement of given and derived confidence.
RANGE_TOLERANCE, SUM_TOLERANCE, CONFIDENCE_TOLERANCE = 1e-6, 1e-2, 1e-4


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def first_present(columns: list[str], names: tuple[str, ...]) -> Column | None:
    """The first non-null of the named columns that exist."""
    found = [F.col(f"`{n}`") for n in names if n in columns]
    return F.coalesce(*found) if found else None


def finite(c: Column) -> Column:
    """NaN and infinities to null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def normalize_label(c: Column, aliases: dict[str, str] | None = None, strict: bool = True) -> Column:
    """Canonical label; blank is null; unknown spellings raise if ``strict``, else are null."""
    raw = F.nullif(F.upper(strip(c)), F.lit(""))
    known = F.try_element_at(literal_map(LABEL_ALIASES | {k.upper(): v for k, v in (aliases or {}).items()}), raw)
    if not strict:
        return known
    return F.when(raw.isNull(), F.lit(None)).otherwise(F.coalesce(known, F.raise_error(F.concat(F.lit("unknown sentiment label: "), raw))))


def label_ids(id2label: dict[int, str]) -> dict[str, str]:
    """Aliases ``0`` and ``LABEL_0`` for the labels of a model."""
    out = {}
    for k, v in id2label.items():
        label = LABEL_ALIASES[str(v).strip().upper()]
        out |= {str(k): label, f"LABEL_{k}": label, str(v).strip().upper(): label}
    return out


def continuous(positive: Column, negative: Column) -> Column:
    """Positive minus negative; null if either is; out of range is an error."""
    for_range = (positive < 0) | (positive > 1) | (negative < 0) | (negative > 1)
    return F.when(F.coalesce(for_range, F.lit(False)), F.raise_error(F.lit("probability outside [0, 1]")).cast("double")).otherwise(positive - negative)


def probabilities_from_container(c: Column, kind: str, order: tuple[str, ...] = LABELS) -> dict[str, Column]:
    """Class columns from a map by label (``map``) or a sequence ordered like ``order`` (``array``)."""
    if kind == "map":
        keys = F.transform_keys(c, lambda k, _: F.try_element_at(literal_map(LABEL_ALIASES), F.upper(F.trim(k))))
        return {label: finite(F.try_element_at(keys, F.lit(label))) for label in LABELS}
    return {label: finite(F.try_element_at(c, F.lit(order.index(label) + 1))) for label in LABELS}


def normalize_probabilities(p: dict[str, Column], strict: bool = True) -> Column:
    """struct(negative, neutral, positive, normalized, ok): clipped and scaled to a sum of 1.

    ``normalized`` is set whenever the sum was not exactly 1. With ``strict``, bad rows raise; else ``ok`` is false.
    """
    values = [p[label] for label in LABELS]
    missing = values[0].isNull() | values[1].isNull() | values[2].isNull()
    outside = F.lit(False)
    for v in values:
        outside = outside | (v < -RANGE_TOLERANCE) | (v > 1 + RANGE_TOLERANCE)
    clipped = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) for v in values]
    total = clipped[0] + clipped[1] + clipped[2]
    ok = ~missing & ~F.coalesce(outside, F.lit(False)) & F.coalesce(F.abs(total - 1) <= SUM_TOLERANCE, F.lit(False))
    bad = F.raise_error(F.lit("class probabilities are missing, out of range or do not add up to 1")).cast("double") if strict else F.lit(None).cast("double")
    scaled = [F.when(ok, F.try_divide(v, total)).otherwise(bad) for v in clipped]
    return F.struct(*(s.alias(label.lower()) for s, label in zip(scaled, LABELS, strict=True)), F.coalesce(total != 1.0, F.lit(False)).alias("normalized"), ok.alias("ok"))


def argmax_label(negative: Column, neutral: Column, positive: Column) -> Column:
    """Label of the largest probability; ties go to the first of NEGATIVE, NEUTRAL, POSITIVE."""
    top = F.greatest(negative, neutral, positive)
    return F.when(top.isNull(), F.lit(None)).when(negative == top, "NEGATIVE").when(neutral == top, "NEUTRAL").otherwise("POSITIVE")


def label_is_argmax(label: Column, p: dict[str, Column], tolerance: float = 1e-6) -> Column:
    own = F.when(label == "NEGATIVE", p["NEGATIVE"]).when(label == "NEUTRAL", p["NEUTRAL"]).when(label == "POSITIVE", p["POSITIVE"])
    return own >= F.greatest(*(p[x] for x in LABELS)) - tolerance


def softmax(logits: Column) -> Column:
    """Of an array of doubles; the largest is taken off first."""
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def sigmoid_scores(logits: Column) -> Column:
    """Independent sigmoids, scaled to a sum of 1."""
    each = F.transform(logits, lambda x: 1 / (1 + F.exp(-x)))
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    return F.transform(each, lambda x: x / total)


def scores_from_logits(logits: Column, problem_type: str | None = None) -> Column:
    return sigmoid_scores(logits) if problem_type == "multi_label_classification" else softmax(logits)
