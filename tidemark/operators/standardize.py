"""Source tables of news to the standard schema."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scores import LABELS, literal_map

# The columns of a standard news table.
COLUMNS = ("dataset_key", "dataset_name", "news_id", "text", "date", "company", "sector", "ticker", "title", "true_label", "source", "url", "source_row_number")
MAPPED = ("news_id", "text", "date", "company", "sector", "ticker", "title", "true_label", "source", "url")
COMPOSED = "__composed_text__"


@dataclass(frozen=True)
class Dataset:
    key: str
    name: str
    columns: dict[str, str | None]  # standard column to source column
    constants: dict[str, str] = field(default_factory=dict)
    language: str = "pt"
    drop_empty_text: bool = True
    compose_template: str | None = None
    compose_fields: dict[str, str] = field(default_factory=dict)
    skip_if_all_empty: bool = True
    max_rows: int | None = None
    start_date: str | None = None
    end_date: str | None = None
    dates_available: bool = True  # without, the date column is null
    date_format: str | None = None
    dayfirst: bool = False
    date_errors: str = "null"  # or "raise"
    output_date: str = "yyyy-MM-dd"
    label_map: dict[str, str] = field(default_factory=dict)
    labels_available: bool = False
    fail_on_duplicate_ids: bool = False
    header_rows: int = 1  # the number of lines before the first row
    keep_extra_columns: bool = True


def strip_headers(df: DataFrame) -> DataFrame:
    names = [c.strip() for c in df.columns]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"columns appear more than once: {twice}")
    return df.toDF(*names)


def check_columns(df: DataFrame, dataset: Dataset) -> None:
    wanted = [c for c in dataset.columns.values() if c and c != COMPOSED] + list(dataset.compose_fields.values())
    if missing := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"{dataset.key}: columns are missing: {missing}")


def extra_names(source: list[str], used: set[str]) -> dict[str, str]:
    """Unmapped source columns and their names in the result; a clash gives source__x, then source__x_2 and so on."""
    taken, out = set(COLUMNS), {}
    for c in source:
        if c in used:
            continue
        name, k = c, 2
        if name in taken:
            name = f"source__{c}"
            while name in taken:
                name, k = f"source__{c}_{k}", k + 1
        taken.add(name)
        out[c] = name
    return out


def duplicate_ids(df: DataFrame, column: str = "news_id") -> DataFrame:
    """One row: how many rows share their id with another."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("duplicate_rows"))


def number_duplicates(df: DataFrame, order: str, column: str = "news_id") -> DataFrame:
    """The second and later rows of an id get ``__dup1`` and so on."""
    k = F.row_number().over(Window.partitionBy(column).orderBy(order)) - 1
    return df.withColumn("__k", k).withColumn(column, F.when(F.col("__k") > 0, F.concat(F.col(column), F.lit("__dup"), F.col("__k"))).otherwise(F.col(column))).drop("__k")


#: A column of lines that could not be read, where the reader keeps them.
BAD = "__bad_line"
#: Why rows of a file are not in the standardized table.
CAUSES = ("bad_line", "missing_date", "unreadable_date", "out_of_range", "empty_text")


def standardize(raw: DataFrame, dataset: Dataset, row_order: str = "row_id", counters: Observation | None = None) -> DataFrame:
    """``raw`` is all text with a ``row_order`` that follows the file: limit, date filter, mapping, cleaning, labels, extras.

    ``counters`` is filled by the first action on the table: rows read, rows kept, and rows dropped by each of ``CAUSES``
    (the first that holds; bad lines if the reader has kept them).

    With ``date_errors="raise"`` a date that is missing or can't be read stops the job. Labels or dates that the dataset
    declares unavailable are null, whatever their column holds.
    """
    df = strip_headers(raw)
    check_columns(df, dataset)
    if dataset.compose_template:
        df = df.withColumn(COMPOSED, T.compose(dataset.compose_template, dataset.compose_fields, dataset.skip_if_all_empty))
    if dataset.max_rows is not None:  # the limit is one of rows read, so it comes before the filter
        df = df.orderBy(row_order).limit(dataset.max_rows)
    mapped = dict(dataset.columns)
    if dataset.compose_template:
        mapped["text"] = COMPOSED
    # Rows that leave are marked first, and counted and dropped in one place.
    dropped = {"bad_line": F.col(BAD).isNotNull()} if BAD in df.columns else {}
    if (dataset.start_date or dataset.end_date) and mapped.get("date"):
        given = F.col(f"`{mapped['date']}`")
        day = T.parse_date(given, dataset.date_format, dataset.dayfirst).cast("date")
        dropped |= {"missing_date": T.blank_to_null(given.cast("string")).isNull(), "unreadable_date": day.isNull(), "out_of_range": ~day.between(F.lit(dataset.start_date or "0001-01-01").cast("date"), F.lit(dataset.end_date or "9999-12-31").cast("date"))}
    df = df.withColumn("__cause", F.coalesce(*(F.when(c, name) for name, c in dropped.items()), F.lit(None).cast("string"))).drop(BAD)
    df = with_row_number(df, row_order, dataset.header_rows, F.col("__cause").isNull())

    def of(name: str) -> Column:
        source = mapped.get(name)
        value = F.col(f"`{source}`").cast("string") if source else F.lit(dataset.constants.get(name)).cast("string")
        return T.blank_to_null(value)

    used = {c for c in mapped.values() if c}
    extras = extra_names([c for c in df.columns if c not in (row_order, "source_row_number", "__cause")], used - {COMPOSED}) if dataset.keep_extra_columns else {}
    out = df.select(
        F.lit(dataset.key).alias("dataset_key"),
        F.lit(dataset.name).alias("dataset_name"),
        *(of(c).alias(c) for c in MAPPED),
        "source_row_number",
        F.col(row_order).alias("__order"),
        "__cause",
        *(F.col(f"`{c}`").cast("string").alias(n) for c, n in extras.items()),
    )
    if dataset.drop_empty_text:
        out = out.withColumn("__cause", F.coalesce("__cause", F.when(F.col("text").isNull(), "empty_text")))
    if counters:
        counts = [F.count(F.lit(1)).alias("rows_read"), F.count_if(F.col("__cause").isNull()).alias("rows_kept")]
        out = out.observe(counters, *counts, *(F.count_if(F.col("__cause") == c).alias(c) for c in CAUSES))
    out = out.where("__cause is null").drop("__cause")
    if not dataset.drop_empty_text:
        out = out.withColumn("text", F.coalesce("text", F.raise_error(F.lit("a text is empty"))))
    out = out.withColumn("news_id", F.coalesce("news_id", F.concat(F.lit(f"{dataset.key}_"), F.col("source_row_number").cast("string"))))
    if dataset.fail_on_duplicate_ids:
        twice = F.count(F.lit(1)).over(Window.partitionBy("news_id")) > 1
        out = out.withColumn("__twice", twice).withColumn("news_id", F.when(F.col("__twice"), F.raise_error(F.concat(F.lit("duplicate id: "), F.col("news_id")))).otherwise(F.col("news_id"))).drop("__twice")
    else:
        out = number_duplicates(out, "__order")
    parsed = T.parse_date(F.col("date"), dataset.date_format, dataset.dayfirst)
    text = F.date_format(parsed, dataset.output_date)
    if dataset.date_errors == "raise":
        text = F.coalesce(text, F.raise_error(F.concat(F.lit("invalid date: "), F.coalesce("date", F.lit("null")))))
    out = out.withColumn("date", text if dataset.dates_available else F.lit(None).cast("string"))
    if mapped.get("true_label"):
        out = out.withColumn("true_label", map_label(F.col("true_label"), dataset.label_map, True) if dataset.labels_available else F.lit(None).cast("string"))
    return out.select(*COLUMNS, *extras.values())


def with_row_number(df: DataFrame, row_order: str, header_rows: int = 1, counted: Column | None = None) -> DataFrame:
    """The position among the rows that are ``counted``, after a file's header lines.

    Rows are counted in ranges of ``row_order`` first, so no task holds them all: a row's number is the rows of the
    ranges before, plus its place in its own.
    """
    ranged = df.withColumns({"__range": F.shiftright(F.col(row_order).cast("long"), 16), "__counted": (F.lit(True) if counted is None else counted).cast("long")})
    counts = ranged.groupBy("__range").agg(F.sum("__counted").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    place = F.sum("__counted").over(Window.partitionBy("__range").orderBy(row_order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("__place", place).join(before, "__range").withColumn("source_row_number", (F.col("__before") + F.col("__place") + header_rows).cast("long")).drop("__range", "__counted", "__place", "__before")


def map_label(c: Column, mapping: dict[str, str], required: bool) -> Column:
    """Through a dictionary (lower-cased keys) to a canonical label. With ``required`` a missing or unknown label is an error."""
    raw = F.lower(T.strip(c))
    known = F.upper(F.try_element_at(literal_map({k.strip().lower(): v for k, v in mapping.items()}), raw)) if mapping else F.upper(raw)
    valid = F.when(known.isin(*LABELS), known)
    return F.coalesce(valid, F.raise_error(F.concat(F.lit("missing or unknown label: "), F.coalesce(c, F.lit("null"))))) if required else valid


def load_statistics(df: DataFrame) -> DataFrame:
    """Counters of a standardized table, and its labels, in one pass."""
    null = lambda c: F.count_if(F.col(c).isNull())
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *(null(c).alias(f"missing_{c}") for c in ("date", "company", "sector", "ticker", "title", "true_label")),
        *(F.count_if(F.col("true_label") == x).alias(f"{x.lower()}_labels") for x in LABELS),
        F.count_if(F.contains("news_id", F.lit("__dup"))).alias("renumbered_ids"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
