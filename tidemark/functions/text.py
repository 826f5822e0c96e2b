"""Text, key and date expressions."""

from __future__ import annotations

import html
import re
from email.utils import parsedate_to_datetime
from string import Formatter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Entities of the sector in their order of precedence (company, sector, ticker).
ENTITIES = (
    ("Sabesp", "Saneamento", "SBSP3"),
    ("Companhia de Saneamento Básico do Estado de Minas Gerais", "Saneamento", "CSMG3"),
    ("Companhia de Saneamento de Minas Gerais", "Saneamento", "CSMG3"),
    ("Companhia de Saneamento do Paraná", "Saneamento", "SAPR4"),
    ("Copasa", "Saneamento", "CSMG3"),
    ("Sanepar", "Saneamento", "SAPR4"),
)

# What a news file writes for a missing value (a public list).
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def strip(c: Column) -> Column:
    """Without white space of any script at both ends (``trim`` would keep tabs and no-break spaces)."""
    return F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def na_to_null(c: Column) -> Column:
    return F.when(~c.isin(*NA_TOKENS), c)


def normalize_title(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(or_empty(c))), r"(?U)\s+", " ")


def normalize_url(c: Column) -> Column:
    """Lower-case scheme (https if there is none) and host; path without trailing slashes; no parameters, query or fragment."""
    raw = strip(or_empty(c))
    scheme = F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    rest = F.regexp_replace(raw, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    host = F.lower(F.regexp_extract(rest, r"^//([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"^//[^/?#]*", ""), r"(?s)[?#].*$", ""), r";[^/]*$", "")
    path = F.regexp_replace(path, r"/+$", "")
    full = F.concat(
        F.when(scheme == "", "https").otherwise(scheme), F.lit(":"), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""), F.when(path == "", "/").otherwise(path)
    )
    return F.when(raw == "", "").otherwise(full)


def dedupe_key(url: Column, record_id: Column, day: Column, source: Column, title: Column) -> Column:
    """URL if there is one, else id, else day, source and title; empty if there is nothing."""
    link, own, t = normalize_url(url), strip(or_empty(record_id)), normalize_title(title)
    d, s = strip(or_empty(day)), F.lower(strip(or_empty(source)))
    return (
        F.when(link != "", F.concat(F.lit("url:"), link))
        .when(own != "", F.concat(F.lit("id:"), own))
        .when((d != "") | (s != "") | (t != ""), F.concat(F.lit("meta:"), F.concat_ws("|", d, s, t)))
        .otherwise("")
    )


def match_entity(text: Column, entities: tuple = ENTITIES) -> Column:
    """struct(company, sector, ticker) of the first entity whose name or ticker stands in the text as words."""
    out = F.lit(None).cast("struct<company:string,sector:string,ticker:string>")
    for company, sector, ticker in reversed(entities):
        pattern = rf"(?iuU)\b\Q{company}\E\b|\b\Q{ticker}\E\b"
        out = F.when(text.rlike(pattern), F.struct(F.lit(company).alias("company"), F.lit(sector).alias("sector"), F.lit(ticker).alias("ticker"))).otherwise(out)
    return out


def contains_any(text: Column, words) -> Column:
    """Substring tests, as the keyword lists are meant."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def strip_html(c: Column) -> Column:
    """Entities decoded, tags to spaces, white space collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(_unescape(or_empty(c)), r"<[^>]+>", " "), r"(?U)\s+", " "))


def strip_tags(c: Column) -> Column:
    """Like ``strip_html`` for text without entities; stays in the JVM."""
    return strip(F.regexp_replace(F.regexp_replace(or_empty(c), r"<[^>]+>", " "), r"(?U)\s+", " "))


def parse_day(c: Column) -> Column:
    """The first 19 characters in one of three formats, else the first yyyy-mm-dd in the text."""
    raw = strip(or_empty(c))
    head = F.substring(raw, 1, 19)
    found = F.nullif(F.regexp_extract(raw, r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    return F.coalesce(F.try_to_date(head, "yyyy-M-d"), F.try_to_date(head, "d/M/yyyy"), F.try_to_date(head, "yyyy-M-d'T'H:m:s"), F.try_to_date(found, "yyyy-MM-dd"))


def iso_day(c: Column) -> Column:
    return F.try_to_date(F.substring(strip(or_empty(c)), 1, 10), "yyyy-M-d")


@F.pandas_udf(StringType())
def feed_day(values: pd.Series) -> pd.Series:
    """RFC 2822 dates to yyyy-mm-dd, else the first yyyy-mm-dd in the text, else empty."""

    def one(value) -> str:
        raw = (value or "").strip()
        try:
            return parsedate_to_datetime(raw).strftime("%Y-%m-%d")
        except (TypeError, ValueError, OverflowError):
            found = re.search(r"\d{4}-\d{2}-\d{2}", raw)
            return found[0] if found else ""

    return values.map(one)


def article_day(node: Column, url: Column, until: Column) -> Column:
    """Day of an article: its time element, else the day in its URL, else the end of the window."""
    in_url = F.regexp_replace(F.regexp_extract(or_empty(url), r"/(\d{4}/\d{2}/\d{2})/", 1), "/", "-")
    return F.coalesce(parse_day(node), F.try_to_date(F.nullif(in_url, F.lit("")), "yyyy-MM-dd"), until.cast("date"))


def stable_id(site: str, url: Column) -> Column:
    return F.concat(F.lit(f"{site}_"), F.substring(F.sha2(url.cast("binary"), 256), 1, 12))


def compose(template: str, fields: dict[str, str], skip_if_all_empty: bool = True) -> Column:
    """A text from a template; ``fields`` maps its names to columns. White space around values goes, null is empty."""
    values = {name: strip(or_empty(F.col(column))) for name, column in fields.items()}
    parts = []
    for literal, name, spec, conversion in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            if spec or conversion or name not in values:
                raise ValueError(f"template field {name!r} is not a plain known field")
            parts.append(values[name])
    text = F.concat(*parts) if parts else F.lit("")
    if not skip_if_all_empty or not values:
        return text
    return F.when(F.concat(*values.values()) != "", text)


#: strptime directives and the patterns that read the same.
_STRPTIME = {"%Y": "yyyy", "%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s", "%y": "yy", "%f": "SSSSSS", "%b": "MMM", "%B": "MMMM", "%z": "XX", "%p": "a", "%I": "h", "%%": "%"}


def date_pattern(strptime: str, padded: bool = False) -> str:
    """A strptime format as a Spark pattern; ``padded`` writes numbers with two digits, as strftime does."""

    def one(m: re.Match) -> str:
        if m[0][0] == "%":
            if m[0] not in _STRPTIME:
                raise ValueError(f"date directive {m[0]} is not supported")
            found = _STRPTIME[m[0]]
            return found * 2 if padded and len(found) == 1 and found.isalpha() and found != "a" else found
        return f"'{m[0]}'"

    return re.sub(r"%.|[A-Za-z]+", one, strptime)


def parse_date(c: Column, fmt: str | None = None, dayfirst: bool = False) -> Column:
    """A timestamp by one format, or by the usual ones in turn; null if none fits."""
    raw = strip(c)
    if fmt:
        return F.try_to_timestamp(raw, F.lit(date_pattern(fmt)))
    days = ["d/M/yyyy", "d-M-yyyy"] if dayfirst else ["M/d/yyyy", "M-d-yyyy"]
    tries = [F.try_to_timestamp(raw), *(F.try_to_timestamp(raw, F.lit(p)) for p in ("yyyy/M/d", *days))]
    return F.coalesce(*tries)
