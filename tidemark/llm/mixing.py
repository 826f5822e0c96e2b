"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Token weights of the cells (source, language, topic) are raked to target marginals: in turn, the cells of each source,
each language and each topic are scaled to that level's target, and the round is repeated. No weight may ask for more
tokens than its cell has: it is held there in every step, and later steps give the rest to the other cells of the level.
Documents are then sampled by the calibrated probability of their cell, which is therefore never above 1.

Targets: by default a level's target is its tokens to a power below 1 (``TEMPERATURE``), so large levels give way to
small ones; explicit shares can be given instead. ``KEEP`` is the part of all tokens that is to be kept. A level whose
target is more than all its tokens gets all of them, and the others share the rest in proportion to their targets
(``reachable``). ``marginals`` tells each level's target and what the sample is expected to have.

A topic is a form of text by rules over the whole of it: table, lines, or prose by length.

Defined results: a null source or language is a level of its own; a null text is empty, counts one token and is short
prose; a null doc_id is drawn like the empty string, rows with equal doc_id are kept or dropped together; levels beyond
explicit targets are dropped; an empty table gives no rows; extra columns pass through ``sample``, and those that clash
with the working names keep their values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

TEMPERATURE = {"source": 0.7, "lang": 0.8, "topic": 0.9}
KEEP = 0.7
SWEEPS = 8
SEED = "mix-0"
_W = "__mix_"  # working columns


def topic(text: Column) -> Column:
    t = F.coalesce(text.cast("string"), F.lit(""))
    n = F.length(t)
    bars = n - F.length(F.replace(t, F.lit("|"), F.lit("")))
    lines = n - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return F.when(bars * 40 > n, "table").when(lines * 120 > n, "lines").when(n < 1000, "short").when(n < 4000, "medium").otherwise("long")


def tokens(text: Column) -> Column:
    """About four bytes a token."""
    return F.ceil((F.octet_length(F.coalesce(text.cast("string"), F.lit(""))) + 1) / 4).cast("long")


def described(docs: DataFrame) -> DataFrame:
    """Adds the levels and the tokens of each document under working names."""
    level = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    return docs.withColumns({f"{_W}source": level("source"), f"{_W}lang": level("lang"), f"{_W}topic": topic(F.col("text")), f"{_W}tokens": tokens(F.col("text"))})


def _share(dim: str, level: Column, n: Column, targets: dict[str, dict[str, float]] | None) -> Column:
    """A level's target, in any unit."""
    given = (targets or {}).get(dim)
    if not given:
        return F.pow(n.cast("double"), F.lit(TEMPERATURE[dim]))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in given.items() for x in kv]), level), F.lit(0.0)).cast("double")


def reachable(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP) -> dict[str, float]:
    """For each dimension the factor from shares to tokens with which, levels held at what they have, all tokens come out.

    ``cells`` is a written table. Weights add up to all tokens and are then kept in part ``keep``, so a level has n / keep.
    """
    one = lambda d: cells.groupBy(F.lit(d).alias("dim"), F.col(f"{_W}{d}").alias("level")).agg(F.sum("n").alias("n")).withColumn("t", _share(d, F.col("level"), F.col("n"), targets))
    parts = [one(d) for d in TEMPERATURE]
    levels = written(parts[0].union(parts[1]).union(parts[2]), "mix-levels")
    factor, before = dict.fromkeys(TEMPERATURE, 0.0), None
    while factor != before:  # the levels that are held only become more
        before = dict(factor)
        now = F.element_at(F.create_map(*[F.lit(x) for kv in factor.items() for x in kv]), F.col("dim")) * F.col("t")
        most = F.col("n") / F.lit(float(keep))
        held = now >= most
        sums = levels.groupBy("dim").agg(F.sum("n").alias("all"), F.coalesce(F.sum(F.when(held, most)), F.lit(0.0)).alias("held"), F.coalesce(F.sum(F.when(~held, F.col("t"))), F.lit(0.0)).alias("free"))
        for r in sums.collect():  # one row a dimension
            if r.free > 0:
                factor[r.dim] = max(factor[r.dim], (float(r["all"]) - r.held) / r.free)
    return factor


def raked(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, sweeps: int = SWEEPS, keep: float = KEEP) -> DataFrame:
    """cells (levels, tokens n; a written table) with ``w``, the tokens scaled to all marginals, and each level's target."""
    of = {d: Window.partitionBy(f"{_W}{d}") for d in TEMPERATURE}
    factor, out = reachable(cells, targets, keep), cells
    for d in TEMPERATURE:
        n = F.sum("n").over(of[d])
        out = out.withColumn(f"{_W}t_{d}", F.least(_share(d, F.col(f"{_W}{d}"), n, targets) * F.lit(factor[d]), n / F.lit(float(keep))))
    most = F.col("n") / F.lit(float(keep))
    out = out.withColumn("w", F.col("n").cast("double"))
    for _ in range(sweeps):
        for d in TEMPERATURE:
            total = F.sum("w").over(of[d])
            out = out.withColumn("w", F.when(total > 0, F.least(most, F.col("w") * F.col(f"{_W}t_{d}") / total)).otherwise(0.0))
    return out


def described_cells(rows: DataFrame) -> DataFrame:
    """The cells of described documents, written down."""
    return written(rows.groupBy(*(f"{_W}{d}" for d in TEMPERATURE)).agg(F.sum(f"{_W}tokens").alias("n")), "mix-cells")


def marginals(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP) -> DataFrame:
    """Per dimension and level: its tokens, its target, and the tokens that the sample is expected to have of it."""
    cells = written(raked(described_cells(described(docs)), targets, SWEEPS, keep), "mix-raked")
    one = lambda d: cells.groupBy(F.lit(d).alias("dimension"), F.col(f"{_W}{d}").alias("level")).agg(F.sum("n").alias("tokens"), (F.first(f"{_W}t_{d}") * keep).alias("target"), (F.sum("w") * keep).alias("expected"))
    parts = [one(d) for d in TEMPERATURE]
    return parts[0].union(parts[1]).union(parts[2])


def calibrated(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP) -> DataFrame:
    """docs with working columns: levels, tokens, weight (times its natural share), probability, kept."""
    rows = described(docs)
    dims = [f"{_W}{d}" for d in TEMPERATURE]
    weights = raked(described_cells(rows), targets, SWEEPS, keep).select(*dims, F.try_divide(F.col("w"), F.col("n")).alias(f"{_W}weight"))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    joined = rows.join(weights, dims, "left")
    out = joined.withColumn(f"{_W}probability", F.least(F.lit(1.0), F.coalesce(F.col(f"{_W}weight"), F.lit(0.0)) * F.lit(float(keep))))
    return out.withColumn(f"{_W}kept", draw < F.col(f"{_W}probability"))


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP) -> DataFrame:
    """The sampled documents, with the columns they came with."""
    return calibrated(docs, targets, keep).where(F.col(f"{_W}kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents with their calibrated weight, probability and whether they were drawn."""
    out = calibrated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    c = {k: F.col(f"{_W}{k}") for k in ("source", "lang", "topic", "tokens", "weight", "probability", "kept")}
    return out.select("doc_id", c["source"].alias("source"), c["lang"].alias("lang"), c["topic"].alias("topic"), c["tokens"].alias("tokens"), F.round(c["weight"], 6).alias("weight"), F.round(c["probability"], 6).alias("probability"), c["kept"].alias("kept"))


def _oracle(sweeps: int = SWEEPS, rounds: int = 8) -> str:
    """Rounds of ``reachable`` beyond the one in which nothing changes leave all as it is."""
    steps, last = [], "f0"

    def step(body: str) -> None:
        nonlocal last
        name = f"f{len(steps) + 1}"
        steps.append(f"{name} AS (SELECT * REPLACE ({body}) FROM {last})")
        last = name

    most = {d: f"(n_{d} / {KEEP}::DOUBLE)" for d in TEMPERATURE}
    for _ in range(rounds):
        # Sums over levels: each cell carries its part of its level.
        parts = [
            f"greatest(c_{d}, (sum(CAST(n AS DOUBLE)) OVER () - coalesce(sum(CASE WHEN c_{d} * s_{d} >= {m} THEN {m} * n / n_{d} END) OVER (), 0))"
            f" / sum(CASE WHEN c_{d} * s_{d} < {m} THEN s_{d} * n / n_{d} END) OVER ()) AS c_{d}"
            for d, m in most.items()
        ]
        step(", ".join(parts))
    for _ in range(sweeps):
        for d, m in most.items():
            step(f"least(n / {KEEP}::DOUBLE, w * least(c_{d} * s_{d}, {m}) / sum(w) OVER (PARTITION BY {d})) AS w")
    sums = ", ".join(f"CAST(sum(n) OVER (PARTITION BY {d}) AS DOUBLE) AS n_{d}" for d in TEMPERATURE)
    shares = ", ".join(f"pow(n_{d}, {t}::DOUBLE) AS s_{d}, 0::DOUBLE AS c_{d}" for d, t in TEMPERATURE.items())
    return f"""
        WITH raw AS (SELECT doc_id, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, coalesce(text, '') AS text FROM documents),
        sized AS (SELECT *, length(text) AS chars, length(text) - length(replace(text, '|', '')) AS bars, length(text) - length(replace(text, chr(10), '')) AS breaks FROM raw),
        rows AS (SELECT doc_id, lang, source, CAST(ceil((strlen(text) + 1) / 4.0::DOUBLE) AS BIGINT) AS tokens,
            CASE WHEN bars * 40 > chars THEN 'table' WHEN breaks * 120 > chars THEN 'lines' WHEN chars < 1000 THEN 'short' WHEN chars < 4000 THEN 'medium' ELSE 'long' END AS topic FROM sized),
        cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS n FROM rows GROUP BY ALL),
        summed AS (SELECT *, {sums} FROM cells),
        f0 AS (SELECT *, {shares}, CAST(n AS DOUBLE) AS w FROM summed),
        {", ".join(steps)},
        weighed AS (SELECT source, lang, topic, w / n AS weight FROM {last}),
        drawn AS (SELECT *, least(1.0::DOUBLE, weight * {KEEP}::DOUBLE) AS p,
            CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0::DOUBLE AS u
            FROM rows JOIN weighed USING (source, lang, topic))
        SELECT doc_id, source, lang, topic, tokens, round(weight, 6) AS weight, round(p, 6) AS probability, u < p AS kept FROM drawn
    """


ORACLE_SQL = {"op5_source_mixing": _oracle()}
