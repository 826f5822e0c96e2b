"""SQL for the block bootstrap: the generator's stream in integers, the blocks it draws, and the metrics of every resample.

The generator is a 128-bit congruential one whose outputs are two 32-bit words each. State k follows from the first by one
multiplication and addition, so all states come from doublings: the states so far, and the same moved on by their number.
Numbers of 128 bits are four limbs of 32, because a product must not overflow.
"""

from __future__ import annotations

import numpy as np

MASK = (1 << 128) - 1

# Multiplier of the generator.
MULTIPLIER = 0x2360ED051FC65DA44385DF649FCCF645


def _limbs(value: int) -> list[int]:
    return [(value >> (32 * i)) & 0xFFFFFFFF for i in range(4)]


def _moved(table: str, by: int, factor: int, addend: int) -> str:
    """Rows (k, s0..s3) of ``table``, k moved on by ``by`` and the state s to s * factor + addend modulo 2**128."""
    b, c = _limbs(factor), _limbs(addend)
    at = lambda i: " + ".join(f"s{j} * {b[i - j]}" for j in range(i + 1)) + f" + {c[i]}"
    inner = f"SELECT k + {by} AS k, {', '.join(f'{at(i)} AS t{i}' for i in range(4))} FROM {table}"
    for i in range(3):
        inner = f"SELECT k, {', '.join(f'r{j}' for j in range(i))}{',' if i else ''} t{i} % 4294967296 AS r{i}, t{i + 1} + t{i} // 4294967296 AS t{i + 1}{''.join(f', t{j}' for j in range(i + 2, 4))} FROM ({inner})"
    return f"SELECT k, r0 AS s0, r1 AS s1, r2 AS s2, t3 % 4294967296 AS s3 FROM ({inner})"


def draws(seed: int, lengths: str, n_bootstrap: int = 500, block: int = 5, doublings: int = 17, prefix: str = "") -> str:
    """CTEs up to ``{prefix}drawn`` (n, rep, place): the places of each resample of the lengths n in the table ``lengths``.

    2**(doublings + 1) words serve lengths of up to that many times block / n_bootstrap points.
    """
    state = np.random.PCG64(seed).state["state"]
    first = (state["state"] * MULTIPLIER + state["inc"]) & MASK
    ctes = [f"{prefix}g0 AS (SELECT 0::BIGINT AS k, {', '.join(f'{v}::HUGEINT AS s{i}' for i, v in enumerate(_limbs(first)))})"]
    factor, addend = MULTIPLIER, state["inc"]
    for i in range(doublings):
        ctes.append(f"{prefix}g{i + 1} AS MATERIALIZED (SELECT * FROM {prefix}g{i} UNION ALL {_moved(f'{prefix}g{i}', 1 << i, factor, addend)})")
        factor, addend = factor * factor & MASK, (addend * factor + addend) & MASK
    ctes.append(f"""{prefix}words AS (
        SELECT 2 * k AS seq, o % 4294967296 AS word FROM {prefix}outputs UNION ALL SELECT 2 * k + 1, o // 4294967296 FROM {prefix}outputs)""")
    outputs = f"""{prefix}outputs AS (
        SELECT k, CAST((x // turn + x * (18446744073709551616::UHUGEINT // turn) % 18446744073709551616::UHUGEINT) AS HUGEINT) AS o
        FROM (SELECT k, (xor(s3, s1)::HUGEINT * 4294967296 + xor(s2, s0)::HUGEINT)::UHUGEINT AS x, (1::HUGEINT << (s3 // 67108864)::INTEGER)::UHUGEINT AS turn FROM {prefix}g{doublings}))"""
    ctes.insert(-1, outputs)
    ctes.append(f"""{prefix}starts AS (
        SELECT n, start, row_number() OVER (PARTITION BY n ORDER BY seq) - 1 AS i
        FROM (SELECT n, seq, word * (n - {block} + 1) // 4294967296 AS start
              FROM (SELECT DISTINCT n FROM {lengths} WHERE n > {block}), {prefix}words
              WHERE seq < n * {n_bootstrap} // {block} + 4000 AND word * (n - {block} + 1) % 4294967296 >= 4294967296 % (n - {block} + 1))
        UNION ALL SELECT n, 0, i FROM (SELECT DISTINCT n FROM {lengths} WHERE n <= {block} AND n > 0), range({n_bootstrap}) t(i)),
    {prefix}drawn AS MATERIALIZED (
        SELECT n, rep, start + step AS place
        FROM (SELECT n, start, i // ((n + {block} - 1) // {block}) AS rep, i % ((n + {block} - 1) // {block}) * {block} AS taken FROM {prefix}starts), range({block}) t(step)
        WHERE rep < {n_bootstrap} AND taken + step < n)""")
    return ",\n    ".join(ctes)


def scores(points: str, keys: str, x: str = "x", y: str = "y") -> str:
    """(keys, metric, value) of each group of ``points``; groups without a value have no row."""
    return f"""SELECT {keys}, unnest(['pearson', 'spearman', 'r2', 'mse']) AS metric, unnest([pearson, spearman, r2, mse]) AS value
        FROM (SELECT {keys}, CASE WHEN n >= 2 AND varied THEN p END AS pearson, CASE WHEN n >= 2 AND varied THEN s END AS spearman,
                     CASE WHEN n >= 2 AND min_x < max_x THEN CASE WHEN min_y = max_y OR total <= 0 THEN CASE WHEN error = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - error / total END END AS r2,
                     CASE WHEN n >= 2 THEN error / n END AS mse
              FROM (SELECT {keys}, count(*) AS n, min({x}) < max({x}) AND min({y}) < max({y}) AS varied, min({x}) AS min_x, max({x}) AS max_x, min({y}) AS min_y, max({y}) AS max_y,
                           corr({x}, {y}) AS p, corr(rank_x, rank_y) AS s, sum(({y} - {x}) * ({y} - {x})) AS error, sum({y} * {y}) - sum({y}) * sum({y}) / count(*) AS total
                    FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0::DOUBLE AS rank_x,
                                 rank() OVER (PARTITION BY {keys} ORDER BY {y}) + (count(*) OVER (PARTITION BY {keys}, {y}) - 1) / 2.0::DOUBLE AS rank_y FROM {points})
                    GROUP BY {keys}))"""


#: Two-sided p-value of a correlation r of n points: the share of the angle's density beyond asin |r|, by Simpson's rule.
CORRELATION_P = """least(1.0, list_sum(list_transform(range(4001), lambda i: (CASE WHEN i % 4000 = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
        * cos(asin(abs({r})) + (pi() / 2 - asin(abs({r}))) * i / 4000) ** ({n} - 3))) * (pi() / 2 - asin(abs({r})))
    / (list_sum(list_transform(range(4001), lambda i: (CASE WHEN i % 4000 = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * cos(pi() / 2 * i / 4000) ** ({n} - 3))) * (pi() / 2)))"""
