"""Vector codes against plain Lloyd, in SQL over the tables and in numpy over odd rows; how much is pruned."""

import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import codes

NAMES = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def plain(rows, parts=8, entries=16, rounds=6):
    """Rows (vec_id, label, integers), in the order of their ids: every part against every entry, in Python's integers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(rows[0][2]) // parts
    split = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in rows]
    books = [[list(x[p]) for x in split[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for x in split:
                groups[nearest(x[p], books[p])[1]].append(x[p])
            for i, xs in groups.items():
                books[p][i] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    found = [[nearest(x[p], books[p]) for p in range(parts)] for x in split]
    errors, labels = [sum(d for d, _ in f) for f in found], defaultdict(int)
    for (_, label, _), e in zip(rows, errors, strict=True):
        labels[label] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{e:02x}" for _, e in f), err, labels[label], digest) for (i, label, _), f, err in zip(rows, found, errors, strict=True))


def got(spark, df, tmp=None):
    fit = codes.fit_codes(df.select("vec_id", "label", codes.integer_vector(F.col("embedding")).alias("v")))
    labels = defaultdict(int)
    rows = fit.coded.collect()
    for r in rows:
        labels[r["label"]] += r["error"]
    return sorted((str(r["vec_id"]), r["code"], r["error"], labels[r["label"]], fit.books.digest()) for r in rows)


def test_tables_equal_sql(spark, duck, sf):
    rel = duck.execute(codes.ORACLE_SQL["op13_vector_codes"])
    at = [d[0] for d in rel.description]
    want = sorted(tuple(row[at.index(n)] for n in NAMES) for row in rel.fetchall())
    assert sorted(tuple(r[n] for n in NAMES) for r in codes.op13_vector_codes(spark, sf).collect()) == want


def test_ties_copies_and_vectors_that_take_no_part(spark):
    """Few distinct values, so that distances tie and entries stay unused; odd vectors are left out."""
    rng = np.random.default_rng(5)
    rows = [(int(i // 2), int(i % 3) if i % 5 else None, (rng.integers(-3, 4, 16) / 4096).tolist()) for i in range(150)]
    rows += [(200 + i, 1, rows[0][2]) for i in range(60)] + [(None, 2, rows[3][2])]
    nan, inf = float("nan"), float("inf")
    odd = [(-9, 1, None), (-8, 1, [nan] * 16), (-7, 1, [inf] + [0.0] * 15), (-6, 1, [None] + [0.0] * 15), (300, 1, []), (301, 1, [0.5] * 8), (302, 1, [1e300] * 16)]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, label int, embedding array<double>, code string").repartition(5)
    assert got(spark, df) == plain([(i, label, [int(np.floor(4096 * x)) for x in v]) for i, label, v in rows])


def test_fewer_vectors_than_entries_and_none(spark):
    rows = [(i, None, [i / 10 + j / 100 for j in range(8)]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert got(spark, df) == plain([(i, label, [int(np.floor(4096 * x)) for x in v]) for i, label, v in rows])
    assert codes.fit_codes(df.select("vec_id", "label", codes.integer_vector(F.col("embedding")).alias("v")).limit(0)).coded.count() == 0
    ragged = spark.createDataFrame([(1, 1, [0.5] * 9)], "vec_id long, label int, embedding array<double>")
    assert codes.fit_codes(ragged.select("vec_id", "label", codes.integer_vector(F.col("embedding")).alias("v"))).coded.count() == 0


def test_bounds_hold_and_most_distances_are_never_measured():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16, 8))
    x = np.floor(4096 * (centres[np.arange(8)[None, :], rng.integers(0, 16, (3000, 8))] + rng.normal(size=(3000, 8, 8)) * 0.05)).astype(np.int64)
    books = codes.Codebooks(x[:16].transpose(1, 0, 2).copy())
    bounds, measured = codes.Bounds.none(len(x), books), []
    for _ in range(6):
        squares, n = codes.assign(x, bounds, books)
        measured.append(n)
        every = ((x[:, :, None, :] - books.entries[None]) ** 2).sum(-1)
        assert (squares == every.min(-1)).all()
        assert (bounds.assigned == every.argmin(-1)).all()
        assert (bounds.lower**2 <= every).all()
        assert (bounds.upper**2 >= squares).all()
        bounds = codes.Bounds.unpacked(bounds.packed(), books)
        sums, counts = np.zeros((8, 16, 8), np.int64), np.zeros((8, 16), np.int64)
        for p in range(8):
            np.add.at(sums[p], bounds.assigned[:, p], x[:, p])
            np.add.at(counts[p], bounds.assigned[:, p], 1)
        books = books.replaced(sums, counts)
    assert measured[-1] < 0.2 * 3000 * 8 * 16


def test_integer_roots():
    n = np.array([0, 1, 2, 3, 4, (1 << 30) ** 2 - 1, (1 << 30) ** 2, (1 << 30) ** 2 + 1, 999_999_999**2 - 1])
    assert codes.root_down(n).tolist() == [0, 1, 1, 1, 2, (1 << 30) - 1, 1 << 30, 1 << 30, 999_999_998]
    assert codes.root_up(n).tolist() == [0, 1, 2, 2, 2, 1 << 30, 1 << 30, (1 << 30) + 1, 999_999_999]
