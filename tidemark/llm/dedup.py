"""Near-duplicate detection with b-bit MinHash.

Each document's set of word shingles gives 96 minima. Bands of 4 whole minima make candidates; of each minimum the low
2 bits are kept and packed, and the similarity of a candidate pair is estimated from the bits that differ, corrected
for chance agreement. Pairs whose estimate is far too low (under ``LEAST_ESTIMATE``) go; the others are confirmed on
the full sets.

No group is ever paired with itself:

1. Documents with the same set form a class; one represents it.
2. In every band bucket all members are paired with the smallest member only. Confirmed pairs are linked, and linked
   classes form components.
3. Only buckets that still hold several components are looked at again. First every member outside a bucket's main
   component meets up to ``PIVOTS`` members of that, which is linear and links most of those that belong to it.
4. In the buckets that are still open, how often each shingle of their members occurs among them is counted. Documents
   of different components that share a rare shingle are paired through it, which is linear. Two that share none can
   only be similar if they share one of the first shingles of each, from the rarest to the most frequent, as many as a
   similar set may lack and one more. Most members have enough rare ones that none of those is frequent; the others
   meet by the few that are, if sizes, estimate and a second bound admit it: the bits in which two sets' parities differ
   (``PARITY`` bits a set) are no more than the shingles that only one of them has. All pairs left are confirmed. So
   every candidate pair is either confirmed, ruled out by a bound or an estimate, or already connected; nothing is capped.

Classes, not documents, are compared: a class has a number of its own, so rows that share a doc_id but not their text
never meet by it.

Defined results: words and shingles as in ``sets_of``; a text without words has an empty set and is linked with
nothing; a null doc_id takes no part (its component is null and it stays); of rows that share a doc_id each is judged
by its own text, and has the smallest doc_id that its own text reaches; an empty table gives no rows; extra columns
are ignored, or pass through ``keep_one``. That leaves of each component one class, and of that one row: the one with
the smallest doc_id (of rows that repeat doc_id and set, any). A pair at the threshold shares no band with a chance of
3.2e-6, and is estimated too low with one of 1.6e-8 (binomial: 37 or more of 96 fields differ, each with a chance of
0.15).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import map_arrow, sized, written

BANDS, ROWS, BITS = 24, 4, 2
WORDS, PERCENT = 5, 80
#: Estimated similarity below which a pair is not confirmed on the full sets. A pair at the threshold is lost by it with a
#: chance of 1.6e-8, a two-hundredth of that to share no band; 0.58 would lose 1.7e-5.
LEAST_ESTIMATE = 0.50
#: A shingle that at most so many of the documents looked at have is rare; the rare ones are paired through it.
RARE = 32
#: Members of a bucket's main component that every other member meets, at most; bits of a set's parity.
PIVOTS, PARITY = 16, 2048

_K = BANDS * ROWS
_random = np.random.default_rng(20240601)
_A = _random.integers(0, 2**63, _K, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 2**64, _K, np.uint64, endpoint=False)
_M1, _M2, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64(33)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _HALF)) * _M1
    x = (x ^ (x >> _HALF)) * _M2
    return x ^ (x >> _HALF)


class _WordHash(dict):
    """Word to 64-bit hash, remembered for words met lately."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 100_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


_HASHES = _WordHash()


def sets_of(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``words`` words; A-Z count as a-z, words end at ASCII white space.

    A text of fewer words is one shingle; without words there is none.
    """
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_HASHES.__getitem__, split), np.uint64, len(split))
    size = min(words, len(w))
    n = len(w) - size + 1
    h = w[:n] + np.uint64(size)
    for j in range(1, size):
        h = _mixed(h) * _STEP + w[j : n + j]
    return np.unique(_mixed(h))


def minima(shingles: np.ndarray) -> np.ndarray:
    best = np.full(_K, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        np.minimum(best, (shingles[None, i : i + 1024] * _A[:, None] + _B[:, None]).min(axis=1), out=best)
    return best


def band_keys(best: np.ndarray) -> np.ndarray:
    rows = best.reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP
    for j in range(ROWS):
        h = _mixed(h + rows[:, j])
    return h.view(np.int64)


def packed(best: np.ndarray) -> np.ndarray:
    """The low bits of all minima, 32 to a word."""
    low = (_mixed(best) & np.uint64(2**BITS - 1)).reshape(-1, 32)
    return (low << (np.arange(32, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def _set_key(shingles: np.ndarray) -> np.ndarray:
    """128-bit hash of a set, as two numbers."""
    import xxhash

    return np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n (set size), k0 and k1 (128-bit hash of the set), s0 to s2 (packed bits), bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, keys, bits, bands = [], [], [], []
            for x in b.column(1):
                own = sets_of(x.as_py(), words)
                sizes.append(len(own))
                keys.append(_set_key(own))
                best = minima(own)
                bits.append(packed(best))
                bands.append(band_keys(best))
            n = len(sizes)
            keys, bits = np.array(keys, np.int64).reshape(n, 2), np.array(bits, np.int64).reshape(n, 3)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(np.array(bands, np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), *(pa.array(np.ascontiguousarray(c)) for m in (keys, bits) for c in m.T), lists], ["doc_id", "n", "k0", "k1", "s0", "s1", "s2", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, sign, "doc_id long, n long, k0 long, k1 long, s0 long, s1 long, s2 long, bands array<bigint>")


def parity(shingles: np.ndarray) -> np.ndarray:
    """For each of PARITY classes of hashes, whether the set has an odd number of it, packed."""
    odd = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, k0 and k1 (hash of the set), the full set and its parity; repeats next to each other are left out."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            met: set = set()
            for i in range(0, b.num_rows, 256):
                ids, keys, sets, odd = [], [], [], []
                for doc, text in zip(b.column(0)[i : i + 256].to_pylist(), b.column(1)[i : i + 256], strict=True):
                    own = sets_of(text.as_py(), words)
                    key = _set_key(own)
                    if (doc, *key.tolist()) not in met:
                        met.add((doc, *key.tolist()))
                        ids.append(doc)
                        keys.append(key)
                        sets.append(own.view(np.int64))
                        odd.append(parity(own))
                k = np.array(keys, np.int64).reshape(len(ids), 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in k.T), *(pa.array(x, pa.list_(pa.int64())) for x in (sets, odd))], ["doc_id", "k0", "k1", "shingles", "odd"])

    return map_arrow(docs, collect, "doc_id long, k0 long, k1 long, shingles array<bigint>, odd array<bigint>")


def estimate(a: str, b: str) -> Column:
    """Similarity from the packed bits in columns ``a``0 to 2 and ``b``0 to 2."""
    return _estimate([(F.col(f"{a}{k}"), F.col(f"{b}{k}")) for k in range(3)])


def _estimate(words: list[tuple[Column, Column]]) -> Column:
    """Agreement beyond the 1 in 4 of chance."""
    apart = F.lit(0)
    for a, b in words:
        x = a.bitwiseXOR(b)
        apart = apart + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    chance = 0.5**BITS
    return ((1 - apart / F.lit(float(_K))) - chance) / (1 - chance)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sets_for(docs: DataFrame, classes: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, shingles and odd (their parity) of the classes in ``nodes`` (one column), each once."""
    wanted = written(classes.select("node", "doc_id", "k0", "k1").join(nodes.toDF("node").distinct(), "node", "left_semi"), "dedup-wanted")
    texts = _texts(docs).join(sized(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
    sets = written(shingle_sets(texts, words).join(sized(wanted), ["doc_id", "k0", "k1"]).select("node", "shingles", "odd"), "dedup-sets")
    if sets.count() > wanted.count():  # rows that repeat doc_id and set
        sets = written(sets.groupBy("node").agg(F.any_value("shingles").alias("shingles"), F.any_value("odd").alias("odd")), "dedup-sets")
    return sets


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), each given once, whose full sets are similar enough.

    A class in very many pairs is no hot task: nothing after the joins needs the pairs together again, so Spark splits
    a partition that is too large.
    """
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    alike = both.select("a", "b", shared.alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("sizes"))
    return alike.where(F.col("i") * 100 >= (F.col("sizes") - F.col("i")) * percent).select("a", "b")


#: Words that a parity is folded to for a first look.
FOLDED = 8


def _folded(odd: str) -> list[Column]:
    """The parity of coarser classes, as columns q0 and so on."""
    return [reduce(Column.bitwiseXOR, (F.col(odd)[j] for j in range(i, PARITY // 64, FOLDED))).alias(f"q{i}") for i in range(FOLDED)]


def _close_enough(differ: Column, a: str, b: str, percent: int) -> Column:
    sizes = F.col(f"{a}n") + F.col(f"{b}n")
    return (sizes - differ) * (100 + percent) >= sizes * (2 * percent)


def _bound(a: str, b: str, percent: int) -> Column:
    """False only where the parities differ in so many bits that the sets can't be similar enough."""
    differ = F.aggregate(F.zip_with(f"{a}odd", f"{b}odd", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return _close_enough(differ, a, b, percent)


def _first_bound(a: str, b: str, percent: int) -> Column:
    """The same by the folded parities: weaker, but of plain columns, so a join's condition stays compiled and makes no garbage."""
    differ = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}q{i}").bitwiseXOR(F.col(f"{b}q{i}"))) for i in range(FOLDED)))
    return _close_enough(differ, a, b, percent)


def _side(rows: DataFrame, s: str, *more: str) -> DataFrame:
    """``rows`` with node as ``s`` and the other columns under its prefix."""
    return rows.select(F.col("node").alias(s), *(F.col(c).alias(f"{s}{c}") for c in ("key", "component", "main", "n", "odd", *more)), *(F.col(f"s{k}").alias(f"{s}{k}") for k in range(3)))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members (key, node, ...) of buckets that hold several components, with their own and the bucket's main one."""
    labelled = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counts = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max_by("component", F.struct("n", "component")).alias("main")).where("low < high").select("key", "main")
    return labelled.join(written(mixed, "dedup-mixed"), "key")


def _by_pivots(open_: DataFrame, percent: int) -> DataFrame:
    """Members outside the main component with at most PIVOTS of it."""
    slot = F.pmod(F.xxhash64("node"), F.lit(PIVOTS))
    chosen = open_.where("component = main").groupBy("key", slot.alias("slot")).agg(F.min("node").alias("node")).select("key", "node")
    pivots = written(open_.join(chosen, ["key", "node"], "left_semi"), "dedup-pivots")
    meet = (F.col("akey") == F.col("bkey")) & (estimate("a", "b") >= LEAST_ESTIMATE) & _bound("a", "b", percent)
    return _ordered(_side(open_.where("component <> main"), "a").join(_side(pivots, "b"), meet))


def _rest(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that may still be similar, of the members of open buckets."""
    nodes = written(open_.select("node", "component", "s0", "s1", "s2").dropDuplicates(["node"]), "dedup-open-nodes")
    rows = sets.join(nodes, "node", "left_semi").select("node", F.explode("shingles").alias("shingle"))
    # Written down, so that the join with a shingle that very many have can be split.
    often = written(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "dedup-often")
    counted = written(rows.join(often, "shingle"), "dedup-shingles")
    frequent = counted.groupBy("node").agg(F.count_if(F.col("df") > RARE).cast("int").alias("f"))

    # By rare shingles: a list of at most RARE nodes each.
    own = F.struct("node", "component", "s0", "s1", "s2")
    lists = counted.where(F.col("df") <= RARE).join(nodes, "node").groupBy("shingle").agg(F.collect_list(own).alias("l"))
    apart = lambda x: F.filter("l", lambda y: (y["node"] < x["node"]) & (y["component"] != x["component"]))
    named = lambda x, side: [x["node"].alias(side), *(x[f"s{k}"].alias(f"{side}{k}") for k in range(3))]
    paired = F.flatten(F.transform("l", lambda x: F.transform(apart(x), lambda y: F.struct(*named(x, "a"), *named(y, "b")))))
    by_rare = lists.select(F.explode(F.filter(paired, lambda p: _estimate([(p[f"a{k}"], p[f"b{k}"]) for k in range(3)]) >= LEAST_ESTIMATE)).alias("p")).select("p.a", "p.b")

    # By frequent shingles alone. Sets of n and m shingles that are similar enough share one of the first n - ceil(t n) + 1
    # of the one and of the first m - ceil(t m) + 1 of the other, counted from the rarest. Rare ones are seen to, so only
    # members whose first ones reach into the frequent are left, and they meet by those few.
    first = F.floor((100 - percent) * F.col("n") / 100) + 1
    open_nodes = open_.select("node", "n", "odd").dropDuplicates(["node"])
    able = frequent.join(open_nodes, "node").select("node", "n", "f", "odd", (first - (F.col("n") - F.col("f"))).cast("int").alias("reach")).where("reach > 0")
    able = written(able.join(nodes, "node"), "dedup-able")
    ranked = counted.where(F.col("df") > RARE).join(able.select("node", "reach"), "node").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("l"), F.first("reach").alias("reach"))
    starts = ranked.select("node", F.slice(F.transform("l", lambda x: x["shingle"]), F.lit(1), F.col("reach")).alias("starts"))
    starts = written(starts.join(able.select("node", "component", "n", "f", "s0", "s1", "s2", *_folded("odd")), "node").withColumn("shingle", F.explode("starts")), "dedup-starts")
    side = lambda s: starts.select("shingle", F.col("node").alias(s), *(F.col(c).alias(f"{s}{c}") for c in ("component", "n", "f", "starts")), *(F.col(f"s{k}").alias(f"{s}{k}") for k in range(3)), *(F.col(f"q{i}").alias(f"{s}q{i}") for i in range(FOLDED)))
    most = F.least("af", "bf")
    alike = (F.least("an", "bn") * 100 >= F.greatest("an", "bn") * percent) & (most * 100 >= (F.col("an") + F.col("bn") - most) * percent) & (estimate("a", "b") >= LEAST_ESTIMATE)
    meet = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("a") > F.col("b")) & (F.col("acomponent") != F.col("bcomponent")) & alike & _first_bound("a", "b", percent)
    # Of the first shingles that two share, the rarest pairs them.
    meet = meet & (F.array_intersect("astarts", "bstarts")[0] == F.col("x.shingle"))
    met = written(side("a").alias("x").join(side("b").alias("y"), meet).select("a", "b"), "dedup-met")
    bits = lambda s: able.select(F.col("node").alias(s), F.col("n").alias(f"{s}n"), F.col("odd").alias(f"{s}odd"))
    by_frequent = met.join(bits("a"), "a").join(bits("b"), "b").where(_bound("a", "b", percent))
    return _ordered(by_rare.union(by_frequent.select("a", "b")))


#: A graph of at most so many edges is worked on in one plan a round; a larger one's steps are written down, so that Spark can
#: split the edges of a node with very many.
SMALL_GRAPH = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for all nodes of ``edges`` (a, b).

    Large-star and small-star steps in turn, each round written down, until nothing changes.
    """
    state, seen = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "dedup-edges"), None
    while True:
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return state.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = now
        step = (lambda df, _: df) if now[0] <= SMALL_GRAPH else written
        both = state.union(state.select("b", "a"))
        lowest = step(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "dedup-lowest")
        large = both.join(lowest, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = step(large, "dedup-large")
        down = step(large.groupBy("a").agg(F.min("b").alias("m")), "dedup-down")
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(down.select("a", "m")).distinct()
        state = written(small, "dedup-stars")


def _classes(usable: DataFrame) -> DataFrame:
    """One row per set: node (its number), the smallest doc_id, hash, packed bits and bands (all the same within a class)."""
    singles = usable.select("doc_id", "k0", "k1", "s0", "s1", "s2", *(F.col("bands")[i].alias(f"b{i}") for i in range(BANDS)))
    same = [c for c in singles.columns if c not in ("doc_id", "k0", "k1")]
    one = singles.groupBy("k0", "k1").agg(F.min("doc_id").alias("doc_id"), *(F.min(c).alias(c) for c in same))
    bands = F.array(*(F.col(f"b{i}") for i in range(BANDS))).alias("bands")
    # The numbers are fixed by the one writing, whichever attempts of its tasks commit.
    return written(one.select(F.monotonically_increasing_id().alias("node"), "doc_id", "k0", "k1", "s0", "s1", "s2", bands), "dedup-classes")


def _linked(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, component) of all classes that are linked with another."""
    bits = lambda side: classes.select(F.col("node").alias(side), *(F.col(f"s{k}").alias(f"{side}{k}") for k in range(3)))

    banded = classes.select("node", F.explode("bands").alias("key"))
    # Small tables by hot keys are written down before they are joined: both sides are then plain shuffles, which Spark can split.
    leaders = written(banded.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("most")).where("leader < most").drop("most"), "dedup-leaders")
    members = written(banded.join(leaders, "key"), "dedup-members")

    stars = members.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    likely = stars.join(bits("a"), "a").join(bits("b"), "b").where(estimate("a", "b") >= LEAST_ESTIMATE).select("a", "b")
    likely = written(likely, "dedup-pairs")
    ends = likely.select("a").union(likely.select("b"))
    edges = written(_confirmed(likely, _sets_for(docs, classes, ends, words), percent), "dedup-links")
    labels = components(edges)

    open_ = written(_open(members.select("key", "node"), labels).join(classes.select("node", "s0", "s1", "s2"), "node"), "dedup-open")
    sets = _sets_for(docs, classes, open_.select("node"), words)
    known = written(open_.join(sets.select("node", F.size("shingles").alias("n"), "odd"), "node"), "dedup-known")
    near = written(_by_pivots(known, percent).join(likely, ["a", "b"], "left_anti"), "dedup-near")
    if near.isEmpty():
        still = known
    else:
        edges = written(edges.union(_confirmed(near, sets, percent)), "dedup-links")
        labels = components(edges)
        still = written(_open(known.drop("component", "main"), labels), "dedup-open")
    met = likely.union(near)
    rest = written(_rest(still, sets, percent).join(met, ["a", "b"], "left_anti"), "dedup-rest")
    if not rest.isEmpty():
        labels = components(edges.union(_confirmed(rest, sets, percent)))
    return labels.union(labels.select("component", "component").distinct())


def _judged(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per row: doc_id, n, k0, k1, component_id, and whether its class is the one of its component that stays."""
    signed = written(signatures(docs, words), "dedup-signatures")
    usable = signed.where("n > 0 and doc_id is not null")
    classes = _classes(usable)
    linked = written(_linked(docs, classes, words, percent), "dedup-linked")
    named = linked.join(classes.select("node", "doc_id"), "node")
    first = named.groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("first"))
    grouped = written(linked.join(first, "component").select("node", "first"), "dedup-grouped")
    own = F.struct("doc_id", "node")
    found = classes.select("node", "doc_id", "k0", "k1").join(grouped, "node", "left").select("k0", "k1", F.coalesce("first", own).alias("first"), F.coalesce(F.col("first.node") == F.col("node"), F.lit(True)).alias("stays"))
    found = written(found.select("k0", "k1", F.col("first.doc_id").alias("component_id"), "stays"), "dedup-found")
    told = usable.select("doc_id", "n", "k0", "k1").join(found, ["k0", "k1"]).select("doc_id", "n", "k0", "k1", "component_id", "stays")
    alone = signed.where("n = 0 or doc_id is null").select("doc_id", "n", "k0", "k1", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    return told.union(alone)


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of ``docs``."""
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return _judged(docs, words, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept)


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Of each group of near-duplicates one document, with all columns."""
    judged = _judged(docs, words, percent).where("doc_id is not null").select(F.col("doc_id").alias("__dedup_id"), "k0", "k1", (F.col("stays") & (F.col("doc_id") == F.col("component_id"))).alias("stays"))
    judged = written(judged, "dedup-result")
    ids = written(judged.groupBy("__dedup_id").agg(F.max("stays").alias("any"), F.count(F.lit(1)).alias("n")), "dedup-ids")
    key = docs["doc_id"].cast("long") == F.col("__dedup_id")
    # Ids of one row go or stay as they are; of those with several, each row is looked up by its own set.
    twice = written(ids.where("any and n > 1").select("__dedup_id"), "dedup-twice")
    gone = written(ids.where("not any").select("__dedup_id").union(twice), "dedup-gone")
    stay = docs.join(sized(gone), key, "left_anti")
    if twice.isEmpty():
        return stay
    repeated = _with_set_key(docs.join(sized(twice), key, "left_semi"), words)
    right = written(judged.where("stays").join(sized(twice), "__dedup_id", "left_semi").select("__dedup_id", "k0", "k1").distinct(), "dedup-right")
    once = repeated.join(right, ["__dedup_id", "k0", "k1"], "left_semi").groupBy("__dedup_id", "k0", "k1").agg(F.any_value("__dedup_row").alias("r"))
    return stay.unionByName(once.select("r.*"))


def _with_set_key(docs: DataFrame, words: int) -> DataFrame:
    """__dedup_id, the whole row, and the hash of its set."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = np.array([_set_key(sets_of(x.as_py(), words)) for x in b.column(1)], np.int64).reshape(b.num_rows, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(np.ascontiguousarray(c)) for c in k.T)], ["__dedup_id", "__dedup_row", "k0", "k1"])

    row = F.struct(*(docs[c] for c in docs.columns)).alias("__dedup_row")
    rows = docs.select(F.col("doc_id").cast("long").alias("__dedup_id"), F.col("text").cast("string").alias("__dedup_text"), row)
    return map_arrow(rows, key, StructType([*(f for f in rows.schema.fields if f.name != "__dedup_text"), *StructType.fromDDL("k0 long, k1 long").fields]))


def op7_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents, sets of 4-word shingles, linked from a similarity of 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)


# All pairs that share a shingle: for small tables only.
ORACLE_SQL = {
    "op7_minhash_dedup": r"""
        WITH RECURSIVE t AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS g FROM t),
        n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
        u AS (SELECT doc_id, unnest(g) AS x FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
        both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach(doc_id, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a)
        SELECT n.doc_id, any_value(n.n) AS n_shingles, min(r) AS component_id, n.doc_id = min(r) AS kept FROM n JOIN reach ON reach.doc_id = n.doc_id GROUP BY n.doc_id
    """,
}
