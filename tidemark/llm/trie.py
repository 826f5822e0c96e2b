"""Prefix trie of conversations with sums over subtrees by heavy-path decomposition.

A node is a distinct sequence of first turns. It is known by the exclusive or of 128-bit hashes of (depth, turn), so a
running value along a conversation names all its nodes, and a node's parent is named by taking its last turn out again.
Texts are digested where they are read; only digests and lengths are shuffled.

The child with most members (ties: the smallest member) is its parent's heavy child, and every other child starts a path,
so a way to the root crosses at most log2(members) paths. Paths are solved in rounds, those under most other paths first:
along a path's array a suffix sum gives the sums of all its subtrees, and the sum at its top is added to the node it hangs
from, which a later round solves. Each round reads its own files and writes its sums to the shared folder.

A node that many conversations share is one row after sums that combine before they are shuffled; where its conversations
look it up, nodes with more than ``HOT_SHARE`` of all rows (at most 1 / HOT_SHARE of them) are broadcast. Members that end
at a node are formatted in sorted slices, and only the slices' bytes meet, in order, in one hash.

Defined results: a null role or text is empty; turns are ordered by number, null first, and those that tie by their
digest; repeated rows are turns of their own; rows without conv_id take no part; a conversation whose rebuilt sequence is
empty is a member of the root alone; an empty table has no nodes; very long texts are digested like others; extra columns
are ignored. A conversation is one sequence, so its turns are numbered by one window (over digests and lengths).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows that name the same node beyond this share of all rows are looked up by a broadcast of at most 1 / HOT_SHARE nodes.
HOT_SHARE = 1e-3

#: Bytes of formatted ids that travel as one row.
SLICE_BYTES = 1 << 16

#: A base conversation is shared by the ids of its hundred; at most this many of its first turns are taken over, less one.
GROUP, HEADS = 100, 6


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, i (from 1), digest and code points of each turn, in order."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("digest"),
        F.length(text).cast("long").alias("chars"),
    ).where("conv_id IS NOT NULL")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    return rows.select("conv_id", F.row_number().over(order).alias("i"), "digest", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with shared beginnings: (conv_id, depth, digest, chars), and (conv_id, length) of every conversation.

    A conversation c begins with the first crc32(c) % HEADS turns of conversation c - c % GROUP, if there are any, and goes
    on with its own turns after as many.
    """
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    convs = turns.groupBy("conv_id").agg(F.max("i").alias("own")).select("conv_id", "own", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    bases = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("i") < HEADS)).select(F.col("conv_id").alias("base"), F.struct("i", "digest", "chars").alias("t"))
    heads = bases.groupBy("base").agg(F.array_sort(F.collect_list("t")).alias("heads"))  # at most HEADS - 1 turns
    begun = convs.join(heads, "base", "left").select("conv_id", "own", "h", F.coalesce(F.slice("heads", F.lit(1), F.col("h")), F.array().cast("array<struct<i:int,digest:binary,chars:bigint>>")).alias("begin"))
    begun = begun.withColumn("taken", F.size("begin"))
    first = begun.select("conv_id", F.explode("begin").alias("t")).select("conv_id", F.col("t.i").alias("depth"), "t.digest", "t.chars")
    rest = turns.join(begun.select("conv_id", "h", "taken"), "conv_id").where(F.col("i") > F.col("h")).select("conv_id", (F.col("i") - F.col("h") + F.col("taken")).alias("depth"), "digest", "chars")
    lengths = begun.select("conv_id", (F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("length"))
    return first.unionByName(rest), lengths


def _marks(depth: Column, digest: Column) -> list[Column]:
    return [F.xxhash64(F.lit(lane), depth.cast("long"), digest) for lane in (1, 2)]


def prefixes(sequences: DataFrame) -> DataFrame:
    """The node (a, b) at each depth of each sequence, and its parent (pa, pb); the root is (0, 0)."""
    along = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    m1, m2 = _marks(F.col("depth"), F.col("digest"))
    rows = sequences.select("conv_id", "depth", "chars", m1.alias("m1"), m2.alias("m2"))
    rows = rows.withColumns({"a": F.bit_xor("m1").over(along), "b": F.bit_xor("m2").over(along)})
    return rows.select("conv_id", "depth", "chars", "a", "b", F.col("a").bitwiseXOR(F.col("m1")).alias("pa"), F.col("b").bitwiseXOR(F.col("m2")).alias("pb"))


def ends_digest(ends: DataFrame) -> DataFrame:
    """(a, b, conv_id) to (a, b, hex SHA-256 of the ids in ascending order, joined by commas)."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "first", "ids"]
        node, first, parts, size = None, 0, [], 0
        for batch in batches:
            out: list[tuple] = []
            for a, b, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, b) != node or size >= SLICE_BYTES:
                    if parts:
                        out.append((*node, first, ",".join(parts).encode()))
                    node, first, parts, size = (a, b), conv, [], 0
                parts.append(str(conv))
                size += len(parts[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names)
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*node, first, ",".join(parts).encode()), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for a, b, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, b) == node:
                    state.update(b"," + ids)
                    continue
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (a, b), hashlib.sha256(ids)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["a", "b", "ends_sha256"])
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*node, state.hexdigest()), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["a", "b", "ends_sha256"])

    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Ranges of (node, id): a node with very many ends spans several, each of which formats its own ids.
    sliced = ends.select("a", "b", "conv_id").repartitionByRange(parts, "a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(slices, "a long, b long, first long, ids binary")
    return sliced.repartition(parts, "a", "b").sortWithinPartitions("a", "b", "first").select("a", "b", "ids").mapInArrow(digests, "a long, b long, ends_sha256 string")


def _look_up(rows: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """``rows`` joined with their nodes; those that very many rows name are broadcast, so that no task gets all their rows."""
    least = max(1, int(total * HOT_SHARE))
    hot = nodes.where(F.col("n_convs") > least)
    sure = rows.join(F.broadcast(hot), ["a", "b"])
    cold = rows.join(F.broadcast(hot.select("a", "b")), ["a", "b"], "left_anti").join(nodes.where(F.col("n_convs") <= least).hint("merge"), ["a", "b"])
    return sure.unionByName(cold)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = written(turns_of(conversations), "trie-turns")
    sequences, lengths = rebuilt(turns)
    lengths = written(lengths, "trie-lengths")
    rows = written(prefixes(sequences).join(lengths, "conv_id"), "trie-rows").withColumn("last", F.col("depth") == F.col("length"))
    total = rows.count()
    zero = F.lit(0).cast("long")

    # Nodes, with what their children say of them.
    root = lengths.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(zero.alias("a"), zero.alias("b"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"), F.lit(0).alias("depth"), zero.alias("chars"), "n_convs", "conv_id")
    nodes = rows.groupBy("a", "b").agg(*(F.min(c).alias(c) for c in ("pa", "pb", "depth", "chars")), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    nodes = written(root.unionByName(nodes), "trie-nodes")
    heaviest = F.max(F.struct("n_convs", (-F.col("conv_id")).alias("by"), "a", "b")).alias("heavy")
    parents = written(nodes.where("depth > 0").groupBy(F.col("pa").alias("na"), F.col("pb").alias("nb")).agg(F.count("*").alias("n_children"), heaviest), "trie-parents")
    children = parents.select(F.col("na").alias("a"), F.col("nb").alias("b"), "n_children")
    heavy = parents.select(F.col("heavy.a").alias("a"), F.col("heavy.b").alias("b"), F.lit(True).alias("on_path"))
    known = nodes.join(children, ["a", "b"], "left").join(heavy, ["a", "b"], "left").select(
        "a", "b", "pa", "pb", "depth", "n_convs", F.col("conv_id").alias("node_conv"), F.coalesce("n_children", zero).alias("n_children"),
        (F.col("on_path").isNull() & (F.col("depth") > 0)).alias("light"), (F.col("chars") * (F.col("n_convs") - 1)).alias("saved"),
    )
    known = written(known, "trie-known")

    # Along the smallest member of a node stand all nodes above it: the last light one is the top of its path.
    members = rows.join(nodes.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "a", "b")
    seen = _look_up(members, known.where("depth > 0"), total)
    seen = seen.unionByName(known.where("depth = 0").select(F.col("node_conv").alias("conv_id"), *known.columns))
    along = Window.partitionBy("conv_id").orderBy("depth")
    top = F.last(F.when(F.col("light"), F.struct("a", "b", "pa", "pb")), ignorenulls=True).over(along)
    first = known.where("depth = 0").select(F.col("node_conv").alias("root_conv"))
    placed = (
        seen.withColumns({"top": top, "level": F.sum(F.col("light").cast("int")).over(along), "above": F.lag("node_conv").over(along)})
        .where(F.col("conv_id") == F.col("node_conv"))
        .join(F.broadcast(first))
        .withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("above", "root_conv")))
        .select("a", "b", "depth", "node_conv", "parent_conv_id", "n_convs", "n_children", "saved", (F.col("n_children") == 0).cast("long").alias("leaf"), F.coalesce("level", F.lit(0)).cast("int").alias("level"),
                *(F.coalesce(F.col(f"top.{c}"), zero).alias(f"top_{c}") for c in ("a", "b")), *(F.col(f"top.{c}").alias(f"hung_{c}") for c in ("pa", "pb")))
    )
    placed = written(placed, "trie-placed")
    deepest = placed.agg(F.max("level")).first()[0]
    if deepest is None:
        return _result(placed.withColumns({"n_leaves": zero, "saved_tokens": zero}), nodes.select("a", "b", "conv_id"))
    by_level = written(placed.repartition("top_a", "top_b"), "trie-levels", "level")

    solved = []
    for level in range(deepest, -1, -1):
        layer = by_level.where(F.col("level") == level)
        if solved:
            hung = solved[-1].where("hung_pa IS NOT NULL AND is_top").groupBy(F.col("hung_pa").alias("a"), F.col("hung_pb").alias("b")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
            layer = layer.join(hung, ["a", "b"], "left")
        else:
            layer = layer.withColumns({"more_leaves": zero, "more_saved": zero})
        below = Window.partitionBy("top_a", "top_b").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
        sums = {"n_leaves": F.sum(F.col("leaf") + F.coalesce("more_leaves", zero)).over(below), "saved_tokens": F.sum(F.col("saved") + F.coalesce("more_saved", zero)).over(below)}
        layer = layer.withColumns(sums).withColumn("is_top", (F.col("a") == F.col("top_a")) & (F.col("b") == F.col("top_b")))
        solved.append(written(layer.drop("more_leaves", "more_saved", "level"), f"trie-solved-{level}"))
    whole = solved[0]
    for part in solved[1:]:
        whole = whole.unionByName(part)
    ends = rows.where("last").select("a", "b", "conv_id").unionByName(lengths.where("length = 0").select(zero.alias("a"), zero.alias("b"), "conv_id"))
    return _result(whole, ends)


def _result(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    none = hashlib.sha256(b"").hexdigest()
    return nodes.join(ends_digest(ends), ["a", "b"], "left").select(
        F.col("node_conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
    )


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all conversations with shared beginnings."""
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


# crc32 byte by byte and bit by bit; nodes are lists of turns, subtrees are found along the smallest member.
ORACLE_SQL = {
    "op12_conversation_trie": """
        WITH turns AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
            FROM conversations WHERE conv_id IS NOT NULL),
        convs AS (
            SELECT conv_id, conv_id - conv_id % 100 AS base,
                   xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
                       lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
                           lambda x, k: xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT) % 6 AS h
            FROM (SELECT DISTINCT conv_id FROM turns)),
        begun AS (
            SELECT c.conv_id, c.h, t.i, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.i <= c.h),
        taken AS (SELECT c.conv_id, c.h, count(b.i) AS k FROM convs c LEFT JOIN begun b USING (conv_id) GROUP BY ALL),
        built AS (
            SELECT conv_id, i AS d, role, text FROM begun
            UNION ALL
            SELECT t.conv_id, t.i - k.h + k.k, t.role, t.text FROM turns t JOIN taken k USING (conv_id) WHERE t.i > k.h),
        lengths AS (SELECT c.conv_id, count(b.d) AS n FROM convs c LEFT JOIN built b USING (conv_id) GROUP BY ALL),
        members AS (
            SELECT conv_id, d, length(text) AS chars,
                   sha256(CAST(list(sha256(role || chr(10) || text)) OVER (PARTITION BY conv_id ORDER BY d) AS VARCHAR)) AS node
            FROM built
            UNION ALL SELECT conv_id, 0, 0, 'root' FROM convs),
        nodes AS (
            SELECT node, min(m.conv_id) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(chars) AS chars,
                   sha256(coalesce(string_agg(CASE WHEN n = d THEN CAST(m.conv_id AS VARCHAR) END, ',' ORDER BY m.conv_id), '')) AS ends_sha256
            FROM members m JOIN lengths USING (conv_id) GROUP BY node),
        parents AS (
            SELECT c.node, p.node AS parent, p.conv_id AS parent_conv_id
            FROM nodes c LEFT JOIN members m ON m.conv_id = c.conv_id AND m.d = c.depth - 1 LEFT JOIN nodes p ON p.node = m.node),
        children AS (SELECT parent AS node, count(*) AS n_children FROM parents WHERE parent IS NOT NULL GROUP BY parent),
        sums AS (
            SELECT a.node, sum(CASE WHEN c.n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved_tokens
            FROM nodes n JOIN members a ON a.conv_id = n.conv_id AND a.d <= n.depth LEFT JOIN children c ON c.node = n.node
            GROUP BY a.node)
        SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children,
               CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
        FROM nodes JOIN sums USING (node) JOIN parents USING (node) LEFT JOIN children USING (node)
    """,
}
