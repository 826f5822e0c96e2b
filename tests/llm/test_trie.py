"""The trie of conversations against SQL and against a plain recursion over odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tidemark.llm import trie

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """Rows (conv_id, turn, role, text) to the nodes, by recursion over tuples of turns."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            turns[conv].append(((turn is not None, turn or 0), tie, (role, text)))
    turns = {c: [t for _, _, t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(turns.get(c - c % 100, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(list)
    for seq in members:
        if seq:
            children[seq[:-1]].append(seq)
    out = []
    for seq, convs in members.items():
        below, leaves, saved = [seq], 0, 0
        while below:
            at = below.pop()
            leaves += not children[at]
            saved += (len(members[at]) - 1) * len(at[-1][1]) if at else 0
            below += children[at]
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(seq))
        out.append((min(convs), len(seq), min(members[seq[:-1]]) if seq else None, len(convs), len(children[seq]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def got(df):
    return Counter(tuple(r[n] for n in NAMES) for r in trie.conversation_trie(df).collect())


def test_tables_equal_sql(spark, duck, sf):
    rel = duck.execute(trie.ORACLE_SQL["op12_conversation_trie"])
    at = [d[0] for d in rel.description]
    want = Counter(tuple(row[at.index(n)] for n in NAMES) for row in rel.fetchall())
    assert Counter(tuple(r[n] for n in NAMES) for r in trie.op12_conversation_trie(spark, sf).collect()) == want


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "lost"), (0, 1, "user", "b"), (0, None, "user", "first"), (0, 1, "user", "a"), (0, 1, "user", "a"), (0, 5, None, None),
        (1, 0, "user", "x"), (201, 0, "user", "alone"), (202, 0, "user", "alone"), (203, 0, None, "alone"), (7, 0, "user", "é日本" * 50_000),
        *[(c, t, "user" if t % 2 == 0 else "assistant", f"copy {t}") for c in range(300, 340) for t in range(8)],
        *[(450, t, "user", f"long {t}") for t in range(700)], *[(451, t, "user", f"long {t}") for t in range(690)],
    ]
    df = spark.createDataFrame([(*r, "extra", 3) for r in rows], "conv_id long, turn long, role string, text string, a string, depth int")
    assert got(df) == plain(rows)
    assert trie.conversation_trie(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_random_tries_with_hot_nodes_and_slices(spark, monkeypatch, seed):
    monkeypatch.setattr(trie, "HOT_SHARE", 0.05)
    monkeypatch.setattr(trie, "SLICE_BYTES", 7)
    pick = random.Random(seed)
    rows = [(c, t, pick.choice(["user", "assistant"]), pick.choice(["yes", "no", "maybe", None])) for c in pick.sample(range(1200), 260) for t in range(pick.randrange(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    assert got(df) == plain(rows)
