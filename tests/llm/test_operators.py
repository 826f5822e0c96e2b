"""Operators on Spark: whole tables against brute force or SQL, and nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import itertools
import json
import os
import zlib
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, dedup, licenses, media, mixing, packing, quality, sharding, topk, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, salt int, score double, payload string, node long"


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names clash with working names."""
    rows = [(i if ids is None else ids[i], t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, len(t) if t else None, "x", 7, 0.5, "p", -1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


HARD = [None, "", " ", "a", "A", "é\u0000日本", "the quick brown fox jumps over", "the quick brown fox jumps over", "THE quick brown fox jumps over", "word " * 30_000, "|" * 50, "Released under the MIT License."]


def rows_of(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


# ---- 1 ----


def test_topk_with_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [(0, [0.5, 0.5]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (50, [-1.0, -1.0]), (None, [1.0, 1.0]), (100, [0.0, 0.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").select("vec_id", topk.scaled("embedding").alias("v"), F.lit(1).alias("part"), F.lit("x").alias("block"))
    got = rows_of(topk.top_k(df, df.where("vec_id % 50 = 0"), 3, part_rows=2, block_rows=1).orderBy("query_id", "rank"), "query_id", "rank", "vec_id", "score")
    assert got == [
        (0, 1, 1, 32768), (0, 2, 2, 32768), (0, 3, 100, 0), (50, 1, 100, 0), (50, 2, 0, -65536), (50, 3, 1, -65536), (100, 1, 0, 0), (100, 2, 1, 0), (100, 3, 2, 0),
    ]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_topk_goes_from_long_to_short_and_leaves_cells_out(spark):
    """Lengths spread over three powers of ten: most queries are done after the longest classes."""
    r = np.random.default_rng(8)
    v = np.floor(r.normal(size=(1500, 6)) * (10.0 ** r.uniform(0, 3, 1500))[:, None]).astype(np.int64)
    v[3] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<bigint>").repartition(4)
    cells = []
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), 5, part_rows=40, block_rows=16, cells=cells).collect()
    products = v[::50] @ v.T
    for q, row in enumerate(products):
        want = sorted(((-int(s), i) for i, s in enumerate(row) if i != 50 * q))[:5]
        assert [(r_.vec_id, r_.score) for r_ in sorted((x for x in got if x.query_id == 50 * q), key=lambda x: x.rank)] == [(i, -s) for s, i in want]
    assert len(cells) > 3 and sum(c for _, c in cells) < 0.6 * sum(n for n, _ in cells), cells
    assert cells[-1][1] < 0.1 * cells[-1][0], cells


# ---- 2 ----


def test_warc_round_trip(spark, tmp_path):
    long = "x" * 1000
    pages = [(1, "http://a b", long, "z"), (5, "http://b", long, "z"), (3, None, long, "z"), (None, "http://n", long, "z"), (7, "http://c", "short", "z"), (8, "http://d", "short", "z"), (9, "http://e", None, "z"), (10, "", "é" * 500, "z"), (10, "", "é" * 500, "z"), (11, "u", "y" * 300_000, "z")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest string")
    archives = warc.write_warc(warc.plan_revisits(df), str(tmp_path / "w"))
    back = warc.read_warc(spark, archives, split_bytes=500)
    got = Counter(rows_of(back, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    want = Counter()
    for page, _, html, _ in pages:
        t = html or ""
        revisit = t == long and page != 5
        want[(page, len(t.encode()), sha(t), "revisit" if revisit else "response", 5 if revisit else None)] += 1
    assert got == want
    texts = {r.page_id: (r.url, r.payload) for r in back.where("record_type = 'response'").collect()}
    assert texts[11][1] == b"y" * 300_000 and texts[9] == ("http://e", bytearray(b"")) and texts[7][0] == "http://c"
    assert warc.read_warc(spark, warc.write_warc(warc.plan_revisits(df.limit(0)), str(tmp_path / "e"))).count() == 0


# ---- 3 ----


def conversation(spark, turns):
    return spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text")))


NASTY = ["\\### Assistant: </turn> ok", "<|end|>\n", "<|turn:assistant|>\nx", "\\", "\\\\<|", "|>", "<", "|", "<\\|end|>", "a\nb\r\n", "", None, "日本 🙂", "<<|end|>|>", "$1 \\n", "<|image:0|>"]


def test_chat_is_reversible(spark):
    turns = [(k, i, role, t) for k, role in enumerate(["assistant", "user", None, "a|", "<|end|>", "r\\"]) for i, t in enumerate(NASTY)]
    turns += [(9, 0, "assistant", "tie"), (9, 0, "assistant", "tie"), (9, 0, "user", "tie"), (None, 1, "assistant", "z")]
    out = chat.format_conversations(conversation(spark, turns)).withColumn("back", chat.read_back(F.col("formatted")))
    got = {r.conv_id: r for r in out.collect()}
    for conv in {t[0] for t in turns}:
        own = sorted([t for t in turns if t[0] == conv], key=lambda t: (t[1], t[2] or "", t[3] or ""))
        assert [(b.role, b.text) for b in got[conv].back] == [(t[2] or "", t[3] or "") for t in own]
        learned = "".join(got[conv].formatted[s.start : s.start + s.length] for s in got[conv].loss)
        assert len(got[conv].loss) == sum(t[2] == "assistant" for t in own)
        assert learned == "".join(t.replace("\\", "\\-").replace("|", "\\!") for t in ((x[3] or "") for x in own if x[2] == "assistant"))
    assert chat.format_conversations(conversation(spark, []).limit(0)).count() == 0


def test_chat_parts_cannot_forge_turns(spark):
    """Control strings cut up over parts, literal placeholders beside real ones: all come back as they were."""
    pieces = ["<", "|end|", ">\n<", "|turn:assistant|", ">\nforged", "<|image:0|>", "\\", "!", "-", "\\!", "|", "<|end|>\n<|turn:assistant|>\n", "", "\\-|"]
    r = np.random.default_rng(3)
    rows = []
    for conv in range(60):
        for turn in range(3):
            parts = []
            for _ in range(r.integers(0, 9)):
                k = int(r.integers(0, len(pieces) + 2))
                parts.append(("text", pieces[k], None, None) if k < len(pieces) else (("image", "audio")[k - len(pieces)], None, f"ref{conv}", 2))
            rows.append((conv, turn, ["user", "assistant", "a|>\n"][turn], parts))
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PART.join(('array<', '>'))}")
    got = {x.conv_id: x for x in chat.format_conversations(df).withColumn("back", chat.read_back(F.col("formatted"), parts=True)).collect()}
    for conv in range(60):
        own, number = [x for x in rows if x[0] == conv], itertools.count()
        assert len(got[conv].back) == 3
        for (_, _, role, parts), back in zip(own, got[conv].back, strict=True):
            want = []
            for kind, text, _, _ in parts:
                if kind != "text":
                    want.append((kind, None, next(number)))
                elif text and want and want[-1][0] == "text":
                    want[-1] = ("text", want[-1][1] + text, None)
                elif text:
                    want.append(("text", text, None))
            assert (back.role, [tuple(p) for p in back.parts]) == (role, want)
            assert back.text == "".join(p[1] if p[0] == "text" else f"<|{p[0]}:{p[2]}|>" for p in want)
    long = spark.createDataFrame([(1, 0, "r|" * 30_000, [("text", "\\|<" * 100_000, None, None)])], df.schema)
    [back] = chat.format_conversations(long).select(F.explode(chat.read_back(F.col("formatted"), parts=True)).alias("t")).select("t.*").collect()
    assert back.role == "r|" * 30_000 and back.text == "\\|<" * 100_000


def test_chat_parts(spark):
    parts = "array<struct<kind:string,text:string,ref:string,units:bigint>>"
    df = spark.createDataFrame([
        (1, 0, "user", [("text", "see ", None, None), ("image", None, "s3://i", 4), (None, " and ", None, None), ("AUDIO", None, "a.wav", 10)]),
        (1, 1, "assistant", [("text", "two", None, None), ("document", None, "d.pdf", None)]),
        (2, 0, "user", None),
    ], f"conv_id long, turn long, role string, parts {parts}")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert got[1].formatted == "<|turn:user|>\nsee <|image:0|> and <|audio:1|><|end|>\n<|turn:assistant|>\ntwo<|document:2|><|end|>\n"
    assert [(a.number, a.kind, a.ref, a.tokens) for a in got[1].attachments] == [(0, "image", "s3://i", 1024), (1, "audio", "a.wav", 250), (2, "document", "d.pdf", 600)]
    assert got[1].expanded_tokens == 1874 and got[2].formatted == "<|turn:user|>\n<|end|>\n"
    with pytest.raises(Exception, match="unknown content part"):
        chat.format_conversations(spark.createDataFrame([(1, 0, "user", [("video", None, "x", 1)])], df.schema)).collect()


# ---- 4 ----


def check_packing(rows, texts, capacity):
    """Pieces tile their documents, sequences hold them without gaps or overlaps."""
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(packing.default_tokenizer_path())
    want = Counter()
    for doc, t in texts:
        ids = np.array([*encode.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % capacity or capacity
        edges = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(itertools.pairwise(edges)):
            want[(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_of_hard_texts(spark, monkeypatch):
    texts = [*HARD, "same text here " * 40] * 3
    df = docs(spark, texts, [None if i == 4 else i // 2 for i in range(len(texts))])
    monkeypatch.setattr(packing, "PART_ROWS", 3)
    rows = packing.pack_documents(df, capacity=64).collect()
    n = check_packing(rows, [(None if i == 4 else i // 2, t) for i, t in enumerate(texts)], 64)
    assert n <= -(-sum(r.length for r in rows) // 64) + 3
    assert packing.pack_documents(df.limit(0)).count() == 0
    clash = packing.pieces(df.limit(4)).withColumns({c: F.lit(-5) for c in ("salt", "k", "before", "rank", "place", "sequence_id", "parts")})
    assert {(r.salt, r.k, r.before, r["rank"], r.place, r.parts) for r in packing.pack(clash).collect()} == {(-5,) * 6}
    kept = packing.pieces(df.limit(4), keep_ids=True).collect()
    assert all(len(r.ids) == r.length and r.ids[-1] == 2 for r in kept)


def test_op4(spark, sf):
    rows = packing.op4_best_fit_packing(spark, sf).collect()
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    n = check_packing(rows, [(r.doc_id, r.text) for r in table], 1024)
    assert n <= 1.04 * sum(r.length for r in rows) / 1024 + 1


# ---- 5 ----


def numpy_raking(cells, sweeps, keep, targets=None):
    """Weights and targets, one dimension and level after the other."""
    n, dims = np.array([c[-1] for c in cells], float), list(mixing.TEMPERATURE)
    goal = []
    for k, d in enumerate(dims):
        levels = sorted({c[k] for c in cells})
        own = {x: n[[c[k] == x for c in cells]].sum() for x in levels}
        share = {x: own[x] ** mixing.TEMPERATURE[d] if d not in (targets or {}) else targets[d].get(x, 0.0) for x in levels}
        held = set()
        while True:
            free = sum(share[x] for x in levels if x not in held)
            scale = (n.sum() - sum(own[x] / keep for x in held)) / free if free else 0.0
            more = {x for x in levels if x not in held and share[x] * scale >= own[x] / keep}
            if not more:
                break
            held |= more
        goal.append({x: own[x] / keep if x in held else share[x] * scale for x in levels})
    w = n.copy()
    for _ in range(sweeps):
        for k in range(len(dims)):
            for x, t in goal[k].items():
                mine = np.array([c[k] == x for c in cells])
                w[mine] = np.minimum(n[mine] / keep, w[mine] * (t / w[mine].sum())) if w[mine].sum() else 0.0
    return w, goal


CELLS = "__mix_source string, __mix_lang string, __mix_topic string, n long"


@pytest.mark.parametrize("targets", [None, {"lang": {"l0": 0.5, "l1": 0.5}}])
def test_raking_against_numpy(spark, targets):
    r = np.random.default_rng(1)
    cells = [(f"s{a}", f"l{b}", f"t{c}", int(r.integers(1, 5000))) for a in range(6) for b in range(3) for c in range(4) if r.random() < 0.8]
    got = {tuple(x)[:3]: x.w for x in mixing.raked(spark.createDataFrame(cells, CELLS), targets).collect()}
    want, _ = numpy_raking(cells, mixing.SWEEPS, mixing.KEEP, targets)
    assert [got[c[:3]] for c in cells] == pytest.approx(list(want), rel=1e-9)


def test_sample_has_the_target_marginals_where_small_sources_abound(spark):
    """One source of a third of all tokens, many of 4 %, many of 0.1 %: what the sample is expected to have is what is asked for."""
    r = np.random.default_rng(2)
    shares = [34.0] + [4.0] * 16 + [0.1] * 20
    rows = [(None, "w " * int(r.integers(40, 900)) + "|" * int(r.choice([0, 0, 200])), "abc"[int(r.integers(0, 3))], f"s{i}") for i, share in enumerate(shares) for _ in range(int(share * 30))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.marginals(df).collect()
    total = sum(x.tokens for x in got if x.dimension == "lang")
    for d in mixing.TEMPERATURE:
        own = [x for x in got if x.dimension == d]
        assert sum(x.target for x in own) == pytest.approx(mixing.KEEP * total) and all(x.target <= x.tokens * (1 + 1e-9) for x in own)
        assert all(abs(x.expected - x.target) <= 0.03 * x.target for x in own)
    drawn = mixing.calibrated(df).agg(F.max("__mix_probability"), F.sum(F.col("__mix_probability") * F.col("__mix_tokens"))).first()
    assert drawn[0] <= 1 and drawn[1] == pytest.approx(mixing.KEEP * total, rel=0.01)
    small = [x for x in got if x.level == "s30"]
    assert small[0].expected > 0.8 * small[0].target


def test_mixing_of_hard_texts(spark):
    df = docs(spark, HARD * 4)
    out = mixing.sample(df)
    assert out.columns == df.columns
    rows = mixing.calibrated(df).collect()
    assert len(rows) == len(HARD) * 4 and all(0 <= r["__mix_probability"] <= 1 for r in rows)
    assert mixing.sample(df.limit(0)).count() == 0
    kept = Counter(rows_of(out, "doc_id", "text"))
    assert all(n == 1 for n in kept.values()) and 0 < sum(kept.values()) <= len(rows)


# ---- 6 ----


def test_op6(spark, sf):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = media.op6_media_columns(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r.doc_id]
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        jpeg = media.encode_jpeg(data)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(jpeg), hashlib.sha256(jpeg).hexdigest()) and r.feature.count(":") == 1


def test_media_of_hard_payloads(spark):
    df = docs(spark, HARD).select("doc_id", F.encode("text", "UTF-8").alias("payload"), "shard", F.lit(1).alias("width"), F.lit("x").alias("media"))
    out = media.media_features(media.encode_media(df))
    rows = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(HARD):
        data = (t or "").encode()
        assert bytes(rows[i].samples) == data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
    assert rows[0].thumb_hash == rows[1].thumb_hash
    assert media.media_features(media.encode_media(df.limit(0))).count() == 0


# ---- 7 ----


def brute_components(texts, k, percent=80):
    """Components by comparing all pairs that share a shingle."""
    sets = {}
    for doc, t in texts:
        words = (t or "").encode().lower().split()
        sets[doc] = frozenset() if not words else frozenset([tuple(words)]) if len(words) < k else frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            inverted[x].append(d)
    for d, s in sets.items():
        shared = Counter(e for x in s for e in inverted[x] if e < d)
        for e, i in shared.items():
            if 100 * i >= percent * (len(s) + len(sets[e]) - i):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def near_copies(n_groups, copies, words, seed):
    """Groups of copies with random edits, from light to heavy, and unrelated texts."""
    r = np.random.default_rng(seed)
    out = []
    for g in range(n_groups):
        base = [f"w{x}" for x in r.integers(0, 400, words)]
        for _ in range(copies):
            t = list(base)
            for _ in range(int(r.integers(0, words // 12))):
                at = int(r.integers(0, len(t)))
                kind = r.integers(0, 3)
                if kind == 0:
                    t[at] = f"z{r.integers(0, 10**6)}"
                elif kind == 1:
                    t.insert(at, f"w{r.integers(0, 400)}")
                elif len(t) > 5:
                    del t[at]
            out.append(" ".join(t))
    return out


@pytest.mark.parametrize("groups,copies,words,seed", [(3, 120, 60, 1), (12, 12, 150, 2), (1, 300, 40, 3)])
def test_components_against_brute_force(spark, groups, copies, words, seed):
    texts = near_copies(groups, copies, words, seed)
    r = np.random.default_rng(seed)
    order = r.permutation(len(texts))
    rows = [(int(i), texts[j].upper() if i % 7 == 0 else texts[j]) for i, j in enumerate(order)]
    rows += [(1000 + i, rows[i % 5][1]) for i in range(40)]  # exact copies
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in dedup.near_duplicates(df, 4).collect()}
    assert got == brute_components(rows, 4)


@pytest.mark.parametrize(("words", "apart"), [("w1346 w2696 w1000 w2928 w2159", 33), ("w809 w2313 w577 w2889 w1327", 31), ("w2641 w1392 w220 w1865 w2762", 31)])
def test_dedup_keeps_links_that_are_estimated_low(spark, words, apart):
    """Four of five words are shared, so the pair is at the threshold; its packed bits differ more than usual."""
    texts = [words.rsplit(" ", 1)[0], words]
    x = np.bitwise_xor(*(dedup.packed(dedup.minima(dedup.sets_of(t, 1))) for t in texts)).view(np.uint64)
    assert sum(bin(int(v | (v >> np.uint64(1))) & 0x5555555555555555).count("1") for v in x) == apart
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in dedup.near_duplicates(df, 1).collect()} == {0}


def test_odds_of_losing_a_link_at_the_threshold():
    fields = dedup.BANDS * dedup.ROWS
    differ = (1 - dedup.PERCENT / 100) * (1 - 0.5**dedup.BITS)
    lost = sum(comb(fields, d) * differ**d * (1 - differ) ** (fields - d) for d in range(fields + 1) if ((1 - d / fields) - 0.25) / 0.75 < dedup.LEAST_ESTIMATE)
    assert lost == pytest.approx(1.6e-8, rel=0.01)
    assert (1 - (dedup.PERCENT / 100) ** dedup.ROWS) ** dedup.BANDS == pytest.approx(3.2e-6, rel=0.01)


def brute_rows(rows, k, percent=80):
    """Per row its component's smallest doc_id, by comparing the sets of all rows; rows without words or id stand alone."""
    sets = []
    for _, t in rows:
        words = (t or "").encode().lower().split()
        sets.append(frozenset() if not words else frozenset([tuple(words)]) if len(words) < k else frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)))
    group = list(range(len(rows)))
    able = [i for i, (d, _) in enumerate(rows) if sets[i] and d is not None]
    for i, j in itertools.combinations(able, 2):
        if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and group[i] != group[j]:
            old, new = group[i], group[j]
            group = [new if g == old else g for g in group]
    smallest = {}
    for g, (d, _) in zip(group, rows, strict=True):
        smallest[g] = d if d is None else min(d, smallest.get(g, d))
    return [(len(s), smallest[g]) for s, g in zip(sets, group, strict=True)], group, sets


def check_one_of_each(rows, out, k):
    """Of every component one row stays, with its smallest id; rows without words stay once an id, those without id always."""
    told, group, sets = brute_rows(rows, k)
    want, places = Counter(), defaultdict(set)
    for (d, t), (_, c), g, s in zip(rows, told, group, sets, strict=True):
        places[(d, t)].add((d, frozenset()) if d is not None and not s else (c, g))
        if d is None:
            want[(None, t)] += 1
    got = Counter(out)
    assert Counter({r: n for r, n in got.items() if r[0] is None}) == want
    met = Counter()
    for (d, t), n in got.items():
        if d is not None:
            [(c, g)] = places[(d, t)]
            assert c == d
            met[(c, g)] += n
    assert met == Counter({p for (d, _), ps in places.items() if d is not None for p in ps})


def test_dedup_of_hard_texts(spark):
    ids = [*range(11), None, *range(100, 110), 3, 104]
    df = docs(spark, [*HARD, *HARD], ids)
    rows = list(zip(ids, [*HARD, *HARD], strict=True))
    got = Counter(rows_of(dedup.near_duplicates(df, 4), "doc_id", "n_shingles", "component_id", "kept"))
    assert got == Counter((d, n, c, d == c) for (d, _), (n, c) in zip(rows, brute_rows(rows, 4)[0], strict=True))
    out = dedup.keep_one(df)
    assert out.columns == df.columns
    check_one_of_each(rows, [tuple(r)[:2] for r in out.collect()], 5)
    assert dedup.near_duplicates(df.limit(0)).count() == 0 and dedup.keep_one(df.limit(0)).count() == 0


def test_dedup_of_ids_with_several_texts(spark):
    long = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"u{i}" for i in range(40))
    rows = [(1, long), (5, f"{long} tail"), (5, other), (5, other), (7, None), (7, ""), (7, long), (2, other.upper()), (None, long), (9, f"{other} x"), (1, "alone here"), (3, "alone here")]
    rows += [(20 + i % 3, text) for i, text in enumerate(near_copies(3, 8, 40, 5))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, k0 int")
    got = Counter(rows_of(dedup.near_duplicates(df, 5), "doc_id", "n_shingles", "component_id", "kept"))
    assert got == Counter((d, n, c, d == c) for (d, _), (n, c) in zip(rows, brute_rows(rows, 5)[0], strict=True))
    out = dedup.keep_one(df)
    assert out.columns == df.columns
    check_one_of_each(rows, [tuple(r)[:2] for r in out.collect()], 5)
    hidden = spark.createDataFrame([(4, None), (4, None), (4, " ")], "doc_id long, text string")
    assert [r.doc_id for r in dedup.keep_one(hidden).collect()] == [4]


def test_dedup_of_one_row_a_thousand_times(spark):
    rows = [(1, "one and the same text of some words")] * 3000 + [(2, "one and the same text of some words"), (3, "another text of some seven words here")]
    out = dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_op7(spark, sf):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in dedup.op7_minhash_dedup(spark, sf).collect()}
    assert got == brute_components(table, 4)


def test_chains_become_one_component(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (300, 200)]
    got = dict(rows_of(dedup.components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert all(got[i] == 0 for i in range(1, 61)) and got[300] == got[200] == 100


# ---- 8 ----


def test_op8(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    from .test_units import brute_findings

    scanner = licenses.Scanner()
    for r in licenses.op8_license_scans(spark, sf).collect():
        words = licenses.words_of(texts[r.doc_id])
        places = [(i, label) for p, label in licenses.PHRASES.items() for q in [licenses.words_of(p)] for i in range(len(words)) if words[i : i + len(q)] == q]
        assert (r.n_words, r.n_base) == (len(words), len(places)) and r.base_labels == ",".join(sorted({x for _, x in places}))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        labels, coverage = brute_findings(scanner, texts[r.doc_id])
        assert r.labels == ",".join(sorted(labels | {x for _, x in places})) and r.score == pytest.approx(1.0 if places else coverage)


def test_licences_of_hard_texts(spark):
    rows = {r.doc_id: r for r in licenses.license_scan(docs(spark, HARD)).collect()}
    assert len(rows) == len(HARD) and rows[0].n_words == 0 and rows[9].n_words == 30_000 and rows[11].labels == ["mit"] and rows[11].spans[0].start == 0
    assert licenses.license_scan(docs(spark, HARD).limit(0)).count() == 0


# ---- 9 ----


def test_op9_holds_out_and_is_accurate(spark):
    path = "/root/testdata/sf0.01"
    rows = quality.op9_quality_classifier(spark, path).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 80 and np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.96


def test_quality_of_hard_texts(spark):
    df = docs(spark, HARD)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (2, None), (3, 5), (77, 1)], "doc_id long, quality int")
    out = quality.score(df, quality.train(df, labels))
    assert out.count() == len(HARD) and out.where("score is null or score < 0 or score > 1").count() == 0
    none = quality.score(df.drop("score"), quality.train(df, labels.limit(0)))
    assert {r.score for r in none.collect()} == {0.5}
    assert quality.keep_good(df, labels).columns == df.columns and quality.keep_good(df.limit(0), labels).count() == 0


# ---- 10 ----


def check_shards(rows, n, total):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert all(0 <= s < n for s in by)
    most = max((r.size for r in rows), default=0)
    sizes = [sum(r.size for r in by.get(s, [])) for s in range(n)]
    assert sum(sizes) == total and max(sizes) - min(sizes) <= 2 * max(2 * most, 0.02 * total / n)


def test_op10(spark, sf):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sharding.op10_sharding(spark, sf).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(texts))
    assert all(r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.law == "bytes" and r.grown_shard is None for r in rows)
    check_shards(rows, 16, sum(len(t) + 1 for t in texts.values()))


def test_sharding_of_hard_and_hot_texts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MIN_RANGES", 4)
    monkeypatch.setattr(sharding, "ROWS_PER_RANGE", 8)
    texts = [t[:500] if t else t for t in HARD] * 5 + ["hot"] * 300
    ids = [None if i % 11 == 0 else i % 100 for i in range(len(texts))]
    rows = sharding.shard(docs(spark, texts, ids), 7).collect()
    assert Counter((r.id, r.crc) for r in rows) == Counter((i, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts, strict=True))
    check_shards(rows, 7, sum(len((t or "").encode()) + 1 for t in texts))
    assert sharding.shard(docs(spark, texts).limit(0), 7).count() == 0
    one = sharding.shard(docs(spark, ["a"]), 3).collect()
    assert [(r.shard, r.slot) for r in one] in ([(0, 0)], [(1, 0)], [(2, 0)])


def test_equal_texts_lie_together(spark):
    texts = [f"text {i // 3}" * 20 for i in range(3000)]
    rows = sharding.shard(docs(spark, texts), 4).collect()
    shards = defaultdict(set)
    for r in rows:
        shards[r.crc].add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) == 0


# ---- SQL and the pipeline ----


@pytest.mark.parametrize("name", ["op1_exact_topk", "op2_warc", "op3_chat_formatting", "op5_source_mixing", "op7_minhash_dedup"])
def test_query_equals_its_sql(spark, sf, duck, name):
    from tidemark.llm import queries

    got = queries.queries()[name](spark, sf)
    want = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    norm = lambda v: "None" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    assert sorted(tuple(norm(r[c]) for c in names) for r in got.collect()) == sorted(tuple(norm(v) for v in r) for r in want.fetchall())


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = stages["quality classifier"](spark, documents, sf)
    assert good.columns == documents.columns
    good_ids = {r.doc_id for r in good.select("doc_id").collect()}
    held = [d for d in labels if zlib.crc32(str(d).encode()) % 3 == 1]
    assert np.mean([(d in good_ids) == bool(labels[d]) for d in held]) > 0.96
    once = stages["minhash near-dedup"](spark, good, sf)
    want = brute_components([(r.doc_id, r.text) for r in good.collect()], 5)
    assert {r.doc_id for r in once.collect()} == {d for d, (_, c) in want.items() if d == c} and once.columns == documents.columns
    mixed = stages["source mixing"](spark, once, sf)
    assert mixed.columns == documents.columns and 0.4 < mixed.count() / once.count() <= 1
    packed = stages["best-fit packing"](spark, mixed, sf).collect()
    check_packing(packed, [(r.doc_id, r.text) for r in mixed.collect()], 1024)
    whole = corpus_pipeline.run(spark, sf)
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in whole.collect()) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_labels_are_the_only_thing_learned_from(spark):
    """Scores do not depend on language, source or id."""
    df = docs(spark, ["some text here", "some text here"])
    other = df.withColumns({"lang": F.lit("zz"), "source": F.lit("q"), "doc_id": F.col("doc_id") + 1000})
    forest = quality.fit(np.random.default_rng(0).normal(size=(100, len(quality.FEATURES))), np.arange(100) % 2.0)
    a, b = (sorted(r.score for r in quality.score(x.drop("score"), forest).collect()) for x in (df, other))
    assert a == b


def test_scratch_is_the_shared_folder(spark):
    from types import SimpleNamespace

    from tidemark.llm.common import own_dir

    root = spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints"
    assert own_dir(spark) == f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"
    named = {"spark.checkpoint.dir": "hdfs://store/shared/"}
    cluster = lambda held: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: held.get(key, default)), sparkContext=SimpleNamespace(master="spark://x", applicationId="app"))
    assert own_dir(cluster(named)) == "hdfs://store/shared/app"
    with pytest.raises(ValueError, match="checkpoint"):  # executors would not see each other's files
        own_dir(cluster({}))


def test_sharding_places_every_row_where_a_plain_pass_does(spark, duck, sf):
    """All rows in the order of text hash and id; borders at equal bytes, or at the edge of a small group of equal texts."""
    import xxhash

    rows = [(i, t) for i, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()]
    hashed = lambda t: -(2**63) if t is None else (h - 2**64 if (h := xxhash.xxh64_intdigest((t or "").encode(), seed=42)) >= 2**63 else h)
    order = sorted((hashed(t), i, len((t or "").encode()) + 1) for i, t in rows)
    total, at, starts, groups = sum(s for _, _, s in order), 0, [], {}
    for h, i, size in order:
        starts.append((at, h, i, size))
        lo, hi, most = groups.get(h, (at, at, 0))
        groups[h] = (lo, at + size, max(most, size))
        at += size
    borders = []
    for x in (total * j // 16 for j in range(1, 16)):
        h = next(h for a, h, _, size in starts if a <= x < a + size)
        lo, hi, most = groups[h]
        if lo < x < hi and hi - lo <= max(sharding.SNAP * total / 16, most):
            x = lo if x - lo <= hi - x else hi
        borders.append(x)
    seen, want = Counter(), {}
    for a, _, i, _size in starts:
        shard = sum(b <= a for b in borders)
        want[i] = (shard, seen[shard])
        seen[shard] += 1
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.op10_sharding(spark, sf).collect()} == want
