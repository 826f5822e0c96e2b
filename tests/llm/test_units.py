"""The parts that work within a task, against brute force, without Spark."""

import hashlib
import itertools
import os
import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import dedup, licenses, media, packing, quality, topk, warc


# ---- packing ----


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 30), max_size=25))
def test_plan_uses_every_piece_once(counts):
    used, total = {}, 0
    for pattern, times in packing.plan(counts, 40):
        assert sum(pattern) <= 40 and times > 0
        for x in pattern:
            used[x] = used.get(x, 0) + times
        total += times
    assert used == {k: v for k, v in counts.items() if v}
    volume = sum(k * v for k, v in counts.items())
    assert total >= -(-volume // 40) and total <= max(1, 2 * volume // 40 + 1)  # best fit leaves at most one sequence half empty


def test_plan_finds_exact_complements():
    assert sum(t for _, t in packing.plan({700: 2, 324: 2}, 1024)) == 2
    assert sum(t for _, t in packing.plan({600: 3, 224: 3, 200: 3}, 1024)) == 3
    assert sum(t for _, t in packing.plan({500: 1, 300: 1, 124: 1, 100: 1}, 1024)) == 1
    assert sum(t for _, t in packing.plan({512: 7}, 1024)) == 4
    assert packing.plan({}, 1024) == []


def file_ids(text):
    """Ids by the library and the unaltered file."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer_path()).encode(text, add_special_tokens=False).ids


def own_ids(*texts):
    return list(packing.encoder(packing.default_tokenizer_path())(list(texts)))


TEXTS = ["", "a", "Hello world!! it's   fine\n\n\tx", "naïve café — “quotes” €5", "日本語 text ﷺ 🙂🙂", "x" * 3000, "<|endoftext|> it", "\x00\x1c\x85 a", "ǅ ǆ ŉ ͅ", " \n  \n", "don't 'LL 'll 12ab_3 __ \t\n x"]
TEXTS += ["a <|endoftext|> b", "<|endoftext|>", "x\n<|endoftext|><|endoftext|>", "é 日本 <|endoftext|>", "<|endoftext| > it", "plain"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_those_of_the_unaltered_file(text):
    assert own_ids(text) == [file_ids(text)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=80), st.text(alphabet="ab'slt 1_\n\té\u00a0", max_size=80)), max_size=3))
def test_ids_of_any_texts(texts):
    assert own_ids(*texts) == [file_ids(t) for t in texts]


def test_ids_when_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    monkeypatch.setattr(packing, "GROUP_CHARS", 10)
    texts = [f"word{i} and word{i % 3} again" for i in range(40)] + TEXTS
    encode = packing.Encoder(packing.default_tokenizer_path())
    assert list(encode(texts)) == [file_ids(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="'stremvld 1!\n\t\u00a0\u00e9\u00b2\u2013\u20acA", max_size=40), max_size=6))
def test_ids_of_texts_looked_at_together(texts):
    assert own_ids(*texts) == [file_ids(t) for t in texts]


def test_a_word_is_looked_up_once_for_many_places():
    encode, looked_up = packing.Encoder(packing.default_tokenizer_path()), []

    class Counted(type(encode.known)):
        def __getitem__(self, word):
            looked_up.append(word)
            return super().__getitem__(word)

    encode.known.__class__ = Counted
    texts = [" ".join(f"word{i % 5}" for i in range(3000)), "it's word1, it's word2 " * 500]
    assert list(encode(texts)) == [file_ids(t) for t in texts]
    assert 0 < len(looked_up) < 40


def test_long_words_are_not_kept():
    encode = packing.Encoder(packing.default_tokenizer_path())
    assert list(encode(["x" * 3000 + " short"])) == [file_ids("x" * 3000 + " short")]
    assert list(encode.known) == [" short"]


def test_added_tokens_are_found_in_texts():
    assert own_ids("a <|endoftext|> b") == [[64, 220, 50256, 275]]


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 14), st.integers(1, 2), max_size=8), st.integers(2, 30), st.integers(1, 14))
def test_sums_against_brute_force(counts, total, own):
    """A pair or triple is found if, and only if, the counts allow one beside a piece of length ``own``."""
    bag = sorted(x for x, n in counts.items() for _ in range(n - (x == own)))
    for size, find in ((2, "pairs_of"), (3, "triples_of")):
        want = {c for c in itertools.combinations(bag, size) if sum(c) == total}
        got = getattr(packing.SumIndex(dict(counts)), find)(total, own)
        assert (got is None and not want) or tuple(sorted(got)) in want


# ---- media ----


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000, 64 * media.MAX_ROWS, 64 * media.MAX_ROWS + 1])
def test_jpeg_keeps_every_byte(n):
    data = os.urandom(n)
    [(width, height, samples, feature)] = media.read_images([media.encode_jpeg(data)])
    assert samples == data + bytes(max(64, -(-n // 64) * 64) - n) and len(feature) == 16
    assert width == 512 and height == len(samples) // 64 * 8


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400))
def test_jpeg_round_trip(data):
    [(_, _, samples, _)] = media.read_images([media.encode_jpeg(data)])
    assert samples[: len(data)] == data and not any(samples[len(data) :])


def test_broken_images_are_null_and_spare_others():
    good = media.encode_jpeg(b"abc" * 50)
    cut = good[:-20]
    flipped = good.replace(b"\xff\xc0", b"\xff\xc2")
    out = media.read_images([good, cut, None, b"", b"no image", flipped, good])
    assert out[0] == out[6] and out[0][2].startswith(b"abc")
    assert all(out[k] == (None,) * 4 for k in (2, 3, 4, 5))


def bits_to_bytes(bits):
    bits += "1" * (-len(bits) % 8)
    return b"".join(bytes((b, 0)) if b == 255 else bytes((b,)) for b in (int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)))


def test_jpeg_with_chroma_and_ac(subtests=None):
    """A 4:2:0 image of one scan with AC coefficients and no restart markers, written bit by bit."""
    rnd = random.Random(5)
    dc_counts, dc_values = (0, 2, 3, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10)
    ac_values = (0x00, 0x01, 0x02, 0x11, 0xF0, 0x21)
    ac_counts = (0, 2, 1, 1, 1, 1) + (0,) * 10
    dc, ac = media._codes(dc_counts, dc_values), media._codes(ac_counts, ac_values)

    def code(table, symbol):
        c, n = table[symbol]
        return f"{c:0{n}b}"

    def magnitude(v):
        n = abs(v).bit_length()
        return "" if n == 0 else f"{v if v > 0 else v + (1 << n) - 1:0{n}b}"

    width, height = 40, 24  # 3 x 2 MCUs of 16 x 16
    luma, last, bits = np.zeros((4, 6), int), [0, 0, 0], ""
    for my in range(2):
        for mx in range(3):
            for comp, (dx, dy) in [(0, (0, 0)), (0, (1, 0)), (0, (0, 1)), (0, (1, 1)), (1, (0, 0)), (2, (0, 0))]:
                v = rnd.randint(-100, 100)
                if comp == 0:
                    luma[2 * my + dy, 2 * mx + dx] = v
                d = v - last[comp]
                last[comp] = v
                bits += code(dc, abs(d).bit_length()) + magnitude(d)
                k = 1
                while k < 60 and rnd.random() < 0.6:
                    symbol = rnd.choice([0x01, 0x02, 0x11, 0xF0, 0x21])
                    bits += code(ac, symbol)
                    if symbol & 15:
                        bits += magnitude(rnd.choice([-1, 1]) if symbol & 15 == 1 else rnd.choice([-3, -2, 2, 3]))
                    k += (symbol >> 4) + 1
                if k < 64:
                    bits += code(ac, 0)
    seg = media._segment
    image = (
        b"\xff\xd8" + seg(0xFE, b"comment") + seg(0xDB, b"\0" + b"\x04" + b"\x01" * 63) + seg(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x03\x01\x22\0\x02\x11\0\x03\x11\0")
        + seg(0xC4, b"\0" + bytes(dc_counts) + bytes(dc_values)) + seg(0xC4, b"\x10" + bytes(ac_counts) + bytes(ac_values)) + seg(0xDA, b"\x03\x01\0\x02\0\x03\0\0\x3f\0") + bits_to_bytes(bits) + b"\xff\xd9"
    )
    [(w, h, samples, _)] = media.read_images([image])
    want = np.clip((luma[:3, :5] * 4 + 4) // 8 + 128, 0, 255)
    assert (w, h) == (width, height) and np.array_equal(np.frombuffer(samples, np.uint8).reshape(3, 5), want)


# ---- licences ----


def brute_places(text):
    words = licenses.words_of(text)
    out = []
    for phrase, label in licenses.PHRASES.items():
        p = licenses.words_of(phrase)
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), out


def test_phrase_places_against_brute_force():
    scanner, rnd = licenses.Scanner(), random.Random(2)
    vocabulary = [w.decode() for w in scanner.vocabulary] + ["zzz", "é"]
    hot = ["cc", "by", "nc", "under", "the", "mit", "license", "apache", "version", "2"] * 12
    for _ in range(1500):
        text = rnd.choice([" ", ", ", "-"]).join(rnd.choice(vocabulary + hot) for _ in range(rnd.randint(0, 30))) + rnd.choice(["", " CC-BY-NC", ". Under the MIT License!", " apache license, version 2.0"])
        n, places = brute_places(text)
        got = scanner.scan(text)
        assert (got["n_words"], got["n_base"]) == (n, len(places))
        assert got["base_labels"] == sorted({label for _, label in places}) and set(got["base_labels"]) <= set(got["labels"])
        assert (got["first_word"], got["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))


def test_matching_statistics_against_brute_force():
    rnd = random.Random(4)
    for _ in range(60):
        seqs = [[rnd.randint(0, 3) for _ in range(rnd.randint(1, 12))] for _ in range(rnd.randint(1, 4))]
        a = licenses.SuffixAutomaton(seqs)
        factors = {tuple(s[i:j]): None for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        assert sum(a.length[v] - a.length[a.link[v]] for v in range(1, len(a.next))) == len(factors)
        for f in factors:
            state = a.walk(list(f))
            where = {k: [i + len(f) - 1 for i in range(len(s)) if tuple(s[i : i + len(f)]) == f] for k, s in enumerate(seqs)}
            assert a.ends[state] == {k: v for k, v in where.items() if v}


def plain(notice):
    return notice.replace("{", "").replace("}", "")


def test_notices_are_found_whole_and_broken():
    scanner = licenses.Scanner(phrases={"no such phrase here": "none"})
    for label, texts in licenses.NOTICES.items():
        for text in texts:
            assert scanner.scan(f"code here\n{plain(text)}\nmore")["labels"] == [label]
    words = plain(licenses.NOTICES["bsd-3-clause"][0]).split()
    words[30:30] = ["changed", "words"]
    got = scanner.scan(" ".join(words))
    assert got["labels"] == ["bsd-3-clause"] and 0.8 < got["score"] < 1.01 and len(got["spans"]) == 1
    assert scanner.scan("the of and software in any way")["labels"] == [] and scanner.scan(None)["n_words"] == 0


GNU = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."


@pytest.mark.parametrize(("text", "labels"), [
    (GNU.format("", 2), ["gpl-2"]), (GNU.format("", 3), ["gpl-3"]), (GNU.format("", 4), []), (GNU.format("Lesser ", 3), ["lgpl-3"]), (GNU.format("Lesser ", "2.1"), ["lgpl-2.1"]),
    (GNU.format("Affero ", 3), ["agpl-3"]), (GNU.format("Other ", 3), []), ("Licensed under the Apache License, Version 1.1", ["apache-1.1"]), ("Licensed under the Apache License, Version 2.0", ["apache-2"]),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", ["cc-by-nd"]), ("Licensed under CC BY-ND 4.0", ["cc-by-nd"]), ("Licensed under CC BY 4.0", ["cc-by"]),
    ("SPDX-License-Identifier: GPL-3.0-or-later", ["gpl-3"]), (plain(licenses.NOTICES["bsd-2-clause"][0]), ["bsd-2-clause"]), (plain(licenses.NOTICES["bsd-3-clause"][0]), ["bsd-3-clause"]),
    (GNU.format("", 2) + " Elsewhere: " + GNU.format("Affero ", 3), ["agpl-3", "gpl-2"]), (plain(licenses.NOTICES["isc"][0]) + plain(licenses.NOTICES["mit"][0]), ["isc", "mit"]),
])
def test_licences_that_resemble_each_other(text, labels):
    assert licenses.Scanner().scan(f"some words {text} and others")["labels"] == labels


def brute_findings(scanner, text):
    """Labels and best coverage by comparing word lists at every place, and chains by looking at all links before."""
    words, least = licenses.words_of(text), licenses.MIN_MATCH
    notices = [(label, *licenses.marked(t)) for label, ts in licenses.NOTICES.items() for t in ts] + [(None, licenses.words_of(p), []) for p in licenses.PHRASES]
    grams = {tuple(ws[i : i + least]) for _, ws, _ in notices for i in range(len(ws) - least + 1)}

    def places(piece):
        return {k: found for k, (_, ws, _) in enumerate(notices) if (found := [i for i in range(len(ws) - len(piece) + 1) if ws[i : i + len(piece)] == piece])}

    matches, longest = [], [0] * (len(words) + 1)
    for end in range(1, len(words) + 1):
        size = longest[end - 1] + 1
        if size >= least and tuple(words[end - least : end]) not in grams:
            size = least - 1
        while size and not places(words[end - size : end]):
            size -= 1
        longest[end] = size
    for end in range(1, len(words) + 1):
        if longest[end] >= least and (end == len(words) or longest[end + 1] <= longest[end]):
            matches.append((end - longest[end], longest[end]))
    spans = []

    def chain(number, group):
        label, ws, passages = notices[number]
        links, text_end = [], -1
        for first, size in group:
            skip = max(0, text_end - first)
            if skip >= size:
                continue
            text_end, made = first + size, []
            for at in places(words[first : first + size])[number]:
                at += skip
                before = max((x for x in links if x[2] + x[3] <= at), key=lambda x: x[0], default=None)
                made.append((size - skip + (before[0] if before else 0), first + skip, at, size - skip, before))
            links += made
        if not links:
            return
        top = max(links, key=lambda x: x[0])
        whole, k = [], top
        while k:
            whole.append(k)
            k = k[4]
        span = {"label": label, "start": whole[-1][1], "end": whole[0][1] + whole[0][3], "words": top[0], "coverage": min(1.0, top[0] / len(ws))}
        span["marked"] = all(any(x[2] <= lo and hi <= x[2] + x[3] for x in whole) for lo, hi in passages)
        spans.append(span)
        if span["coverage"] >= licenses.MIN_COVER:
            for rest in ([m for m in group if m[0] + m[1] <= span["start"]], [m for m in group if m[0] >= span["end"]]):
                if rest:
                    chain(number, rest)

    for number in range(len(notices) - len(licenses.PHRASES)):
        group = []
        for m in matches:
            if number in places(words[m[0] : m[0] + m[1]]):
                if group and m[0] - sum(group[-1]) > licenses.MAX_GAP:
                    chain(number, group)
                    group = []
                group.append(m)
        if group:
            chain(number, group)
    won = []
    for f in sorted((s for s in spans if s["coverage"] >= licenses.MIN_COVER and s["marked"]), key=lambda s: (-s["words"], -s["coverage"], s["start"], s["label"])):
        if all(f["end"] <= o["start"] or o["end"] <= f["start"] for o in won):
            won.append(f)
    return {f["label"] for f in won}, max((s["coverage"] for s in spans), default=0.0)


def test_findings_against_brute_force():
    scanner, rnd = licenses.Scanner(), random.Random(9)
    texts = [plain(t) for ts in licenses.NOTICES.values() for t in ts]
    for _ in range(150):
        words = []
        for _ in range(rnd.randint(1, 3)):
            own = rnd.choice(texts).split()
            for _ in range(rnd.randint(0, 3)):
                at = rnd.randrange(len(own) + 1)
                own[at : at + rnd.randint(0, 3)] = rnd.choice([[], ["zzz"], ["the", "software"], own[:6]])
            words += own + ["filler"] * rnd.choice([0, 1, 60])
        text = " ".join(words)
        got, (labels, coverage) = scanner.scan(text), brute_findings(scanner, text)
        assert set(got["labels"]) == labels | set(got["base_labels"])
        assert got["score"] == (1.0 if got["base_labels"] else pytest.approx(coverage))


# ---- WARC ----


def archive(tmp_path, payloads):
    path = tmp_path / "a.warc.gz"
    members = [warc._record(i, f"https://e.com/ {i}\r\n", p, hashlib.sha1(p).hexdigest(), "response", None) for i, p in enumerate(payloads)]
    path.write_bytes(b"".join(members))
    return str(path), [len(m) for m in members]


@pytest.mark.parametrize("split", [7, 64, 1000, 10**6])
def test_ranges_own_each_record_once(tmp_path, split):
    rnd = random.Random(1)
    payloads = [rnd.randbytes(rnd.randint(0, 900)) for _ in range(25)] + [b"", warc._MAGIC * 200, b"WARC/1.1\r\n" + warc._MAGIC, zlib.compress(b"WARC/1.1", wbits=31)]
    path, sizes = archive(tmp_path, payloads)
    got = [r for s in range(0, sum(sizes), split) for r in warc.scan_range(path, s, min(s + split, sum(sizes)))]
    rows = sorted(warc._row(r) for r in got)
    assert [r[0] for r in rows] == list(range(len(payloads))) and [r[6] for r in rows] == payloads
    assert rows[0][1] == "https://e.com/ 0\r\n"


def test_truncated_archive_gives_whole_records(tmp_path):
    path, sizes = archive(tmp_path, [b"a" * 100, b"b" * 100])
    with open(path, "r+b") as f:
        f.truncate(sum(sizes) - 5)
    assert len(list(warc.scan_range(path, 0, sum(sizes)))) == 1


def test_python_gzip_reads_the_archive(tmp_path):
    import gzip

    path, _ = archive(tmp_path, [b"a" * 100, b"b"])
    assert gzip.open(path).read().count(b"WARC/1.1\r\n") == 2


# ---- quality ----


def test_boosting_learns_and_traverses():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, len(quality.FEATURES)))
    y = ((x[:, 3] > 0.2) ^ (x[:, 7] > -0.1)).astype(float)
    forest = quality.fit(x[:2000], y[:2000])
    assert ((forest.scores(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.97
    one = quality.fit(x[:50], np.ones(50))
    assert (one.scores(x) > 0.99).all()
    assert (quality.fit(x[:0], y[:0]).scores(x[:5]) == 0.5).all()


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_statistics_are_finite(text):
    s = quality.statistics(text)
    assert len(s) == len(quality.FEATURES) and np.isfinite(s).all()


# ---- near-duplicates ----


def brute_set(text, k):
    words = text.encode().lower().split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < k else frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aAbB é \t\n\x0b\x1c", max_size=60), st.integers(1, 5))
def test_shingles_against_brute_force(text, k):
    assert len(dedup.sets_of(text, k)) == len(brute_set(text, k))


def test_parities_differ_in_no_more_bits_than_shingles():
    r = np.random.default_rng(4)
    for n in (0, 1, 50, 3000):
        for share in (0.0, 0.5, 0.95, 1.0):
            base, cut = r.integers(0, 2**63, 2 * n, np.uint64), int(n * share)
            a, b = np.unique(base[:n]), np.unique(np.concatenate([base[:cut], base[n : 2 * n - cut]]))
            bits = sum(int(x).bit_count() for x in (dedup.parity(a) ^ dedup.parity(b)).view(np.uint64))
            assert len(dedup.parity(a)) * 64 == dedup.PARITY and bits <= len(np.setxor1d(a, b)) and (n > 50 or bits >= 0.8 * len(np.setxor1d(a, b)))


def test_estimate_follows_similarity():
    r = np.random.default_rng(3)
    for share in (0.9, 0.8, 0.5, 0.1):
        found = []
        for _ in range(60):
            base = r.integers(0, 2**63, 400, np.uint64)
            cut = int(400 * share)
            a, b = np.unique(np.concatenate([base[:cut], r.integers(0, 2**63, (400 - cut) // 2, np.uint64)])), np.unique(np.concatenate([base[:cut], r.integers(0, 2**63, (400 - cut) // 2, np.uint64)]))
            x = (dedup.packed(dedup.minima(a)) ^ dedup.packed(dedup.minima(b))).view(np.uint64)
            apart = sum(bin(int(v | (v >> 1)) & 0x5555555555555555).count("1") for v in x.tolist())
            found.append(((1 - apart / 96) - 0.25) / 0.75)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(np.mean(found) - true) < 0.03


# ---- top-k ----


@pytest.mark.parametrize("kind", ["unit", "norms", "ties", "negative", "wide", "tiny"])
def test_search_against_brute_force(kind):
    r = np.random.default_rng(7)
    n, d = (4000, 16) if kind not in ("wide", "tiny") else (300, 5) if kind == "wide" else (4, 3)
    x = r.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "norms":
        x *= r.lognormal(0, 1.5, n)[:, None]
    v = np.floor(256 * x).astype(np.int64)
    if kind == "ties":
        v[r.random(n) < 0.4] = v[0]
        v[5::37] = v[1]
    if kind == "negative":
        v = -np.abs(v)
        v[::2] *= -1
    if kind == "wide":
        v = r.integers(-(2**30), 2**30, (n, d))
    ids = r.permutation(n * 3)[:n].astype(np.int64)
    q = np.flatnonzero(ids % 10 == 0)
    got = {}
    for a, b, s in zip(*topk.search(ids[q], v[q], ids, v, 5), strict=True):
        got.setdefault(int(a), []).append((-int(s), int(b)))
    full = v.astype(object) @ v[q].T.astype(object) if kind == "wide" else v @ v[q].T
    limit = np.iinfo(np.int64)
    for k, i in enumerate(q):
        want = sorted((-min(limit.max, max(limit.min, int(full[j, k]))), int(ids[j])) for j in range(n) if j != i)[:5]
        assert sorted(got.get(int(ids[i]), [])) == want, kind


# ---- 8: neighbours and many notices ----


def _plain(notice):
    return notice.replace("{", "").replace("}", "")


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("SPDX-License-Identifier: MIT", ["mit"]), ("SPDX-License-Identifier: MIT-0", ["mit-0"]), ("SPDX-License-Identifier: MIT-Modern-Variant", []),
        ("SPDX-License-Identifier: BSD-3-Clause-Clear", ["bsd-3-clause-clear"]), ("SPDX-License-Identifier: BSD-3-Clause-Attribution", []),
        ("SPDX-License-Identifier: GPL-2.0-or-later", ["gpl-2"]), ("SPDX-License-Identifier: GPL-2.0-only", ["gpl-2"]), ("SPDX-License-Identifier: MIT\n0 items", ["mit"]),
        *((_plain(licenses.NOTICES[k][0]), [k]) for k in licenses.NOTICES),
    ],
)
def test_neighbouring_licenses_are_told_apart(text, labels):
    assert licenses.default_scanner().scan(text)["labels"] == labels


def test_many_notices_take_time_in_proportion():
    scanner = licenses.default_scanner()
    apache = _plain(licenses.NOTICES["apache-2"][0]).split()
    for one, n in (("SPDX-License-Identifier: MIT\n", 4000), (_plain(licenses.NOTICES["mit"][0]) + " ", 400), (" ".join(apache[: len(apache) * 4 // 5]) + " x y z ", 400)):
        began = time.perf_counter()
        found = scanner.scan(one * n)
        assert len(found["spans"]) == n
        assert time.perf_counter() - began < 3
    # Some other text between and around them changes nothing.
    mixed = "".join(f"part {i} of it. SPDX-License-Identifier: MIT\n" + "word " * (i % 60) for i in range(300))
    assert [s["label"] for s in scanner.scan(mixed)["spans"]] == ["mit"] * 300


# ---- 2: archives of others ----


def _foreign(kind, block, compress=6, **headers):
    import gzip

    lines = [f"WARC-Type: {kind}", *(f"{k.replace('_', '-')}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    record = b"WARC/1.0\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(record, compress) if compress is not None else record


def test_archives_of_others_are_read(tmp_path):
    import gzip

    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hello</p>"
    sha = hashlib.sha1(b"<p>hello</p>").hexdigest()
    http = {"Content_Type": "application/http; msgtype=response"}
    members = [
        _foreign("warcinfo", b"x"),
        _foreign("response", page, 9, WARC_Record_ID="<urn:uuid:1>", WARC_Target_URI="<http://a/b%20c>", WARC_Payload_Digest="sha1:AAAA", **http),
        _foreign("response", page, 1, WARC_Record_ID="<urn:uuid:2>", WARC_Target_URI="http://a/\r\n\tlong", **http),
        _foreign("response", page, 0, WARC_Record_ID="<urn:uuid:3>", WARC_Target_URI="u", WARC_Payload_Digest="md5:0123", **http),
        _foreign("revisit", b"HTTP/1.1 200 OK", WARC_Record_ID="<urn:uuid:4>", WARC_Target_URI="u", WARC_Refers_To="<urn:uuid:1>", WARC_Payload_Digest=f"sha1:{sha}", **http),
        _foreign("response", b"plain", WARC_Target_URI="u", Content_Type="text/plain"),
        _foreign("metadata", b"y"),
        gzip.compress(_foreign("response", page, None, WARC_Record_ID="<urn:uuid:6>", **http) + _foreign("response", b"two", None, WARC_Record_ID="<urn:uuid:7>", Content_Type="text/plain")),
    ]
    path = tmp_path / "foreign.warc.gz"
    path.write_bytes(b"".join(members))
    size = path.stat().st_size
    for step in (size, 97, 40):
        rows = [r for lo in range(0, size, step) for x in warc.scan_range(str(path), lo, min(size, lo + step)) if (r := warc._row(x))]
        assert [r[:8] for r in rows] == [
            (None, "http://a/b c", "response", 12, sha, None, "<urn:uuid:1>", None), (None, "http://a/ long", "response", 12, sha, None, "<urn:uuid:2>", None),
            (None, "u", "response", 12, sha, None, "<urn:uuid:3>", None), (None, "u", "revisit", None, sha, None, "<urn:uuid:4>", sha),
            (None, "u", "response", 5, hashlib.sha1(b"plain").hexdigest(), None, None, None),
            (None, "", "response", 12, sha, None, "<urn:uuid:6>", None), (None, "", "response", 3, hashlib.sha1(b"two").hexdigest(), None, "<urn:uuid:7>", None),
        ]


def test_a_payload_of_ones_own_must_match_its_digest():
    record = {"headers": {"warc-type": "response", "warc-record-id": "<urn:page:5>", "warc-payload-digest": "sha1:" + "A" * 32}, "block": b"HTTP/1.1 200 OK\r\n\r\nx"}
    with pytest.raises(ValueError, match="digest"):
        warc._row(record)


# ---- 9: trees by a plain grower, and row by row ----


def _grow(x, edges, g, h, rows, depth, least, l2):
    """A tree as nested tuples (feature, threshold, left, right), or a leaf's value before the rate."""
    best, choice = 1e-6, None
    if depth:
        gt, ht = g[rows].sum(), h[rows].sum()
        for j, own in enumerate(edges):
            top, at = -1.0, None
            for edge in own:
                left = rows[x[rows, j] <= edge]
                if least <= len(left) <= len(rows) - least:
                    gs, hs = g[left].sum(), h[left].sum()
                    gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                    if gain > top + 1e-12:
                        top, at = gain, edge
            if at is not None and top > best + 1e-12:
                best, choice = top, (j, at)
    if not choice:
        return g[rows].sum() / (h[rows].sum() + l2)
    j, edge = choice
    parts = (rows[x[rows, j] <= edge], rows[x[rows, j] > edge])
    return (j, edge, *(_grow(x, edges, g, h, part, depth - 1, least, l2) for part in parts))


def _walk(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def test_forest_equals_a_plain_grower():
    r = np.random.default_rng(12)
    x = r.normal(size=(240, len(quality.FEATURES)))
    x[:, 3] = np.round(x[:, 3])  # few values, many ties
    y = ((x[:, 0] + x[:, 3] > 0) ^ (r.random(240) < 0.1)).astype(float)
    trees, depth, rate, bins, least, l2 = 3, 3, 0.15, 16, 5, 1.0
    forest = quality.fit(x, y, trees=trees, depth=depth, rate=rate, bins=bins, least=least, l2=l2)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    raw = np.full(len(x), np.log(y.mean() / (1 - y.mean())))
    more = r.normal(size=(50, x.shape[1]))
    plain = np.full(len(more), raw[0])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        tree = _grow(x, edges, y - p, p * (1 - p), np.arange(len(x)), depth, least, l2)
        raw = raw + rate * np.array([_walk(tree, row) for row in x])
        plain = plain + rate * np.array([_walk(tree, row) for row in more])
    assert np.allclose(forest.scores(x), 1 / (1 + np.exp(-raw)), atol=1e-9)
    assert np.allclose(forest.scores(more), 1 / (1 + np.exp(-plain)), atol=1e-9)
    # The arrays, node by node.
    for row, got in zip(more, forest.scores(more), strict=True):
        total = forest.base
        for t in range(trees):
            node = 0
            while forest.left[t][node] != node:
                node = int(forest.right[t][node] if row[forest.feature[t][node]] > forest.threshold[t][node] else forest.left[t][node])
            total += forest.value[t][node]
        assert got == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-12)
