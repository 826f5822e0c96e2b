"""Best-fit packing with exact-complement hashing.

Documents become token pieces of at most ``capacity``; only the number of pieces of each length matters for a
packing, so it is planned on the histogram of lengths (at most ``capacity`` entries, whatever the corpus size):

1. For each length, longest first, the gap it leaves is looked up among single lengths, then in a hash of pair sums,
   then in one of triple sums (``SumIndex``). A combination that fills the gap exactly is consumed as often as the
   availability counts allow.
2. What is left goes best-fit decreasing, again by counts: the fullest kind of open sequence that a length still fits.

The plan is a list of patterns (lengths, times). Pieces are numbered within their length and look up their place.
A length that many pieces have is numbered in parts by a hash, so no task holds it whole.

Defined results: a null or empty text is its end token alone; a null doc_id is kept; repeated rows are pieces of their
own; an empty table gives no rows; extra columns are ignored by ``pieces`` and pass through ``pack`` (sequence_id and offset are replaced).
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, written

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 1024
#: The numbering of pieces is split into about so many parts, and a part holds at least ``PART_ROWS`` pieces of one length.
PARTS, PART_ROWS = 65_536, 256
_W = "__pack_"  # working columns
_SALT, _BEFORE, _RANK, _PLACE = f"{_W}salt", f"{_W}before", f"{_W}rank", f"{_W}place"

#: Words whose ids a worker remembers, at most twice so many and none longer; texts are looked at in groups of about so many characters.
REMEMBERED, LONGEST, GROUP_CHARS = 300_000, 64, 1 << 20

#: Characters that every Unicode version classes alike: ASCII, Latin, general punctuation, euro.
_COMMON = "[\\t\\n\\r -~\\u00a0-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20ac]*"

#: What a common character is to the file's rule for words; the end of a text stands between texts that are looked at together.
_END, _BLANK, _WHITE, _LETTER, _NUMBER, _OTHER = range(6)
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")  # fixed values: what the rule takes for a word after an apostrophe


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    import unicodedata

    kinds = np.full(0x20AD, _OTHER, np.uint8)
    for code in range(0x250):
        kinds[code] = {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(code))[0], _OTHER)
    kinds[[ord(c) for c in "\t\n\r\u00a0"]], kinds[ord(" ")], kinds[0] = _WHITE, _BLANK, _END
    return kinds


def _word_starts(codes: np.ndarray) -> np.ndarray:
    """Where words begin in common characters between ends of texts (code 0), of which the first is one and the last two are.

    The file's rule, by what stands beside a character: a word is a run of letters, of numbers or of others with the blank before
    it, or a known ending after an apostrophe; of white space before a word, the last character stands apart.
    """
    kind = _kinds()[codes]
    white = (kind == _BLANK) | (kind == _WHITE)
    starts = np.ones(len(codes), bool)
    before, own, after = kind[:-2], kind[1:-1], kind[2:]
    starts[1:-1] = np.where(white[1:-1], ~white[:-2] | (after >= _LETTER), ((own != before) & (before != _BLANK)) | (own == _END))
    marks = np.flatnonzero(starts[:-2] & (codes[:-2] == ord("'")))
    for ending in _ENDINGS:
        found = marks[codes[marks + 1] == ord(ending[0])]
        if len(ending) > 1:
            found = found[codes[found + 2] == ord(ending[1])]
        starts[found + 1], starts[found + 1 + len(ending)] = False, True
    return starts


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


class _Remembered(dict):
    """Results of ``find`` by text. Once there are ``REMEMBERED`` of them, those that are not met again until the next so many are dropped."""

    def __init__(self, find: Callable[[str], bytes]):
        self.find, self.before = find, {}

    def __missing__(self, text: str) -> bytes:
        own = self.before.get(text)
        if own is None:
            own = self.find(text)
        if len(text) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[text] = own
        return own


class _ByteLevel(dict):
    """What the library's byte-level step makes of a character, by code, as ``str.translate`` asks for it."""

    def __init__(self):
        from tokenizers import pre_tokenizers

        self.step = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, code: int) -> str:
        own = self[code] = self.step.pre_tokenize_str(chr(code))[0][0]
        return own


def _steps(path: str) -> dict:
    """A tokenizer file without its vocabulary, which would fill memory with objects that nothing needs, if that comes last as usual."""
    import json

    with open(path, encoding="utf-8") as f:
        text = f.read()
    head, found, _ = text.partition('"model"')
    try:
        return json.loads(head.rstrip().rstrip(",") + "}") if found else json.loads(text)
    except ValueError:
        return json.loads(text)


class Encoder:
    """Texts to ids as ``tokenizers`` gives them for the file at ``path``, without special tokens of its own.

    That library's merges never cross words, so its model is asked for each distinct word once and the ids are remembered. Words
    are found and numbered as columns, for many texts at a time. Texts with other than common characters, or that hold an added
    token of the file, are given to the library whole, and so is every text if the file's steps are not a plain byte-level split.
    """

    def __init__(self, path: str):
        steps = _steps(path)
        step = steps.get("pre_tokenizer") or {}
        plain = (step.get("type"), step.get("add_prefix_space"), step.get("use_regex")) == ("ByteLevel", False, True)
        self.by_word = plain and not any(steps.get(k) for k in ("normalizer", "truncation", "padding"))
        self.tokenizer, self.characters, self.known = _tokenizer(path), _ByteLevel(), _Remembered(self._word)
        self.model, self.blank = self.tokenizer.model, self.characters[ord(" ")]
        self.added = [t["content"] for t in steps.get("added_tokens") or []]
        self.common = re.compile(_COMMON).fullmatch

    def __call__(self, texts: Iterable[str]) -> Iterator[list[int]]:
        return (np.frombuffer(ids, "<u4").tolist() for ids in self.packed(texts))

    def packed(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text as unsigned 32-bit numbers, little-endian."""
        group, chars = [], 0
        for text in texts:
            group.append(text)
            chars += len(text)
            if chars >= GROUP_CHARS:
                yield from self._group(group)
                group, chars = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        plain = [self.by_word and self.common(t) is not None and not any(a in t for a in self.added) for t in texts]
        own = self._plain([t for t, p in zip(texts, plain, strict=True) if p])
        for text, p in zip(texts, plain, strict=True):
            yield next(own) if p else np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, texts: list[str]) -> Iterator[bytes]:
        if not texts:
            return
        joined = "\0".join(["", *texts, "", ""])
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        starts = np.flatnonzero(_word_starts(codes))
        ends = codes[starts] == 0
        places = starts if joined.isascii() else np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800))])[starts]
        data = joined.encode()
        offsets = np.append(places, len(data)).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        found = [b"" if w == "\0" else self.known[w] for w in words.dictionary.to_numpy(zero_copy_only=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        number = words.indices.to_numpy()
        # A word's ids are a slice of those of all distinct words: each id's place there is its place here, moved by word.
        first, upto = np.cumsum(sizes) - sizes, np.cumsum(sizes[number])
        moved = first[number] - upto + sizes[number]
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(moved, sizes[number]) + np.arange(upto[-1])]
        edges = upto[ends]
        for lo, hi in zip(edges[: len(texts)], edges[1:], strict=False):
            yield ids[lo:hi].tobytes()

    def _word(self, word: str) -> bytes:
        # The byte-level step leaves printable ASCII as it is, but for blanks.
        mapped = word.replace(" ", self.blank) if word.isascii() and word.isprintable() else word.translate(self.characters)
        found = [t.id for t in self.model.tokenize(mapped)]
        return struct.pack(f"<{len(found)}I", *found)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = 2, keep_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Token pieces: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids.

    Only documents longer than ``capacity`` are cut; the first piece takes what is over, the others are full.
    """
    path = tokenizer_path or default_tokenizer_path()

    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).packed
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc, own in zip(b.column(0).to_pylist(), encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                ids = memoryview(own + end)
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                    part = ids[4 * lo : 4 * hi]
                    for name, value in zip(out, (doc, k, lo, hi - lo, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int32) if keep_ids else None), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32")), *([pa.array(out["ids"], pa.list_(pa.int32()))] if keep_ids else [])],
                [k for k in out if keep_ids or k != "ids"],
            )

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_arrow(rows, cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else ""))


class SumIndex:
    """Which lengths still there add up to a sum: two by a hash of pair sums, three by a hash that points to pair sums.

    Counts only go down, so an entry that can't be filled any more is dropped for good; a search costs what it drops.
    """

    def __init__(self, left: dict[int, int]):
        self.left = left
        self.pairs: dict[int, list[tuple[int, int]]] = {}
        self.triples: dict[int, list[tuple[int, int]]] = {}
        self.lengths = sorted(k for k, n in left.items() if n)

    def _enough(self, own: int, *lengths: int) -> bool:
        """Whether the counts allow all of ``lengths`` beside one of ``own``."""
        return all(self.left[x] >= lengths.count(x) + (x == own) for x in lengths)

    def _live_pairs(self, total: int) -> list[tuple[int, int]]:
        if total not in self.pairs:
            present = set(self.lengths)
            self.pairs[total] = [(total - c, c) for c in self.lengths if 2 * c <= total and total - c in present][::-1]
        entries = self.pairs[total]
        while entries and not self._enough(0, *entries[-1]):
            entries.pop()
        return entries

    def pairs_of(self, total: int, own: int) -> tuple[int, int] | None:
        """The pair with the longest member."""
        return next((p for p in reversed(self._live_pairs(total)) if self._enough(own, *p)), None)

    def triples_of(self, total: int, own: int) -> tuple[int, int, int] | None:
        if total not in self.triples:
            self.triples[total] = [(b, total - b) for b in self.lengths if 3 * b >= total and b < total]
        entries = self.triples[total]
        while entries and (not self.left[entries[-1][0]] or not self._live_pairs(entries[-1][1])):
            entries.pop()
        for b, rest in reversed(entries):
            for c, d in reversed(self._live_pairs(rest)):
                if self._enough(own, b, c, d):
                    return b, c, d
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in their order, times) that use up ``counts`` of each length."""
    left = defaultdict(int, {k: n for k, n in counts.items() if n > 0})
    out: list[tuple[tuple[int, ...], int]] = []

    def take(*pattern: int) -> int:
        need: dict[int, int] = defaultdict(int)
        for x in pattern:
            need[x] += 1
        times = min(left[x] // n for x, n in need.items())
        if times:
            for x, n in need.items():
                left[x] -= n * times
            out.append((pattern, times))
        return times

    index = SumIndex(left)
    take(capacity)
    for a in range(capacity - 1, 0, -1):
        gap = capacity - a
        if left[a]:
            take(a, gap)
        for fill in (index.pairs_of, index.triples_of):
            while left[a] and (found := fill(gap, a)):
                take(a, *found)

    # Best fit, longest first: open kinds by gap; a kind is a pattern so far with how many sequences have it.
    gaps: list[int] = []
    open_kinds: dict[int, list[list]] = {}

    def put(gap: int, pattern: tuple[int, ...], times: int) -> None:
        if gap not in open_kinds:
            gaps.insert(bisect_left(gaps, gap), gap)
            open_kinds[gap] = []
        open_kinds[gap].append([pattern, times])

    for a in range(capacity, 0, -1):
        while left[a]:
            i = bisect_left(gaps, a)
            if i == len(gaps):
                fit = capacity // a
                whole, rest = divmod(left[a], fit)
                if whole:
                    put(capacity - a * fit, (a,) * fit, whole)
                if rest:
                    put(capacity - a * rest, (a,) * rest, 1)
                left[a] = 0
                break
            gap = gaps[i]
            pattern, times = open_kinds[gap].pop()
            if not open_kinds[gap]:
                del open_kinds[gap], gaps[i]
            each = min(gap // a, left[a])  # as many of this length as fit
            use = min(times, left[a] // each)
            put(gap - a * each, pattern + (a,) * each, use)
            if times > use:
                put(gap, pattern, times - use)
            left[a] -= use * each
    out += [(pattern, times) for kinds in open_kinds.values() for pattern, times in kinds]
    return out


def pack(pieces_df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces_df`` (doc_id, piece, length, ...) with sequence_id and offset."""
    spark, n = pieces_df.sparkSession, F.count(F.lit(1)).alias("n")
    counts = {int(r.length): int(r.n) for r in pieces_df.groupBy("length").agg(n).collect()}  # at most capacity rows
    if not counts:
        return pieces_df.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).limit(0)
    # A length that many pieces have is numbered in parts; there are at most PARTS + capacity of them.
    per_part = max(PART_ROWS, -(-sum(counts.values()) // PARTS))
    split = F.broadcast(spark.createDataFrame([(k, -(-c // per_part)) for k, c in counts.items()], f"{_W}length long, {_W}parts long"))
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start"), F.col(f"{_W}parts")).cast("int")
    salted = pieces_df.join(split, F.col("length") == F.col(f"{_W}length")).withColumn(_SALT, salt)
    cells = salted.groupBy("length", _SALT).agg(n).toPandas().sort_values(["length", _SALT])
    cells[_BEFORE] = cells.groupby("length").n.cumsum() - cells.n

    # Where the ranks of each length go: runs (length, first rank, how many, first sequence, place in it).
    runs, next_rank, next_sequence = [], defaultdict(int), 0
    for pattern, times in plan(counts, capacity):
        offset = 0
        for x in pattern:
            runs.append((x, next_rank[x], times, next_sequence, offset))
            next_rank[x] += times
            offset += x
        next_sequence += times

    starts: dict[int, list] = defaultdict(list)
    for x, first, _, sequence, offset in runs:
        starts[x].append((first, sequence, offset))
    # A row per run: their number is bounded by the patterns of the plan, not by the corpus.
    by_length = {x: tuple(np.array(c, np.int64) for c in zip(*sorted(v), strict=True)) for x, v in starts.items()}
    lookup = spark.sparkContext.broadcast(by_length)

    place_in_cell = F.row_number().over(Window.partitionBy("length", _SALT).orderBy("doc_id", "piece", "ids_crc32", "start"))
    offsets = F.broadcast(spark.createDataFrame(cells[["length", _SALT, _BEFORE]], f"length long, {_SALT} int, {_BEFORE} long"))
    ranked = salted.withColumn(_RANK, place_in_cell).join(offsets, ["length", _SALT]).withColumn(_RANK, F.col(_BEFORE) + F.col(_RANK) - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for x in np.unique(lengths):
            first, seq, off = lookup.value[int(x)]
            own = lengths == x
            i = np.searchsorted(first, ranks[own], side="right") - 1
            sequence[own], offset[own] = seq[i] + ranks[own] - first[i], off[i]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn(_PLACE, place("length", _RANK))
    own = [c for c in pieces_df.columns if c not in ("sequence_id", "offset")]
    return placed.select(*own, f"{_PLACE}.sequence_id", f"{_PLACE}.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = 2) -> DataFrame:
    """Tokenize once, keep the pieces in the shared folder, plan on their lengths, place them."""
    return pack(written(pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of at most 1024 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
