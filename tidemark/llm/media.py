"""Media columns: baseline JPEG written and read in numpy.

Writing stores a byte string losslessly as a greyscale baseline JPEG: each byte is one flat 8 x 8 block, so the DC
coefficient (quantised by 8) carries it exactly and the AC coefficients are zero. A row of 64 bytes is a restart
interval, which lets the reader decode all intervals of a batch side by side.

Reading parses the markers (SOF0, DHT, DQT, DRI, SOS), Huffman-decodes the scan and rebuilds a DC-only luminance
thumbnail: one sample per 8 x 8 block. It reads any baseline file of one interleaved scan, AC coefficients and
subsampled chroma included; those are skipped over, since the thumbnail needs luminance DC alone.

Defined results: a null or empty payload becomes 64 zero bytes; other payloads are padded with zero bytes to a
multiple of 64; a payload beyond the size of one image goes on in further images, one after the other. Bytes that are
no baseline JPEG give null dimensions, samples and hash. Extra columns pass through, but for those of the added names; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, with_fields

#: Blocks in a row of the images written: the bytes of a restart interval.
ROW = 64
#: Rows of blocks in one image at most (a JPEG side has 16 bits).
MAX_ROWS = 8000
#: Entropy-coded bytes decoded together at most.
GROUP_BYTES = 1 << 20
#: Luminance DC code lengths of the images written: number of codes of 1 to 16 bits, then the categories in order.
_DC_COUNTS = (0, 1, 3, 2, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0)
_DC_VALUES = (5, 4, 6, 0, 3, 7, 2, 1, 8, 9)
#: The only AC symbol written is end of block.
_AC_COUNTS = (1,) + (0,) * 15
_AC_VALUES = (0,)


def _codes(counts, values) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: symbol to (code, bits)."""
    out, code, k = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            out[values[k]] = (code, bits)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _encoding_table() -> tuple[np.ndarray, np.ndarray]:
    """For a DC difference + 255: the bits of its code, magnitude and end of block, and how many."""
    codes, (end, end_bits) = _codes(_DC_COUNTS, _DC_VALUES), _codes(_AC_COUNTS, _AC_VALUES)[0]
    bits, sizes = np.zeros(511, np.uint32), np.zeros(511, np.uint8)
    for diff in range(-255, 256):
        category = abs(diff).bit_length()
        code, n = codes[category]
        magnitude = diff if diff > 0 else diff + (1 << category) - 1
        bits[diff + 255] = ((code << category | magnitude) << end_bits) | end
        sizes[diff + 255] = n + category + end_bits
    return bits, sizes


_BITS, _SIZES = _encoding_table()


def _scan(payload: np.ndarray) -> bytes:
    """Entropy-coded data of rows of 64 samples, with restart markers between."""
    rows = payload.reshape(-1, ROW).astype(np.int16) - 128
    diffs = np.diff(rows, axis=1, prepend=0) + 255
    sizes, bits = _SIZES[diffs], _BITS[diffs]
    row_bits = sizes.sum(axis=1, dtype=np.int64)
    row_bytes = (row_bits + 7) // 8
    starts = np.cumsum(row_bytes) - row_bytes
    at = (np.cumsum(sizes, axis=1, dtype=np.int64) - sizes + starts[:, None] * 8).ravel()
    total = int(row_bytes.sum())
    # Each code touches at most four bytes; codes never overlap, so adding is joining.
    word = bits.ravel().astype(np.uint64) << (32 - sizes.ravel().astype(np.uint64) - (at & 7).astype(np.uint64))
    out = np.zeros(total + 4, np.uint8)
    byte = at >> 3
    for k in range(4):
        out[: total + 4] += np.bincount(byte + k, weights=((word >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.float64), minlength=total + 4).astype(np.uint8)
    out = out[:total]
    pad = row_bytes * 8 - row_bits  # the last byte of a row is filled with ones
    out[starts + row_bytes - 1] |= ((1 << pad) - 1).astype(np.uint8)
    # A zero after each 255 byte, and a restart marker after each row but the last.
    stuffed = out == 255
    ends = starts + row_bytes - 1
    extra = stuffed.astype(np.int64)
    extra[ends[:-1]] += 2
    where = np.arange(total) + np.cumsum(extra) - extra
    whole = np.zeros(total + int(extra.sum()), np.uint8)
    whole[where] = out
    marks = where[ends[:-1]] + 1 + stuffed[ends[:-1]]
    whole[marks] = 255
    whole[marks + 1] = 0xD0 + np.arange(len(marks)) % 8
    return whole.tobytes()


def _image(payload: np.ndarray) -> bytes:
    height, width = len(payload) // ROW * 8, ROW * 8
    return b"".join((
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"),
        _segment(0xDB, b"\0" + b"\x08" + b"\x01" * 63),
        _segment(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x01\x01\x11\0"),
        _segment(0xC4, b"\0" + bytes(_DC_COUNTS) + bytes(_DC_VALUES)),
        _segment(0xC4, b"\x10" + bytes(_AC_COUNTS) + bytes(_AC_VALUES)),
        _segment(0xDD, ROW.to_bytes(2, "big")),
        _segment(0xDA, b"\x01\x01\0\0\x3f\0"),
        _scan(payload),
        b"\xff\xd9",
    ))


def encode_jpeg(data: bytes) -> bytes:
    """Bytes as one greyscale JPEG, or several in a row if they are too many for one."""
    size = max(ROW, -(-len(data) // ROW) * ROW)
    payload = np.zeros(size, np.uint8)
    payload[: len(data)] = np.frombuffer(data, np.uint8)
    step = ROW * MAX_ROWS
    return b"".join(_image(payload[i : i + step]) for i in range(0, size, step))


class NotBaseline(ValueError):
    pass


def _dc_lookup(counts, values) -> np.ndarray:
    """For each 16-bit window: symbol << 8 | bits of the code; 0 where no code fits."""
    out = np.zeros(1 << 16, np.uint32)
    for symbol, (code, n) in _codes(counts, values).items():
        out[code << (16 - n) : (code + 1) << (16 - n)] = symbol << 8 | n
    return out


def _lanes(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Entropy-coded bytes without stuffing, the first byte of each restart interval, and where the scan ends."""
    ff = np.flatnonzero(scan[:-1] == 255)
    after = scan[ff + 1]
    restart = (after >= 0xD0) & (after <= 0xD7)
    stops = ff[(after != 0) & ~restart & (after != 255)]
    end = int(stops[0]) if len(stops) else len(scan)
    ff, after, restart = ff[ff < end], after[ff < end], restart[ff < end]
    keep = np.ones(end, bool)
    keep[ff[after == 0] + 1] = False
    keep[ff[restart]] = False
    keep[ff[restart] + 1] = False
    upto = np.cumsum(keep)
    starts = np.concatenate([[0], upto[ff[restart]]])
    return scan[:end][keep], starts, end


@dataclass
class _Image:
    """One image, parsed up to its entropy-coded data."""

    width: int
    height: int
    frame: list[tuple[int, int, int, int]]  # of each component: id, horizontal and vertical sampling, quantiser
    blocks: tuple[int, ...]  # the component of each block of an MCU
    tables: tuple
    quant: int
    data: np.ndarray
    starts: np.ndarray
    mcus: np.ndarray  # of each lane
    end: int


def parse_jpeg(data: bytes, start: int = 0) -> _Image:
    """Reads the markers of the image at ``start`` and finds its restart intervals."""
    if data[start : start + 2] != b"\xff\xd8":
        raise NotBaseline("no start of image")
    pos, quant, dc, ac, frame, interval = start + 2, {}, {}, {}, None, 0
    while True:
        while data[pos : pos + 2] == b"\xff\xff":
            pos += 1
        if pos + 4 > len(data) or data[pos] != 255:
            raise NotBaseline("marker expected")
        marker, size = data[pos + 1], int.from_bytes(data[pos + 2 : pos + 4], "big")
        body, pos = data[pos + 4 : pos + 2 + size], pos + 2 + size
        if marker == 0xC0:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise NotBaseline("not a baseline frame")
        elif marker == 0xC4:
            while len(body) >= 17:
                n = sum(body[1:17])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = (bytes(body[1:17]), bytes(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")  # of DC; the thumbnail needs no other
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            break
    if not frame or len(frame) != body[0] or not width or not height:
        raise NotBaseline("the scan does not hold all components")
    used = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
    bytes_, starts, end = _lanes(np.frombuffer(data, np.uint8, offset=pos))
    if len(frame) == 1:
        frame = [(frame[0][0], 1, 1, frame[0][3])]  # a scan of one component is not interleaved
    h_most, v_most = max(c[1] for c in frame), max(c[2] for c in frame)
    mcus = -(-width // (8 * h_most)) * -(-height // (8 * v_most))
    per_lane = interval or mcus
    lanes = -(-mcus // per_lane)
    try:
        tables = tuple((dc[used[c[0]][0]], ac[used[c[0]][1]]) for c in frame)
    except KeyError as e:
        raise NotBaseline("a table is missing") from e
    if len(starts) < lanes:
        raise NotBaseline("restart markers are missing")
    blocks = tuple(i for i, c in enumerate(frame) for _ in range(c[1] * c[2]))
    pos += end
    return _Image(width, height, frame, blocks, tables, quant.get(frame[0][3], 1), bytes_, starts[:lanes], np.minimum(per_lane, mcus - per_lane * np.arange(lanes)), pos + 2 if data[pos : pos + 2] == b"\xff\xd9" else pos)


def thumbnails(images: list[_Image]) -> list[np.ndarray]:
    """DC-only luminance thumbnails; the images must have the same blocks and tables."""
    sizes = [len(i.data) + 8 for i in images]
    offsets = np.cumsum(sizes) - sizes
    data = np.full(sum(sizes), 255, np.uint8)
    for at, i in zip(offsets, images, strict=True):
        data[at : at + len(i.data)] = i.data
    lanes = [len(i.starts) for i in images]
    starts = np.concatenate([i.starts for i in images]) + np.repeat(offsets, lanes)
    ends = np.repeat(offsets + [len(i.data) for i in images], lanes)
    values = _decode_lanes(data, starts, ends, np.concatenate([i.mcus for i in images]), images[0].blocks, images[0].tables)
    out, at = [], 0
    for i in images:
        h, v = i.frame[0][1], i.frame[0][2]
        h_most, v_most = max(c[1] for c in i.frame), max(c[2] for c in i.frame)
        across, down = -(-i.width // (8 * h_most)), -(-i.height // (8 * v_most))
        n = across * down * h * v
        dcs = values[at : at + n].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        dcs = dcs[: -(-i.height * v // (8 * v_most)), : -(-i.width * h // (8 * h_most))]
        out.append(np.clip((dcs * i.quant + 4) // 8 + 128, 0, 255).astype(np.uint8))
        at += n
    return out


_PAIRS: dict = {}


def _pair_lookup(tables) -> np.ndarray:
    """For a 16-bit window that holds a whole DC code with its magnitude and an end of block: (difference + 2048) << 8 | bits."""
    if tables not in _PAIRS:
        dc, ac = _codes(*tables[0]), _codes(*tables[1])
        out = np.zeros(1 << 16, np.uint32)
        if 0 in ac:
            end, end_bits = ac[0]
            for category, (code, n) in dc.items():
                for magnitude in range(1 << category) if n + category + end_bits <= 16 else ():
                    diff = magnitude if category == 0 or magnitude >> (category - 1) else magnitude - (1 << category) + 1
                    bits = n + category + end_bits
                    whole = (code << category | magnitude) << end_bits | end
                    out[whole << (16 - bits) : (whole + 1) << (16 - bits)] = (diff + 2048) << 8 | bits
        _PAIRS[tables] = out, _dc_lookup(*tables[0]), _dc_lookup(*tables[1])
    return _PAIRS[tables]


def _decode_lanes(data, starts, ends, mcus, blocks, tables) -> np.ndarray:
    """Luminance DC values, lane after lane; all lanes go on block by block in step. ``data`` ends in 8 spare bytes."""
    windows = data[:-3].astype(np.uint32)
    for k in (1, 2, 3):
        windows <<= 8
        windows |= data[k : len(data) - 3 + k]
    at = starts.astype(np.int64) * 8
    limit = len(windows) - 1
    looks = [_pair_lookup(t) for t in tables]
    luma = sum(b == 0 for b in blocks)
    most = int(mcus.max(initial=0))
    out = np.zeros((len(starts), most * luma), np.int32)
    last = np.zeros((len(starts), len(tables)), np.int32)

    def peek(where):
        return (windows[np.minimum(where >> 3, limit)] >> (16 - (where & 7)).astype(np.uint32)) & 0xFFFF

    column = 0
    for m in range(most):
        active = mcus > m
        every = bool(active.all())
        for component in blocks:
            pair, dc, ac = looks[component]
            found = pair[peek(at)]
            whole = found != 0
            if not every:
                whole = whole | ~active
            step = (found & 255).astype(np.int64)
            diff = (found >> 8).astype(np.int32) - 2048
            if not whole.all():  # code, magnitude and AC symbols one after the other
                slow = np.flatnonzero(~whole)
                where, diffs = at[slow], np.zeros(len(slow), np.int32)
                look = dc[peek(where)]
                if not look.all():
                    raise NotBaseline("no such code")
                category, where = (look >> 8).astype(np.int64), where + (look & 255)
                magnitude = (peek(where) >> (16 - category).astype(np.uint32)).astype(np.int64)
                diffs = np.where((category == 0) | (magnitude >> np.maximum(category - 1, 0) == 1), magnitude, magnitude - (1 << category) + 1)
                diffs = np.where(category == 0, 0, diffs)
                where = where + category
                k, going = np.ones(len(slow), np.int64), np.ones(len(slow), bool)
                while going.any():
                    g = np.flatnonzero(going)
                    look = ac[peek(where[g])]
                    if not (look & 255).all():
                        raise NotBaseline("no such code")
                    symbol = (look >> 8).astype(np.int64)
                    run, category = symbol >> 4, symbol & 15
                    where[g] += (look & 255) + category
                    k[g] = np.where(symbol == 0, 64, k[g] + run + 1)
                    going[g] = k[g] < 64
                step[slow], diff[slow] = where - at[slow], diffs
            if not every:
                step, diff = np.where(active, step, 0), np.where(active, diff, 0)
            at = at + step
            last[:, component] += diff
            if component == 0:
                out[:, column] = last[:, 0]
                column += 1
    if (at > ends * 8).any():
        raise NotBaseline("the scan ends early")
    return out[np.arange(most * luma)[None, :] < (mcus * luma)[:, None]]


def thumbnail_hash(thumb: np.ndarray) -> str:
    """Average hash: an 8 x 8 grid of cell means against their mean, as 16 hex digits."""
    ys, xs = (np.arange(8) * n // 8 for n in thumb.shape)
    ys, xs = np.minimum(ys, thumb.shape[0] - 1), np.minimum(xs, thumb.shape[1] - 1)
    grid = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), ys, axis=0), xs, axis=1)
    rows, cols = np.maximum(np.diff(np.append(ys, thumb.shape[0])), 1), np.maximum(np.diff(np.append(xs, thumb.shape[1])), 1)
    means = grid / (rows[:, None] * cols[None, :])
    return np.packbits(means > means.mean()).tobytes().hex()


def _features(thumbs: list[np.ndarray], images: list[_Image]) -> tuple[int, int, bytes, str]:
    wide = max(t.shape[1] for t in thumbs)
    joined = thumbs[0] if len(thumbs) == 1 else np.concatenate([np.pad(t, ((0, 0), (0, wide - t.shape[1]))) for t in thumbs])
    return max(i.width for i in images), sum(i.height for i in images), joined.tobytes(), thumbnail_hash(joined)


def read_images(media: list[bytes | None]) -> list[tuple]:
    """Of each stored value: width, height (those of several images add up), samples and hash; None where it is no baseline JPEG.

    Images with the same tables are decoded together.
    """
    parsed: list[list[_Image] | None] = []
    for data in media:
        images, pos = [], 0
        try:
            while pos < len(data or b"") or not images:
                images.append(parse_jpeg(data or b"", pos))
                pos = images[-1].end
        except (NotBaseline, IndexError, KeyError, ValueError):
            images = None
        parsed.append(images)
    groups: dict[tuple, list[tuple[int, int]]] = {}
    for k, images in enumerate(parsed):
        for j, i in enumerate(images or ()):
            groups.setdefault((i.blocks, i.tables), []).append((k, j))
    thumbs: dict[tuple[int, int], np.ndarray] = {}

    def decode(members: list[tuple[int, int]]) -> None:
        try:
            thumbs.update(zip(members, thumbnails([parsed[k][j] for k, j in members]), strict=True))
        except (NotBaseline, IndexError, ValueError):
            if len(members) > 1:  # one of them is broken: halve until it stands alone
                decode(members[: len(members) // 2])
                decode(members[len(members) // 2 :])

    for members in groups.values():
        part, size = [], 0
        for m in members:
            part.append(m)
            size += len(parsed[m[0]][m[1]].data)
            if size >= GROUP_BYTES:
                decode(part)
                part, size = [], 0
        if part:
            decode(part)
    none = (None, None, None, None)
    return [_features([thumbs[k, j] for j in range(len(images))], images) if images and all((k, j) in thumbs for j in range(len(images))) else none for k, images in enumerate(parsed)]


def encode_media(df: DataFrame, payload_column: str = "payload", media_column: str = "media") -> DataFrame:
    """Adds the JPEG of a binary column; the payload itself goes."""
    keep, schema = with_fields(df.drop(payload_column), f"`{media_column}` binary")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = pa.array([encode_jpeg(x.as_py() or b"") for x in b.column(payload_column)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), media], [*keep, media_column])

    return map_arrow(df, encode, schema)


_FEATURES = {"width": pa.int32(), "height": pa.int32(), "samples": pa.binary(), "thumb_hash": pa.string()}


def media_features(df: DataFrame, media_column: str = "media") -> DataFrame:
    """Reads the stored images: width, height, samples of the thumbnail and its hash beside the other columns."""
    keep, schema = with_fields(df, "width int, height int, samples binary, thumb_hash string")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = zip(*read_images(b.column(media_column).to_pylist()), strict=True) if b.num_rows else [()] * len(_FEATURES)
            made = [pa.array(v, t) for v, t in zip(out, _FEATURES.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *made], [*keep, *_FEATURES])

    return map_arrow(df, decode, schema)


def op6_media_columns(spark, sf_dir: str) -> DataFrame:
    """Every document's bytes as a JPEG column, read back with dimensions and thumbnail hashes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    stored = encode_media(docs.select("doc_id", F.length(text).cast("long").alias("n_bytes"), text.alias("payload")))
    samples = F.col("samples")
    return media_features(stored).select(
        "doc_id",
        "n_bytes",
        F.length(samples).cast("long").alias("payload_bytes"),
        F.sha2(samples, 256).alias("payload_sha256"),
        F.crc32(F.substring(samples, -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.concat_ws("x", "width", "height"), "thumb_hash").alias("feature"),
    )
