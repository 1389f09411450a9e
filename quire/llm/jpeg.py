"""Baseline JPEG in numpy: marker parsing, Huffman decoding of scans, DC-only luminance thumbnails.

The decoder takes many files at once and steps through all their restart
intervals together: each numpy step decodes one coefficient code of every
interval. A file without restart markers is one interval.

``encode_samples`` stores bytes without loss as the DC level of one 8x8 block
each (quantiser 8, so a block is flat and its sample is the byte), one restart
interval per row of blocks. The number of bytes stands in a comment segment;
what exceeds one image's largest frame follows in further images.

Within a frame an interval is decoded code by code: a foreign file without
restart markers takes as many numpy steps as it has blocks.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_blocks

UNIT = 576
#: Fixed values of the format: code counts by length and symbols of its standard luminance DC table.
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)
#: Blocks a side of a frame may have: 65,535 samples at most.
MAX_SIDE = 8191
#: Blocks coded at once, and coded bytes decoded at once, at most (one row or interval may be longer): large images go in bands.
BAND, CODED = 1 << 16, 6 << 20
#: Begins the comment of the images that ``encode_samples`` writes; the number of their samples follows.
MAGIC = b"quire samples "
#: What a damaged file may raise while it is read.
DAMAGE = (ValueError, IndexError, KeyError, ZeroDivisionError, struct.error)


def zigzag() -> np.ndarray:
    """Natural index of each zigzag position: diagonals, alternately up and down."""
    cells = sorted(((y + x, (y if (y + x) % 2 else x), 8 * y + x) for y in range(8) for x in range(8)))
    return np.array([c[2] for c in cells])


def _codes(counts, symbols) -> list[tuple[int, int, int]]:
    """(code, length, symbol) in canonical order."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((code, length, symbols[at]))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _lookup(counts, symbols) -> tuple[np.ndarray, np.ndarray]:
    """Length (0: no code) and symbol for each possible next 16 bits."""
    length, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for code, n, s in _codes(counts, symbols):
        first = code << (16 - n)
        length[first : first + (1 << (16 - n))] = n
        symbol[first : first + (1 << (16 - n))] = s
    return length, symbol


# ---------------------------------------------------------------- writing


def _words() -> tuple[np.ndarray, np.ndarray]:
    """For each DC difference from -255 to 255: its code, extra bits and the one-bit end of block, left-aligned in 16 bits; total bits."""
    table = {s: (c, n) for c, n, s in _codes(DC_COUNTS, DC_SYMBOLS)}
    word, bits = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = table[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        total = n + size + 1
        word[d + 255] = ((code << size | extra) << 1) << (16 - total)
        bits[d + 255] = total
    return word, bits


_WORD, _BITS = _words()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(rows: int, cols: int, stored: int) -> bytes:
    quant = bytes([0, 8]) + bytes([1]) * 63
    dc = bytes([0x00, *DC_COUNTS, *DC_SYMBOLS])
    ac = bytes([0x10, 1, *[0] * 15, 0])  # only the end of block
    return (
        b"\xff\xd8"
        + _segment(0xFE, MAGIC + struct.pack(">Q", stored))
        + _segment(0xDB, quant)
        + _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, cols * 8, 1) + bytes([1, 0x11, 0]))
        + _segment(0xC4, dc)
        + _segment(0xC4, ac)
        + _segment(0xDD, struct.pack(">H", cols))
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def _band(samples: np.ndarray, cols: int, first: int) -> bytes:
    """Coded rows of blocks, ``first`` the number of the first one; each is a restart interval of its own and begins on a byte, so rows go band by band."""
    rows = -(-len(samples) // cols)
    grid = np.full(rows * cols, 127, np.int64)
    grid[: len(samples)] = samples.astype(np.int64) - 128
    diff = np.diff(grid.reshape(rows, cols), axis=1, prepend=0)
    word, bits = _WORD[diff + 255], _BITS[diff + 255]
    ends = np.cumsum(bits, axis=1)
    size = (ends[:, -1] + 7) // 8
    start = np.concatenate([[0], np.cumsum(size)])
    place = (start[:-1, None] * 8 + ends - bits).ravel()
    value = word.ravel() << (8 - (place & 7))
    byte = place >> 3
    n = int(start[-1])
    out = np.bincount(np.concatenate([byte, byte + 1, byte + 2]), np.concatenate([value >> 16, value >> 8 & 255, value & 255]), n + 2)[:n].astype(np.uint8)
    out[start[1:] - 1] |= ((1 << (size * 8 - ends[:, -1])) - 1).astype(np.uint8)
    full = np.flatnonzero(out == 255) + 1
    marked = np.arange(first == 0, rows)  # rows with a mark before them: all but the image's first
    marks = np.repeat(start[marked], 2)
    signs = np.empty(len(marks), np.uint8)
    signs[0::2], signs[1::2] = 255, 0xD0 + (first + marked - 1) % 8
    # a stuffed byte belongs to the row before a mark at the same place
    return np.insert(out, np.concatenate([full, marks]), np.concatenate([np.zeros(len(full), np.uint8), signs])).tobytes()


def _image(samples: np.ndarray, cols: int) -> list[bytes]:
    """The parts of an image."""
    step = max(1, BAND // cols)
    rows = -(-len(samples) // cols)
    bands = [_band(samples[r * cols : (r + step) * cols], cols, r) for r in range(0, rows, step)]
    return [_head(rows, cols, len(samples)), *bands, b"\xff\xd9"]


def _columns(n: int) -> int:
    """Blocks in a row: 24, or 576 and its multiples where the frame would be too high."""
    if n <= 24 * MAX_SIDE:
        return 24
    return UNIT * -(-n // (UNIT * MAX_SIDE))


def encode_samples(data: bytes) -> bytes:
    """Store bytes (at least one) without loss in one or more baseline images."""
    if not data:
        raise ValueError("no samples")
    samples = np.frombuffer(data, np.uint8)
    most = MAX_SIDE * (MAX_SIDE // UNIT * UNIT)
    images = (samples[i : i + most] for i in range(0, len(samples), most))
    return b"".join(x for part in images for x in _image(part, _columns(len(part))))


# ---------------------------------------------------------------- reading


@dataclass
class Frame:
    """One parsed image: what its markers say and its entropy-coded intervals."""

    height: int = 0
    width: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quantisers: dict[int, int] = field(default_factory=dict)  # of DC
    tables: dict[tuple[int, int], tuple[bytes, bytes]] = field(default_factory=dict)
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component's place, DC table, AC table
    restart: int = 0
    comment: bytes = b""
    coded: np.ndarray | None = None  # without stuffing
    intervals: list[int] = field(default_factory=list)  # byte offsets in ``coded``


def parse(data: bytes) -> list[Frame]:
    """Frames of one or more images that follow each other. Raises ValueError for what is not baseline."""
    frames, at = [], 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        frame, at = Frame(), at + 2
        while True:
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            if data[at] != 0xFF:
                raise ValueError("marker expected")
            marker = data[at + 1]
            if marker == 0xD9:
                at += 2
                break
            length = struct.unpack(">H", data[at + 2 : at + 4])[0]
            body, at = data[at + 4 : at + 2 + length], at + 2 + length
            if marker == 0xDB:
                _quantisers(frame, body)
            elif marker == 0xC0:
                bits, frame.height, frame.width, n = struct.unpack(">BHHB", body[:6])
                if bits != 8:
                    raise ValueError("8-bit samples are needed")
                frame.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise ValueError("not a baseline image")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    frame.tables[body[0] >> 4, body[0] & 15] = (bytes(body[1:17]), bytes(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif marker == 0xDD:
                frame.restart = struct.unpack(">H", body)[0]
            elif marker == 0xFE:
                frame.comment = bytes(body)
            elif marker == 0xDA:
                order = [c[0] for c in frame.components]
                scan = [(order.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                at = _scan(frame, data, at, scan)
        frames.append(frame)
    return frames


def _quantisers(frame: Frame, body: bytes) -> None:
    while body:
        wide = body[0] >> 4
        frame.quantisers[body[0] & 15] = struct.unpack(">H", body[1:3])[0] if wide else body[1]
        body = body[129 if wide else 65 :]


def _scan(frame: Frame, data: bytes, at: int, scan: list) -> int:
    """Take a scan that holds the first component; return the place of the marker after it."""
    raw = np.frombuffer(data, np.uint8, offset=at)
    full = np.flatnonzero(raw[:-1] == 255)
    after = raw[full + 1]
    ends = full[(after != 0) & ~((after >= 0xD0) & (after <= 0xD7)) & (after != 255)]
    if not len(ends):
        raise ValueError("scan without an end")
    end = int(ends[0])
    if any(c == 0 for c, _, _ in scan) and not frame.scan:
        full, after = full[full < end], after[full < end]
        marks = full[after != 0]
        gone = np.concatenate([full[after == 0] + 1, marks, marks + 1])
        gone.sort()
        keep = np.ones(end, bool)
        keep[gone] = False
        frame.scan, frame.coded = scan, raw[:end][keep]
        frame.intervals = [0, *(marks + 1 - np.searchsorted(gone, marks, "right")).tolist()]
    return at + end


def dc_thumbnails(frames: list[Frame]) -> list[np.ndarray]:
    """Luminance thumbnails, one sample per 8x8 block of the first component. Raises one of ``DAMAGE`` if any frame is damaged."""
    groups: dict[tuple, list[int]] = {}
    for i, f in enumerate(frames):
        pattern = [(c, d, a) for c, d, a in f.scan for _ in range(f.components[c][1] * f.components[c][2] if len(f.scan) > 1 else 1)]
        used = tuple((k, f.tables[k]) for k in sorted({(0, d) for _, d, _ in pattern} | {(1, a) for _, _, a in pattern}))
        groups.setdefault((tuple(pattern), used, f.restart), []).append(i)
    out: list[np.ndarray] = [np.zeros((0, 0), np.uint8)] * len(frames)
    for (pattern, used, _), members in groups.items():
        for i, samples in zip(members, _decode([frames[i] for i in members], pattern, dict(used)), strict=True):
            out[i] = _grid(frames[i], samples)
    return out


def _mcus(f: Frame) -> tuple[int, int]:
    """Rows and columns of coded units."""
    h, v = max(c[1] for c in f.components), max(c[2] for c in f.components)
    if len(f.scan) > 1:
        return -(-f.height // (8 * v)), -(-f.width // (8 * h))
    _, ch, cv, _ = f.components[0]
    return -(-(-(-f.height * cv // v)) // 8), -(-(-(-f.width * ch // h)) // 8)


_TABLES: dict = {}


def _table(key) -> tuple[np.ndarray, np.ndarray]:
    if key not in _TABLES:
        if len(_TABLES) > 32:
            _TABLES.clear()
        _TABLES[key] = _lookup(*key)
    return _TABLES[key]


def _decode(frames: list[Frame], pattern: tuple, tables: dict) -> list[np.ndarray]:
    """Samples of the first component, in coded order, of frames with the same tables: ``CODED`` bytes of intervals at a time."""
    out, filled, batch, size = [], [0] * len(frames), [], 0

    def flush():
        nonlocal batch, size
        for i, levels in zip(*_levels(frames, batch, pattern, tables), strict=True):
            f = frames[i]
            levels *= f.quantisers[f.components[0][3]]
            levels += 4
            levels >>= 3
            levels += 128
            np.clip(levels, 0, 255, out=levels)
            out[i][filled[i] : filled[i] + len(levels)] = levels
            filled[i] += len(levels)
        batch, size = [], 0

    for i, f in enumerate(frames):
        rows, cols = _mcus(f)
        total, each = rows * cols, f.restart or rows * cols
        if len(f.intervals) != -(-total // each):
            raise ValueError("restart intervals do not match the frame")
        if total * len(pattern) > 4 * len(f.coded):  # a block takes two bits at least
            raise ValueError("scan is too short for the frame")
        out.append(np.empty(total * sum(c == 0 for c, _, _ in pattern), np.uint8))
        last = len(f.intervals) - 1
        for k, (begin, end) in enumerate(zip(f.intervals, [*f.intervals[1:], len(f.coded)], strict=True)):
            if batch and size + end - begin > CODED:
                flush()
            batch.append((i, begin, end, each if k < last else total - each * last))
            size += end - begin
    if batch:
        flush()
    return out


def _levels(frames: list[Frame], intervals: list[tuple], pattern: tuple, tables: dict) -> tuple[list[int], list[np.ndarray]]:
    """DC levels of intervals (frame, begin, end, units), decoded in step; joined for each frame, with the frames' places."""
    pieces, starts, stops, at = [], [], [], 0
    counts = [x[3] for x in intervals]
    runs = [list(g) for _, g in groupby(intervals, lambda x: x[0])]
    for run in runs:
        begin, end = run[0][1], run[-1][2]
        starts += [at + x[1] - begin for x in run]
        stops += [at + x[2] - begin for x in run]
        pieces += [frames[run[0][0]].coded[begin:end], np.full(8, 255, np.uint8)]
        at += end - begin + 8
    data = np.concatenate(pieces).astype(np.uint32)
    window = data[:-2] << 16
    window |= data[1:-1] << 8
    window |= data[2:]
    last = len(window) - 1
    counts = np.array(counts)
    order = np.argsort(-counts, kind="stable")
    pos, left = np.array(starts, np.int64)[order] * 8, counts[order]
    width = sum(c == 0 for c, _, _ in pattern)
    levels = np.zeros((len(left), int(left.max()) * width), np.int32)
    n_comp = 1 + max(c for c, _, _ in pattern)
    previous = np.zeros((n_comp, len(left)), np.int64)
    lookups = {k: _table(v) for k, v in tables.items()}

    def peek(p):
        return window[np.minimum(p >> 3, last)].astype(np.int64) >> (8 - (p & 7)) & 0xFFFF

    for step in range(int(left.max())):
        live = int(np.searchsorted(-left, -step, side="left"))  # intervals are sorted by length, longest first
        p, first = pos[:live], 0
        for c, d, a in pattern:
            length, symbol = lookups[0, d]
            bits = peek(p)
            n, size = length[bits], symbol[bits]
            if not n.all():
                raise ValueError("damaged scan")
            p = p + n
            extra = peek(p) >> (16 - size)
            p = p + size
            diff = np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra)
            previous[c, :live] += diff
            if c == 0:
                levels[:live, step * width + first] = previous[c, :live]
                first += 1
            length, symbol = lookups[1, a]
            bits = peek(p)
            n, rs = length[bits], symbol[bits]
            if not n.all():
                raise ValueError("damaged scan")
            p = p + n
            open_ = np.flatnonzero(rs)  # blocks that go on after this code
            if len(open_):
                k = np.ones(live, np.int64)
                while len(open_):
                    r, s = rs[open_] >> 4, rs[open_] & 15
                    k[open_] += r + 1
                    p[open_] += s
                    ended = (s == 0) & (r < 15)
                    open_ = open_[~ended & (k[open_] < 64)]
                    if len(open_):
                        bits = peek(p[open_])
                        if not length[bits].all():
                            raise ValueError("damaged scan")
                        p[open_] += length[bits]
                        rs[open_] = symbol[bits]
        pos[:live] = p
    if (pos > np.array(stops, np.int64)[order] * 8).any():
        raise ValueError("damaged scan")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    each = iter([levels[back[j], : counts[j] * width] for j in range(len(counts))])
    return [run[0][0] for run in runs], [np.concatenate([next(each) for _ in run]) for run in runs]


def _grid(f: Frame, samples: np.ndarray) -> np.ndarray:
    rows, cols = _mcus(f)
    _, h, v, _ = f.components[0]
    if len(f.scan) == 1:
        return samples.reshape(rows, cols)
    grid = samples.reshape(rows, cols, v, h).transpose(0, 2, 1, 3).reshape(rows * v, cols * h)
    hm, vm = max(c[1] for c in f.components), max(c[2] for c in f.components)
    return grid[: -(-(-(-f.height * v // vm)) // 8), : -(-(-(-f.width * h // hm)) // 8)]


def decode_samples(frames: list[Frame], thumbs: list[np.ndarray]) -> bytes:
    """The bytes that ``encode_samples`` stored."""
    parts = [t.ravel()[: struct.unpack(">Q", f.comment[len(MAGIC) :])[0]] for f, t in zip(frames, thumbs, strict=True)]
    return parts[0].tobytes() if len(parts) == 1 else b"".join(x.tobytes() for x in parts)


def difference_hash(thumb: np.ndarray) -> str:
    """64 bits in hex: whether area means of an 8 x 9 grid grow from left to right."""
    rows, cols = np.linspace(0, thumb.shape[0], 9).astype(int)[:-1], np.linspace(0, thumb.shape[1], 10).astype(int)[:-1]
    sums = np.add.reduceat(np.add.reduceat(thumb, rows, 0, dtype=np.int64), cols, 1)
    sizes = np.maximum(np.diff(np.append(rows, thumb.shape[0])), 1)[:, None] * np.maximum(np.diff(np.append(cols, thumb.shape[1])), 1)[None]
    mean = sums * 1_000_000 // sizes
    return np.packbits((mean[:, 1:] > mean[:, :-1]).ravel()).tobytes().hex()


def describe(media: list[bytes | None]) -> list[dict | None]:
    """Payload, dimensions and thumbnail hashes of each media value; None for what is null, damaged or no baseline image.

    Files are decoded together; only if one of them turns out to be damaged,
    each by itself. Several frames in a file have their hashes joined in order.
    """
    parsed: list[list[Frame] | None] = []
    for m in media:
        try:
            parsed.append(parse(m) if m else None)
        except DAMAGE:
            parsed.append(None)
    try:
        together = iter(dc_thumbnails([f for frames in parsed for f in frames or []]))
        thumbs = [[next(together) for _ in frames or []] for frames in parsed]
    except DAMAGE:
        thumbs = [_alone(frames) for frames in parsed]
    out: list[dict | None] = []
    for frames, own in zip(parsed, thumbs, strict=True):
        try:
            out.append(_description(frames, own) if frames and own else None)
        except DAMAGE:
            out.append(None)
    return out


def _alone(frames: list[Frame] | None) -> list[np.ndarray] | None:
    try:
        return dc_thumbnails(frames) if frames else None
    except DAMAGE:
        return None


def _description(frames: list[Frame], thumbs: list[np.ndarray]) -> dict:
    stored = all(len(f.comment) == len(MAGIC) + 8 and f.comment.startswith(MAGIC) for f in frames)
    payload = decode_samples(frames, thumbs) if stored else None
    return {"payload": payload, "dims": "+".join(f"{f.width}x{f.height}" for f in frames), "hash": "+".join(map(difference_hash, thumbs))}


# ---------------------------------------------------------------- Spark


def padded(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of ``UNIT``."""
    return data + b"\xff" * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def store_media(df: DataFrame, text_col: str = "text", out: str = "media") -> DataFrame:
    """Append ``out`` (binary): the padded UTF-8 text as a JPEG file. A null text counts as empty. No shuffle."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for block in text_blocks(texts, rows=1000, max_bytes=4 << 20):
                yield pa.array([encode_samples(padded((t or "").encode())) for t in block.to_pylist()], pa.binary())

    return df.withColumn(out, run(F.col(text_col)))


def read_media(df: DataFrame, media_col: str = "media", out: str = "image") -> DataFrame:
    """Append ``out``: struct of payload, its digests, dimensions and thumbnail hash, from JPEG bytes alone.

    All fields are null for null media and for what is not a baseline image or
    is damaged, which does not touch the rows beside it; the payload is null for
    images that ``store_media`` did not write.
    """
    kind = pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("dims", pa.string()), ("hash", pa.string())])

    @F.arrow_udf("payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, dims string, hash string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for media in batches:
            for block in text_blocks(media, rows=500, max_bytes=2 << 20):
                rows = []
                for d in describe(block.to_pylist()):
                    p = d and d["payload"]
                    has = p is not None
                    rows.append({"payload_bytes": len(p) if has else None, "payload_sha256": hashlib.sha256(p).hexdigest() if has else None, "tail_crc32": zlib.crc32(p[-32:]) if has else None, "dims": d and d["dims"], "hash": d and d["hash"]})
                yield pa.array(rows, kind)

    return df.withColumn(out, run(F.col(media_col)))


def op8_jpeg_media(spark, sf_dir):
    """Contract: sizes and digests of each text's padded payload and of its stored JPEG, read back, and a feature."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    read = read_media(store_media(docs.withColumn("n_bytes", n_bytes)))
    return read.select(
        "doc_id",
        "n_bytes",
        "image.payload_bytes",
        "image.payload_sha256",
        "image.tail_crc32",
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", "image.dims", "image.hash").alias("feature"),
    )
