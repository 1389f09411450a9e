"""JPEG: exact round trips, and images with AC coefficients and subsampled colour from a second, plain encoder."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import jpeg as J


def plain_jpeg(planes, sampling, quant, restart=0, seed=0):
    """Code given quantised blocks: ``planes[c]`` is rows x columns x 64 (zigzag), one bit at a time, with full AC codes."""
    ac_symbols = [0x00, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 11)]
    counts = [0] * 16
    counts[7], counts[8] = 100, len(ac_symbols) - 100
    dc, ac = {s: (c, n) for c, n, s in J._codes(J.DC_COUNTS, J.DC_SYMBOLS)}, {s: (c, n) for c, n, s in J._codes(counts, ac_symbols)}
    h, v = max(s[0] for s in sampling), max(s[1] for s in sampling)
    rows, cols = planes[0].shape[0] // sampling[0][1], planes[0].shape[1] // sampling[0][0]
    out, bits, previous, sent = bytearray(), [], [0] * len(planes), 0

    def put(code, n):
        bits.extend((code >> i) & 1 for i in range(n - 1, -1, -1))

    def number(x):
        s = abs(x).bit_length()
        return s, x if x >= 0 else x + (1 << s) - 1

    def flush():
        while len(bits) % 8:
            bits.append(1)
        for i in range(0, len(bits), 8):
            b = int("".join(map(str, bits[i : i + 8])), 2)
            out.append(b)
            if b == 255:
                out.append(0)
        bits.clear()

    for m in range(rows * cols):
        if restart and m and m % restart == 0:
            flush()
            out.extend([255, 0xD0 + (m // restart - 1) % 8])
            previous = [0] * len(planes)
        y, x = divmod(m, cols)
        for c, (sh, sv) in enumerate(sampling):
            for by in range(sv):
                for bx in range(sh):
                    block = planes[c][y * sv + by, x * sh + bx].tolist()
                    s, e = number(block[0] - previous[c])
                    previous[c] = block[0]
                    put(*dc[s])
                    put(e, s)
                    run = 0
                    last = max([i for i in range(1, 64) if block[i]], default=0)
                    for i in range(1, last + 1):
                        if not block[i]:
                            run += 1
                            continue
                        while run > 15:
                            put(*ac[0xF0])
                            run -= 16
                        s, e = number(block[i])
                        put(*ac[run << 4 | s])
                        put(e, s)
                        run = 0
                    if last < 63:
                        put(*ac[0x00])
    flush()
    n = len(planes)
    frame = bytes([8]) + (rows * v * 8).to_bytes(2, "big") + (cols * h * 8).to_bytes(2, "big") + bytes([n]) + b"".join(bytes([c + 1, s[0] << 4 | s[1], 0]) for c, s in enumerate(sampling))
    head = b"\xff\xd8" + J._segment(0xE0, b"JFIF\0...") + J._segment(0xDB, bytes([0, quant]) + bytes([3]) * 63) + J._segment(0xC0, frame)
    head += J._segment(0xC4, bytes([0, *J.DC_COUNTS, *J.DC_SYMBOLS, 0x10, *counts, *ac_symbols]))
    if restart:
        head += J._segment(0xDD, restart.to_bytes(2, "big"))
    return head + J._segment(0xDA, bytes([n, *[x for c in range(n) for x in (c + 1, 0)], 0, 63, 0])) + bytes(out) + b"\xff\xd9"


@pytest.mark.parametrize("sampling,restart", [([(1, 1)], 0), ([(1, 1)], 3), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 2)])
def test_images_of_another_encoder(sampling, restart):
    rng = np.random.default_rng(3)
    planes = []
    for sh, sv in sampling:
        p = np.zeros((4 * sv, 5 * sh, 64), int)
        p[:, :, 0] = rng.integers(-60, 60, p.shape[:2])
        for k in (1, 2, 17, 40, 63):
            p[:, :, k] = rng.integers(-9, 10, p.shape[:2]) * (rng.random(p.shape[:2]) < 0.4)
        planes.append(p)
    data = plain_jpeg(planes, sampling, 16, restart)
    frames = J.parse(data)
    want = np.clip((planes[0][:, :, 0] * 16 + 4 >> 3) + 128, 0, 255)
    assert (J.dc_thumbnails(frames)[0] == want).all()
    d = J.describe([data])[0]
    assert d["payload"] is None and d["dims"] == f"{frames[0].width}x{frames[0].height}" and len(d["hash"]) == 16


def test_zigzag_order():
    z = J.zigzag()
    assert sorted(z) == list(range(64)) and z[:11].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32] and z[-1] == 63


@pytest.mark.parametrize("n", [1, 2, 575, 576, 577, 24 * 8191, 24 * 8191 + 1])
def test_samples_come_back(n):
    data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    frames = J.parse(J.encode_samples(data))
    assert J.decode_samples(frames, J.dc_thumbnails(frames)) == data


def test_several_frames(monkeypatch):
    monkeypatch.setattr(J, "MAX_SIDE", 576)
    data = bytes(range(256)) * 3000
    media = J.encode_samples(data)
    frames = J.parse(media)
    assert len(frames) == 3 and J.decode_samples(frames, J.dc_thumbnails(frames)) == data


def test_what_is_no_baseline_image():
    good = J.encode_samples(b"abc" * 300)
    progressive = good.replace(b"\xff\xc0", b"\xff\xc2", 1)
    assert J.describe([None, b"", b"GIF89a", good[:40], good[:-2], progressive]) == [None] * 6
    assert J.describe([good])[0]["payload"] == b"abc" * 300


def test_query(spark, odd_dir, documents, empty_dir):
    got = J.op8_jpeg_media(spark, odd_dir).collect()
    want = Counter()
    for d in documents:
        raw = (d["text"] or "").encode()
        p = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        want[d["doc_id"], len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    texts = {}
    for d, r in zip(sorted(documents, key=lambda d: str(d["doc_id"])), sorted(got, key=lambda r: str(r.doc_id)), strict=True):
        own = (r.media_bytes, r.media_sha256, r.feature)
        assert r.feature and texts.setdefault((d["text"] or "") if d["doc_id"] != 1 else None, own) == own or d["doc_id"] == 1
    assert J.op8_jpeg_media(spark, empty_dir).collect() == []


def test_bands_leave_the_bytes_alone(monkeypatch):
    """The same images whatever the bands, and the same samples from them."""
    rng = np.random.default_rng(4)
    for n in (1, 577, 30_000, 24 * 8191 + 5):
        data = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        monkeypatch.setattr(J, "BAND", 1 << 40)
        whole = J.encode_samples(data)
        for band, coded in ((1, 1), (700, 5000), (1 << 16, 1 << 20)):
            monkeypatch.setattr(J, "BAND", band)
            monkeypatch.setattr(J, "CODED", coded)
            assert J.encode_samples(data) == whole
            frames = J.parse(whole)
            assert J.decode_samples(frames, J.dc_thumbnails(frames)) == data


def test_a_very_long_text_in_bounded_memory():
    """20 MB: coding takes a fraction of what whole-image arrays of 8 bytes a sample would."""
    import tracemalloc

    data = b"a text without an end, or nearly so. " * (20 * (1 << 20) // 37)
    tracemalloc.start()
    media = J.encode_samples(data)
    assert tracemalloc.get_traced_memory()[1] < 90 << 20
    tracemalloc.reset_peak()
    back = J.describe([media])[0]["payload"]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert back == data and peak < 450 << 20
