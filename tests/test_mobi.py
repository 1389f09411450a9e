"""MOBI books packed by an encoder of its own: Huffman phrases, tagged indexes, skeletons with fragments, two forms in one file."""

import io
import random
import struct

import pytest

from quire.operators import chapters as C
from quire.sources.containers import read_books, read_mobi
from quire.sources.mobi import Index, Phrases, language_of, number, read_mobi_parts

NONE = 0xFFFFFFFF


def database(records, name=b"internal"):
    out, at = bytearray(name.ljust(32, b"\0") + bytes(28) + b"BOOKMOBI" + bytes(8) + struct.pack(">H", len(records))), 78 + 8 * len(records)
    for r in records:
        out += struct.pack(">II", at, 0)
        at += len(r)
    return bytes(out) + b"".join(records)


def header(packing, length, count, *, version=6, fields=(), exth=(), language=9, flags=0, title="Book"):
    extra = b"".join(struct.pack(">II", kind, 8 + len(v)) + v for kind, v in exth)
    extra = b"EXTH" + struct.pack(">II", 12 + len(extra), len(exth)) + extra if exth else b""
    head = bytearray(16 + 264)
    struct.pack_into(">HHIHHHH", head, 0, packing, 0, length, count, 4096, 0, 0)
    head[16:20] = b"MOBI"
    struct.pack_into(">III", head, 20, 264, 2, 65001)
    struct.pack_into(">I", head, 36, version)
    struct.pack_into(">II", head, 84, len(head) + len(extra), len(title))
    struct.pack_into(">I", head, 92, language)
    struct.pack_into(">I", head, 128, 0x40 if exth else 0)
    struct.pack_into(">H", head, 242, flags)
    for at in (192, 244, 248, 252):
        struct.pack_into(">I", head, at, NONE)
    for at, value in dict(fields).items():
        struct.pack_into(">I", head, at, value)
    return bytes(head) + extra + title.encode()


# ------------------------------------------------------------------ Huffman phrases


class Packer:
    """Short codes for the first phrases, long ones for the rest; phrases in ``nested`` are stored packed."""

    def __init__(self, phrases, nested=(), short=5, long=12, often=20):
        self.phrases, self.short, self.long, self.often = phrases, short, long, min(often, len(phrases))
        self.nested = nested

    def code(self, k):
        if k < self.often:
            return format(2**self.short - 1 - k, f"0{self.short}b")
        return format(((2**self.short - self.often) << (self.long - self.short)) - 1 - (k - self.often), f"0{self.long}b")

    def pack(self, text, without=None):
        bits, at, order = "", 0, sorted((i for i in range(len(self.phrases)) if i != without), key=lambda i: -len(self.phrases[i]))
        while at < len(text):
            k = next(i for i in order if text.startswith(self.phrases[i], at))
            bits += self.code(k)
            at += len(self.phrases[k])
        bits += "0" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))

    def records(self, bits=6):
        least_short = 2**self.short - self.often
        top = (least_short << (self.long - self.short)) - 1
        ends = [0] * 66
        for n in range(1, 33):  # lengths without codes have a least code that nothing reaches
            ends[2 * n], ends[2 * n + 1] = (2**n, 0) if n < self.long else (0, 0)
        ends[2 * self.short], ends[2 * self.short + 1] = least_short, 2**self.short - 1
        ends[2 * self.long], ends[2 * self.long + 1] = 0, top + self.often
        by_byte = []
        for b in range(256):
            known = b >> (8 - self.short) >= least_short
            by_byte.append(self.short | 0x80 | (2**self.short - 1) << 8 if known else self.short + 1)
        codes = b"HUFF" + struct.pack(">IIIII", 24, 24, 24 + 1024, 0, 0) + struct.pack(">256I", *by_byte) + struct.pack(">64I", *[min(x, NONE) for x in ends[2:66]])
        out = [codes]
        for at in range(0, len(self.phrases), 2**bits):
            some = range(at, min(at + 2**bits, len(self.phrases)))
            body, places = b"", []
            for k in some:
                places.append(2 * len(some) + len(body))
                data = self.pack(self.phrases[k], without=k) if k in self.nested else self.phrases[k]
                body += struct.pack(">H", len(data) | (0 if k in self.nested else 0x8000)) + data
            out.append(b"CDIC" + struct.pack(">III", 16, len(self.phrases), bits) + struct.pack(f">{len(some)}H", *places) + body)
        return out


def corpus(seed=1, n=3000):
    pick = random.Random(seed)
    words = ["the ", "river ", "höhe ", "walked ", "<p>", "</p>", "and then ", "stone. "]
    return "".join(pick.choice(words) for _ in range(n)).encode()


def huffman_book(text, fields=(), nested=True, damage=None):
    """Letters, words, and phrases of words that are packed themselves."""
    letters = [bytes([b]) for b in range(256)]
    words = [w.encode() for w in ("the ", "river ", "walked ", "<p>", "</p>", "and then ")]
    phrases = [*words, *letters, b"the river ", b"the river the river walked ", b"<p>the river "]
    packer = Packer(phrases, nested={len(phrases) - 3, len(phrases) - 2, len(phrases) - 1} if nested else ())
    chunks = [text[i : i + 4096] for i in range(0, len(text), 4096)]
    packed = [packer.pack(c) for c in chunks]
    tables = packer.records()
    if damage:
        tables = damage(tables)
    first = 1 + len(packed)
    head = header(17480, len(text), len(packed), fields={112: first, 116: len(tables), **dict(fields)}, exth=[(100, "Jörg".encode())])
    return [head, *packed, *tables]


def test_huffman_text_is_the_plain_one():
    text = corpus()
    packed = huffman_book(text)
    assert sum(map(len, packed[1:5])) < len(text)
    plain = [header(1, len(text), (len(text) + 4095) // 4096, exth=[(100, "Jörg".encode())]), *[text[i : i + 4096] for i in range(0, len(text), 4096)]]
    assert read_mobi(database(packed)) == read_mobi(database(plain))
    meta, parts = read_mobi(database(packed))
    assert meta == {"title": "Book", "author": "Jörg", "language": "en"} and parts[0][1].encode() == text


@pytest.mark.parametrize("damage", [
    lambda t: [b"HUFX" + t[0][4:], *t[1:]],
    lambda t: [t[0][:900], *t[1:]],
    lambda t: [t[0], b"CDIX" + t[1][4:], *t[2:]],
    lambda t: [t[0], t[1][:40], *t[2:]],
    lambda t: [t[0], *t[2:]],
    lambda t: [t[0]],
    lambda t: [t[0][:24] + bytes(1024) + t[0][1048:], *t[1:]],
])
def test_damaged_dictionaries_are_errors(damage):
    with pytest.raises(ValueError):
        read_mobi(database(huffman_book(corpus(), damage=damage)))


def test_phrases_cannot_run_away():
    packer = Packer([b"a", b"bb"], often=2, short=2)
    codes, words = packer.records()
    assert Phrases(codes, [words]).unpack(packer.pack(b"abbabb")) == b"abbabb"
    own = b"CDIC" + struct.pack(">III", 16, 2, 6) + struct.pack(">HH", 4, 7) + struct.pack(">H", 1 | 0x8000) + b"a" + struct.pack(">H", 1) + bytes([0b10101010])
    with pytest.raises(ValueError, match="within itself"):
        Phrases(codes, [own]).unpack(bytes([0b10101010]))
    # forty phrases, each twice the next: 2**40 bytes from a few hundred
    chain = Packer([b"x" * (k + 1) for k in range(40)], short=7, often=40)
    body, places = b"", []
    for k in range(40):
        places.append(80 + len(body))
        bits = chain.code(k + 1) * 2 if k < 39 else ""
        bits += "1" * 0 + "0" * (-len(bits) % 8)
        data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)) if bits else b"x"
        body += struct.pack(">H", len(data) | (0x8000 if k == 39 else 0)) + data
    bomb = b"CDIC" + struct.pack(">III", 16, 40, 6) + struct.pack(">40H", *places) + body
    with pytest.raises(ValueError):
        Phrases(chain.records()[0], [bomb]).unpack(bytes([0b11111110]))


# ------------------------------------------------------------------ indexes


def vwi(n):
    out = [n & 0x7F | 0x80]
    while n := n >> 7:
        out.append(n & 0x7F)
    return bytes(out[::-1])


def index(tags, entries, pool=(), parts=1, coding=65001):
    """Records of an index: (tag, numbers per entry, mask) rows in one control byte; entries are (label, {tag: [numbers]})."""
    table = b"".join(struct.pack(">BBBB", *t, 0) for t in tags) + b"\0\0\0\1"
    strings, places = b"", []
    for s in pool:
        places.append(len(strings))
        strings += vwi(len(s.encode())) + s.encode()

    def entry(label, values):
        control, first, body = 0, b"", b""
        for tag, width, mask in tags:
            if tag in values:
                n = len(values[tag]) // width
                low = mask & -mask
                numbers = b"".join(vwi(places[v] if tag == 3 and pool else v) for v in values[tag])
                if n * low < mask or mask == low:
                    control |= n * low
                else:  # too many for the mask: all its bits, and the length in bytes
                    control |= mask
                    first += vwi(len(numbers))
                body += numbers
        return bytes([len(label)]) + label + bytes([control]) + first + body

    def part(some):
        body, at = b"", []
        for e in some:
            at.append(192 + len(body))
            body += entry(*e)
        out = b"INDX" + struct.pack(">IIIIII", 192, 0, 1, 0, 192 + len(body), len(some))
        return out.ljust(192, b"\0") + body + b"IDXT" + struct.pack(f">{len(at)}H", *at)

    step = -(-len(entries) // parts) or 1
    bodies = [part(entries[i : i + step]) for i in range(0, len(entries), step)]
    head = bytearray(b"INDX".ljust(192, b"\0"))
    struct.pack_into(">I", head, 4, 192)
    struct.pack_into(">III", head, 20, 0, len(bodies), coding)
    struct.pack_into(">I", head, 52, 1 if strings else 0)
    return [bytes(head) + b"TAGX" + struct.pack(">II", 12 + len(table), 1) + table, *bodies, *([strings] if strings else [])]


def test_numbers_and_values():
    for n in (0, 1, 127, 128, 300, 16383, 16384, 2**28 - 1):
        assert number(b"\xff" + vwi(n) + b"\x05", 1) == (n, 1 + len(vwi(n)))
    with pytest.raises(ValueError):
        number(b"\x01\x02", 0)
    tags = [(1, 1, 1), (2, 2, 6), (3, 1, 8)]
    entries = [(b"a", {1: [300]}), (b"bc", {2: [1, 2]}), (b"", {1: [5], 2: [1, 2, 3, 4, 5, 200000], 3: [1]}), (b"d", {3: [0]})]
    records = index(tags, entries, ["Eins", "Zwei ö"], parts=2)
    found = Index(records.__getitem__, 0)
    assert [(label, values) for label, values in found.entries][1] == (b"bc", {2: [1, 2]})
    assert found.entries[2][1] == {1: [5], 2: [1, 2, 3, 4, 5, 200000], 3: [found.entries[2][1][3][0]]}
    assert found.text(found.entries[2][1][3][0]) == "Zwei ö" and found.text(found.entries[3][1][3][0]) == "Eins" and found.text(1 << 20) is None


NCX = [(1, 1, 1), (2, 1, 2), (3, 1, 4), (4, 1, 8)]
PROSE = "It was a long day and nothing happened. " * 30


def listed_book(contents=None, **more):
    parts = ["<p>Front</p>", f"<h2>One</h2><p>{PROSE}</p>", f"<p>No heading ö {PROSE}</p><mbp:pagebreak/>", f"<p>Last {PROSE}</p>"]
    text = "".join(parts).encode()
    at = [sum(len(p.encode()) for p in parts[:k]) for k in range(4)]
    records = [text[i : i + 4096] for i in range(0, len(text), 4096)]
    entries = contents or [(b"1", {1: [at[1]], 2: [9], 3: [0], 4: [0]}), (b"2", {1: [at[2]], 3: [1], 4: [0]}), (b"3", {1: [at[2]], 3: [2], 4: [1]}), (b"4", {1: [at[3]], 3: [3], 4: [0]})]
    listed = index(NCX, entries, ["Eins", "Zwei", "Zwei a", "Drei"], parts=2)
    return [header(1, len(text), len(records), fields={244: 1 + len(records)}, **more), *records, *listed], parts


def test_parts_follow_the_index():
    records, parts = listed_book()
    _, found = read_mobi_parts(database(records))
    assert [p.markup for p in found] == parts and [p.title for p in found] == [None, "Eins", "Zwei", "Drei"]
    # a damaged index leaves the page breaks
    records[-1 - 2] = b"INDX"
    assert len(read_mobi_parts(database(records))[1]) == 2


# ------------------------------------------------------------------ skeletons and fragments


def new_form(base=0, exth=()):
    """Two files, one of two fragments, one of a skeleton alone; a style sheet follows the markup."""
    skeletons = ["<html><body></body></html>", "<html><p>alone</p></html>"]
    fragments = [f"<h1>One</h1><p>{PROSE}</p>", f"<p>more ü {PROSE}</p>"]
    text = (skeletons[0] + fragments[0] + fragments[1] + skeletons[1]).encode()
    flow, first = len(text), len(skeletons[0])
    one, two = (len(f.encode()) for f in fragments)
    text += b"p { color: red }"
    records = [text[i : i + 4096] for i in range(0, len(text), 4096)]
    skel = index([(1, 1, 3), (6, 2, 12)], [(b"SKEL0", {1: [2], 6: [0, first]}), (b"SKEL1", {1: [0], 6: [first + one + two, len(skeletons[1])]})])
    # the second fragment goes behind the first one
    frag = index([(2, 1, 1), (3, 1, 2), (4, 1, 4), (6, 2, 8)], [(b"%010d" % 12, {2: [0], 3: [0], 4: [0], 6: [0, one]}), (b"%010d" % (12 + one), {2: [0], 3: [0], 4: [1], 6: [one, two]})])
    toc = index([(1, 1, 1), (3, 1, 2), (6, 2, 4)], [(b"0", {1: [0], 3: [0], 6: [1, 0]})], ["Kapitel eins"])
    at = 1 + len(records)
    fields = {252: at, 248: at + len(skel), 244: at + len(skel) + len(frag), 192: at + len(skel) + len(frag) + len(toc)}
    table = b"FDST" + struct.pack(">II", 12, 2) + struct.pack(">IIII", 0, flow, flow, len(text))
    want = ["<html><body>" + fragments[0] + fragments[1] + "</body></html>", skeletons[1]]
    return [header(1, len(text), len(records), version=8, fields=fields, exth=exth, title="New", language=0x407), *records, *skel, *frag, *toc, table], want


def test_fragments_go_back_into_skeletons():
    records, want = new_form()
    meta, found = read_mobi_parts(database(records))
    assert [p.markup for p in found] == want and [p.title for p in found] == ["Kapitel eins", None]
    assert meta == {"title": "New", "language": "de-DE"}


def test_two_forms_in_one_file():
    new, want = new_form()
    old, parts = listed_book()
    base = len(old) + 1
    old, _ = listed_book(exth=[(100, b"Ann"), (121, struct.pack(">I", base))])
    both = [*old, b"BOUNDARY", *new]
    meta, found = read_mobi_parts(database(both))
    assert [p.markup for p in found] == parts and meta["author"] == "Ann"
    # the old text cannot be read: the new one is
    broken = [old[0][:0] + struct.pack(">H", 2) + old[0][2:], b"\x80", *old[2:], b"BOUNDARY", *new]
    meta, found = read_mobi_parts(database(broken))
    assert [p.markup for p in found] == want and meta == {"title": "New", "author": "Ann", "language": "de-DE"}


def test_missing_fragments_are_errors():
    records, _ = new_form()
    for k in (1, len(records) - 8):
        cut = [*records]
        cut[k] = b""
        with pytest.raises((ValueError, struct.error)):
            parts = read_mobi_parts(database(cut))[1]
            assert k != 1 or not parts[0].markup  # an emptied text leaves nothing
            raise ValueError


def test_languages():
    assert [language_of(x) for x in (9, 7, 17, 18, 4, 25, 0x409, 0x816, 0)] == ["en", "de", "ja", "ko", "zh", "ru", "en-US", "pt-PT", None]
    assert len({language_of(x) for x in range(1, 0x90)}) > 80


@pytest.mark.parametrize("seed", range(40))
def test_noise_is_an_error_or_a_book(seed):
    """Flipped bytes and cut files raise nothing but errors of the format."""
    pick = random.Random(seed)
    data = bytearray(database(pick.choice([huffman_book(corpus(n=300)), listed_book()[0], new_form()[0]])))
    for _ in range(20):
        data[pick.randrange(len(data))] = pick.randrange(256)
    data = data[: pick.randrange(100, len(data))] if seed % 3 == 0 else data
    try:
        read_mobi_parts(io.BytesIO(bytes(data)))
    except (ValueError, struct.error, IndexError):
        pass


def test_chapters_from_files(spark, tmp_path):
    (tmp_path / "listed.mobi").write_bytes(database(listed_book()[0]))
    (tmp_path / "packed.MOBI").write_bytes(database(huffman_book(corpus())))
    (tmp_path / "new.mobi").write_bytes(database(new_form()[0]))
    (tmp_path / "broken.mobi").write_bytes(database(huffman_book(corpus(), damage=lambda t: t[:1])))
    books = {r.book_id.rsplit("/", 1)[1]: r for r in C.book_documents(read_books(spark, str(tmp_path), "mobi"), "mobi").collect()}
    assert [c.title for c in books["listed.mobi"].all_chapters] == ["Chapter 1", "One", "Zwei", "Drei"]
    assert [c.title for c in books["new.mobi"].all_chapters] == ["One", "Chapter 2"] and books["new.mobi"].language == "de-DE"
    assert books["packed.MOBI"].total_chapters == 1 and books["broken.mobi"].content.startswith("Error: Failed to parse MOBI")
