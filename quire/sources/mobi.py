"""MOBI databases: records, packed texts, tagged indexes, and the parts of a book.

Three ways to pack a text are read (none, PalmDOC, Huffman codes with a phrase
dictionary) and two ways to lay it out: one text cut by its index or by page
breaks, and skeletons whose fragments are put back at their places. Records are
read one by one from a seekable file; the text of a book is in memory once.
Whatever does not hold together raises ``ValueError``.
"""

from __future__ import annotations

import io
import locale
import re
import struct
from typing import BinaryIO, NamedTuple

NONE, PALMDOC, HUFFMAN = 1, 2, 17480
_NO_RECORD = 0xFFFFFFFF
#: A text record expands to this much at most, and a phrase to its own bound: nested phrases could otherwise double without end.
MOST_RECORD, MOST_PHRASE, MOST_DEPTH = 1 << 20, 1 << 16, 32
_BREAK = re.compile(rb"(?i)<mbp:pagebreak[^>]*/?>(?:</mbp:pagebreak>)?")


class Part(NamedTuple):
    path: str
    markup: str
    title: str | None


def _need(condition, what: str) -> None:
    if not condition:
        raise ValueError(what)


def language_of(code: int) -> str | None:
    """Language tag of a locale number (dialect and language bytes), by the standard library's table of Windows locales."""
    known = locale.windows_locale
    if code >> 8 and code in known:
        return known[code].replace("_", "-")
    return next((tag.split("_")[0] for number, tag in sorted(known.items()) if number & 0xFF == code & 0xFF and number & 0x300 == 0), None) if code & 0xFF else None


class Database:
    """Numbered records of a file."""

    def __init__(self, file: BinaryIO):
        self.file = file
        head = self._read(0, 78)
        _need(len(head) == 78 and head[60:68] in (b"BOOKMOBI", b"TEXtREAd"), "no such database")
        (count,) = struct.unpack(">H", head[76:78])
        table = self._read(78, 8 * count)
        _need(count and len(table) == 8 * count, "cut off")
        self.name = head[:32].split(b"\0")[0].decode("latin-1")
        self.starts = [at for at, _ in struct.iter_unpack(">II", table)] + [file.seek(0, io.SEEK_END)]
        _need(all(a <= b for a, b in zip(self.starts, self.starts[1:])), "records out of order")

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def record(self, k: int) -> bytes:
        _need(0 <= k < len(self.starts) - 1, f"no record {k}")
        return self._read(self.starts[k], self.starts[k + 1] - self.starts[k])


# ------------------------------------------------------------------ packing


def palmdoc(data: bytes) -> bytes:
    """Literals, copies of up to ten bytes, spaces joined with a letter."""
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        i += 1
        if 1 <= c <= 8:
            out += data[i : i + c]
            i += c
        elif c < 0x80:
            out.append(c)
        elif c >= 0xC0:
            out += bytes((0x20, c ^ 0x80))
        else:
            _need(i < len(data), "damaged record")
            pair = c << 8 | data[i]
            i += 1
            back, n = (pair >> 3) & 0x7FF, (pair & 7) + 3
            _need(0 < back <= len(out), "damaged record")
            for _ in range(n):
                out.append(out[-back])
    return bytes(out)


class Phrases:
    """Huffman codes for the phrases of a dictionary; a phrase may itself be packed.

    Codes of a length are consecutive and shorter codes lie above longer ones, so
    a code's distance from the greatest of its length numbers its phrase. The
    first byte of a code tells its length, or where to begin to look for it.
    """

    def __init__(self, codes: bytes, dictionaries: list[bytes]):
        _need(codes[:8] == b"HUFF\0\0\0\x18", "no code table")
        by_byte, by_length = struct.unpack(">II", codes[8:16])
        _need(by_byte + 1024 <= len(codes) and by_length + 256 <= len(codes), "code table cut off")
        self.first = [(v & 31, bool(v & 128), v >> 8) for v in struct.unpack(">256I", codes[by_byte : by_byte + 1024])]
        ends = struct.unpack(">64I", codes[by_length : by_length + 256])
        self.least, self.most = (0, *ends[::2]), (0, *ends[1::2])
        #: (bytes, whether they are text already)
        self.phrases: list[tuple[bytes, bool]] = []
        for part in dictionaries:
            _need(part[:4] == b"CDIC" and len(part) >= 16, "no dictionary")
            size, total, bits = struct.unpack(">III", part[4:16])
            count = min(1 << min(bits, 31), total - len(self.phrases))
            _need(0 <= count and size + 2 * count <= len(part), "dictionary cut off")
            for (at,) in struct.iter_unpack(">H", part[size : size + 2 * count]):
                at += size
                _need(at + 2 <= len(part), "dictionary cut off")
                (n,) = struct.unpack(">H", part[at : at + 2])
                _need(at + 2 + (n & 0x7FFF) <= len(part), "dictionary cut off")
                self.phrases.append((part[at + 2 : at + 2 + (n & 0x7FFF)], bool(n & 0x8000)))
        self._open: set[int] = set()

    def unpack(self, data: bytes, most: int = MOST_RECORD) -> bytes:
        out, size, at, end = [], 0, 0, 8 * len(data)
        data += bytes(5)
        while at < end:
            code = int.from_bytes(data[at >> 3 : (at >> 3) + 5]) >> (8 - (at & 7)) & 0xFFFFFFFF
            length, known, most_code = self.first[code >> 24]
            _need(length, "no such code")
            if not known:
                while length <= 32 and code >> (32 - length) < self.least[length]:
                    length += 1
                _need(length <= 32, "no such code")
                most_code = self.most[length]
            at += length
            if at > end:  # bits that fill the last byte
                break
            phrase = self._phrase(most_code - (code >> (32 - length)))
            size += len(phrase)
            _need(size <= most, "a record that expands without end")
            out.append(phrase)
        return b"".join(out)

    def _phrase(self, number: int) -> bytes:
        _need(0 <= number < len(self.phrases), "no such phrase")
        phrase, plain = self.phrases[number]
        if not plain:
            _need(number not in self._open and len(self._open) < MOST_DEPTH, "a phrase within itself")
            self._open.add(number)
            phrase = self.unpack(phrase, MOST_PHRASE)
            self._open.discard(number)
            self.phrases[number] = phrase, True
        return phrase


def without_trailer(data: bytes, flags: int) -> bytes:
    """A text record without its trailing entries."""
    for bit in range(15, 0, -1):
        if flags >> bit & 1:
            n = 0
            for b in data[-4:]:
                n = (0 if b & 0x80 else n << 7) | b & 0x7F
            data = data[: max(0, len(data) - n)]
    if flags & 1 and data:
        data = data[: max(0, len(data) - ((data[-1] & 3) + 1))]
    return data


# ------------------------------------------------------------------ indexes


def number(data: bytes, at: int) -> tuple[int, int]:
    """A number in groups of seven bits, the last one marked, and the place behind it."""
    value = 0
    for k in range(at, min(at + 5, len(data))):
        value = value << 7 | data[k] & 0x7F
        if data[k] & 0x80:
            return value, k + 1
    raise ValueError("a number without end")


class Index:
    """Entries (label, {tag: numbers}) of a tagged index, and its pool of strings."""

    def __init__(self, record, first: int):
        head = record(first)
        _need(head[:4] == b"INDX" and len(head) >= 56, "no index")
        size, parts, strings = (struct.unpack(">I", head[k : k + 4])[0] for k in (4, 24, 52))
        self.coding = "utf-8" if struct.unpack(">I", head[28:32])[0] == 65001 else "cp1252"
        _need(head[size : size + 4] == b"TAGX", "an index without tags")
        table_end, self.control = struct.unpack(">II", head[size + 4 : size + 12])
        self.tags = list(struct.iter_unpack(">BBBB", head[size + 12 : size + table_end]))
        self.entries: list[tuple[bytes, dict[int, list[int]]]] = []
        for k in range(first + 1, first + 1 + parts):
            self._part(record(k))
        self.pool = [record(k) for k in range(first + 1 + parts, first + 1 + parts + strings)]

    def _part(self, data: bytes) -> None:
        _need(data[:4] == b"INDX" and len(data) >= 28, "no index")
        at, count = struct.unpack(">II", data[20:28])
        _need(data[at : at + 4] == b"IDXT" and at + 4 + 2 * count <= len(data), "an index without places")
        places = [*struct.unpack(f">{count}H", data[at + 4 : at + 4 + 2 * count]), at]
        for begin, end in zip(places, places[1:]):
            _need(begin < end, "entries out of order")
            entry = data[begin:end]
            self.entries.append((entry[1 : 1 + entry[0]], self._values(entry, 1 + entry[0])))

    def _values(self, entry: bytes, at: int) -> dict[int, list[int]]:
        """What the control bytes announce: how often a tag stands, or how many bytes its numbers take."""
        control, turn = entry[at : at + self.control], 0
        at += self.control
        _need(len(control) == self.control, "entry cut off")
        found: list[tuple[int, int, int, bool]] = []
        for tag, width, mask, last in self.tags:
            if last:
                turn += 1
                continue
            _need(turn < len(control) and mask, "no such control byte")
            set_bits = control[turn] & mask
            if set_bits == mask and mask.bit_count() > 1:
                n, at = number(entry, at)
                found.append((tag, width, n, True))
            elif set_bits:
                found.append((tag, width, set_bits // (mask & -mask), False))
        out: dict[int, list[int]] = {}
        for tag, width, n, in_bytes in found:
            end, values = at + n, out.setdefault(tag, [])
            while at < end if in_bytes else len(values) < n * width:
                value, at = number(entry, at)
                values.append(value)
        return out

    def text(self, place: int) -> str | None:
        """A string of the pool: records of 64 KB, numbered through."""
        k, at = place >> 16, place & 0xFFFF
        if k >= len(self.pool):
            return None
        n, at = number(self.pool[k], at)
        return self.pool[k][at : at + n].decode(self.coding, "replace")


# ------------------------------------------------------------------ books


class Book:
    """One book of a database; a file may hold an older and a newer form of it, the newer from record ``base`` on."""

    def __init__(self, data: Database, base: int = 0):
        self.data, self.base = data, base
        head = self.head = self.record(0)
        _need(len(head) >= 16, "no header")
        self.packing, _, _, self.count, _, encryption = struct.unpack(">HHIHHH", head[:14])
        _need(not encryption, "encrypted")
        _need(self.packing in (NONE, PALMDOC, HUFFMAN), "packed in another way")
        self.meta: dict[str, str] = {}
        self.coding, self.flags, self.version, self.newer = "cp1252", 0, 0, None
        if data.name:
            self.meta["title"] = data.name
        if head[16:20] == b"MOBI":
            self._mobi()

    def record(self, k: int) -> bytes:
        return self.data.record(self.base + k)

    def _field(self, at: int) -> int:
        """A number of the header, if the header goes that far."""
        return struct.unpack(">I", self.head[at : at + 4])[0] if at + 4 <= 16 + self.size and at + 4 <= len(self.head) else _NO_RECORD

    def _mobi(self) -> None:
        head = self.head
        self.size, _, code = struct.unpack(">III", head[20:32])
        self.coding = "utf-8" if code == 65001 else "cp1252"
        self.version = self._field(36)
        at, length = struct.unpack(">II", head[84:92])
        name = head[at : at + length].decode(self.coding, "replace")
        if name:
            self.meta["title"] = name
        language = language_of(self._field(92) & 0xFFFF)
        if language:
            self.meta["language"] = language
        if self.size >= 228:
            self.flags = struct.unpack(">H", head[242:244])[0]
        if struct.unpack(">I", head[128:132])[0] & 0x40:
            self._extra(head[16 + self.size :])

    def _extra(self, extra: bytes) -> None:
        if extra[:4] != b"EXTH":
            return
        at = 12
        for _ in range(struct.unpack(">I", extra[8:12])[0]):
            _need(at + 8 <= len(extra), "metadata cut off")
            kind, length = struct.unpack(">II", extra[at : at + 8])
            _need(length >= 8, "metadata cut off")
            raw = extra[at + 8 : at + length]
            value = raw.decode(self.coding, "replace")
            if kind == 100:
                self.meta.setdefault("author", value)
            elif kind == 503:
                self.meta["title"] = value
            elif kind == 524:
                self.meta["language"] = value
            elif kind == 121 and len(raw) == 4:
                self.newer = struct.unpack(">I", raw)[0]
            at += length

    def text(self) -> bytes:
        if self.packing == HUFFMAN:
            first, count = self._field(112), self._field(116)
            _need(_NO_RECORD not in (first, count) and 1 < count <= len(self.data.starts), "no code table")
            unpack = Phrases(self.record(first), [self.record(first + k) for k in range(1, count)]).unpack
        else:
            unpack = palmdoc if self.packing == PALMDOC else bytes
        return b"".join(unpack(without_trailer(self.record(k), self.flags)) for k in range(1, self.count + 1))

    def _index(self, at: int) -> Index | None:
        first = self._field(at)
        return None if first in (0, _NO_RECORD) else Index(self.record, first)

    def _contents(self) -> Index | None:
        """The table of contents; a damaged one says nothing, the text is still there."""
        try:
            return self._index(244)
        except (ValueError, struct.error):
            return None

    def parts(self) -> list[Part]:
        return self._fragments() if self.version >= 8 else self._pieces()

    def _pieces(self) -> list[Part]:
        """One text, cut where its index names chapters, else at page breaks."""
        text, listed = self.text(), {}
        contents = self._contents()
        for _, values in contents.entries if contents else ():
            if values.get(1) and values[1][0] <= len(text):
                listed.setdefault(values[1][0], contents.text(values[3][0]) if values.get(3) else None)
        if not listed:
            return [Part(f"part{k:04d}", x.decode(self.coding, "replace"), None) for k, x in enumerate(_BREAK.split(text))]
        cuts = sorted({0, len(text), *listed})
        pieces = [Part(f"part{k:04d}", text[a:b].decode(self.coding, "replace"), listed.get(a)) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        return pieces or [Part("part0000", "", None)]

    def _fragments(self) -> list[Part]:
        """Skeletons, each followed by the fragments that belong into it; the index of fragments says where."""
        text = self._flow()
        skeletons, fragments, contents = self._index(252), self._index(248), self._contents()
        _need(skeletons is not None, "no skeletons")
        places = [(int(label), values) for label, values in fragments.entries] if fragments else []
        parts, homes, at = [], [], 0
        for k, (_, values) in enumerate(skeletons.entries):
            _need(values.get(1) and len(values.get(6, ())) >= 2, "no skeleton")
            (count, *_), (begin, size, *_) = values[1], values[6]
            page, end = text[begin : begin + size], begin + size
            _need(at + count <= len(places), "fragments are missing")
            for place, inside in places[at : at + count]:
                _need(len(inside.get(6, ())) >= 2 and 0 <= place - begin <= len(page), "no place for a fragment")
                length = inside[6][1]
                page = page[: place - begin] + text[end : end + length] + page[place - begin :]
                end += length
            homes += [k] * count
            at += count
            parts.append(page)
        titles: dict[int, str | None] = {}
        for _, values in contents.entries if contents else ():
            fragment = values.get(6, [None])[0]
            if fragment is not None and fragment < len(homes) and values.get(3):
                titles.setdefault(homes[fragment], contents.text(values[3][0]))
        return [Part(f"part{k:04d}", p.decode(self.coding, "replace"), titles.get(k)) for k, p in enumerate(parts)]

    def _flow(self) -> bytes:
        """The markup alone; style sheets and images in text form follow it."""
        text, first = self.text(), self._field(192)
        if first != _NO_RECORD:
            table = self.record(first)
            if table[:4] == b"FDST" and len(table) >= 20:
                at = struct.unpack(">I", table[4:8])[0]
                begin, end = struct.unpack(">II", table[at : at + 8])
                return text[begin:end]
        return text


def read_mobi_parts(source: bytes | BinaryIO) -> tuple[dict, list[Part]]:
    """Metadata and parts of a book. Of a file with two forms the older is read, the newer where the older cannot be."""
    data = Database(io.BytesIO(source) if isinstance(source, bytes) else source)
    book = Book(data)
    try:
        return book.meta, book.parts()
    except ValueError:
        if book.newer is None:
            raise
        newer = Book(data, book.newer)
        return book.meta | newer.meta, newer.parts()
