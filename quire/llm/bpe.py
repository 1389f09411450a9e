"""Word-level byte-pair encoding with word ends, as the public tokenizer file describes it.

Three pieces are shared by the token counter, the encoder/decoder and the
table writer:

* ``WordBpe``: vocabulary, merge ranks and the byte alphabet of a ``.json`` file;
* ``PreTokenizer``: normalisation and splitting, exact to the library;
* ``WordCache``: bounded memory of words already merged, per Python worker.
"""

from __future__ import annotations

import hashlib
import json
import re
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Ranges of characters on which Python's and Arrow's Unicode tables are checked (in the tests, one by
#: one) to agree with the library's, and which NFC leaves alone wherever they stand. Texts with any other
#: character are split by the library's own normaliser and pre-tokenizer.
SAFE_RANGES = (
    (0x0000, 0x001B), (0x0020, 0x012F), (0x0131, 0x02FF), (0x0370, 0x0373), (0x0375, 0x037D), (0x037F, 0x0386), (0x0388, 0x03A2),
    (0x03A4, 0x0482), (0x048A, 0x052F), (0x1E00, 0x1EFF), (0x2002, 0x206F), (0x20A0, 0x20BF), (0x2100, 0x2125), (0x212C, 0x218B),
    (0x2190, 0x2328), (0x232B, 0x23FF), (0x2500, 0x27BF), (0x3000, 0x3029), (0x3030, 0x3096), (0x309B, 0x30FF), (0x3400, 0x4DBF),
    (0x4E00, 0x9FEF), (0xAC00, 0xD7A3), (0xFF01, 0xFF5E),
)
_UNSAFE = re.compile("[^" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in SAFE_RANGES) + "]")
_UNSAFE_RE2 = "[^" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in SAFE_RANGES) + "]"
_ASCII = re.compile(r"[a-z]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\sa-z0-9]+")


def state_key(raw: str) -> str:
    """Names what a worker keeps for a tokenizer file, by the file's content."""
    return hashlib.sha256(raw.encode()).hexdigest()


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in printable}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(printable))
    return [table[b] for b in range(256)]


class WordBpe:
    """Vocabulary and merges of a tokenizer file. Plain data: it is broadcast, its size is the vocabulary's."""

    def __init__(self, raw: str):
        spec = json.loads(raw)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or not model.get("end_of_word_suffix"):
            raise ValueError("a BPE model with word ends is needed")
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.tokens: list[str] = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        letters = byte_alphabet()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + self.suffix] for c in letters]
        self.left, self.right, self.result = [], [], []
        self.ranks: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.left.append(vocab[a])
            self.right.append(vocab[b])
            self.result.append(vocab[a + b])
            self.ranks[vocab[a] << 20 | vocab[b]] = rank
        self._inner_ids, self._final_ids = np.array(self.inner, np.int64), np.array(self.final, np.int64)
        self._first_ranks = self._byte_pairs()
        self._bytes = {c: b for b, c in enumerate(letters)}
        self.vocab_strings = list(vocab)

    def _byte_pairs(self) -> np.ndarray:
        """Ranks of all pairs of symbols that stand for bytes (-1: none)."""
        n = 1 + max(*self.inner, *self.final)
        table = np.full((n, n), -1, np.int32)
        for rank, (a, b) in enumerate(zip(self.left, self.right, strict=True)):
            if a < n and b < n:
                table[a, b] = rank
        return table

    def symbols(self, word: str) -> list[int]:
        raw = word.encode()
        inner = self.inner
        return [inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]

    def merge_word(self, word: str) -> list[int]:
        """One word at a time: the pair of least rank, leftmost first, until no pair has a rank."""
        sym, ranks = self.symbols(word), self.ranks
        while len(sym) > 1:
            best, at = None, -1
            for i in range(len(sym) - 1):
                r = ranks.get(sym[i] << 20 | sym[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            sym[at : at + 2] = [self.result[best]]
        return sym

    def count_words(self, words: list[str]) -> list[int]:
        """Tokens of each word; long ones, on which ``merge_word`` is quadratic, are merged together by ``merge_block``."""
        many = [w for w in words if len(w) > 40]
        long = dict(zip(many, self.merge_block(many)[0].tolist(), strict=True)) if many else {}
        return [long[w] if w in long else len(self.merge_word(w)) for w in words]

    def whole_words(self) -> frozenset[str]:
        """The words proved to encode alone as the one token that spells them.

        Each vocabulary string that ends a word is turned back into text and
        merged in full; it counts only if just its own token comes out.
        """
        proved = set()
        for token in self.vocab_strings:
            body = token.removesuffix(self.suffix)
            if body == token or not body:
                continue
            try:
                word = bytes(self._bytes[c] for c in body).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            ids = self.merge_word(word)
            if len(ids) == 1 and self.tokens[ids[0]] == token:
                proved.add(word)
        return frozenset(proved)

    def merge_block(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Merge many words together through an index from each pair to all its positions.

        All words lie in one linked row of symbols. A pair is known by its rank;
        ``places[rank]`` lists where it stands. Active ranks are taken in
        ascending order. A merge puts the two pairs it makes into the lists of
        their ranks; entries whose pair is gone are skipped when met. If a merge
        makes a pair of lower rank, the rest of the list waits, so each word
        sees the same order as if it were merged alone. Returns the number of ids
        of each word and all ids in the words' order.
        """
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        starts = np.cumsum(size) - size
        row = np.frombuffer(b"".join(raw), np.uint8)
        n = len(row)
        if not n:
            return size, np.zeros(0, np.int32)
        first = self._inner_ids[row]
        last = starts + size - 1
        first[last] = self._final_ids[row[last]]
        follow, back = np.arange(1, n + 1), np.arange(-1, n - 1)
        follow[last] = back[starts] = -1
        sym, after, before = first.tolist(), follow.tolist(), back.tolist()
        ranks, left, right, result = self.ranks, self.left, self.right, self.result
        rank_of = ranks.get
        pair = self._first_ranks[first[:-1], first[1:]]
        pair[follow[:-1] < 0] = -1
        at = np.flatnonzero(pair >= 0)
        at = at[np.argsort(pair[at], kind="stable")]
        found, cut = np.unique(pair[at], return_index=True)
        places: dict[int, list[int]] = {r: p.tolist() for r, p in zip(found.tolist(), np.split(at, cut[1:]), strict=True)} if len(at) else {}
        active = sorted(places)
        while active:
            rank = heappop(active)
            here = places.pop(rank)
            here.sort()
            a, b, new = left[rank], right[rank], result[rank]
            for i, p in enumerate(here):
                if sym[p] != a:
                    continue
                q = after[p]
                if q < 0 or sym[q] != b:
                    continue
                sym[p], sym[q] = new, -1
                lower = False
                q = after[p] = after[q]
                if q >= 0:
                    before[q] = p
                    r = rank_of(new << 20 | sym[q])
                    if r is not None:
                        lower = r < rank
                        if r in places:
                            places[r].append(p)
                        else:
                            places[r] = [p]
                            heappush(active, r)
                q = before[p]
                if q >= 0:
                    r = rank_of(sym[q] << 20 | new)
                    if r is not None:
                        lower = lower or r < rank
                        if r in places:
                            places[r].append(q)
                        else:
                            places[r] = [q]
                            heappush(active, r)
                if lower and i + 1 < len(here):
                    places[rank] = here[i + 1 :]
                    heappush(active, rank)
                    break
        end = np.array(sym, np.int32)
        alive = end >= 0
        return np.add.reduceat(alive, starts, dtype=np.int64), end[alive]


class PreTokenizer:
    """Words of a text in the library's sense; special strings come out whole."""

    def __init__(self, raw: str):
        spec = json.loads(raw)
        self.special = {t["content"] for t in spec["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._pattern = regex.compile(pattern)
        self._raw, self._source, self._library = raw, pattern, None

    def _segment(self, text: str) -> list[str]:
        if not _UNSAFE.search(text):
            return self.parts(text.lower())
        if self._library is None:
            from tokenizers import Regex, Tokenizer, pre_tokenizers

            self._library = (Tokenizer.from_str(self._raw).normalizer, pre_tokenizers.Split(Regex(self._source), "removed", invert=True))
        normalizer, split = self._library
        return [w for w, _ in split.pre_tokenize_str(normalizer.normalize_str(text))]

    def words(self, text: str) -> list[str]:
        if "<|" not in text:
            return self._segment(text)
        out: list[str] = []
        for k, part in enumerate(self._cut.split(text)):
            if k % 2:
                out.append(part)
            elif part:
                out += self._segment(part)
        return out

    def parts(self, unit: str) -> list[str]:
        """Words of one piece of a plain text."""
        return _ASCII.findall(unit) if unit.isascii() else self._pattern.findall(unit)

    def block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], set[str]]:
        """Offsets of documents, places of their pieces, the distinct pieces, and which of these are single words.

        Nulls count as empty. Of plain texts, only the distinct pieces leave Arrow.
        """
        texts = texts.fill_null("")
        odd = odd_texts(texts)
        lists = pc.utf8_split_whitespace(pc.utf8_lower(texts.filter(pc.invert(odd))))
        coded = lists.flatten().dictionary_encode()
        offsets, places, units = lists.offsets.to_numpy().astype(np.int64), coded.indices.to_numpy(), coded.dictionary.to_pylist()
        offsets -= offsets[0]
        if len(lists) == len(texts):
            return offsets, places, units, set()
        place: dict[str, int] = {}
        sizes, more = [], []
        for t in texts.filter(odd).to_pylist():
            words = self.words(t)
            sizes.append(len(words))
            more += [place.setdefault(w, len(place)) for w in words]
        # documents of both kinds back into their order
        order = np.argsort(np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        size = np.concatenate([np.diff(offsets), np.array(sizes, np.int64)])
        begin = (np.cumsum(size) - size)[order]
        size = size[order]
        offsets = np.concatenate([[0], np.cumsum(size)])
        places = np.concatenate([places, np.array(more, np.int64) + len(units)])
        places = places[np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])]
        return offsets, places, units + list(place), set(place)


def odd_texts(texts: pa.Array) -> pa.Array:
    """Which texts need the library's own normaliser and pre-tokenizer."""
    return pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, _UNSAFE_RE2))


def gather(parts: list[bytes], item: int, places: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Put together what each piece stands for (bytes of items): offsets of documents in items, and all items as bytes."""
    size = np.fromiter(map(len, parts), np.int64, len(parts)) // item
    begin = np.cumsum(size) - size
    table = np.frombuffer(b"".join(parts), np.dtype(f"<u{item}"))
    width = size[places]
    stop = np.cumsum(width)
    total = int(stop[-1]) if len(stop) else 0
    out = table[np.repeat(begin[places] - stop + width, width) + np.arange(total)] if total else table[:0]
    return np.concatenate([[0], stop])[offsets], out


class WordCache:
    """Two generations of a dictionary: memory stays under twice ``limit`` entries, and one block's words, whatever the corpus.

    Words of more than ``longest`` characters are not remembered beyond a block.
    """

    def __init__(self, limit: int = 250_000, longest: int = 256):
        self.limit, self.longest, self.young, self.old = limit, longest, {}, {}

    def values(self, units: list[str], single: set[str], parts, encode, join) -> list:
        """What each of the distinct pieces stands for.

        ``encode`` gives the values of words not known yet, many at a time. A
        piece that is no word itself is cut by ``parts``, and ``join`` puts its
        words' values together. Only words are remembered.
        """
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        known, old = self.young, self.old.get
        out = list(map(known.get, units))
        words: dict[str, None] = {}
        later, cut = [], []
        for i, v in enumerate(out):
            if v is None:
                u = units[i]
                v = old(u)
                if v is not None:
                    out[i] = known[u] = v
                elif u.isalpha() or u in single:  # letters only: one word
                    words[u] = None
                    later.append(i)
                else:
                    pieces = parts(u)
                    cut.append((i, pieces))
                    for w in pieces:
                        if w not in known and w not in words:
                            v = old(w)
                            if v is None:
                                words[w] = None
                            else:
                                known[w] = v
        new = list(words)
        known.update(zip(new, encode(new), strict=True))
        for i in later:
            out[i] = known[units[i]]
        for i, pieces in cut:
            out[i] = join([known[w] for w in pieces])
        for w in new:
            if len(w) > self.longest:
                del known[w]
        return out
