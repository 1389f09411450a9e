"""Toxicity by nearest labelled examples.

Examples and documents are TF-IDF vectors over all their words, each word's IDF
times the square of its relevance frequency (after Lan et al., tf.rf): a smooth
factor, 1 at least, of how much more often the word stands in toxic examples
than in clean ones. No word is left out, and cosines are exact under these
weights. The examples lie in an inverted index cut into blocks of alike ones: postings for most words,
one matrix a block for the few hundred words that stand in most texts, and each
word's largest weight in each block. A batch of queries visits, each, the block
of its greatest upper bound and then those that may still hold a nearer example,
so its neighbours are those of a full comparison. Single precision only names
candidates; cosines are exact. Votes weighted by similarity give a score,
calibrated on examples left out one by one, and the nearest examples are the
evidence.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Arrays, arrow_units, least_hashes, materialize, small_batches, spare_name, split_units, table, text_blocks, tidy, work_path
from .language_id import held_out

#: Labelled documents in the index, about; neighbours; examples for calibration; examples in a block.
MAX_EXAMPLES, NEIGHBOURS, CALIBRATION, BLOCK = 20_000, 25, 4000, 1024
#: Words kept as matrices, those in most examples; the others are postings. Only speed depends on it.
FREQUENT = 512
#: Texts and bytes that are cut into words at once, about.
TEXT_BLOCK = (1500, 4 << 20)
#: Queries in a batch; more than single precision may lose of a cosine.
BATCH, SLACK = 256, 1e-4
#: Documents scored this or higher are dropped by the pipeline.
REJECT = 0.5

_WORD = re.compile(r"[^\W\d_]+")


#: Trimmed from pieces before they are looked up; none of it can be part of a word.
_AROUND = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"


def _places_in(terms: pa.Array, few: pa.Array) -> np.ndarray:
    """Place in ``terms`` of each of the distinct ``few``, -1 if it is none. The terms look for themselves, so the hash table is that of the few."""
    out = np.full(len(few), -1, np.int64)
    if len(few):
        found = pc.index_in(terms, value_set=few)
        met = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        out[found.drop_null().to_numpy()] = met
    return out


def term_counts(texts: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, terms and counts of a block of whole texts, ordered by row, then term. Words beyond ``terms`` get numbers from ``len(terms)`` on.

    A piece between white space that, without the ASCII signs around it, is one
    of ``terms`` is that word and never leaves Arrow; only the others are cut
    into words here.
    """
    offsets, places, units = arrow_units(texts)
    first = len(terms)
    # a piece that is a word is its own trimmed form, so one look-up finds both
    trimmed = pc.utf8_trim(units, _AROUND).dictionary_encode()
    own = _places_in(terms, trimmed.dictionary)[trimmed.indices.to_numpy()]
    unknown = own < 0
    words = [_WORD.findall(u) for u in trimmed.filter(pa.array(unknown)).to_pylist()]
    coded = pa.array([w for x in words for w in x], pa.string()).dictionary_encode()
    number = _places_in(terms, coded.dictionary)
    number = np.where(number < 0, first + np.arange(len(number)), number)
    # per piece: its number of words and where they begin in ``flat``
    size = np.ones(len(units), np.int64)
    size[unknown] = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(size) - size
    flat = np.empty(int(size.sum()), np.int64)
    flat[begin[~unknown]] = own[~unknown]
    flat[_ranges(begin[unknown], size[unknown])] = number[coded.indices.to_numpy()]
    at = np.flatnonzero(size[places])
    row = np.searchsorted(offsets, at, "right") - 1
    width = size[places[at]]
    span = max(first + len(number), 1)
    keys, counts = np.unique(np.repeat(row, width) * span + flat[_ranges(begin[places[at]], width)], return_counts=True)
    return keys // span, keys % span, counts


def ordered(votes: np.ndarray, labels: np.ndarray) -> float:
    """Share of the pairs of a toxic and a clean example in which the toxic one has the higher vote; equal votes count half."""
    own = np.unique(np.round(votes, 12), return_inverse=True)[1]
    toxic, clean = np.bincount(own, labels), np.bincount(own, 1 - labels)
    return float((toxic * (np.cumsum(clean) - clean / 2)).sum() / (toxic.sum() * clean.sum()))


_COUNT = [np.arange(1 << 16)]


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``begin[0], begin[0] + 1, ...`` (``size[0]`` of them), then those from ``begin[1]``, and so on."""
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    out = np.repeat(begin - stop + size, size)
    if total <= 1 << 20 and total > len(_COUNT[0]):
        _COUNT[0] = np.arange(1 << 20)
    out += _COUNT[0][:total] if total <= len(_COUNT[0]) else np.arange(total)
    return out


#: One posting: place of the example, weight of the word in it.
_POST = np.dtype([("at", np.int32), ("weight", np.float32)])


class Rows:
    """Examples as flat rows: identifiers, labels, and the terms and counts of all, cut at ``begin``."""

    def __init__(self, ids: list, labels: np.ndarray, begin: np.ndarray, words: np.ndarray, counts: np.ndarray):
        self.ids, self.labels, self.begin, self.words, self.counts = ids, labels, begin, words, counts

    @classmethod
    def of(cls, examples: list[tuple]) -> Rows:
        flat = lambda k: np.concatenate([np.zeros(0, np.int32), *(np.asarray(x[k], np.int32) for x in examples)])
        return cls([x[0] for x in examples], np.array([x[1] for x in examples], np.float64), np.cumsum([0, *(len(x[2]) for x in examples)]), flat(2), flat(3))

    def taken(self) -> Rows:
        """The same rows; these ones are left empty."""
        rows = Rows(self.ids, self.labels, self.begin, self.words, self.counts)
        self.words = self.counts = np.zeros(0, np.int32)
        return rows

    def order(self) -> np.ndarray:
        """Places of the rows that have words, by identifier (nulls last) and content."""
        full = np.flatnonzero(np.diff(self.begin)).tolist()
        return np.array(sorted(full, key=lambda p: (self.ids[p] is None, self.ids[p] or 0, self.content(p))), np.int64)

    def content(self, p: int) -> bytes:
        s, e = self.begin[p], self.begin[p + 1]
        return hashlib.blake2b(self.words[s:e].tobytes() + self.counts[s:e].tobytes(), digest_size=16).digest()

    def take(self, places: np.ndarray) -> Rows:
        begin, size = self.begin[places], np.diff(self.begin)[places]
        cut = list(zip(begin.tolist(), (begin + size).tolist(), strict=True))
        words, counts = (np.concatenate([x[:0], *(x[s:e] for s, e in cut)]) for x in (self.words, self.counts))
        return Rows([self.ids[p] for p in places.tolist()], self.labels[places], np.concatenate([[0], np.cumsum(size)]), words, counts)


def relevance(rows: Rows, n_terms: int) -> np.ndarray:
    """Per term the square of ``log2(2 + r)``, ``r`` being its rate among toxic examples over that among clean ones; 1 for a word of clean examples only.

    Equal examples count once. One toxic example less and one clean one more are
    counted, so that no word owes its weight to a single example, which would
    tell calibration the label it leaves out.
    """
    counts, sizes, seen = np.zeros((2, n_terms)), [0, 0], set()
    for p in range(len(rows.ids)):
        y, content = int(rows.labels[p]), rows.content(p)
        if (y, content) not in seen:
            seen.add((y, content))
            sizes[y] += 1
            counts[y, rows.words[rows.begin[p] : rows.begin[p + 1]]] += 1
    clean, toxic = counts
    return np.log2(2 + np.maximum(toxic - 1, 0) / max(1, sizes[1]) / ((clean + 1) / max(1, sizes[0]))) ** 2


class Index:
    """Block-max inverted index of the examples and what turns neighbours into scores. Bounded by the examples.

    ``idf`` is that of ``terms``; ``unseen`` that of a word in no example, which
    counts in the length of a document's vector only. ``examples`` are rows
    (identifier, label, terms, counts), or ``Rows`` of many at once, which are
    emptied. It is built a few rows at a time: the driver does it.
    """

    def __init__(self, terms, idf: np.ndarray, examples, k: int = NEIGHBOURS, block: int = BLOCK, unseen: float = 1.0, frequent: int = FREQUENT):
        self.vocabulary = terms if isinstance(terms, pa.Array) else pa.array(terms, pa.string())
        self.idf, self.k, self.block, self.unseen = idf, k, block, unseen
        rows = examples.taken() if isinstance(examples, Rows) else Rows.of(examples)
        self.base = (float(rows.labels.sum()) + 1) / (len(rows.ids) + 2)
        empty = rows.labels[np.diff(rows.begin) == 0]
        self.blank = (float(empty.sum()) + self.base) / (len(empty) + 1)
        # an order that does not depend on the tables' order, then alike examples next to each other, which keeps bounds tight
        rows = rows.take(rows.order())
        self.often = np.sort(np.argsort(-np.bincount(rows.words, minlength=len(self.vocabulary)), kind="stable")[:frequent])
        rows = rows.take(self._alike(rows))
        self.ids, self.labels, self.begin, self.words, self.counts = rows.ids, rows.labels, rows.begin, rows.words, rows.counts
        if self.counts.max(initial=0) < 1 << 16:
            self.counts = self.counts.astype(np.uint16)
        self.curve, self.weighing = (np.array([0.0, 1.0]), np.array([0.0, 1.0])), (k, 2)
        self._derive()

    @property
    def terms(self) -> list[str]:
        return self.vocabulary.to_pylist()

    def _weights(self, begin: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Weights of some rows' words, each vector of length 1. ``begin`` cuts the rows and may start anywhere."""
        w = (1 + np.log(counts.astype(np.float64))) * self.idf[words]
        return w / np.repeat(self._lengths(begin, w), np.diff(begin))

    @staticmethod
    def _lengths(begin: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.sqrt(np.add.reduceat(w * w, begin[:-1] - begin[0])) if len(w) else np.zeros(0)

    def _rise(self, counts: np.ndarray) -> np.ndarray:
        """``1 + log`` of counts, looked up unless some example repeats a word extremely often."""
        return self.logs[counts] if len(self.logs) else 1 + np.log(counts.astype(np.float64))

    def vector(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of an example and their weights."""
        cut = self.begin[p : p + 2]
        words = self.words[cut[0] : cut[1]]
        return words, self._weights(cut, words, self.counts[cut[0] : cut[1]])

    def _few(self, begin: np.ndarray):
        """A block of rows at a time: the first one and their cuts, so that nothing else is as long as the examples."""
        for at in range(0, len(begin) - 1, self.block):
            yield at, begin[at : at + self.block + 1]

    def _slots(self) -> np.ndarray:
        """Row in the matrices of each frequent word, -1 for the others."""
        slot = np.full(len(self.vocabulary), -1, np.int32)
        slot[self.often] = np.arange(len(self.often))
        return slot

    def _alike(self, rows: Rows, groups: int = 16) -> np.ndarray:
        """Order of the examples by rough groups (spherical k-means on the frequent words), near groups next to each other."""
        n = len(rows.ids)
        slot = self._slots()
        points = np.zeros((n, len(self.often)), np.float32)
        for first, cut in self._few(rows.begin):
            words, counts = rows.words[cut[0] : cut[-1]], rows.counts[cut[0] : cut[-1]]
            own = slot[words]
            at = np.flatnonzero(own >= 0)
            owner = np.repeat(np.arange(first, first + len(cut) - 1), np.diff(cut))
            points[owner[at], own[at]] = self._weights(cut, words, counts)[at]
            norm = np.sqrt(np.einsum("ij,ij->i", points[first : first + len(cut) - 1], points[first : first + len(cut) - 1]))
            points[first : first + len(cut) - 1] /= np.maximum(norm, 1e-9)[:, None]
        centers = points[:: max(1, -(-n // groups))].copy()
        own = np.zeros(n, np.int64)
        for _ in range(6 if n else 0):
            own = (points @ centers.T).argmax(axis=1)
            for g in range(len(centers)):
                if (own == g).any():
                    centers[g] = (own == g).astype(np.float32) @ points
                    centers[g] /= max(float(np.sqrt((centers[g] ** 2).sum())), 1e-9)
        near, left, place = centers @ centers.T, list(range(1, len(centers))), np.zeros(max(len(centers), 1), np.int64)
        at = 0
        for g in range(1, len(centers)):
            at = max(left, key=lambda x: near[at, x])
            left.remove(at)
            place[at] = g
        return np.argsort(place[own], kind="stable")

    def _derive(self) -> None:
        """Lengths, postings, matrices and bounds, from the examples' words and counts."""
        n, block = len(self.ids), self.block
        self.slot = self._slots()
        top = int(self.counts.max(initial=0))
        self.logs = 1 + np.log(np.maximum(np.arange(top + 1), 1)) if top < 1 << 20 else np.zeros(0)
        self.lengths = np.zeros(n)
        self.blocks, self.most = [], np.zeros((len(self.often), -(-n // block)), np.float32)
        size = np.bincount(self.words, minlength=len(self.vocabulary))
        size[self.often] = 0
        self.posted = np.concatenate([[0], np.cumsum(size)])
        posts, after = np.empty(int(self.posted[-1]), _POST), self.posted[:-1].copy()
        for first, cut in self._few(self.begin):
            own = slice(int(cut[0]), int(cut[-1]))
            words = self.words[own]
            weights = self._rise(self.counts[own]) * self.idf[words]
            length = self.lengths[first : first + len(cut) - 1] = self._lengths(cut, weights)
            weights /= np.repeat(length, np.diff(cut))
            owner = np.repeat(np.arange(first, first + len(cut) - 1), np.diff(cut))
            slot = self.slot[words]
            at = np.flatnonzero(slot >= 0)
            dense = np.zeros((len(self.often), block), np.float32)
            dense[slot[at], owner[at] - first] = weights[at]
            self.most[:, first // block] = dense.max(axis=1, initial=0)
            self.blocks.append(dense)
            # the other words' postings go behind those of the rows before
            at = np.flatnonzero(slot < 0)
            at = at[np.argsort(words[at], kind="stable")]
            word = words[at]
            found, begin, count = np.unique(word, return_index=True, return_counts=True)
            place = after[word] + np.arange(len(word)) - np.repeat(begin, count)
            posts["at"][place], posts["weight"][place] = owner[at], weights[at]
            after[found] += count
        # gathered as plain numbers, which is faster
        self.posts = posts.view(np.int64)
        self._fresh()

    def _fresh(self) -> None:
        """What a process changes while it scores."""
        self._query = np.zeros(len(self.vocabulary))
        self._known: dict[bytes, tuple] = {}

    def stored(self, uri: str) -> StoredIndex:
        """A handle on the index, whose arrays go to a file of the shared folder."""
        return StoredIndex(self, uri)

    def weigh(self, terms: np.ndarray, counts: np.ndarray, others: np.ndarray | tuple = ()) -> np.ndarray:
        """Weights of ``terms`` in a vector of length 1 that also has words of no example, ``others`` times each."""
        if not len(terms):
            return np.zeros(0)
        w = (1 + np.log(counts)) * self.idf[terms]
        rest = (1 + np.log(np.asarray(others, np.float64))) * self.unseen
        return w / np.sqrt((w * w).sum() + (rest * rest).sum())

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of greatest cosine (above 0) and their cosines; of equal ones those first in the index."""
        return self.nearest_of_each([(terms, weights)], k)[0]

    def nearest_of_each(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        n, block, blocks = len(self.ids), self.block, len(self.blocks)
        rough = np.zeros((len(queries), blocks * block), np.float32)
        often = np.zeros((len(queries), len(self.often)), np.float32)
        for q, (terms, weights) in enumerate(queries):
            slot = self.slot[terms]
            inside = slot >= 0
            often[q, slot[inside]] = weights[inside]
            rare = terms[~inside]
            begin = self.posted[rare]
            size = self.posted[rare + 1] - begin
            post = self.posts.take(_ranges(begin, size), mode="clip").view(_POST)
            if len(post):
                rough[q, :n] = np.bincount(post["at"].astype(np.int64), post["weight"] * np.repeat(weights[~inside], size), n)
        bound = rough.reshape(len(queries), blocks, block).max(axis=2) + often @ self.most
        best, least = bound.argmax(axis=1), np.zeros(len(queries), np.float32)
        for first in (True, False):
            for b in range(blocks):
                at = np.flatnonzero(best == b if first else (best != b) & (bound[:, b] > 0) & (bound[:, b] >= least - SLACK))
                if len(at):
                    found = rough[at, b * block : (b + 1) * block] + often[at] @ self.blocks[b]
                    rough[at, b * block : (b + 1) * block] = found
                    if first and k <= block:  # what k examples of one block reach
                        least[at] = np.partition(found, block - k, axis=1)[:, block - k]
        out = []
        # a block that was not visited holds sums below its bound, which no longer reaches ``least``
        for q, (terms, weights) in enumerate(queries):
            places = np.flatnonzero((rough[q] > 0) & (rough[q] >= least[q] - SLACK))
            if len(places) > k:
                found = rough[q, places]
                places = places[found >= np.partition(found, len(found) - k)[len(found) - k] - SLACK]
            self._query[terms] = weights * self.idf[terms]
            begin, size = self.begin[places], self.begin[places + 1] - self.begin[places]
            own = _ranges(begin, size)
            sims = np.add.reduceat(self._query[self.words[own]] * self._rise(self.counts[own]), np.cumsum(size) - size) / self.lengths[places] if len(places) else np.zeros(0)
            self._query[terms] = 0.0
            order = np.lexsort((places, -np.round(sims, 9)))[:k]
            places, sims = places[order], sims[order]
            out.append((places[sims > 0], sims[sims > 0]))
        return out

    def vote(self, places: np.ndarray, sims: np.ndarray) -> float:
        """Share of toxic labels among the neighbours that vote, nearer ones weighing more, and one vote of the base rate."""
        voters, power = self.weighing
        w = (sims[:voters] / max(float(sims[0]), 1e-12)) ** power if len(sims) else sims
        return float((w @ self.labels[places[:voters]] + self.base) / (w.sum() + 1))

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list[tuple]]:
        """Calibrated score and the three nearest examples (identifier, cosine, label). Terms from ``len(self.vocabulary)`` on are in no example."""
        return self.score_each([(terms, counts)])[0]

    def score_each(self, documents: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[tuple]]]:
        if len(self._known) > 5_000:
            self._known.clear()
        keys, new = [], {}
        for terms, counts in documents:
            inside = terms < len(self.vocabulary)
            if not self.ids or not inside.any():
                keys.append(None)
                continue
            others = np.sort(counts[~inside])
            key = hashlib.blake2b(b"".join(x.astype(np.int64).tobytes() for x in (np.array([inside.sum()]), terms[inside], counts[inside], others)), digest_size=16).digest()
            keys.append(key)
            if key not in self._known and key not in new:
                new[key] = (terms[inside], self.weigh(terms[inside], counts[inside], others))
        names = list(new)
        for at in range(0, len(names), BATCH):
            part = names[at : at + BATCH]
            for key, (places, sims) in zip(part, self.nearest_of_each([new[x] for x in part], self.k), strict=True):
                score = float(np.interp(self.vote(places, sims), *self.curve))
                self._known[key] = (score, [(self.ids[p], float(s), int(self.labels[p])) for p, s in zip(places[:3].tolist(), sims[:3], strict=True)])
        return [(self.blank, []) if key is None else self._known[key] for key in keys]

    def calibrate(self, limit: int = CALIBRATION) -> None:
        """Choose how neighbours weigh and fit a rising curve from votes to label rates, on evenly spread examples left out of their own votes."""
        n = len(self.ids)
        near, labels = [], []
        chosen = range(0, n, max(1, -(-n // limit)))
        for at in range(0, len(chosen), BATCH):
            part = chosen[at : at + BATCH]
            for p, (places, sims) in zip(part, self.nearest_of_each([self.vector(p) for p in part], self.k + 1), strict=True):
                others = places != p
                near.append((places[others][: self.k], sims[others][: self.k]))
                labels.append(self.labels[p])
        if len(set(labels)) < 2:
            return
        trials = []
        for self.weighing in [(k, power) for k in sorted({min(k, self.k) for k in (5, 10, self.k)}) for power in (1, 2, 4, 8)]:
            votes = [self.vote(*x) for x in near]
            trials.append((ordered(np.array(votes), np.array(labels)), self.weighing, votes))
        _, self.weighing, votes = max(trials, key=lambda x: x[0])
        # pool adjacent violators, with one pseudo-observation of the plain vote at each step's ends
        order = np.argsort(votes, kind="stable")
        steps: list[list[float]] = []
        for v, y in zip(np.array(votes)[order], np.array(labels)[order], strict=True):
            steps.append([y, 1.0, v])
            while len(steps) > 1 and steps[-2][0] / steps[-2][1] >= steps[-1][0] / steps[-1][1]:
                y2, n2, v2 = steps.pop()
                steps[-1] = [steps[-1][0] + y2, steps[-1][1] + n2, steps[-1][2] + v2]
        # beyond the highest and lowest votes seen, towards agreement of all neighbours
        x = np.array([0.0, *(v / n for _, n, v in steps), 1.0])
        y = np.array([0.0, *((y + v / n) / (n + 1) for y, n, v in steps), 1.0])
        self.curve = (x, np.maximum.accumulate(y))


class StoredIndex:
    """An index as a small handle to be broadcast; its arrays lie in a file that the workers map (``Arrays``), so none builds or holds a copy."""

    def __init__(self, index: Index, uri: str):
        state = {k: v for k, v in index.__dict__.items() if k not in ("vocabulary", "blocks", "_query", "_known")}
        large = {k: v for k, v in state.items() if isinstance(v, np.ndarray)}
        self.rest = {k: v for k, v in state.items() if k not in large}
        cut, letters = np.zeros(1, np.int32), np.zeros(0, np.uint8)
        if len(terms := index.vocabulary):
            _, offsets, data = terms.buffers()
            cut = np.frombuffer(offsets, np.int32)[terms.offset : terms.offset + len(terms) + 1]
            letters, cut = np.frombuffer(data, np.uint8)[cut[0] : cut[-1]], cut - cut[0]
        self.arrays = Arrays(uri, {**large, "blocks": index.blocks, "term_offsets": cut, "term_letters": letters})

    def __getstate__(self) -> dict:
        return {"rest": self.rest, "arrays": self.arrays}

    def open(self) -> Index:
        """The index, once a process."""
        if not hasattr(self, "_index"):
            index, found = Index.__new__(Index), self.arrays.open()
            cut, letters = found.pop("term_offsets"), found.pop("term_letters")
            index.__dict__.update(self.rest, **found)
            index.blocks = list(found["blocks"])
            index.vocabulary = pa.StringArray.from_buffers(len(cut) - 1, pa.py_buffer(cut), pa.py_buffer(letters))
            index._fresh()
            self._index = index
        return self._index


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", *, max_examples: int = MAX_EXAMPLES, neighbours: int = NEIGHBOURS, calibration: int = CALIBRATION) -> Index:
    """Build the index from ``labels`` (doc_id, toxic 0/1) and ``docs``.

    About ``max_examples`` labelled documents are examples, chosen by a hash of
    the identifier, one text each (of several under one identifier that with the
    least hash); of repeated labels the higher counts, null labels and
    identifiers are left out. About ``calibration`` of them, evenly spread over
    the index, are left out one by one to fit votes to label rates. All words of the examples are in the index;
    their document frequencies come from all documents. A word of no example
    weighs as one of a single document. ``relevance`` scales the weights by the
    examples' labels.
    Without labels the index is empty and every score is 0.5.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    chosen = known.where(F.xxhash64("doc_id") <= least_hashes(max_examples, known.count())).withColumnRenamed("doc_id", "i")
    # the chosen labels are bounded by ``max_examples``, so they are broadcast and documents stay where they are
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    sample = rows.join(F.broadcast(chosen), "i").where("t is not null")
    # one text per identifier, reduced before the shuffle, so that repeated identifiers do not grow the sample
    sample = sample.groupBy("i", "y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("least"))
    sample = materialize(sample.select("i", "y", "least.t"), "examples")

    @tidy
    def words(batches):
        seen: set[str] = set()
        for batch in batches:
            for texts in text_blocks(batch.column(0)):
                for unit in split_units(texts)[2]:
                    seen.update(_WORD.findall(unit))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], names=["term"])

    # the words of the bounded examples
    terms = sample.select("t").mapInArrow(words, "term string").distinct().toArrow().column(0)
    terms = pa.concat_arrays([pa.array([], pa.string()), *(c.cast(pa.string()) for c in terms.chunks)])
    terms = terms.take(pc.sort_indices(terms))
    shared = spark.sparkContext.broadcast(terms)

    @tidy
    def frequency(batches):
        size = len(shared.value)
        seen, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for texts in text_blocks(batch.column(0), *TEXT_BLOCK):
                term = term_counts(texts, shared.value)[1]
                seen += np.bincount(term[term < size], minlength=size)
                n += len(texts)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], at])), pa.array(np.concatenate([[n], seen[at]]))], names=["term", "n"])

    found = rows.select("t").mapInArrow(frequency, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    at, n = found.column(0).to_numpy(), found.column(1).to_numpy()
    df = np.zeros(len(terms))
    df[at[at >= 0]] = n[at >= 0]
    total = int(n[at < 0].sum())
    idf = np.log((1 + total) / (1 + df)) + 1

    def vectors(batches):
        for batch in batches:
            row, term, n = term_counts(batch.column(2), shared.value)
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            packed = [pa.array([x[s:e].astype(np.int32).tobytes() for s, e in zip(cut, cut[1:], strict=False)], pa.binary()) for x in (term, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), *packed], names=["i", "y", "terms", "counts"])

    packed = sample.select(F.col("i").cast("bigint").alias("i"), "y", "t").mapInArrow(vectors, "i long, y long, terms binary, counts binary").toArrow()
    size = pc.binary_length(packed.column(2)).to_numpy().astype(np.int64) // 4
    examples = Rows(packed.column(0).to_pylist(), packed.column(1).to_numpy().astype(np.float64), np.concatenate([[0], np.cumsum(size)]), *(_numbers(packed.column(c)) for c in (2, 3)))
    del packed, found
    shared.unpersist()
    pa.default_memory_pool().release_unused()
    idf *= relevance(examples, len(terms))
    index = Index(terms, idf, examples, neighbours, unseen=float(np.log((1 + total) / 2) + 1) if total else 1.0)
    index.calibrate(calibration)
    return index


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """The values of a binary column, one after the other, as 4-byte numbers."""
    parts = [np.zeros(0, np.int32)]
    for x in column.chunks:
        offsets, data = x.buffers()[1:]
        if len(x) and data is not None:
            cut = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(x.type) else np.int32)[x.offset : x.offset + len(x) + 1]
            parts.append(np.frombuffer(data, np.uint8)[cut[0] : cut[-1]].view(np.int32))
    return np.concatenate(parts)


_KIND = pa.struct([("score", pa.float64()), ("evidence", pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())])))])


def score(docs: DataFrame, index: Index, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """Append ``out``: struct of score (0 to 1) and evidence (nearest examples: doc_id, similarity, label).

    Null, empty and all other texts that share no word with any example get the
    rate of examples without words, and no evidence. Equal texts get equal scores. Other
    columns pass unchanged. No shuffle; the bounded index lies in the shared folder and workers map it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(index.stored(work_path(spark, "index")))

    @F.arrow_udf("score double, evidence array<struct<doc_id:bigint,similarity:double,label:int>>")
    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own: Index = shared.value.open()
        for texts in batches:
            for block in text_blocks(texts, *TEXT_BLOCK):
                row, term, n = term_counts(block, own.vocabulary)
                cut = np.searchsorted(row, np.arange(len(block) + 1))
                found = own.score_each([(term[s:e], n[s:e]) for s, e in zip(cut, cut[1:], strict=False)])
                rows = [{"score": value, "evidence": [{"doc_id": i, "similarity": x, "label": y} for i, x, y in near]} for value, near in found]
                yield pa.array(rows, _KIND)

    return docs.withColumn(out, run(F.col(text_col)))


def _trained(spark, docs: DataFrame, sf_dir: str) -> Index:
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5, 0))
    return fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))


def op3_toxicity_neighbours(spark, sf_dir):
    """Contract: doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, _trained(spark, docs, sf_dir))
    value = F.col("toxicity.score")
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), value.alias("score"), (value >= 0.5).cast("int").alias("predicted"), F.to_json("toxicity.evidence").alias("evidence"))


def drop_toxic(spark, docs, sf_dir):
    """Pipeline stage: drop documents whose score reaches ``REJECT``."""
    own = spare_name(docs, "toxicity")
    return score(docs, _trained(spark, docs, sf_dir), out=own).where(F.col(f"{own}.score") < REJECT).drop(own)
