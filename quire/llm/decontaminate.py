"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are token rows. Seeds (runs of ``min_match``
tokens, found by Karp-Rabin hashes and confirmed token by token) join the two;
for each pair that shares one, the longest matches between unmarked tokens are
marked again and again. The share of an item's tokens under tiles is its
coverage; it does not depend on the order of its passages in the document.

The benchmark is a stated query set: it goes to the executors in blocks of
bounded size, one after the other, and the documents are read once per block.
A benchmark of one block needs no shuffle; of more, only the hits are written
and joined back to their texts by digest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup_join, materialize, small_batches, spare_name, table, text_blocks, tidy

MIN_MATCH, COVERAGE = 5, 0.5
#: Bytes of benchmark text in one broadcast, about.
BLOCK_BYTES = 8 << 20
#: Pairs of equal seeds of one document that are held at once, about.
PAIRS = 1 << 20

_TOKEN = re.compile(r"\w+")
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def tokens(text: str) -> list[str]:
    """Runs of word characters of the lower-cased text."""
    return _TOKEN.findall(text.lower())


def _window_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``k`` ids, modulo 2**64."""
    n = len(ids) - k + 1
    out = np.zeros(n, np.uint64)
    x = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        for t in range(k):
            out = out * np.uint64(_BASE) + x[t : t + n] + np.uint64(1)
    return out


def diagonals(starts: np.ndarray, ends: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Maximal matches (place in doc, place in item, length) from their first and last seeds, rows (i, j).

    On one diagonal, first and last seeds alternate, so sorted alike they belong together in pairs.
    """
    starts, ends = (x[np.lexsort((x[:, 0], x[:, 0] - x[:, 1]))] for x in (starts, ends))
    return list(zip(starts[:, 0].tolist(), starts[:, 1].tolist(), (ends[:, 0] - starts[:, 0] + k).tolist(), strict=True))


def tile(doc: np.ndarray, item: np.ndarray, seeds: list[tuple[int, int]], k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two token rows from all places ``seeds`` of equal runs of ``k`` tokens; see ``tile_matches``."""
    known = set(seeds)
    first = np.array([(i, j) for i, j in seeds if (i - 1, j - 1) not in known], np.int64).reshape(-1, 2)
    last = np.array([(i, j) for i, j in seeds if (i + 1, j + 1) not in known], np.int64).reshape(-1, 2)
    return tile_matches(len(doc), len(item), diagonals(first, last, k), k)


def tile_matches(n_doc: int, n_item: int, matches: list[tuple[int, int, int]], k: int) -> list[tuple[int, int, int]]:
    """Tiles (place in doc, place in item, length), longest first.

    ``matches`` are the maximal ones. The longest match is taken; one that
    overlaps marked tokens is cut to its unmarked stretches, which wait for
    their turn by length. Of equally long matches the first in the document,
    then in the item, wins. It ends when no stretch of the item is free that
    could hold a seed.
    """
    heap = [(-length, i, j) for i, j, length in matches]
    heapify(heap)
    in_doc, in_item = np.zeros(n_doc, bool), np.zeros(n_item, bool)
    tiles = []
    while heap:
        length, i, j = heappop(heap)
        length = -length
        free = ~(in_item[j : j + length] | in_doc[i : i + length])
        if free.all():
            tiles.append((i, j, length))
            in_item[j : j + length] = in_doc[i : i + length] = True
            if max((e - s for s, e in _stretches(~in_item)), default=0) < k:
                break
            continue
        for s, e in _stretches(free):
            if e - s >= k:
                heappush(heap, (s - e, i + s, j + s))
    return tiles


def _stretches(free: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
    return list(zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True))


def _spans(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``low[0], low[0] + 1, ...`` (``size[0]`` of them), then those from ``low[1]``, and so on."""
    return np.repeat(low - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class Items:
    """Index of one block of benchmark items: vocabulary, token rows and seeds by hash."""

    def __init__(self, rows: list[tuple[int | None, str]], min_match: int):
        self.vocabulary: dict[str, int] = {}
        self.ids: list[int | None] = []
        self.rows: list[np.ndarray] = []
        for item, text in rows:
            row = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in tokens(text)]
            if row:
                self.ids.append(item)
                self.rows.append(np.array(row, np.int64))
        self.flat = np.concatenate([np.zeros(0, np.int64), *self.rows])
        self.offsets = np.cumsum([0, *map(len, self.rows)])
        # items shorter than a seed are their own seed
        by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
        for n, row in enumerate(self.rows):
            k = min(min_match, len(row))
            by_length.setdefault(k, []).append((_window_hashes(row, k), n))
        self.seeds = {}
        for k, parts in by_length.items():
            hashes = np.concatenate([h for h, _ in parts])
            owner = np.concatenate([np.full(len(h), n) for h, n in parts])
            place = np.concatenate([np.arange(len(h)) for h, _ in parts])
            order = np.argsort(hashes, kind="stable")
            self.seeds[k] = (hashes[order], owner[order], place[order])

    def matches(self, text: str, coverage: float) -> list[tuple[int | None, float, int, int]]:
        """(item, coverage, tiles, tokens of the longest tile) of the items covered enough by one document."""
        words = tokens(text)
        doc = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        out = []
        for k, (hashes, owner, place) in self.seeds.items():
            if len(doc) < k:
                continue
            known = doc >= 0
            whole = np.cumsum(np.concatenate([[0], known]))
            at = np.flatnonzero(whole[k:] - whole[:-k] == k)
            if not len(at):
                continue
            own = _window_hashes(doc, k)[at]
            low = np.searchsorted(hashes, own, "left")
            hit = (low < len(hashes)) & (hashes[np.minimum(low, len(hashes) - 1)] == own)
            at, own = at[hit], own[hit]
            if not len(at):
                continue
            # no tiling covers more of an item than the tokens under its seeds, however often the document repeats them
            low = np.unique(low[hit])
            met = _spans(low, np.searchsorted(hashes, hashes[low], "right") - low)
            met = met[np.argsort(owner[met], kind="stable")]
            enough = []
            for item, a, b in zip(*_runs(owner[met]), strict=True):
                size = len(self.rows[item])
                under = np.zeros(size + k, np.int64)
                np.add.at(under, place[met[a:b]], 1)
                np.add.at(under, place[met[a:b]] + k, -1)
                if np.count_nonzero(np.cumsum(under)[:size]) >= coverage * size:
                    enough.append(met[a:b])
            if not enough:
                continue
            left = np.sort(np.concatenate(enough))
            for item, found in self._maximal(doc, at, own, hashes[left], owner[left], place[left], k).items():
                size = len(self.rows[item])
                tiles = tile_matches(len(doc), size, found, k)
                share = sum(t[2] for t in tiles) / size
                if share >= coverage:
                    out.append((self.ids[item], share, len(tiles), max(t[2] for t in tiles)))
        return out

    def _maximal(self, doc, at, own, hashes, owner, place, k) -> dict[int, list[tuple[int, int, int]]]:
        """Maximal matches per item. Pairs of equal seeds are looked at ``PAIRS`` at a time, and only first and last ones of a match are kept."""
        low = np.searchsorted(hashes, own, "left")
        size = np.searchsorted(hashes, own, "right") - low
        cut = np.concatenate([[0], np.cumsum(size)])
        ends: dict[int, tuple[list, list]] = {}
        begin = 0
        while begin < len(at):
            stop = max(begin + 1, int(np.searchsorted(cut, cut[begin] + PAIRS, "right")) - 1)
            i, s = np.repeat(at[begin:stop], size[begin:stop]), _spans(low[begin:stop], size[begin:stop])
            begin = stop
            n = owner[s]
            offset = self.offsets[n]
            j = place[s] + offset
            sure = np.ones(len(i), bool)
            for t in range(k):
                sure &= doc[i + t] == self.flat[j + t]
            i, j, n, offset = i[sure], j[sure], n[sure], offset[sure]
            first = (i == 0) | (j == offset) | (doc[i - 1] != self.flat[j - 1])
            last = (i + k == len(doc)) | (j + k == self.offsets[n + 1]) | (doc[np.minimum(i + k, len(doc) - 1)] != self.flat[np.minimum(j + k, len(self.flat) - 1)])
            for side, which in enumerate((first, last)):
                x, y, z = i[which], (j - offset)[which], n[which]
                order = np.argsort(z, kind="stable")
                if len(order):
                    for item, a, b in zip(*_runs(z[order]), strict=True):
                        ends.setdefault(item, ([], []))[side].append(np.stack([x[order[a:b]], y[order[a:b]]], axis=1))
        return {n: diagonals(np.concatenate(a), np.concatenate(b), k) for n, (a, b) in ends.items()}


def _runs(values: np.ndarray) -> tuple[list, list, list]:
    """Equal neighbours of a sorted row: value, begin, end."""
    cut = np.flatnonzero(np.diff(values)) + 1
    begin = np.concatenate([[0], cut])
    return values[begin].tolist(), begin.tolist(), np.concatenate([cut, [len(values)]]).tolist()


def _blocks(items: DataFrame, id_col: str, text_col: str, min_match: int, block_bytes: int) -> tuple[int, Iterator[Items]]:
    """Number of blocks, and the blocks, collected one at a time."""
    rows = items.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).where("t is not null and t <> ''")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // block_bytes)
    found = (rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).sort("i", "t").collect() for b in range(n))
    return n, (Items([(r.i, r.t) for r in some], min_match) for some in found)


_HITS = "array<struct<item_id:bigint,coverage:double,n_tiles:int,longest:int>>"
_ARROW_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int32()), ("longest", pa.int32())]))


def _matcher(shared, coverage: float):
    """UDF from text to the hits in one block of the benchmark."""
    names = ("item_id", "coverage", "n_tiles", "longest")

    @F.arrow_udf(_HITS)
    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index: Items = shared.value
        for texts in batches:
            for some in text_blocks(texts, rows=2000):
                yield pa.array([[dict(zip(names, m, strict=True)) for m in index.matches(t, coverage)] if t else [] for t in some.to_pylist()], _ARROW_HITS)

    return run


def contaminated(
    docs: DataFrame, items: DataFrame, text_col: str = "text", out: str = "hits", *,
    item_id: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Append ``out``: array of structs (item_id, coverage, n_tiles, longest), the items a document covers, by item.

    Null or empty texts and items match nothing; without items all arrays are
    empty. Repeated items are reported as often as they occur, repeated
    documents each get their own row. An item with fewer than ``min_match``
    tokens counts only as a whole. Other columns pass unchanged.

    Driver and executors hold one block of about ``block_bytes`` of the
    benchmark at a time; a single item is never cut.
    """
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    n, blocks = _blocks(items, item_id, item_text, min_match, block_bytes)
    if n == 0:
        return docs.withColumn(out, F.array().cast(_HITS))
    if n == 1:
        return docs.withColumn(out, F.sort_array(_matcher(sc.broadcast(next(blocks)), coverage)(F.col(text_col))))
    key, hits = spare_name(docs, "digest"), spare_name(docs, "found")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    parts = []
    for block in blocks:
        shared = sc.broadcast(block)
        rows = docs.select(digest(F.col(text_col)).alias(key), _matcher(shared, coverage)(F.col(text_col)).alias(hits)).where(F.size(hits) > 0)
        parts.append(materialize(rows.groupBy(key).agg(F.first(hits).alias(hits)), "leaks"))
        shared.unpersist()
    found = reduce(DataFrame.union, parts).groupBy(key).agg(F.sort_array(F.flatten(F.collect_list(hits))).alias(hits))
    found = materialize(found, "leaks-by-text")
    got = lookup_join(docs.withColumn(key, digest(F.col(text_col))), found, key)
    value = F.coalesce(hits, F.array().cast(_HITS)).alias(out)
    columns = [value if c.lower() == out.lower() else F.col(f"`{c}`") for c in docs.columns]
    return got.select(*columns, *([] if out.lower() in {c.lower() for c in docs.columns} else [value]))


def op9_decontamination(spark, sf_dir):
    """Per contaminated document and item: doc_id, item_id, coverage (6 digits), n_tiles, longest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = contaminated(docs, table(spark, sf_dir, "benchmark"))
    rows = hits.select("doc_id", F.explode("hits").alias("h"))
    return rows.select("doc_id", "h.item_id", F.round("h.coverage", 6).alias("coverage"), "h.n_tiles", "h.longest")


def drop_contaminated(spark, docs, sf_dir):
    """Pipeline stage: drop documents that cover a benchmark item."""
    own = spare_name(docs, "hits")
    return contaminated(docs, table(spark, sf_dir, "benchmark"), out=own).where(F.size(own) == 0).drop(own)
