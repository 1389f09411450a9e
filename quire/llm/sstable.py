"""Sorted-string-table shards of token ids.

Layout of one shard, all numbers little-endian:

    data block*   entries, then crc32 of the block (4 bytes)
    index block   per data block: last key, offset, length; then crc32
    filter block  Bloom filter bits; then crc32
    footer        56 bytes, see ``_FOOTER``

An entry is ``varint shared, varint unshared, varint value bytes, key suffix,
value``: keys are prefix-compressed against the entry before, from scratch in
each block. A key is the identifier as 8 big-endian bytes with the sign bit
turned, so byte order is number order; a null identifier has the empty key and
comes first. A value is the document's ids in 2 bytes each if the vocabulary
allows, else 4.

Tables are written in range partitions of the identifier. Identifiers that
occur often are split by a hash of the text, so one identifier of many texts
does not fill one task; order by identifier stays. Equal rows (one identifier,
one text) stay in one task, which encodes their text once a block and ends a
shard as often as needed. A manifest (a small table, one
row per shard) names only files of tasks that ended well.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import PreTokenizer, WordCache, gather, odd_texts, state_key
from .common import materialize, open_read, open_write, small_batches, table, text_blocks, tidy, work_path

MAGIC = b"QSST0001"
#: index offset, index bytes, filter offset, filter bytes, entries, id width, Bloom hashes, magic
_FOOTER = struct.Struct("<QQQQQII8s")
BLOCK_BYTES = 64 << 10
#: A shard ends with the document that reaches either.
SHARD_BYTES, SHARD_ENTRIES = 64 << 20, 1 << 20
#: Texts and bytes that are encoded at once, about.
TEXT_BLOCK = (2000, 4 << 20)
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 10, 7


def key_of(identifier: int | None) -> bytes:
    return b"" if identifier is None else struct.pack(">Q", (identifier + (1 << 63)) & (2**64 - 1))


def identifier_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _put_varint(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def _get_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class TableWriter:
    """Writes one shard; keys must come in ascending order (equal keys may follow each other)."""

    def __init__(self, f, width: int):
        self.f, self.width = f, width
        self.at, self.entries, self.ids = 0, 0, 0
        self.block, self.last, self.index, self.hashes = bytearray(), b"", [], []

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            while shared < len(key) and shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        for n in (shared, len(key) - shared, len(value)):
            _put_varint(self.block, n)
        self.block += key[shared:]
        self.block += value
        self.last = key
        if not self.entries or key != self.hashes[-1]:
            self.hashes.append(key)
        self.entries += 1
        self.ids += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.block:
            self.index.append((self.last, self.at, len(self.block) + 4))
            self._write(bytes(self.block))
            self.block = bytearray()

    def _write(self, data: bytes) -> int:
        self.f.write(data + struct.pack("<I", zlib.crc32(data)))
        self.at += len(data) + 4
        return len(data) + 4

    def close(self) -> int:
        self._end_block()
        index = bytearray()
        for key, offset, length in self.index:
            _put_varint(index, len(key))
            index += key
            _put_varint(index, offset)
            _put_varint(index, length)
        index_at = self.at
        index_bytes = self._write(bytes(index))
        bits = max(64, BLOOM_BITS_PER_KEY * self.entries)
        bloom = np.zeros((bits + 7) // 8 * 8, bool)
        for key in self.hashes:
            bloom[_bloom_places(key, bits)] = True
        filter_at = self.at
        filter_bytes = self._write(struct.pack("<Q", bits) + np.packbits(bloom, bitorder="little").tobytes())
        self.f.write(_FOOTER.pack(index_at, index_bytes, filter_at, filter_bytes, self.entries, self.width, BLOOM_HASHES, MAGIC))
        return self.at + _FOOTER.size


class TableReader:
    """Reads one shard: ``scan`` in key order, ``get`` by Bloom filter and binary search."""

    def __init__(self, f):
        self.f = f
        f.seek(0, os.SEEK_END)
        f.seek(f.tell() - _FOOTER.size)
        index_at, index_bytes, filter_at, filter_bytes, self.entries, self.width, _, magic = _FOOTER.unpack(f.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a table shard")
        data, at = self._checked(index_at, index_bytes), 0
        self.keys: list[bytes] = []
        self.blocks: list[tuple[int, int]] = []
        while at < len(data):
            n, at = _get_varint(data, at)
            self.keys.append(data[at : at + n])
            offset, at = _get_varint(data, at + n)
            length, at = _get_varint(data, at)
            self.blocks.append((offset, length))
        self._filter = (filter_at, filter_bytes)
        self._bloom: bytes | None = None

    def _checked(self, at: int, length: int) -> bytes:
        self.f.seek(at)
        data = self.f.read(length)
        if len(data) != length or struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
            raise ValueError("damaged block")
        return data[:-4]

    def _entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        data, at, key = self._checked(*self.blocks[block]), 0, b""
        while at < len(data):
            shared, at = _get_varint(data, at)
            own, at = _get_varint(data, at)
            size, at = _get_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, data[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for block in range(len(self.blocks)):
            for key, value in self._entries(block):
                yield key, np.frombuffer(value, "<u2" if self.width == 2 else "<u4")

    def may_contain(self, key: bytes) -> bool:
        if self._bloom is None:
            self._bloom = self._checked(*self._filter)
        bits = struct.unpack("<Q", self._bloom[:8])[0]
        return all(self._bloom[8 + p // 8] >> (p % 8) & 1 for p in _bloom_places(key, bits))

    def get(self, key: bytes) -> list[np.ndarray]:
        """All values under a key; empty if there is none."""
        if not self.may_contain(key):
            return []
        found = []
        for block in range(bisect_left(self.keys, key), len(self.blocks)):
            for k, value in self._entries(block):
                if k == key:
                    found.append(np.frombuffer(value, "<u2" if self.width == 2 else "<u4"))
                elif k > key:
                    return found
        return found


class LibraryEncoder:
    """Ids as the tokenizers library gives them; it encodes each distinct piece once while the worker remembers it.

    White space parts words, so texts are split at it, and the library encodes
    the words of each new piece, many at a time; a word's ids end with its one
    token that carries the word end. Texts with characters or special strings
    whose treatment reaches further go to the library as a whole.
    """

    def __init__(self, raw: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_str(raw)
        self.library.no_truncation()
        self.library.no_padding()
        self.pre, self.cache = PreTokenizer(raw), WordCache()
        self.by_word = Tokenizer(self.library.model)
        self.by_word.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix, vocab = self.library.model.end_of_word_suffix, self.library.get_vocab()
        self.ends = np.zeros(1 + max(vocab.values()), bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def _words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            ids = np.array(self.by_word.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, f"<u{self.width}")
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * self.width).tolist()
            raw = ids.tobytes()
            out += [raw[s:e] for s, e in zip([0, *ends], ends, strict=False)]
        return out

    def block(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (null: none) in the width of the file."""
        texts = texts.fill_null("")
        odd = odd_texts(texts)
        whole = iter([self.pack(self.library.encode(t, add_special_tokens=False).ids) for t in texts.filter(odd).to_pylist()])
        offsets, places, units, _ = self.pre.block(texts.filter(pc.invert(odd)))
        offsets, ids = gather(self.cache.values(units, set(), self.pre.parts, self._words, b"".join), self.width, places, offsets)
        raw, cut = ids.tobytes(), (offsets * self.width).tolist()
        plain = iter([raw[s:e] for s, e in zip(cut, cut[1:], strict=False)])
        return [next(whole) if x else next(plain) for x in odd.to_pylist()]


_WORKER: dict = {}
_MANIFEST = "part long, seq long, path string, first_key binary, last_key binary, n_docs long, n_ids long, n_bytes long"


def write_tables(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer_path: str, end_id: int, path: str | None = None) -> DataFrame:
    """Encode whole texts, append ``end_id`` and write shards in ascending order of ``id_col``.

    Returns the manifest. Null texts count as empty (only the end id), rows with
    a null identifier come first, repeated identifiers stand next to each other
    in the order of a hash of their texts. An empty table gives an empty
    manifest. The library encodes whole texts where their treatment reaches
    across white space, and single words, which give the same ids, elsewhere. One shuffle, of the two columns only.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = path or work_path(spark, "tables")
    with open(tokenizer_path, encoding="utf-8") as f:
        raw = f.read()
    shared = spark.sparkContext.broadcast(raw)
    key = state_key(raw)
    order = ["k", "h"]
    rows = df.select(F.col(id_col).cast("bigint").alias("k"), F.col(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("k", "t")

    def run(batches):
        if _WORKER.get("key") != key:
            _WORKER.update(key=key, encoder=LibraryEncoder(shared.value))
        encoder: LibraryEncoder = _WORKER["encoder"]
        part, seq, done = TaskContext.get().partitionId(), 0, []
        target = out = writer = first = None

        def end():
            nonlocal writer
            size = writer.close()
            out.__exit__(None, None, None)
            done.append((part, seq, target, first, writer.last, writer.entries, writer.ids, size))
            writer = None

        try:
            for batch in batches:
                keys, at = batch.column(0).to_pylist(), 0
                for block in text_blocks(batch.column(1), *TEXT_BLOCK):
                    for value in encoder.block(block):
                        if writer is None:
                            target = f"{path}/part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.sst"
                            out = open_write(target)
                            writer, first = TableWriter(out.__enter__(), encoder.width), key_of(keys[at])
                        writer.add(key_of(keys[at]), value + encoder.pack([end_id]))
                        at += 1
                        if writer.at >= SHARD_BYTES or writer.entries >= SHARD_ENTRIES:
                            end()
                            seq += 1
            if writer is not None:
                end()
        except BaseException as e:
            if writer is not None:
                out.__exit__(type(e), e, None)
            raise
        if done:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _MANIFEST.split(", ")])

    return materialize(rows.mapInArrow(tidy(run), _MANIFEST), "manifest")


def read_tables(manifest: DataFrame) -> DataFrame:
    """Read shards back in parallel: ``doc_id``, ``start`` (ids in all documents before it), ``ids`` (binary, uint32 little-endian).

    The running sum is over the manifest, one row per shard, not over documents.
    """
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("path", "part", "seq", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    spread = max(1, min(manifest.count(), 20_000))
    shards = shards.repartition(spread, "path").select("path", "start")

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_read(path) as f:
                    docs, starts, values, held = [], [], [], 0
                    for key, ids in TableReader(f).scan():
                        docs.append(identifier_of(key))
                        starts.append(start)
                        values.append(ids.astype("<u4").tobytes())
                        start += len(ids)
                        held += len(values[-1])
                        if held > 8 << 20:
                            yield _rows(docs, starts, values)
                            docs, starts, values, held = [], [], [], 0
                    if docs:
                        yield _rows(docs, starts, values)

    return shards.mapInArrow(tidy(run), "doc_id bigint, start bigint, ids binary")


def _rows(docs, starts, values):
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(values, pa.binary())], names=["doc_id", "start", "ids"])


def lookup(manifest: DataFrame, identifiers: list[int | None]) -> dict[int | None, list[np.ndarray]]:
    """Ids of a few identifiers: the manifest's key ranges name the shards, then filter and binary search."""
    found: dict[int | None, list[np.ndarray]] = {}
    for x in identifiers:
        k = key_of(x)
        rows = manifest.where((F.col("first_key") <= F.lit(k)) & (F.col("last_key") >= F.lit(k))).orderBy("part", "seq").select("path").collect()
        found[x] = []
        for r in rows:
            with open_read(r.path) as f:
                found[x] += TableReader(f).get(k)
    return found


def op5_sorted_tables(spark, sf_dir):
    """Contract: doc_id, start, n_tokens, ids_crc32 of every document, read back from the shards (end id 2)."""
    docs = table(spark, sf_dir, "documents")
    manifest = write_tables(docs, tokenizer_path=public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_tables(manifest).select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
