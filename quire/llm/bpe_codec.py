"""BPE encoding and decoding through a pair occurrence index.

Encoding collects the distinct unknown words of a block of documents and
merges them all at once: an index maps each pair to all its positions, active
ranks are applied in ascending order, and every merge updates the lists it
touches (``WordBpe.merge_block``). Decoding joins token strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PreTokenizer, WordBpe, WordCache, gather, state_key
from .common import small_batches, table, text_blocks, tidy

#: Rows and bytes of text that are encoded at once, about.
TEXT_BLOCK = (1000, 2 << 20)

_WORKER: dict = {}


def _state(key, shared):
    if _WORKER.get("key") != key:
        raw, model = shared.value
        _WORKER.update(key=key, pre=PreTokenizer(raw), model=model, cache=WordCache(120_000))
    return _WORKER


def encode_block(texts: pa.Array, pre: PreTokenizer, model: WordBpe, cache: WordCache) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and all token ids of a block of texts. The cache holds each word's ids as int32 bytes."""

    def encode(words):
        special = {w: np.int32(model.special[w]).tobytes() for w in words if w in pre.special}
        plain = [w for w in words if w not in special]
        counts, ids = model.merge_block(plain)
        ends, raw = (np.cumsum(counts) * 4).tolist(), ids.tobytes()
        done = dict(zip(plain, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=False))
        return [done[w] if w in done else special[w] for w in words]

    offsets, places, units, single = pre.block(texts)
    offsets, ids = gather(cache.values(units, single, pre.parts, encode, b"".join), 4, places, offsets)
    return offsets, ids.astype(np.int32)


def decode_block(lists: pa.ListArray, tokens: pa.Array) -> pa.Array:
    """Token strings of each list joined by a space: the file names no decoder."""
    ids, row = lists.flatten(), pc.list_parent_indices(lists)
    known = pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(tokens))).fill_null(False)
    words = tokens.take(pc.if_else(known, ids, pa.scalar(None, ids.type)))
    if words.null_count:
        keep = words.is_valid()
        words, row = words.filter(keep), row.filter(keep)
    offsets = np.searchsorted(row.to_numpy(), np.arange(len(lists) + 1))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words), " ")


def _load(df: DataFrame, tokenizer_path: str):
    small_batches(df.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        raw = f.read()
    return state_key(raw), df.sparkSession.sparkContext.broadcast((raw, WordBpe(raw)))


def encode(df: DataFrame, text_col: str = "text", *, tokenizer_path: str, out: str = "ids") -> DataFrame:
    """Append ``out`` (array<int>): the token ids of the whole text, no special tokens added.

    Special strings inside a text become their own ids. Null and empty texts
    give an empty array. A column already named ``out`` is replaced; all others
    pass unchanged, repeated rows are encoded alike. No shuffle.
    """
    key, shared = _load(df, tokenizer_path)

    @F.arrow_udf("array<int>")
    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        s = _state(key, shared)
        for texts in batches:
            for block in text_blocks(texts, *TEXT_BLOCK):
                offsets, ids = encode_block(block, s["pre"], s["model"], s["cache"])
                yield pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))

    return df.withColumn(out, run(F.col(text_col)))


def decode(df: DataFrame, ids_col: str = "ids", *, tokenizer_path: str, out: str = "decoded") -> DataFrame:
    """Append ``out`` (string): the text of an array of ids, special tokens kept.

    A null array gives an empty string; ids outside the vocabulary and null ids are left out.
    """
    key, shared = _load(df, tokenizer_path)

    @F.arrow_udf("string")
    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = pa.array([t or None for t in _state(key, shared)["model"].tokens])
        for lists in batches:
            for at in range(0, len(lists), 1000):
                yield decode_block(lists.slice(at, 1000), tokens)

    return df.withColumn(out, run(F.col(ids_col)))


def round_trip(df: DataFrame, text_col: str = "text", *, tokenizer_path: str, out: str = "coded") -> DataFrame:
    """Append ``out``: struct of ids and the text decoded from them, in one Python worker per task.

    Same results as ``encode`` followed by ``decode``.
    """
    key, shared = _load(df, tokenizer_path)
    kind = [pa.field("ids", pa.list_(pa.int32())), pa.field("decoded", pa.string())]

    @F.arrow_udf("ids array<int>, decoded string")
    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        s = _state(key, shared)
        tokens = pa.array([t or None for t in s["model"].tokens])
        for texts in batches:
            for block in text_blocks(texts, *TEXT_BLOCK):
                offsets, ids = encode_block(block, s["pre"], s["model"], s["cache"])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.StructArray.from_arrays([lists, decode_block(lists, tokens)], fields=kind)

    return df.withColumn(out, run(F.col(text_col)))


def op10_bpe_codec(spark, sf_dir):
    """Contract: doc_id, n_tokens and the digests of the ids and of the decoded text of every document."""
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, tokenizer_path=path).select(
        "doc_id",
        F.size("coded.ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("coded.ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("coded.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
