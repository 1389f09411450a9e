"""Token counts with a whole-token shortcut.

Offline, every vocabulary string is merged once to prove which words encode
alone as a single token. A document is then split into words; a word in the
proved set counts one without any merging, and only the rest is merged, each
distinct word once while the worker remembers it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PreTokenizer, WordBpe, WordCache, state_key
from .common import table, text_blocks

_WORKER: dict = {}


def _state(key, shared):
    if _WORKER.get("key") != key:
        raw, model, whole = shared.value
        cache = WordCache()
        _WORKER.update(key=key, pre=PreTokenizer(raw), model=model, whole=whole, cache=cache)
    return _WORKER


def count_tokens(df: DataFrame, text_col: str = "text", *, tokenizer_path: str, out: str = "n_tokens") -> DataFrame:
    """Append ``out`` (bigint): tokens of the whole text, without begin, end or padding tokens.

    Special strings inside a text count as one token each, as the library takes
    them by default. Null and empty texts have 0 tokens. All other columns pass
    unchanged; a column already named ``out`` is replaced. Repeated rows and
    identifiers do not matter: every row is counted by itself. Only the text
    goes to Python, and there is no shuffle. The broadcast holds the vocabulary,
    whose size the tokenizer file fixes.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        raw = f.read()
    model = WordBpe(raw)
    shared = df.sparkSession.sparkContext.broadcast((raw, model, model.whole_words()))
    key = state_key(raw)

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        s = _state(key, shared)
        pre, model, cache = s["pre"], s["model"], s["cache"]
        direct = s["whole"] | pre.special

        def lengths(words):
            rest = [w for w in words if w not in direct]
            merged = dict(zip(rest, model.count_words(rest), strict=True))
            return [merged.get(w, 1) for w in words]

        for texts in batches:
            counts = []
            for block in text_blocks(texts):
                offsets, places, units, single = pre.block(block)
                n = np.array(cache.values(units, single, pre.parts, lengths, sum), np.int64)
                counts.append(np.diff(np.concatenate([[0], np.cumsum(n[places])])[offsets]))
            yield pa.array(np.concatenate(counts) if counts else [], pa.int64())

    return df.withColumn(out, count(F.col(text_col)))


def op1_token_counts(spark, sf_dir):
    """Contract: doc_id, n_bytes, n_tokens, over_limit (n_tokens > 2048) of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = count_tokens(docs, tokenizer_path=public_tokenizers.path("word_bpe_49k.json"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    return got.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
