"""From raw documents to token ids: language, toxicity, near duplicates, benchmark leaks, encoding.

Each stage works on what its predecessor kept, written as Parquet in the shared
folder and read again. Decisions take effect: rejected documents are gone for
all later stages, in their statistics too.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bpe_codec import encode
from quire.llm.common import materialize, table
from quire.llm.decontaminate import drop_contaminated
from quire.llm.language_id import keep_known_languages
from quire.llm.near_duplicates import keep_one_of_each
from quire.llm.toxicity import drop_toxic


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: the documents with their token ids and number of tokens."""
    coded = encode(docs, tokenizer_path=public_tokenizers.path("word_bpe_49k.json"), out="ids")
    return coded.withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [
    ("language_id", keep_known_languages),
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("bpe_encoding", encode_texts),
]

#: SQL cannot express these stages; the tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
