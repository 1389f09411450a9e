"""Token counts, codec and tables against the tokenizers library, text by text."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire.llm import sstable
from quire.llm.bpe import WordBpe, WordCache
from quire.llm.bpe_codec import decode, encode, op10_bpe_codec, round_trip
from quire.llm.sstable import op5_sorted_tables
from quire.llm.token_count import op1_token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def model():
    return WordBpe(open(PATH, encoding="utf-8").read())


def encoded(library, documents):
    return [(d["doc_id"], d["text"] or "", library.encode(d["text"] or "", add_special_tokens=False).ids) for d in documents]


def test_counts(spark, odd_dir, documents, library):
    want = Counter((i, len(t.encode()), len(ids), len(ids) > 2048) for i, t, ids in encoded(library, documents))
    got = op1_token_counts(spark, odd_dir)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert Counter(map(tuple, got.collect())) == want


def test_codec(spark, odd_dir, documents, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))) for i, t, ids in encoded(library, documents))
    assert Counter(map(tuple, op10_bpe_codec(spark, odd_dir).collect())) == want


def test_round_trip_is_encode_then_decode(spark, odd_dir):
    df = spark.read.parquet(f"{odd_dir}/documents.parquet").select("doc_id", "text")
    one = round_trip(df, tokenizer_path=PATH).select("doc_id", "coded.ids", "coded.decoded")
    two = decode(encode(df, tokenizer_path=PATH), tokenizer_path=PATH).select("doc_id", "ids", "decoded")
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_decode_skips_what_is_no_id(spark):
    df = spark.createDataFrame([([320, -1, None, 999999, 49407],), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in decode(df, tokenizer_path=PATH).collect()] == ["a</w> <|endoftext|>", "", ""]


def test_tables(spark, odd_dir, documents, library):
    got = op5_sorted_tables(spark, odd_dir).collect()
    by_id = Counter((i, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())) for i, t, ids in encoded(library, documents))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == by_id
    at, last = 0, None
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and (last is None or (r.doc_id is not None and r.doc_id >= last))
        at, last = at + r.n_tokens, r.doc_id


def test_lookup_by_filter_and_binary_search(spark, odd_dir, documents, library, monkeypatch):
    manifest = sstable.write_tables(spark.read.parquet(f"{odd_dir}/documents.parquet"), tokenizer_path=PATH, end_id=2)
    found = sstable.lookup(manifest, [3, 100_009, None, 55_555])
    by_id = {}
    for i, _, ids in encoded(library, documents):
        by_id.setdefault(i, []).append([*ids, 2])
    for i in (3, 100_009, None):
        assert [x.tolist() for x in found[i]] == by_id[i]
    assert found[55_555] == []


def test_table_blocks_and_keys(tmp_path, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 64)
    keys = [None, -(2**63), -5, -5, 0, 1, 2, 300, 2**63 - 1]
    with open(tmp_path / "t", "wb") as f:
        w = sstable.TableWriter(f, 4)
        for n, k in enumerate(keys):
            w.add(sstable.key_of(k), np.arange(n, dtype="<u4").tobytes())
        w.close()
    with open(tmp_path / "t", "rb") as f:
        r = sstable.TableReader(f)
        assert len(r.blocks) > 2 and [sstable.identifier_of(k) for k, _ in r.scan()] == keys
        assert [x.tolist() for x in r.get(sstable.key_of(-5))] == [[0, 1], [0, 1, 2]]
        assert r.get(sstable.key_of(7)) == [] and all(r.may_contain(sstable.key_of(k)) for k in keys)
    data = bytearray((tmp_path / "t").read_bytes())
    data[3] ^= 1
    (tmp_path / "t").write_bytes(data)
    with open(tmp_path / "t", "rb") as f, pytest.raises(ValueError):
        list(sstable.TableReader(f).scan())


def test_whole_words_are_proved(model, library):
    whole = model.whole_words()
    assert len(whole) > 30_000
    some = sorted(whole)[::97]
    assert all(len(library.encode(w, add_special_tokens=False).ids) == 1 for w in some)


def test_pair_index_equals_word_by_word(model):
    import random

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéth's") for _ in range(rng.randint(1, 30))) for _ in range(2000)] + ["aaaaaaa", "ababababab"]
    counts, ids = model.merge_block(words)
    assert counts.sum() == len(ids)
    at = 0
    for w, n in zip(words, counts, strict=True):
        assert ids[at : at + n].tolist() == model.merge_word(w)
        at += n
    assert [x.tolist() for x in model.merge_block([])] == [[], []]


def test_cache_is_bounded_and_right():
    cache, asked = WordCache(limit=10), []

    def encode(words):
        asked.extend(words)
        return [w.encode() for w in words]

    for at in range(0, 1000, 5):
        units = [f"w{'x' * (k % 7)}{chr(97 + k % 26)}" for k in range(at, at + 5)] + [f"a,{at % 3}", "same"]
        units = list(dict.fromkeys(units))
        got = cache.values(units, set(), lambda u: u.replace(",", " , ").split(), encode, b"".join)
        assert got == [u.encode() for u in units]
    assert len(cache.young) + len(cache.old) <= 40 and asked.count("same") == 1


def test_empty_tables(spark, empty_dir):
    for query in (op1_token_counts, op5_sorted_tables, op10_bpe_codec):
        assert query(spark, empty_dir).collect() == []


def test_tables_are_written_from_small_batches(spark, library):
    """Whole texts reach a worker by few rows and bytes at once, whatever the session's limits; ids stay those of the library."""
    limits = {f"spark.sql.execution.arrow.max{x}PerBatch": spark.conf.get(f"spark.sql.execution.arrow.max{x}PerBatch") for x in ("Records", "Bytes")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(256 << 20))
        docs = spark.range(5000).selectExpr("id as doc_id", "concat('word ', id) as text")
        rows = sstable.read_tables(sstable.write_tables(docs, tokenizer_path=PATH, end_id=2)).orderBy("doc_id").collect()
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000
        assert int(str(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")).removesuffix("b")) <= 8 << 20
    finally:
        for k, v in limits.items():
            spark.conf.set(k, v)
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in rows] == [[*library.encode(f"word {k}", add_special_tokens=False).ids, 2] for k in range(5000)]
