import pyarrow as pa
import pyarrow.parquet as pq
import pytest

#: Nulls in any column, empty and blank texts, ties, repeated rows, odd characters, special strings, one long text.
WORDS = "the quick brown fox jumps over the lazy dog and runs away from it all"
ODD_TEXTS = [
    None,
    "",
    " \n\t ",
    "x",
    "Avec.",
    WORDS,
    WORDS,
    WORDS.upper(),
    WORDS + " today",
    "Hello wörld's <|endoftext|> J\u030c x İSTANBUL ΑΣ ẞ ﬁ ① ½ x²",
    "<|startoftext|><|endoftext|>",
    "a\x1cb\x85c\u3000d '''s 's'll DON'T",
    "日本語テキスト 한국어 😀😀 a😀",
    "12345 ... !!! 67,89",
    "you pathetic idiot " * 3,
    "long " + "wörter über alles hier drinnen " * 8000,
    "y" * 3000,
]


@pytest.fixture(scope="session")
def odd_dir(tmp_path_factory):
    """Tables like those of the corpus, small, with every unwelcome case and extra columns whose names clash."""
    at = tmp_path_factory.mktemp("odd")
    base = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    rows = [{**r, "ids": "mine", "language": 1, "toxicity": None, "hits": [1]} for r in base]
    for k, t in enumerate(ODD_TEXTS):
        rows.append({"doc_id": 100_000 + k, "text": t, "lang": None if k % 2 else "en", "source": None, "n_chars": None, "ids": None, "language": None, "toxicity": 0.5, "hits": None})
    rows.append({**rows[0], "doc_id": None})
    rows.append({**rows[0], "doc_id": 99_999})
    rows.append(dict(rows[1]))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("ids", pa.string()), ("language", pa.int64()), ("toxicity", pa.float64()), ("hits", pa.list_(pa.int64()))])
    pq.write_table(pa.Table.from_pylist(rows, schema), at / "documents.parquet")
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()
    pages += [
        {"page_id": 900, "url": None, "html": None},
        {"page_id": 901, "url": "no scheme", "html": ""},
        {"page_id": 902, "url": "HTTP://WWW.Example.COM/en/7?x#y", "html": pages[3]["html"]},
        {"page_id": 903, "url": "x://Example.net\n/de/8/a b\r\n", "html": pages[3]["html"]},
        {"page_id": None, "url": "http://a.example.net/de/8", "html": "q"},
        {"page_id": 904, "url": "http://u@h.co.uk:80#/en/", "html": "q"},
        {"page_id": 905, "url": "://com/en/://x", "html": "q"},
    ]
    pages = [{**p, "host": "clash", "bad": 7, "path": None} for p in [*pages, dict(pages[0])]]
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("host", pa.string()), ("bad", pa.int64()), ("path", pa.string())])
    pq.write_table(pa.Table.from_pylist(pages, schema), at / "pages.parquet")
    labels = pq.read_table("/root/testdata/sf0.001/labels.parquet").to_pylist()
    labels += [{"doc_id": None, "quality": 1, "toxic": 1}, {"doc_id": 5, "quality": None, "toxic": None}, dict(labels[0])]
    pq.write_table(pa.Table.from_pylist(labels, pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])), at / "labels.parquet")
    bench = pq.read_table("/root/testdata/sf0.001/benchmark.parquet").to_pylist()
    bench += [{"item_id": 900, "text": None}, {"item_id": 901, "text": ""}, {"item_id": 902, "text": "Avec"}, {"item_id": None, "text": "brown fox jumps over the lazy dog"}, dict(bench[0])]
    pq.write_table(pa.Table.from_pylist(bench, pa.schema([("item_id", pa.int64()), ("text", pa.string())])), at / "benchmark.parquet")
    return str(at)


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory, odd_dir):
    at = tmp_path_factory.mktemp("empty")
    for name in ("documents", "pages", "labels", "benchmark"):
        pq.write_table(pq.read_table(f"{odd_dir}/{name}.parquet").slice(0, 0), at / f"{name}.parquet")
    return str(at)


@pytest.fixture(scope="session")
def documents(odd_dir):
    return pq.read_table(f"{odd_dir}/documents.parquet").to_pylist()
