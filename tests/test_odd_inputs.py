"""Every query over documents and pages against its SQL, on inputs that the driver's tables lack."""

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quire.functions.dialect import SPACE_CHARACTERS, re2
from quire.plans.queries import ORACLES, QUERIES

SPACES = [c for c in SPACE_CHARACTERS if c not in " \t\n\r"]
WORD = "Wörterbuch" * 20  # 200 letters
TEXTS = [
    None, "", "　", "".join(SPACES), "　For my mother　", " Für Anna \n﻿", "Chapter 1 Chapter　2 ..... 14 Part III", WORD, "x" * 80, "x" * 79, "y" * 81 + " z",
    "a" * 40 + "　" + "b" * 120, " ".join(["c" * 50] * 3), "t h e　r o a d", "f l a c h e n   S t e i n e", "A &#8364; b &#x41;", "a --　b „q“ ‹r›", "(Titel) 　 «X» y ",
    "All rights　reserved. 2020", "“To be” — William　Shakespeare", "Sign up. Subscribe to　our newsletter.", "ISBN　978-3\n12 €\nHardcover\nerhältlich jetzt", "\x1c\x1d\x1e\x1f\x85 x", "😀" * 90, "\n\n　\n\n\nq\r\n\u000b\u000cr",
    "Jane Doe lives　in Berlin. She was born in 1970.", "I would　like to thank everyone.", " Introduction ", "1.　Something\n2. Other\nIV. End\n" * 4,
]
PAGES = [
    None, "", "<h1>A &#8364; b</h1>", "<title>T &#x41;</title>", "<h1>A　B</h1>", "<h2> 　</h2><title> Real Title　</title>x", "<h1>&#0;&#1114111;&#55296;&#x110000;&#99999999999999999999;&#x0000000041;&#00065;z</h1>",
    "<p>&amp;#65; &#38;amp; &#x26;lt; &#38;#66;</p>", "<p>&#x1F600;&#128512;</p>", "<p>a　　b  c</p>\n　\n \nx", "<h3>&lt;b&gt; &#60;i&#62;</h3>", "<p>f l a c h e n   S t e i n e</p>", "<title>　untitled </title>first line　", "&#;&#x;&#xg;&#12", "<script　x>no</script><style >no</style>y" + WORD,
    "<p class =　'dedication x'>z", "<section epub:type='copyright-page'>&#169;</section>", "　".join(["<p>q</p>"] * 3), "<h1>" + "w" * 130 + "</h1>",
]


@pytest.fixture(scope="module")
def odd(tmp_path_factory, sf_dir):
    at = tmp_path_factory.mktemp("odd-inputs")
    for f in os.listdir(sf_dir):
        if f not in ("documents.parquet", "pages.parquet"):
            os.symlink(f"{sf_dir}/{f}", at / f)
    docs = [{"doc_id": k, "text": t, "lang": "en", "source": f"src{k % 3}", "n_chars": 0} for k, t in enumerate(TEXTS * 7)]
    pq.write_table(pa.Table.from_pylist(docs, pq.read_schema(f"{sf_dir}/documents.parquet")), at / "documents.parquet")
    urls = ["http://a.example/x　y/ch-1 .html", None, "https://b.example/about　the_author.xhtml", "z"]
    pages = [{"page_id": k, "url": urls[k % 4], "html": t} for k, t in enumerate(PAGES * 3)]
    pq.write_table(pa.Table.from_pylist(pages, pq.read_schema(f"{sf_dir}/pages.parquet")), at / "pages.parquet")
    con = duckdb.connect()
    for f in os.listdir(at):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{at}/{f}'")
    return str(at), con


READ = [n for n, sql in ORACLES.items() if "from documents" in sql or "from pages" in sql]


@pytest.mark.parametrize("name", READ)
def test_query_equals_its_sql(spark, odd, name):
    at, con = odd
    df = QUERIES[name](spark, at)
    cols = sorted(df.columns)
    want = con.sql(ORACLES[name])
    order = [want.columns.index(c) for c in cols]
    got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    assert got == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


def test_values_are_the_right_ones(spark, odd):
    """Not only equal: entities are decoded, and Unicode spaces are white space."""
    at, _ = odd
    headings = {r.page_id: r.heading for r in QUERIES["page_headings"](spark, at).where(f"page_id < {len(PAGES)}").collect()}
    assert headings[2] == "A € b" and headings[4] == "A B" and headings[6] == "AAz" and headings[10] == "<b> <i>"
    titles = {r.page_id: r.title for r in QUERIES["page_title"](spark, at).collect()}
    assert titles[3] == "T A" and titles[5] == "Real Title"
    flags = {r.doc_id: r for r in QUERIES["content_predicates"](spark, at).collect()}
    assert flags[4].is_dedication and flags[18].is_short_rights is False


def test_patterns_for_the_other_engine():
    assert re2(r"[\s\S]*a.b\.\s") .startswith("(?s:.)*a[^") and re2("[.]", True) == "(?i)[.]"
    with pytest.raises(ValueError, match="no form"):
        re2(r"[a\S]")
