"""Golden vectors for classification, names, titles, text."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.functions.dialect import SparkOps, java
from quire.functions.html import html_to_text
from quire.operators import chapters as C
from quire.operators.classify import RULES, classify, position, with_position
from quire.plans import fixtures
from quire.sources.containers import file_is_skipped


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def golden(spark):
    """Each golden chapter in a book of ten, at its place among plain chapters."""
    rows = []
    for k, (place, title, content, _) in enumerate(fixtures.GOLDEN):
        at = {"start": 0, "middle": 5, "end": 9}[place]
        rows += [(f"g{k:02d}", i, title, content) if i == at else (f"g{k:02d}", i, f"Part {i}", fixtures._PROSE) for i in range(10)]
    return spark.createDataFrame(rows, "book_id string, chapter_idx bigint, title string, content string")


def test_golden_chapters(spark):
    got = {(r.book_id, r.position): r.filter_reason for r in C.filter_chapters(golden(spark)).where("chapter_idx in (0, 5, 9)").collect()}
    for k, (place, title, content, reason) in enumerate(fixtures.GOLDEN):
        assert got[f"g{k:02d}", place] == reason, (k, title, content)


def test_every_rule_is_met_somewhere(spark):
    seen = {r.filter_reason for r in C.filter_chapters(golden(spark)).select("filter_reason").distinct().collect()}
    seen |= {r.filter_reason for r in C.filter_chapters(fixtures.chapters(spark, "/root/testdata/sf0.01")).select("filter_reason").distinct().collect()}
    assert {r for r, _, _ in RULES} <= seen


def test_fixed_mode_wakes_dead_patterns(spark):
    rows = spark.createDataFrame([("b", k, t, c) for k, (t, c) in enumerate([("Chapter X", "For Anna"), ("By Kim Harrison", "Prose. " * 300), ("A", "B " * 300)])], "book_id string, chapter_idx long, title string, content string")
    reasons = lambda mode: [r.filter_reason for r in C.filter_chapters(rows, mode).orderBy("chapter_idx").collect()]
    assert reasons("compat") == [None, None, None]
    assert reasons("fixed") == ["dedication (content-detected)", "also by this author", None]
    with pytest.raises(ValueError):
        classify(with_position(rows), mode="other")


@pytest.mark.parametrize("n,want", [(1, "s"), (3, "sss"), (4, "ssse"), (5, "sssee"), (10, "sssmmmmmee"), (20, "ssss" + "m" * 13 + "eee")])
def test_positions(spark, n, want):
    rows = spark.range(n).select(position(F.col("id"), F.lit(n)).alias("p"), "id").orderBy("id").collect()
    assert "".join(r.p[0] for r in rows) == want


def test_names_in_reader_and_columns(spark):
    rows = spark.createDataFrame([(p,) for p in fixtures.PATHS], "path string").select("path", C.filename_skip_reason(F.col("path")).alias("r")).collect()
    assert all(file_is_skipped(r.path) == r.r for r in rows)
    known = {r.path: r.r for r in rows}
    assert known["x/discover.xhtml"] is None and known["x/recovery.xhtml"] == "cover page" and known["bmx.xhtml"] is None


@pytest.mark.parametrize("raw,want", [("&amp;mdash;", "—"), ("&amp;lt;", "&lt;"), ("&amp;#65;", "A"), ("&#x41;&#X41;", "A&#X41;"), ("&#0;&#1114111;&#99999999999;x", "x"), ("a&nbsp;b", "a b"), ("&#8212;", "—"), ("&unknown;", "&unknown;")])
def test_entities(spark, raw, want):
    assert one(spark, raw, X.decode_entities) == want


@pytest.mark.parametrize(
    "raw,want",
    [
        ("f l a c h e n   S t e i n e", "flachen Steine"),
        ("H E L L O  W O R L D", "HELLO WORLD"),
        ("A B test", "A B test"),
        ("„f l a c h“ x", "„flach“ x"),
        ("see a b c d.", "see abcd."),
        ("a b c1", "a b c1"),
        ("x a b c d1 y", "x a b c d1 y".replace("x a b c", "xabc")),
        ("a     b c d", "a bcd"),
        ("", ""),
    ],
)
def test_letter_spacing(spark, raw, want):
    assert one(spark, raw, X.fix_letter_spacing) == want


def test_letter_spacing_against_an_expression(spark):
    import random

    import regex

    run = regex.compile(r"""(^|[\s"'„‚“”‘’«»‹›(\[—–])(\p{L}(?:[ ]{1,4}\p{L}){2,})(?=[\s.,;:!?"'„‚“”‘’«»‹›)\]—–…]|$)""")

    def plain(line):
        line = run.sub(lambda m: m[1] + " ".join(w.replace(" ", "") for w in re.split(" {2,}", m[2])), line)
        return re.sub(r"[^\S\n]{2,}", " ", line)

    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "B", "é", " ", " ", " ", "  ", "12", "xy", ".", "(", "”", "—", "\n"]) for _ in range(rng.randint(0, 30))) for _ in range(6000)]
    df = spark.createDataFrame([(t,) for t in [*texts, " ".join("a" * 50_000)]], "x string")
    for r in df.select("x", X.fix_letter_spacing(F.col("x")).alias("y")).collect():
        assert r.y == "\n".join(map(plain, r.x.split("\n"))), repr(r.x[:80])


def test_normal_forms(spark):
    assert one(spark, "a​b­c  d   e\n\n\n\n f \t\n", X.normalize) == "abc d e\n\nf"
    assert one(spark, None, X.normalize) == ""
    assert one(spark, "x" * 80, X.normalize_for_export) == "x" * 40 + " " + "x" * 40 + " "
    assert one(spark, "x" * 79 + " y", X.normalize_for_export) == "x" * 79 + " y"
    assert one(spark, "a -- b „c‚ ‹d›", X.normalize_for_export) == "a — b \"c\" 'd'"
    assert one(spark, " 　﻿x ", SparkOps.trim) == "x"
    assert one(spark, "a😀", SparkOps.length) == 3


def test_normalize_is_idempotent(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").withColumn("a", X.normalize(F.col("text")))
    assert rows.where(X.normalize(F.col("a")) != F.col("a")).count() == 0


def test_html(spark):
    page = "<html><head><title>T</title><link rel=x><style>p{}</style></head><body><!-- c --><p>One &amp; two<br/>three</p>\n\n\n<script>x<y</script><b>four</b> &#8364;</body></html>"
    assert one(spark, page, html_to_text) == "T\n\nOne & two\nthree\n\nfour €"
    assert one(spark, None, html_to_text) == ""


def test_pattern_translation():
    assert java("[a\\s]") != java("a\\s") and java("a$").endswith("\\z") and java("x", True).startswith("(?iu)")


def test_hazards(spark):
    match = lambda s, p, i=False: one(spark, s, lambda c: SparkOps.match(c, p, i))
    assert match("übook", r"\bbook") and not match("abook", r"\bbook")
    assert not match("toc\n", r"^toc$") and match("ÜBER", "über", True) and match("a b", r"a\sb")
    assert unicodedata.name("€") == "EURO SIGN"


def test_removed_titles_classifies_once_and_keeps_books_without_a_name(spark, tmp_path):
    """The count is taken from the labels that are digested, and a book of null is a book as in the SQL."""
    import duckdb

    from quire.plans.queries import ORACLES, QUERIES

    docs = spark.range(120).selectExpr("id as doc_id", "concat('text ', id) as text", "case when id % 3 > 0 then concat('s', id % 3) end as source")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["removed_titles"](spark, str(tmp_path))
    assert "RLIKE" not in found._jdf.queryExecution().optimizedPlan().toString()
    db = duckdb.connect()
    db.execute(f"create view documents as from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    expected = db.execute(ORACLES["removed_titles"]).fetchall()
    assert len(expected) == 3 and {tuple(r) for r in found.collect()} == set(expected)
