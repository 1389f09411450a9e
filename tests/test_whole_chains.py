"""Documents through the whole chains, letter spacing included, against plain versions."""

import html
import re
import time
from hashlib import md5

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import regex
from pyspark.sql import functions as F

from quire.functions.dialect import java
from quire.functions.text import normalize, normalize_for_export
from quire.plans.queries import ORACLES, QUERIES

RUN = regex.compile(r"""(^|[\s"'„‚“”‘’«»‹›(\[—–])(\p{L}(?:[ ]{1,4}\p{L}){2,})(?=[\s.,;:!?"'„‚“”‘’«»‹›)\]—–…]|$)""")


def normal(text):
    text = re.sub("[\u200b-\u200f\u2060-\u2064\ufeff]", "", text or "").replace("\u00ad", "").replace("\u00a0", " ")
    lines = [RUN.sub(lambda m: m[1] + " ".join(w.replace(" ", "") for w in re.split(" {2,}", m[2])), x) for x in text.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(re.sub(r"[^\S\n]{2,}", " ", x).strip() for x in lines)).strip()


def exported(text):
    return re.sub("[‹›]", "'", re.sub("[„‚«»]", '"', re.sub(r"(\s)--(\s)", r"\1—\2", normal(text))))


TEXTS = ["f l a c h e n   S t e i n e", "see a b c d. -- „t h e  e n d“", "a\u00adb  c\n\n\n\nH\u200b E L L O\u00a0W", "plain text", "", None]


def test_whole_chains(spark, tmp_path):
    pq.write_table(pa.table({"doc_id": list(range(len(TEXTS))), "text": TEXTS}), tmp_path / "documents.parquet")
    digest = lambda x: md5(x.encode()).hexdigest()
    got = {r.doc_id: (r.digest, r.n) for r in QUERIES["normalized_documents"](spark, str(tmp_path)).collect()}
    assert got == {k: (digest(normal(t)), len(normal(t))) for k, t in enumerate(TEXTS)}
    got = {r.doc_id: r.digest for r in QUERIES["exported_documents"](spark, str(tmp_path)).collect()}
    assert got == {k: digest(exported(t)) for k, t in enumerate(TEXTS)}


PAGES = ["<p>the a a a that</p>", "<p>f l a c h e n   S t e i n e &amp; so</p>", "<h1>A &#8364; &#x41;</h1><p>b&#66;</p>", "<p>y ñ ñ ue</p>\n\n\n<br/>é é é éê", "plain", "", None]


def page(markup):
    lines = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)[^>]*/?>", "\n", markup or "")).split("\n")
    return normal(re.sub(r"[ \t]+", " ", re.sub(r"\n\s*\n\s*\n", "\n\n", html.unescape("\n".join(lines)))))


def test_pages(spark, tmp_path):
    """Spaced letters and numeric entities: ``page_text`` is its SQL, ``normalized_pages`` the whole chain."""
    pages = pa.table({"page_id": list(range(len(PAGES))), "html": PAGES})
    pq.write_table(pages, tmp_path / "pages.parquet")
    want = duckdb.connect().sql(ORACLES["page_text"]).fetchall()
    got = [tuple(r) for r in QUERIES["page_text"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    got = {r.page_id: (r.digest, r.n) for r in QUERIES["normalized_pages"](spark, str(tmp_path)).collect()}
    assert got == {k: (md5(page(t).encode()).hexdigest(), len(page(t))) for k, t in enumerate(PAGES)}
    assert got[0] != dict((k, v) for k, *v in want)[0]


def test_titles(spark, tmp_path):
    """``normalized_titles`` closes spaced letters of the text, ``page_title`` does not."""
    pages = pa.table({"page_id": [1, 2, 3], "html": ["<p>f l a c h e n   S t e i n e</p>", "<h1>A &#8364;</h1>", None], "url": ["x", "y", None]})
    pq.write_table(pages, tmp_path / "pages.parquet")
    titles = lambda name: {r.page_id: r.title for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert titles("normalized_titles") == {1: "flachenSteine", 2: "A €", 3: "Chapter 3"}
    assert titles("page_title")[1] == "f l a c h e n S t e i n e"


WORDS = ["x" * 79, "x" * 80, "y" * 121, "«" * 95, "a\n" + "ä" * 81, "😀" * 160, "z" * 80 + "\n", "a -- b --  c", "„q‚", ""]


def test_long_words_in_pieces(spark):
    """Only pieces that may hold a long word are read for it; the result is that of one expression over the whole text."""
    texts = [" ".join(WORDS[k:] + WORDS[:j]) + w for k in range(len(WORDS)) for j in (0, 3) for w in ("", "x" * 300, "\tv", "　" + "w" * 90)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    one = F.regexp_replace(normalize(F.col("text")), java(r"(?:(?<!\S)(?=\S{80})|\G(?!\A)(?<=\S))(\S{40})"), "$1 ")
    got = rows.select("text", normalize_for_export(F.col("text")).alias("got"), one.alias("one")).collect()
    assert len(got) == len(texts) and all(r.got == re.sub("[‹›]", "'", re.sub("[„‚«»]", '"', re.sub(r"(\s)--(\s)", r"\1—\2", r.one))) for r in got)


def test_breaking_words_costs_less_than_the_rest(spark):
    """Texts without long words, as almost all are: before, the look at each character took longer than all other steps."""
    docs = spark.range(0, 64, 1, 8).select(F.repeat(F.concat(F.lit("some words, "), "id", F.lit(" and more of them\n")), 4000).alias("text")).cache()
    docs.count()

    def seconds(column):
        begin = time.perf_counter()
        docs.select(F.md5(column.cast("binary"))).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    plain, whole = normalize(F.col("text"), False), normalize_for_export(F.col("text"), False)
    assert min(seconds(whole) for _ in range(3)) < 2.5 * min(seconds(plain) for _ in range(3))
    docs.unpersist()
