"""Literal expectations, and what the library does at its edges."""

import time

import pytest
from pyspark.sql import functions as F

from quire.operators import catalog as K
from quire.operators import chapters as C
from quire.operators import export as E
from quire.operators import translation as T
from quire.sources.containers import decoded, read_books, read_epub

from test_books import FILES, PROSE, epub

START = {
    "Chapter 1": None, "Table of Contents": "table of contents", "Contents": "table of contents", "Contents and more": None, "TOC": "table of contents", "Inhaltsverzeichnis": "table of contents", "Inhalt": "table of contents", "Übersicht": "table of contents",
    "Copyright 2020": "copyright notice", "Legal Notice": "copyright notice", "Legal matters": None, "Impressum": "copyright notice", "Imprint": "copyright notice", "Rights page": "copyright notice", "Urheberrecht": "copyright notice", "Colophon": "copyright notice",
    "Books by Jane Doe": "also by this author", "Romane von Jane Doe": "also by this author", "By Jane Doe": None,
    "Foreword": "foreword/preface", "Preface": "foreword/preface", "Prologue": "foreword/preface", "Preamble": "foreword/preface", "Vorwort": "foreword/preface", "Einleitung": "foreword/preface", "Author's Note": "foreword/preface", "Anmerkungen des Autors": "foreword/preface", "Kapitel 7 - Vorwort": "foreword/preface", "Chapter 3: Preface": "foreword/preface", "A Foreword": None,
    "Introduction": "foreword/introduction", "Chapter 2: Introduction": "foreword/introduction",
    "Dedication": "dedication", "Widmung": "dedication", "For the Queen": "dedication", "Für Anna": "dedication", "To my mother": "dedication", "To mothers": None, "In memory of them": "dedication", "Fortune": None,
    "Epigraph": "epigraph", "Motto": "epigraph", "Zitat": "epigraph", "Quote": "epigraph",
    "Praise for this": "praise/reviews", "Reviews": "praise/reviews", "Pressestimmen": "praise/reviews", "What readers are saying": "praise/reviews",
    "About this book": "about the book", "Über dieses Buch": "about the book", "Klappentext": "about the book", "Synopsis": "about the book",
    "About the Author": "about the author", "About me": "about the author", "Meet the author": "about the author", "Über den Autor": "about the author", "Vita": "about the author", "Zur Person": "about the author", "Vitality": None,
    "Acknowledgements": "acknowledgements", "Acknowledgments": "acknowledgements", "Danksagung": "acknowledgements",
    "Newsletter": "publisher promo/newsletter", "Glossary": "glossary", "Cover": "cover/title page", "Title Page": "cover/title page", "Frontispiece": "cover/title page", "Discovery": None, "": None, "XII": None, "Ein neuer Morgen": None,
    "Index": None, "Bibliography": "book suggestions", "References": None,
}
END = {"Index": "index", "Stichwortverzeichnis": "index", "The Index of Things": None, "References": "bibliography", "Danksagung": "acknowledgements", "Vita": "about the author", "Glossary": "glossary", "Table of Contents": "table of contents", "Dedication": None, "Foreword": None, "Cover": None, "Epigraph": None, "Klappentext": None}
MIDDLE = {"Table of Contents": "table of contents", "Impressum": "copyright notice", "Romane von Jane Doe": "also by this author", "Danksagung": None, "Vita": None, "Index": None, "Glossary": None, "Newsletter": None, "Foreword": None}
_PLAIN = "She walked on. The road was long and nobody spoke for hours, and then the rain began to fall on all of them. " * 4


def test_titles_by_position(spark):
    rows, want = [], {}
    for place, titles in ((0, START), (5, MIDDLE), (9, END)):
        for k, (title, reason) in enumerate(titles.items()):
            book = f"{place}-{k:03d}"
            rows += [(book, i, title if i == place else f"Part {i}", _PLAIN) for i in range(10)]
            want[book] = (title, reason)
    done = C.filter_chapters(spark.createDataFrame(rows, "book_id string, chapter_idx long, title string, content string"))
    got = {r.book_id: (r.title, r.filter_reason) for r in done.collect() if r.chapter_idx == int(r.book_id[0])}
    assert got == want
    assert {r.filter_reason for r in done.where("title like 'Part %'").collect()} == {None}


def test_file_names(spark):
    want = {
        "OEBPS/cover.xhtml": "cover page", "x/discover.xhtml": None, "back-cover.jpg": "cover page", "title.html": "title page", "titlepage.htm": "title page", "toc.xhtml": "table of contents", "table-of-contents.html": "table of contents",
        "nav.xhtml": "navigation", "navigation.xhtml": None, "Copyright.XHTML": "copyright", "impressum.htm": "copyright", "widmung.html": "dedication", "colophon.xhtml": "colophon", "about_the_author.xhtml": "about the author", "vita.html": "about the author",
        "acknowledgments.xhtml": "acknowledgements", "danksagung.htm": "acknowledgements", "also-by.xhtml": "publisher promo", "bm01.xhtml": "publisher promo", "bmx.xhtml": None, "prh-ad.html": "publisher promo", "ch01.xhtml": None, "copyright": None,
    }
    rows = spark.createDataFrame([(p,) for p in want], "path string").select("path", C.filename_skip_reason(F.col("path")).alias("r")).collect()
    assert {r.path: r.r for r in rows} == want


def test_package_text():
    assert decoded("A &amp; B&nbsp;c &amp;lt; &amp;mdash; &#65;&#x42;&#0;&#xD800; &nbsp") == "A & B c &lt; — AB &nbsp"
    with pytest.raises(ValueError):
        read_epub(epub(FILES, ["x%zz.html"]))
    meta, found = read_epub(epub(FILES, ["ch1.xhtml"], extra='<item href="last.xhtml" id="i0"/>'))
    assert [p for p, _ in found] == ["OEBPS/last.xhtml"]


def test_malformed_reference_makes_an_error_book(spark, tmp_path):
    (tmp_path / "a.ePuB").write_bytes(epub({"OEBPS/x%zz.html": PROSE}, ["x%zz.html"]))
    book = C.book_documents(read_books(spark, str(tmp_path))).first()
    assert book.parse_error and book.title == "Unknown Title" and book.chapters == []


def test_upper_case_files_are_ingested(spark, tmp_path):
    from quire.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "A.EPUB").write_bytes(epub(FILES, ["ch1.xhtml"]))
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_quota_is_the_accounts(spark):
    rows = [(b, i, 400) for b in ("a", "b", "c") for i in range(2)]
    items = spark.createDataFrame(rows, "book_id string, index int, char_count long")
    got = {(r.book_id, r["index"]): (r.spent, r.provider) for r in T.plan_providers(items, 900).collect()}
    assert got == {("a", 0): (400, "deepl"), ("a", 1): (800, "deepl"), ("b", 0): (1200, "google"), ("b", 1): (1600, "google"), ("c", 0): (2000, "google"), ("c", 1): (2400, "google")}
    assert {r.provider for r in T.plan_providers(items, None).collect()} == {"deepl"}


def test_probe():
    assert T.probe(None) is None and T.probe(lambda: None) is None and T.probe(lambda: 1 / 0) is None
    assert T.probe(lambda: time.sleep(5), timeout=0.05) is None
    assert T.probe(lambda: (990, 1000)) == {"used": 990, "limit": 1000, "remaining": 10, "has_capacity": False}
    assert T.probe(lambda: (5, 0))["has_capacity"] and T.probe(lambda: (900, 1000))["remaining"] == 100


def test_whole_book():
    upper = lambda title, text: (title.upper(), text.upper(), "google" if "x" in text else "deepl")
    book = T.translate_book("", [("a", "b"), ("c", "x")], upper)
    assert (book["content"], book["chapters"], book["provider"]) == ("B\n\nX", [("A", "B"), ("C", "X")], "deepl")
    assert book["stats"]["total_characters"] == 2 and book["stats"]["total_chunks"] == 0
    alone = T.translate_book("x y", [], upper)
    assert (alone["content"], alone["chapters"], alone["provider"], alone["stats"]["total_characters"]) == ("X Y", [], "google", 3)
    assert T.translate_text("abc", T.UpperCase()) == "ABC"


def test_requests_and_rows(spark):
    bodies = ['{"chapterIndex":0,"title":"t","content":"c"}', '{"chapterIndex":1.5,"title":"t","content":"c"}', '{"chapterIndex":"0","title":"t","content":"c"}', '{"title":"t","content":"c"}', '{"chapterIndex":0,"title":"","content":"c"}', '{"chapterIndex":0,"title":"t"}', '{"chapterIndex":null,"title":"t","content":"c"}']
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, j string").select("id", F.parse_json("j").alias("body"))
    assert {r.id for r in K.valid_requests(df).select("id").collect()} == {0, 1}
    kind = "book_id string, user_id string, original string, content string, chapters array<struct<title:string,content:string>>, providers array<string>"
    done = spark.createDataFrame([("1", "u", None, "t", [("a", "t")], ["deepl", None, "google"]), ("2", "u", "o", "t", [], ["google"]), ("3", "u", "o", "t", [], None)], kind)
    rows = {r.epub_file_id: r for r in K.new_translations(done).withColumn("body", F.to_json("translated_content")).collect()}
    assert {k: r.provider for k, r in rows.items()} == {"1": "mixed", "2": "google", "3": "deepl"}
    assert rows["1"].body == '{"chapters":[{"content":"t","title":"a"}],"original":"","providers":["deepl",null,"google"],"translated":"t"}' and '"providers":null' in rows["3"].body
    assert rows["1"].target_language == "de" and rows["1"].translation_status == "completed" and len({r.id for r in rows.values()}) == 3
    books = spark.createDataFrame([("1", None), ("2", '{"a":1}')], "id string, j string").select("id", F.parse_json("j").alias("original_content"))
    assert {r.id: r.j for r in K.backfill_content(books).select("id", F.to_json("original_content").alias("j")).collect()} == {"1": "{}", "2": '{"a":1}'}
    name = spark.range(1).select(K.encoded_name(F.lit("Ä b_(1)~!'*.pdf")).alias("n")).first().n
    assert name == "%C3%84%20b_(1)~!'*.pdf"


def test_documents_keep_their_own_files(spark, tmp_path):
    books = spark.createDataFrame([("a/b", "T", "A", []), ("a_b", "T", "A", []), ("a:b", "T", "A", [])], "book_id string, title string, author string, chapters array<struct<title:string,content:string>>")
    out = E.write_documents(E.render(books), str(tmp_path / "pdf")).collect()
    assert len({r.path for r in out}) == 3 and (tmp_path / "pdf" / "a_b.pdf").exists()
    text = bytes(E.render(books.withColumn("language", F.lit("de")), form="text").first().document).decode().split("\f")
    assert text[0].splitlines() == ["T", "A", "Language: de", "- 1 -"] and text[1].splitlines() == ["(No content available)", "- 2 -"]


def test_shared_folder_is_asked_for_off_this_machine():
    from quire.storage import shared_dir

    class Context:
        master, applicationId = "spark://far:7077", "x"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        shared_dir(Session())
