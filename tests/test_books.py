"""Containers, reassembly, translation, export, library changes."""

import io
import random
import re
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.operators import catalog as K
from quire.operators import chapters as C
from quire.operators import export as E
from quire.operators import translation as T
from quire.sources.containers import read_books, read_epub, read_mobi


def epub(files, order, *, opf="OEBPS/content.opf", container=True, extra="", meta="<dc:title>Bücher &amp; mehr</dc:title><dc:creator>A</dc:creator><dc:language>de</dc:language>"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if container:
            z.writestr("META-INF/container.xml", f'<rootfile full-path="{opf}"/>')
        items = "".join(f'<item id="i{k}" href="{h}"/>' for k, h in enumerate(order))
        z.writestr(opf, f"<package>{meta}<manifest>{items}{extra}</manifest><spine>{''.join(f'<itemref idref={chr(34)}i{k}{chr(34)}/>' for k in range(len(order)))}</spine></package>")
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


PROSE = "<p>" + "It was a long day and nothing happened at all. " * 20 + "</p>"
FILES = {"OEBPS/ch1.xhtml": "<h1>One</h1>" + PROSE, "OEBPS/a b.xhtml": "<h2>Two</h2>" + PROSE, "OEBPS/empty.xhtml": "<p> </p>", "OEBPS/copyright.xhtml": "x", "OEBPS/ack.xhtml": "<h1>Acknowledgements</h1>thanks", "OEBPS/last.xhtml": "<p>It ends here</p>" + PROSE}


def test_epub_reading_order():
    meta, found = read_epub(epub(FILES, ["ch1.xhtml", "a%20b.xhtml", "copyright.xhtml", "gone.xhtml", "empty.xhtml", "ch1.xhtml"]))
    assert meta == {"title": "Bücher & mehr", "author": "A", "language": "de"}
    assert [p for p, _ in found] == ["OEBPS/ch1.xhtml", "OEBPS/a b.xhtml", "OEBPS/empty.xhtml", "OEBPS/ch1.xhtml"]
    _, found = read_epub(epub(FILES, ["copyright.xhtml"], container=False))
    assert [p for p, _ in found] == ["OEBPS/a b.xhtml", "OEBPS/ack.xhtml", "OEBPS/ch1.xhtml", "OEBPS/empty.xhtml", "OEBPS/last.xhtml"]


def mobi(text, *, packed=True, title="My Mobi"):
    raw = text.encode()
    records = [raw[i : i + 4096] for i in range(0, len(raw), 4096)]
    if packed:
        records = [b"".join(bytes([b]) if 9 <= b < 128 else bytes([1, b]) for b in r) for r in records]
    exth = b"EXTH" + struct.pack(">II", 12 + 8 + 3, 1) + struct.pack(">II", 100, 11) + b"Ann"
    head = bytearray(16 + 232)
    struct.pack_into(">HHIHHHH", head, 0, 2 if packed else 1, 0, len(raw), len(records), 4096, 0, 0)
    head[16:20] = b"MOBI"
    struct.pack_into(">III", head, 20, 232, 2, 65001)
    name = title.encode()
    struct.pack_into(">II", head, 84, 16 + 232 + len(exth), len(name))
    struct.pack_into(">I", head, 92, 7)
    struct.pack_into(">I", head, 128, 0x40)
    records.insert(0, bytes(head) + exth + name)
    out = bytearray(b"internal".ljust(32, b"\0") + bytes(28) + b"BOOKMOBI" + bytes(8) + struct.pack(">H", len(records)))
    at = 78 + 8 * len(records) + 2
    for r in records:
        out += struct.pack(">II", at, 0)
        at += len(r)
    return bytes(out + b"\0\0" + b"".join(records))


@pytest.mark.parametrize("packed", [True, False])
def test_mobi(packed):
    text = f"<h1>Eins</h1>{PROSE}<mbp:pagebreak/>{PROSE} ö <mbp:pagebreak></mbp:pagebreak><p>Ende</p>"
    meta, parts = read_mobi(mobi(text, packed=packed))
    assert meta == {"title": "My Mobi", "author": "Ann", "language": "de"} and len(parts) == 3 and "ö" in parts[1][1]


def test_palmdoc_copies():
    from quire.sources.mobi import palmdoc as _palmdoc

    pair = 0x8000 | 3 << 3 | 4  # three back, seven bytes
    assert _palmdoc(b"abc" + struct.pack(">H", pair) + b"\xe4") == b"abc" + b"abcabca" + b" d"
    with pytest.raises(ValueError):
        _palmdoc(b"a" + struct.pack(">H", 0x8000 | 9 << 3))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("books")
    (at / "good.epub").write_bytes(epub(FILES, ["ch1.xhtml", "a%20b.xhtml", "empty.xhtml", "ack.xhtml", "last.xhtml"]))
    (at / "UPPER.EPUB").write_bytes(epub(FILES, ["ack.xhtml"], meta=""))
    (at / "bad.epub").write_bytes(b"no archive")
    (at / "percent.epub").write_bytes(epub(FILES, ["%ff%zz.xhtml"]))
    (at / "m.mobi").write_bytes(mobi(f"{PROSE}<mbp:pagebreak/><h2>Zwei</h2>{PROSE}"))
    (at / "skip.txt").write_text("x")
    return str(at)


def test_books_from_files(spark, folder):
    books = {r.book_id.rsplit("/", 1)[1]: r for r in C.book_documents(read_books(spark, folder)).collect()}
    assert set(books) == {"good.epub", "UPPER.EPUB", "bad.epub", "percent.epub"}
    good = books["good.epub"]
    assert (good.title, good.author, good.language) == ("Bücher & mehr", "A", "de")
    assert [c.title for c in good.all_chapters] == ["One", "Two", "Acknowledgements", "It ends here"]
    assert [c.title for c in good.chapters] == ["One", "Two", "It ends here"] or good.removed_titles == ["Acknowledgements (acknowledgements)"]
    assert good.total_chapters == 4 and good.kept_chapters + good.removed_chapters == 4 and good.content.startswith("One")
    bad = books["bad.epub"]
    assert bad.title == "Unknown Title" and bad.chapters == [] and bad.content.startswith("Error: Failed to parse EPUB")
    assert books["UPPER.EPUB"].title == "Unknown Title"
    m = C.book_documents(read_books(spark, folder, "mobi"), "mobi").first()
    assert m.title == "My Mobi" and [c.title for c in m.all_chapters] == ["Chapter 1", "Zwei"]


def test_streaming_ingest(spark, folder, tmp_path):
    from quire.streaming.ingest import ingest

    for _ in range(2):  # a second run finds nothing new
        ingest(spark, folder, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.select("book_id").distinct().count() == 4 and rows.where("parse_error is null").count() == rows.where("html is not null").count()


def test_work_items_ladder(spark):
    kind = "book_id string, title string, content string, chapters array<struct<title:string,content:string>>, all_chapters array<struct<title:string,content:string>>"
    long = "prose and more prose " * 40
    rows = [
        ("a", "T", "c", [("x", "y")], [("", long), ("Dedication", "z"), ("B", long)]),
        ("b", "T", "c", [("Dedication", "kept")], None),
        ("c", "", "whole", [], []),
        ("d", "Name", "whole", None, None),
    ]
    got = sorted((r.book_id, r["index"], r.title, r.content[:5], r.char_count) for r in C.work_items(spark.createDataFrame(rows, kind)).collect())
    assert got == [("a", 0, "Chapter 1", "prose", len(long)), ("a", 1, "B", "prose", len(long)), ("b", 0, "Dedication", "kept", 4), ("c", 0, "Full content", "whole", 5), ("d", 0, "Name", "whole", 5)]


def test_entries_by_encoded_path(spark):
    paths = spark.createDataFrame([("b", 0, "a b/ö.x"), ("b", 1, "c.x"), ("b", 2, "none")], "book_id string, pos int, path string")
    entries = spark.createDataFrame([("b", "a%20b/%C3%B6.x", "1"), ("b", "c.x", "2")], "book_id string, path string, html string")
    assert sorted((r.pos, r.html) for r in C.join_entries(paths, entries).collect()) == [(0, "1"), (1, "2")]


# ------------------------------------------------------------------ translation


def test_chunks():
    rng = random.Random(7)
    for _ in range(400):
        text = "".join(rng.choice(["word ", "längeres Wort ", "x", "! ", ". ", "?” ", "…", "\n", " ", "y" * 30]) for _ in range(rng.randint(0, 120)))
        limit = rng.choice([20, 50, 90])
        got = T.chunk_text(text, limit)
        squeeze = lambda s: re.sub(r"\s", "", s)
        assert squeeze("".join(got)) == squeeze(text)
        if len(text) > limit:
            assert all(len(c) <= limit or " " not in c for c in got) and all(c == c.strip() != "" for c in got)
        else:
            assert got == [text]
    long = "word " * 1000 + "."
    assert len(T.chunk_text(long, 3000)) == 2
    assert T.chunk_text("a " * 200_000, 3000)[0].count("a") == 1500


def test_retry_and_fallback(spark):
    slept, calls = [], []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) < 3:
            raise OSError("fetch failed")
        return [t[::-1] for t in texts]

    assert T.call(T.Provider("deepl", flaky), ["ab"], slept.append) == ["ba"] and slept == [1.0, 2.0]
    with pytest.raises(T.RequestError):
        T.call(T.Provider("deepl", lambda t: []), ["ab"])

    def empty(texts):
        raise T.QuotaError("quota")

    items = spark.createDataFrame([("b", k, f"T{k}", "some text. " * 500, "deepl" if k < 2 else "google") for k in range(4)], "book_id string, index int, title string, content string, provider string")
    got = T.translate_items(items, {"deepl": T.Provider("deepl", empty), "google": T.UpperCase("google", 3000)})
    rows = got.orderBy("index").collect()
    assert [r.provider for r in rows] == ["google"] * 4 and rows[0].translated_title == "T0" and rows[0].translated_content == ("SOME TEXT. " * 500).strip()
    book = T.translated_books(got).first()
    assert book.provider == "google" and len(book.chapters) == 4


def test_rollup_of_unknown_providers(spark):
    df = spark.createDataFrame([("a", None), ("a", "google"), ("b", None), ("c", "deepl"), ("c", "google")], "book_id string, provider string")
    assert {r.book_id: r.provider for r in T.overall_provider(df).collect()} == {"a": "google", "b": "deepl", "c": "mixed"}


# ------------------------------------------------------------------ export


def plain_echoes(content, title):
    key = lambda s: re.sub(r"\s+", " ", re.sub(r"""["'„‚“”‘’«»‹›()\[\]]""", "", s.lower())).strip()
    t = key(title)
    forms = {t, t.split(",")[0].strip() or t}
    m = re.match(r"(kapitel|chapter|teil|part)\s*(\d+)", t)
    forms |= {m[2], m[0]} if m else set()
    from quire.functions.patterns import ECHO_LINES

    lines, hits = content.split("\n"), 0
    for i, line in enumerate(lines):
        if hits >= 8 or i >= 8 + hits:
            break
        s = line.strip()
        if not s:
            continue
        k = key(s)
        if k == "" or (len(s) <= 120 and (k in forms or any(re.search(p.replace("$", r"\Z"), k) for p in ECHO_LINES))):
            lines[i] = ""
            hits += 1
        else:
            break
    return re.sub(r"\A\s*\n+", "", "\n".join(lines)) if hits else content


def test_title_echoes(spark):
    rng = random.Random(9)
    pool = ["Kapitel 3", "Chapter 3, The End", "the end", "", " ", "12", "XIV", "Mild", "Some prose here.", "“The End”", "kapitel 3: x", "()"]
    rows = [("\n".join(rng.choice(pool) for _ in range(rng.randint(0, 22))), rng.choice(["Kapitel 3", "The End, again", "", "Part 12"])) for _ in range(300)]
    df = spark.createDataFrame(rows, "content string, title string")
    got = df.select("content", "title", E.strip_title_echoes(F.col("content"), F.col("title")).alias("out")).collect()
    for r in got:
        assert r.out == plain_echoes(r.content, r.title), (r.content, r.title)


def test_documents(spark, tmp_path):
    rows = [("b", "Titel (1)", "Autor", [("Eins", "wort " * 3000), ("Zwei", "kurz")])]
    books = spark.createDataFrame(rows, "book_id string, title string, author string, chapters array<struct<title:string,content:string>>")
    doc = E.render(books).first()
    raw = bytes(doc.document)
    assert raw.startswith(b"%PDF-1.4") and raw.rstrip().endswith(b"%%EOF") and raw.count(b"/Type /Page ") == doc.n_pages > 5
    start = int(re.search(rb"startxref\n(\d+)", raw)[1])
    assert raw[start:].startswith(b"xref") and b"/Count %d" % doc.n_pages in raw
    for at in re.findall(rb"(\d{10}) 00000 n", raw):
        assert re.match(rb"\d+ 0 obj", raw[int(at) :])
    text = bytes(E.render(books, form="text").first().document).decode().split("\f")
    assert len(text) == doc.n_pages and text[0].startswith("Titel (1)\nAutor") and "Zwei" in text[-1]
    out = E.write_documents(E.render(books), str(tmp_path / "pdf")).collect()
    assert (tmp_path / "pdf" / "b.pdf").read_bytes() == raw and out[0].n_bytes == len(raw)


def test_export_bodies(spark):
    bodies = ['{"chapters":[{"title":"a","content":"x"},{"title":"b"},{"title":"c","content":"y"}],"translated":"z"}', '{"translated":"z"}', '"bare"', "{}", '{"chapters":[]}', '{"chapters":5,"translated":"ok"}']
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, j string").select("id", F.parse_json("j").alias("translated_content"))
    assert {r.id: r.text for r in E.export_content(df).select("id", "text").collect()} == {0: "x\n\ny", 1: "z", 2: "bare", 5: "ok"}


# ------------------------------------------------------------------ library


def test_changes(spark):
    books = spark.createDataFrame([("1", "u", "A", "f"), ("2", "u", "B", None), ("3", "v", "C", "f")], "id string, user_id string, title string, folder_id string")
    by = lambda df, c: {r.id: r[c] for r in df.collect()}
    assert by(K.rename_book(books, "1", "u", " New "), "title") == {"1": "New", "2": "B", "3": "C"}
    assert by(K.rename_book(books, "3", "u", "New"), "title")["3"] == "C" and by(K.rename_book(books, "1", "u", "  "), "title")["1"] == ""
    with pytest.raises(ValueError):
        K.rename_book(books, "1", "u", "")
    ids = spark.createDataFrame([("1",), ("1",), ("3",)], "id string")
    assert by(K.move_books(books, ids, "u", None), "folder_id") == {"1": None, "2": None, "3": "f"}
    assert [r.id for r in K.in_folder(books, None).collect()] == ["2"]
    folders = spark.createDataFrame([("f", "u", "x", None)], "id string, user_id string, name string, created_at timestamp")
    left, freed = K.delete_folder(folders, books, folders.select("id"))
    assert left.count() == 0 and by(freed, "folder_id") == {"1": None, "2": None, "3": None}
    assert K.add_folder(folders, "u", " y ").where("name = 'y'").count() == 1
    with pytest.raises(ValueError):
        K.add_folder(folders, "u", " ")
    assert K.rename_folder(folders, "f", "u", " z ").first().name == "z"
    none = spark.createDataFrame([], "id string, user_id string")
    translations = spark.createDataFrame([("t", "1", "u")], "id string, epub_file_id string, user_id string")
    assert [x.count() for x in K.delete_book(books, translations, none)] == [3, 1]
    assert [x.count() for x in K.delete_user(none, books, translations, folders, "u")] == [0, 1, 0, 0]
    new = K.new_book(spark.createDataFrame([("u", "a.epub", "", "Meta", "A", "en", 5, "{}")], "user_id string, original_filename string, custom_title string, title string, author string, language string, file_size long, document string"), F.lit("2024-01-02").cast("timestamp")).first()
    assert new.title == "Meta" and new.file_path == "u/1704153600000_a.epub" and new.translation_status == "none" and new.folder_id is None
