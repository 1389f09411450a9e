"""From stored translations to documents: content selection, title echoes, pages, PDF files."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions import patterns as P
from ..functions.dialect import SparkOps, let
from ..functions.text import compare_key, normalize_for_export
from ..sinks.documents import listed_documents, save_documents

S = SparkOps


# ------------------------------------------------------------------ content selection


def export_content(translations: DataFrame, body: str = "translated_content") -> DataFrame:
    """Adds ``text`` and ``chapters`` from a variant body; rows without any content are gone.

    The body is an object with ``chapters`` (objects with a string content) and
    ``translated``, or a bare string. Chapters win; their contents are joined by
    blank lines.
    """
    raw = F.col(body)
    chapters = F.filter(F.coalesce(F.try_variant_get(raw, "$.chapters", "array<struct<title:string,content:string>>"), F.array().cast("array<struct<title:string,content:string>>")), lambda c: c["content"].isNotNull())
    flat = F.coalesce(F.try_variant_get(raw, "$.translated", "string"), F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(raw, "$", "string")))
    rows = translations.withColumn("chapters", chapters)
    joined = F.array_join(F.transform("chapters", lambda c: c["content"]), "\n\n")
    rows = rows.withColumn("text", F.when(F.size("chapters") > 0, joined).otherwise(flat))
    return rows.where(F.coalesce("text", F.lit("")) != "")


def export_chapters(chapters: DataFrame) -> DataFrame:
    """Chapters (book_id, chapter_idx, title, content) ready to print: normalised, title echoes gone, empty ones dropped."""
    rows = chapters.withColumn("title", normalize_for_export(F.col("title"))).withColumn("content", normalize_for_export(F.col("content")))
    return rows.where("content <> ''").withColumn("content", strip_title_echoes(F.col("content"), F.col("title")))


# ------------------------------------------------------------------ title echoes


def title_variants(ops, title):
    """Forms of a chapter's title that count as its echo, as an array."""
    key = compare_key(ops, title)
    comma = ops.trim(ops.first(ops.split(key, ",")))
    return [key, ops.cases([(comma != "", comma)]), ops.extract(key, P.NUMBERED_PART, 2), ops.extract(key, P.NUMBERED_PART, 0)]


def is_title_echo(ops, line, variants):
    """Whether a trimmed line only repeats the title. A word of roman digits alone counts as a number."""
    return repeats(ops, compare_key(ops, line), line, variants)


def repeats(ops, key, line, variants):
    """``is_title_echo`` with the line's compared form given."""
    same = (key == variants[0]) | ops.coalesce(key == variants[1], ops.lit(False)) | ops.coalesce(key == variants[2], ops.lit(False)) | ops.coalesce(key == variants[3], ops.lit(False))
    return (key == "") | ((ops.length(line) <= 120) & (same | ops.match(key, P.ECHO_LINES)))


def strip_title_echoes(content: Column, title: Column) -> Column:
    """Content without the lines at its start that repeat the title; unchanged if there are none.

    Looks at the first eight lines and one more for each echo found, at most
    eight echoes; blank lines pass, the first other line ends the search.
    """
    start = F.struct(F.lit(True).alias("open"), F.lit(0).alias("hits"), F.lit(0).alias("at"), F.array().cast("array<boolean>").alias("gone"))

    def step(state, line, forms):
        going = state["open"] & (state["hits"] < 8) & (state["at"] < 8 + state["hits"])
        echo = lambda text: going & (text != "") & let(compare_key(S, text), lambda key: repeats(S, key, text, [F.get(forms, F.lit(k)) for k in range(4)]))
        after = lambda text, e: F.struct((going & ((text == "") | e)).alias("open"), (state["hits"] + e.cast("int")).alias("hits"), (state["at"] + 1).alias("at"), F.concat(state["gone"], F.array(e)).alias("gone"))
        return let(S.trim(line), lambda text: let(echo(text), lambda e: after(text, e)))

    def stripped(book):
        # only the first sixteen lines can be echoes
        lines = book["lines"]
        head = F.slice(lines, 1, 16)
        found = F.aggregate(head, start, lambda state, line: step(state, line, book["forms"]))
        kept = lambda gone: F.concat(F.transform(head, lambda x, i: F.when(F.get(gone, i), "").otherwise(x)), F.slice(lines, F.lit(17), F.size(lines)))
        left = lambda state: S.replace(F.array_join(kept(state["gone"]), "\n"), r"^\s*\n+", "")
        return let(found, lambda state: F.when(state["hits"] > 0, left(state)).otherwise(F.array_join(lines, "\n")))

    return let(F.struct(F.split(content, "\n", -1).alias("lines"), F.array(*title_variants(S, title)).alias("forms")), stripped)


# ------------------------------------------------------------------ pages

#: Fixed values of the page: millimetres of an A4 sheet, its margin, and (font points, line height) of each kind of line.
WIDTH, HEIGHT, MARGIN, FOOT = 210, 297, 20, 30
SIZES = {"body": (11, 6), "heading": (18, 9), "title": (24, 12), "author": (14, 8), "meta": (10, 6), "note": (11, 6)}
EMPTY = "(No content available)"
#: Which face each kind of line has; lines of the title page are centred.
FACE_OF = {"title": "bold", "heading": "bold", "author": "italic"}
CENTRED = ("title", "author", "meta", "note")
_MM = 72 / 25.4


def wrap(text: str, kind: str) -> list[str]:
    """Lines of a kind that fit between the margins, by the widths of its face."""
    return metrics.wrap(text, (WIDTH - 2 * MARGIN) * _MM, SIZES[kind][0], FACE_OF.get(kind, "regular"))


def left_edge(kind: str, line: str) -> float:
    """Where a line begins, in points."""
    if kind not in CENTRED:
        return MARGIN * _MM
    return (WIDTH * _MM - metrics.text_width(line, SIZES[kind][0], FACE_OF.get(kind, "regular"))) / 2


def layout(title: str, author: str, chapters: list[tuple[str, str]], language: str = "", note: str = "") -> list[list[tuple[float, str, str]]]:
    """Pages of (height from the top, kind, line): a title page, then each chapter on a new page.

    The title page names the language if there is one; without chapters, ``note`` has a page of its own.
    """
    titles, authors = wrap(title[:500], "title"), wrap(author[:200], "author")
    below = HEIGHT / 3 + 16 + (len(titles) - 1) * SIZES["title"][1]
    pages = [[(HEIGHT / 3 + k * SIZES["title"][1], "title", x) for k, x in enumerate(titles)] + [(below + k * SIZES["author"][1], "author", x) for k, x in enumerate(authors)]]
    if language:
        pages[0].append((below + len(authors) * SIZES["author"][1] + SIZES["title"][1], "meta", f"Language: {language}"))
    if note and not chapters:
        pages.append([(HEIGHT / 2, "note", note)])
    for head, content in chapters:
        y, page = float(MARGIN), []
        pages.append(page)
        for kind, text in (("heading", head), ("body", content)):
            step = SIZES[kind][1]
            for line in wrap(text, kind) if text else []:
                if y + step > HEIGHT - FOOT:
                    y, page = float(MARGIN), []
                    pages.append(page)
                if line:
                    page.append((y, kind, line))
                y += step
            y += step
    return pages


def text_pages(pages: list[list[tuple[float, str, str]]]) -> list[str]:
    """The pages as plain text, each with its number."""
    return ["\n".join([*[line for _, _, line in page], f"- {n} -"]) for n, page in enumerate(pages, 1)]


def pdf(pages: list[list[tuple[float, str, str]]]) -> bytes:
    """A PDF of the pages in three standard faces; the same input gives the same bytes."""
    faces = {"regular": b"Helvetica", "bold": b"Helvetica-Bold", "italic": b"Helvetica-Oblique"}
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", *[b"<< /Type /Font /Subtype /Type1 /BaseFont /%s /Encoding /WinAnsiEncoding >>" % name for name in faces.values()]]
    fonts = b" ".join(b"/F%d %d 0 R" % (k, k + 2) for k in (1, 2, 3))
    number = {face: k for k, face in enumerate(faces, 1)}
    kids = []
    for n, page in enumerate(pages, 1):
        parts = []
        for y, kind, line in [*page, (HEIGHT - 12, "foot", str(n))]:
            size = SIZES.get(kind, (9, 0))[0]
            raw = line.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
            parts.append(b"BT /F%d %d Tf %.2f %.2f Td (%s) Tj ET" % (number[FACE_OF.get(kind, "regular")], size, left_edge(kind, line), (HEIGHT - y) * _MM, raw))
        data = zlib.compress(b"\n".join(parts))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(data), data))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.2f %.2f] /Resources << /Font << %s >> >> /Contents %d 0 R >>" % (WIDTH * _MM, HEIGHT * _MM, fonts, len(objects)))
        kids.append(len(objects))
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start)
    return bytes(out)


def render(books: DataFrame, *, form: str = "pdf") -> DataFrame:
    """(book_id, n_pages, document binary) of books (book_id, title, author, chapters, and language if there is one) with export-ready chapters.

    A book without chapters has a page that says so.
    """
    if form not in ("pdf", "text"):
        raise ValueError("form is pdf or text")
    rows = books.select("book_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("author", F.lit("")).alias("author"), F.transform("chapters", lambda c: c["title"]).alias("t"), F.transform("chapters", lambda c: c["content"]).alias("c"), (F.coalesce("language", F.lit("")) if "language" in books.columns else F.lit("")).alias("language"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book, title, author, heads, texts, language in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = [(h or "", x or "") for h, x in zip(heads or [], texts or [], strict=True)]
                pages = layout(title, author, parts, language, EMPTY)
                body = pdf(pages) if form == "pdf" else "\f".join(text_pages(pages)).encode()
                yield pa.RecordBatch.from_arrays([pa.array([book], batch.schema.field(0).type), pa.array([len(pages)], pa.int32()), pa.array([body], pa.binary())], names=["book_id", "n_pages", "document"])

    return rows.mapInArrow(run, f"book_id {dict(rows.dtypes)['book_id']}, n_pages int, document binary")


def write_documents(rendered: DataFrame, folder: str, suffix: str = ".pdf") -> DataFrame:
    """Write each document as a file below a folder that all executors share, at once and all or none; returns (book_id, path, n_bytes) of the folder's documents."""
    save_documents(rendered, folder, suffix)
    return listed_documents(rendered.sparkSession, folder)
