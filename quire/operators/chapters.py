"""From chapter files to classified chapters, statistics and reassembled books."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import patterns as P
from ..functions.dialect import SPACE_CHARACTERS, SparkOps, either
from ..functions.html import chapter_title, clean_title, html_to_text
from ..schema import DEFAULT_METADATA, FAILED, NO_CONTENT
from ..storage import materialize
from .classify import classify, skip_reason, with_position
from .scan import numbered, running_sums

S = SparkOps


def filename_skip_reason(path: Column) -> Column:
    return skip_reason(S, path)


def drop_blank(chapters: DataFrame, content: str = "content") -> DataFrame:
    """Chapters with text; white space alone is none."""
    return chapters.where(S.trim(F.coalesce(content, F.lit(""))) != "")


def read_chapters(files: DataFrame, kind: str = "epub") -> DataFrame:
    """Chapter files (html) to chapters (book_id, chapter_idx, path, title, content), blank ones dropped.

    Indexes count the chapters that are left. Titles without any other source
    are numbered by that count, for ``kind="mobi"`` by the place in the file,
    where a title listed in the file or its first heading comes first.
    """
    rows = drop_blank(files.where("html is not null").withColumn("content", html_to_text(F.col("html"))))
    rows = _with_number(rows, "_n")
    if kind == "mobi":
        heading = S.trim(S.replace(S.extract(F.col("html"), P.HEADING, 1, True), r"<[^>]+>", ""))
        listed = F.when(F.col("listed_title") != "", F.col("listed_title"))
        title = F.coalesce(F.when(heading != "", heading), listed, F.concat(F.lit("Chapter "), (F.col("chapter_idx") + 1).cast("string")))
    else:
        title = chapter_title(F.col("html"), F.col("content"), F.col("path"), F.col("_n"))
    return rows.select("book_id", (F.col("_n") - 1).alias("chapter_idx"), "path", title.alias("title"), "content")


def filter_chapters(chapters: DataFrame, mode: str = "compat") -> DataFrame:
    """Chapters with position and ``filter_reason`` (null: kept)."""
    return classify(with_position(chapters), mode=mode)


def _with_number(chapters: DataFrame, name: str) -> DataFrame:
    """Chapters with their number from 1 in their book.

    Written once with a row number; the narrow rows are numbered by a scan and
    joined back, so that no task holds a book and equal indexes do not multiply.
    """
    rows = materialize(chapters.withColumn("_row", F.monotonically_increasing_id()), "rows")
    numbers = numbered(rows.select("book_id", "chapter_idx", "_row"), ["book_id"], ["chapter_idx"], name)
    return rows.join(numbers.select("_row", name), "_row").drop("_row")


def kept(classified: DataFrame) -> DataFrame:
    """Kept chapters, indexed anew from 0 in order."""
    rows = _with_number(classified.where("filter_reason is null"), "_n")
    return rows.withColumn("chapter_idx", (F.col("_n") - 1).cast("int")).drop("_n")


def removed(classified: DataFrame) -> DataFrame:
    return classified.where("filter_reason is not null")


def _sums() -> list[Column]:
    """Aggregates of classified chapters that ``filter_stats`` is made of."""
    stay = F.col("filter_reason").isNull()
    size = S.length(F.coalesce("content", F.lit("")))
    return [
        F.count("*").alias("total_chapters"),
        F.count_if(stay).alias("kept_chapters"),
        F.count_if(~stay).alias("removed_chapters"),
        F.sum(size).alias("original_chars"),
        F.coalesce(F.sum(F.when(stay, size)), F.lit(0)).cast("bigint").alias("filtered_chars"),
    ]


def _savings() -> list[Column]:
    saved = F.col("original_chars") - F.col("filtered_chars")
    percent = F.when(F.col("original_chars") > 0, F.floor(saved.cast("double") / F.col("original_chars") * 100 + 0.5)).otherwise(0)
    return [saved.alias("saved_chars"), percent.cast("int").alias("saved_percent")]


def filter_stats(classified: DataFrame) -> DataFrame:
    """Per book: chapters in total, kept, removed; characters (UTF-16 units, untrimmed) before, after, saved; percent saved."""
    return classified.groupBy("book_id").agg(*_sums()).select("*", *_savings())


def in_order(value: Column, index: str = "chapter_idx", where: Column | None = None) -> Column:
    """Aggregate: values of a group as an array, by index; only those that meet a condition, if there is one."""
    pair = F.struct(F.col(index).alias("i"), value.alias("v"))
    return F.transform(F.array_sort(F.collect_list(pair if where is None else F.when(where, pair))), lambda x: x["v"])


def joined_content(chapters: DataFrame, trim: bool = True, placeholder: str | None = None) -> DataFrame:
    """Per book its chapters' text in order, blank lines between; ``placeholder`` where nothing is left."""
    text = F.array_join(in_order(F.coalesce("content", F.lit(""))), "\n\n")
    text = S.trim(text) if trim else text
    if placeholder is not None:
        text = F.when(text == "", placeholder).otherwise(text)
    return chapters.groupBy("book_id").agg(text.alias("content"))


def content_segments(chapters: DataFrame, value: Column | None = None, *, gap: str = "\n\n", trim: bool = True) -> DataFrame:
    """Each book's text as ordered segments (book_id, segment, offset, text), one a chapter: what ``joined_content`` puts into one row, for books of any size.

    Put one behind the other by ``segment``, the texts are the book; ``offset``
    counts the characters before. All but the first begin with the gap. With
    ``trim`` the white space around the whole book is gone; a book of white
    space alone has no segment then.
    """
    text, space = F.coalesce("content" if value is None else value, F.lit("")), F.lit(SPACE_CHARACTERS)
    rows = chapters.select("book_id", "chapter_idx", text.alias("text"), F.monotonically_increasing_id().alias("_row"))
    sizes = {"n": F.length("text"), "n_left": F.length(F.ltrim("text", space)), "n_right": F.length(F.rtrim("text", space)), "n_both": F.length(S.trim(F.col("text")))} if trim else {"n": F.length("text")}
    rows = materialize(rows.withColumns(sizes), "segments")
    narrow = rows.drop("text")
    if trim:
        here = F.struct("chapter_idx", "_row")
        place = F.when(F.col("n_both") > 0, here)
        ends = narrow.groupBy("book_id").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first is not null").withColumnRenamed("book_id", "_book")
        inside = narrow.join(ends, F.col("book_id").eqNullSafe(F.col("_book"))).where((here >= F.col("first")) & (here <= F.col("last")))
        opens, closes = here == F.col("first"), here == F.col("last")
        n = F.when(opens & closes, F.col("n_both")).when(opens, F.col("n_left")).when(closes, F.col("n_right")).otherwise(F.col("n"))
        narrow = inside.select("book_id", "chapter_idx", "_row", n.alias("n"), opens.alias("opens"), closes.alias("closes"))
    else:
        narrow = narrow.withColumns({"opens": F.lit(False), "closes": F.lit(False)})
    order = ["chapter_idx", "_row"]
    places = running_sums(narrow, ["book_id"], order, segment=F.lit(1), end=F.col("n") + len(gap))
    out = rows.select("_row", "text").join(places, "_row")
    text = F.when(F.col("opens"), F.ltrim("text", space)).otherwise(F.col("text"))
    text = F.when(F.col("closes"), F.rtrim(text, space)).otherwise(text)
    lead = F.when(F.col("segment") > 1, gap).otherwise("")
    start = F.greatest(F.col("end") - F.col("n") - 2 * len(gap), F.lit(0))
    return out.select("book_id", (F.col("segment") - 1).alias("segment"), start.alias("offset"), F.concat(lead, text).alias("text"))


def segment_digests(segments: DataFrame) -> DataFrame:
    """(book_id, digest, n): MD5 and characters of each book's whole text from its segments.

    A digest takes its bytes in order, so the segments of a book stream through
    one task; it holds one batch of them, not the book.
    """
    kind = segments.schema["book_id"].dataType
    schema = pa.schema([("book_id", to_arrow_type(kind)), ("digest", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, held, out = None, None, []
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held is None or name != book:
                    if held:
                        out.append((book, held[0].hexdigest(), held[1]))
                    book, held = name, [hashlib.md5(usedforsecurity=False), 0]
                text = text.as_py()
                held[0].update(text.encode())
                held[1] += len(text)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if held:
            out.append((book, held[0].hexdigest(), held[1]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    ordered = segments.repartition("book_id").sortWithinPartitions("book_id", "segment").select("book_id", "text")
    return ordered.mapInArrow(run, f"book_id {kind.simpleString()}, digest string, n bigint")


def removed_titles(classified: DataFrame) -> DataFrame:
    """Per book ``title (reason)`` of its removed chapters, in order."""
    return removed(classified).groupBy("book_id").agg(in_order(removed_label()).alias("removed_titles"))


def removed_label() -> Column:
    return F.concat("title", F.lit(" ("), "filter_reason", F.lit(")"))


def nest_chapters(chapters: DataFrame) -> DataFrame:
    """Per book an array of (title, content) structs in order."""
    return chapters.groupBy("book_id").agg(in_order(F.struct("title", "content")).alias("chapters"))


def unnest_chapters(books: DataFrame, chapters: str = "chapters") -> DataFrame:
    return books.select("book_id", F.posexplode(chapters).alias("chapter_idx", "c")).select("book_id", "chapter_idx", "c.title", "c.content")


def book_documents(files: DataFrame, kind: str = "epub", mode: str = "compat") -> DataFrame:
    """One row per book: metadata, content of kept chapters, kept and all chapters, statistics.

    A book that could not be read has the default metadata, a fixed message as
    content and no chapters; one without kept chapters a placeholder. A single
    entry that could not be read is only missing.
    """
    name = kind.upper()
    books = files.groupBy("book_id").agg(F.first("file_title", True).alias("title"), F.first("author", True).alias("author"), F.first("language", True).alias("language"), F.max(F.when(F.col("path").isNull(), F.col("parse_error"))).alias("parse_error"))
    # written once: positions read it twice, and markup is the costly step
    done = filter_chapters(materialize(read_chapters(files, kind), "chapters"), mode)
    stay, chapter = F.col("filter_reason").isNull(), F.struct("title", "content")
    parts = done.groupBy("book_id").agg(
        in_order(chapter, where=stay).alias("chapters"), in_order(chapter).alias("all_chapters"), in_order(removed_label(), where=~stay).alias("removed_titles"), *_sums()
    )
    failed = F.col("parse_error").isNotNull()
    out = books.join(parts.select("*", *_savings()), "book_id", "left")
    content = F.trim(F.array_join(F.transform("chapters", lambda c: F.coalesce(c["content"], F.lit(""))), "\n\n"), F.lit(SPACE_CHARACTERS))
    content = F.when(failed, FAILED.format(name)).otherwise(F.coalesce(F.when(content != "", content), F.lit(NO_CONTENT.format(name))))
    meta = {c: F.when(failed, d).otherwise(F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(d))) for c, d in DEFAULT_METADATA.items()}
    none = F.array().cast("array<struct<title:string,content:string>>")
    unless_failed = lambda c, default: F.coalesce(F.when(~failed, F.col(c)), default).alias(c)
    return out.select(
        "book_id", *[v.alias(c) for c, v in meta.items()], content.alias("content"), "parse_error",
        unless_failed("chapters", none), unless_failed("all_chapters", none),
        *[F.when(~failed, F.col(c)).alias(c) for c in ("total_chapters", "kept_chapters", "removed_chapters", "saved_chars", "saved_percent")],
        unless_failed("removed_titles", F.array().cast("array<string>")),
    )


def source_chapters(books: DataFrame) -> DataFrame:
    """Which stored chapters a new run starts from: all chapters if there are any, else the kept ones."""
    return books.withColumn("source", F.when(F.size(F.coalesce("all_chapters", F.array().cast("array<struct<title:string,content:string>>"))) > 0, F.col("all_chapters")).otherwise(F.col("chapters")))


def work_items(books: DataFrame, mode: str = "compat") -> DataFrame:
    """Chapters to translate per book (book_id, index, title, content, char_count).

    Filtered anew from the stored chapters. If nothing passes: the stored kept
    chapters; if there are none either, the whole content as one chapter under
    the book's title or "Full content". Empty titles become "Chapter n".
    """
    flat = unnest_chapters(source_chapters(books).select("book_id", F.col("source").alias("chapters")))
    has = F.size(F.coalesce("chapters", F.array().cast("array<struct<title:string,content:string>>"))) > 0
    return flat_work_items(books.select("book_id", "title", "content"), flat, unnest_chapters(books.where(has).select("book_id", "chapters")), mode)


def flat_work_items(books: DataFrame, source: DataFrame, stored: DataFrame, mode: str = "compat") -> DataFrame:
    """``work_items`` of books whose chapters lie in rows (book_id, chapter_idx, title, content): those a run starts from, and the stored kept ones.

    Nothing is gathered by book, so books may have any number of chapters.
    """
    passed = kept(filter_chapters(source, mode)).select("book_id", "chapter_idx", "title", "content")
    rest = books.join(passed.select("book_id").distinct(), "book_id", "left_anti")
    kept_before = stored.join(rest.select("book_id"), "book_id", "left_semi").select("book_id", "chapter_idx", "title", "content")
    single = rest.join(stored.select("book_id").distinct(), "book_id", "left_anti")
    single = single.select("book_id", F.lit(0).alias("chapter_idx"), F.coalesce(F.when(F.col("title") != "", F.col("title")), F.lit("Full content")).alias("title"), "content")
    items = passed.unionByName(kept_before).unionByName(single)
    title = F.when(F.coalesce("title", F.lit("")) == "", F.concat(F.lit("Chapter "), (F.col("chapter_idx") + 1).cast("string"))).otherwise(F.col("title"))
    return items.select("book_id", F.col("chapter_idx").alias("index"), title.alias("title"), "content", S.length(F.coalesce("content", F.lit(""))).alias("char_count"))


# ------------------------------------------------------------------ package documents


def package_metadata(packages: DataFrame, text: str = "opf") -> DataFrame:
    """Adds title, author, language from a package document: first element of each, trimmed, defaults where missing."""
    def field(tag, decode):
        raw = S.trim(S.extract(F.col(text), P.PACKAGE_ELEMENT.format(tag, tag), 1))
        return clean_title(raw) if decode else raw

    raw = {"title": field("title", True), "author": field("creator", True), "language": field("language", False)}
    return packages.withColumns({c: F.coalesce(raw[c], F.lit(d)) for c, d in DEFAULT_METADATA.items()})


def manifest_items(packages: DataFrame, text: str = "opf") -> DataFrame:
    """(book_id, id, href): the last entry of an id wins, entries with href first coming after the others."""
    def entries(pattern, id_group, href_group, turn):
        found = lambda g: F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(g))
        return packages.select("book_id", F.posexplode(F.arrays_zip(found(id_group).alias("id"), found(href_group).alias("href"))).alias("pos", "e")).select("book_id", F.lit(turn).alias("turn"), "pos", "e.id", "e.href")

    both = entries(P.MANIFEST_ID_FIRST, 1, 2, 0).union(entries(P.MANIFEST_HREF_FIRST, 2, 1, 1))
    return both.groupBy("book_id", "id").agg(F.max_by("href", F.struct("turn", "pos")).alias("href"))


def spine_items(packages: DataFrame, text: str = "opf") -> DataFrame:
    """(book_id, pos, idref) in reading order, repeats kept."""
    return packages.select("book_id", F.posexplode(F.regexp_extract_all(F.col(text), F.lit(P.SPINE_ITEM), F.lit(1))).alias("pos", "idref"))


def spine_paths(spine: DataFrame, manifest: DataFrame, base: str = "base") -> DataFrame:
    """Reading order with decoded paths and skip reasons; entries without a manifest item are gone. ``spine`` carries ``base``."""
    joined = spine.join(manifest.withColumnRenamed("id", "idref"), ["book_id", "idref"])
    path = F.concat(F.coalesce(base, F.lit("")), F.try_url_decode(F.replace("href", F.lit("+"), F.lit("%2B"))))
    return joined.select("book_id", "pos", "idref", path.alias("path")).withColumn("skip_reason", filename_skip_reason(F.col("path")))


def fallback_paths(entries: DataFrame) -> DataFrame:
    """Chapter files of an archive without usable spine: (book_id, pos, path) by code order."""
    path = F.col("path")
    good = either([path.endswith(x) for x in P.CHAPTER_SUFFIXES]) & ~either([path.contains(x) for x in P.NO_CHAPTER_PARTS]) & filename_skip_reason(path).isNull()
    return numbered(entries.where(good).select("book_id", "path"), ["book_id"], ["path"], "n").select("book_id", (F.col("n") - 1).cast("int").alias("pos"), "path")


def join_entries(paths: DataFrame, entries: DataFrame) -> DataFrame:
    """Chapter files by path, else by the percent-encoded path; missing ones are gone."""
    direct = entries.select("book_id", "path", "html")
    coded = entries.select("book_id", F.col("path").alias("coded"), F.col("html").alias("coded_html"))
    encoded = F.replace(F.url_encode("path"), F.lit("+"), F.lit("%20"))
    for plain in "/;,?:@&=+$#!'()*~":
        encoded = F.replace(encoded, F.url_encode(F.lit(plain)), F.lit(plain))
    found = paths.withColumn("coded", encoded).join(direct, ["book_id", "path"], "left").join(coded, ["book_id", "coded"], "left")
    return found.withColumn("html", F.coalesce("html", "coded_html")).where("html is not null").drop("coded", "coded_html")
