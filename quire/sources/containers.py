"""Readers of book files: EPUB archives and MOBI databases, one row per chapter file.

Spark lists and reads the files (``binaryFile``), so any store works; the
container format is taken apart in Arrow batches, one file at a time.
"""

from __future__ import annotations

import io
import re
import urllib.parse
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..schema import CHAPTER_FILES
from .mobi import read_mobi_parts

SCHEMA = pa.schema([("book_id", pa.string()), ("file_title", pa.string()), ("author", pa.string()), ("language", pa.string()), ("chapter_idx", pa.int32()), ("path", pa.string()), ("html", pa.string()), ("listed_title", pa.string()), ("parse_error", pa.string())])


def file_is_skipped(path: str) -> str | None:
    """The file-name rule for readers, before a file is unpacked."""
    low = path.lower()
    name = low.rsplit("/", 1)[-1] or low
    for k, (reason, pattern) in enumerate(P.SKIPPED_FILES):
        if re.search(pattern.replace("$", r"\Z"), name) or (k == 0 and "cover" in name and "discover" not in name):
            return reason
    return None


def decoded(text: str) -> str:
    """Entities of a metadata value: the named ones in sequence, then decimal and hexadecimal references; what is no character goes."""
    for name, char in P.ENTITIES:
        text = text.replace(name, char)
    for pattern, base in ((r"&#([0-9]+);", 10), (r"&#x([0-9a-fA-F]+);", 16)):
        text = re.sub(pattern, lambda m, base=base: _character(int(m[1], base)), text)
    return text


def _character(code: int) -> str:
    return chr(code) if 0 < code < 0x10FFFF and not 0xD800 <= code <= 0xDFFF else ""


def _path_of(href: str) -> str:
    """A percent-decoded reference; a malformed one is an error of the book."""
    if re.search(r"%(?![0-9a-fA-F]{2})", href):
        raise ValueError(f"malformed reference {href!r}")
    return urllib.parse.unquote(href, errors="strict")


class Package:
    """A package document: what the fixed expressions find in its text."""

    def __init__(self, text: str, folder: str):
        self.text, self.folder = text, folder

    def field(self, tag: str) -> str | None:
        found = re.search(P.PACKAGE_ELEMENT.format(tag, tag), self.text)
        return found and found[1].strip()

    def metadata(self) -> dict[str, str | None]:
        title, author = (value and decoded(value) for value in map(self.field, ("title", "creator")))
        return {"title": title, "author": author, "language": self.field("language")}

    def paths(self) -> Iterator[str]:
        """Reading order, without entries that the manifest lacks and files that are skipped by name."""
        manifest = {m[1]: m[2] for m in re.finditer(P.MANIFEST_ID_FIRST, self.text)}
        manifest |= {m[2]: m[1] for m in re.finditer(P.MANIFEST_HREF_FIRST, self.text)}
        listed = (self.folder + _path_of(manifest[m[1]]) for m in re.finditer(P.SPINE_ITEM, self.text) if m[1] in manifest)
        return (path for path in listed if not file_is_skipped(path))


class EntryTooLarge(ValueError):
    """An entry of an archive that unpacks to more than is allowed."""


class Archive:
    """Named entries of an EPUB file, unpacked one by one when they are read, piece by piece and up to ``most`` bytes."""

    def __init__(self, file: BinaryIO, most: int | None = None):
        self.zip, self.most = zipfile.ZipFile(file), most
        self.names = dict.fromkeys(self.zip.namelist())

    def packed_size(self, name: str) -> int:
        return self.zip.getinfo(name).compress_size

    def text(self, name: str) -> str:
        parts, size = [], 0
        with self.zip.open(name) as f:
            while part := f.read(1 << 20):
                size += len(part)
                if self.most is not None and size > self.most:  # whatever size the archive claims
                    raise EntryTooLarge(f"{name} is larger than {self.most} bytes")
                parts.append(part)
        return b"".join(parts).decode("utf-8", "replace")

    def package(self) -> Package | None:
        """The package that the container file names, else the first one by suffix."""
        named = re.search(P.PACKAGE_PATH, self.text(P.CONTAINER_FILE)) if P.CONTAINER_FILE in self.names else None
        candidates = [*([named[1]] if named else []), *(n for n in self.names if n.endswith(".opf"))]
        place = next((n for n in candidates if n in self.names), None)
        return place and Package(self.text(place), place[: place.rfind("/") + 1])

    def loose_paths(self) -> list[str]:
        """Chapter files by name alone, in code order."""
        good = [n for n in self.names if n.endswith(P.CHAPTER_SUFFIXES) and not any(x in n for x in P.NO_CHAPTER_PARTS) and not file_is_skipped(n)]
        return sorted(good, key=lambda n: n.encode("utf-16-be"))

    def entry(self, path: str) -> str | None:
        """The name of an entry as it is, or percent-encoded."""
        return next((n for n in (path, urllib.parse.quote(path, safe="/;,?:@&=+$#!'()*~")) if n in self.names), None)

    def chapters(self) -> tuple[dict, list[tuple[str, str]]]:
        """Metadata, and (path, entry) of the chapter files in reading order; skipped ones stay packed."""
        package = self.package()
        paths = list(package.paths()) if package else []
        entries = ((path, self.entry(path)) for path in paths or self.loose_paths())
        return package.metadata() if package else {}, [(path, name) for path, name in entries if name is not None]


def read_epub(data: bytes) -> tuple[dict, list[tuple[str, str]]]:
    """Metadata and (path, markup) of an archive's chapter files in reading order."""
    archive = Archive(io.BytesIO(data))
    meta, chapters = archive.chapters()
    return meta, [(path, archive.text(name)) for path, name in chapters]


# ------------------------------------------------------------------ MOBI


def read_mobi(data: bytes) -> tuple[dict, list[tuple[str, str]]]:
    """Metadata and (path, markup) of a book's parts."""
    meta, parts = read_mobi_parts(data)
    return meta, [(p.path, p.markup) for p in parts]


# ------------------------------------------------------------------ Spark


def chapter_files(files: DataFrame, kind: str) -> DataFrame:
    """(path, content) rows of ``binaryFile``, also of a stream, to chapter files; a file that cannot be read gives one row with parse_error.

    A row holds a whole file here; ``read_books`` reads archives of any size.
    """
    if kind not in ("epub", "mobi"):
        raise ValueError("kind is epub or mobi")

    def parts_of(data: bytes) -> tuple[dict, list[tuple]]:
        if kind == "mobi":
            return read_mobi_parts(data)
        meta, parts = read_epub(data)
        return meta, [(*p, None) for p in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    meta, parts = parts_of(data.as_py())
                    error = None
                except Exception as e:  # any defect of the file makes an error book
                    meta, parts, error = {}, [], f"{type(e).__name__}: {e}"
                common = {"book_id": book, "file_title": meta.get("title"), "author": meta.get("author"), "language": meta.get("language"), "parse_error": error}
                rows = [{**common, "chapter_idx": k, "path": p, "html": h, "listed_title": t} for k, (p, h, t) in enumerate(parts)] or [common]
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    return files.select("path", "content").mapInArrow(run, CHAPTER_FILES)


def file_glob(kind: str) -> str:
    """Files of a kind by their extension in any case."""
    return "*." + "".join(f"[{c}{c.upper()}]" for c in kind)


def read_books(spark: SparkSession, folder: str, kind: str = "epub", **options) -> DataFrame:
    """Chapter files of all books of a kind under a folder, by the data source of ``books``; the extension counts in any case."""
    from .books import FORMAT, BookSource

    spark.dataSource.register(BookSource)
    return spark.read.format(FORMAT).options(kind=kind, **options).load(folder)


def upload_kind(name):
    """Kind of an uploaded file by its extension in any case; null for what is refused."""
    low = F.lower(name)
    return F.when(F.endswith(low, F.lit(".epub")), "epub").when(F.endswith(low, F.lit(".mobi")), "mobi")
