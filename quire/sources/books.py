"""Books as a Spark data source: ``spark.read.format("quire_books").option("kind", "epub").load(folder)``.

The driver lists files. Small ones are grouped by size; of a large archive it
reads the central directory, which stands at the end of the file, and cuts the
reading order into ranges, so that one archive is read by many tasks. A task
seeks to single entries and inflates them piece by piece: no archive is ever in
memory, only one entry, and of an entry no more than ``maxEntryBytes``.

Options: ``kind`` (epub or mobi), ``splitBytes`` (packed bytes of a partition),
``maxEntryBytes`` (an entry that is larger becomes a row with an error).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import CHAPTER_FILES
from .containers import SCHEMA, Archive, EntryTooLarge
from .mobi import read_mobi_parts
from .stores import File, listed, reading

FORMAT = "quire_books"
SPLIT_BYTES, MAX_ENTRY_BYTES = 64 << 20, 64 << 20
#: Files of a partition and bytes of a batch, at most.
FILES, BATCH_BYTES = 1000, 8 << 20


@dataclass(frozen=True)
class Range:
    """A file's chapters from ``begin`` up to ``end`` (None: all that follow)."""

    uri: str
    begin: int = 0
    end: int | None = None


@dataclass
class Ranges(InputPartition):
    ranges: list[Range]


def plan(files: list[File], kind: str, split_bytes: int, max_entry: int) -> list[Ranges]:
    """Partitions of about ``split_bytes``: many small files each, or a range of a large archive."""
    out, group, size = [], [], 0
    for file in files:
        if kind == "epub" and file.size > split_bytes:
            out += [Ranges([r]) for r in archive_ranges(file.uri, split_bytes, max_entry)]
            continue
        if group and (size + file.size > split_bytes or len(group) == FILES):
            out.append(Ranges(group))
            group, size = [], 0
        group.append(Range(file.uri))
        size += file.size
    return [*out, Ranges(group)] if group else out


def archive_ranges(uri: str, split_bytes: int, max_entry: int) -> list[Range]:
    """Ranges of an archive's reading order by packed size; one range if it cannot be read, whose task then reports why."""
    try:
        with reading(uri) as f:
            archive = Archive(f, max_entry)
            sizes = [archive.packed_size(name) for _, name in archive.chapters()[1]]
    except Exception:  # any defect of the file
        return [Range(uri)]
    cuts, held = [0], 0
    for k, size in enumerate(sizes):
        if held and held + size > split_bytes:
            cuts.append(k)
            held = 0
        held += size
    return [Range(uri, a, b) for a, b in zip(cuts, [*cuts[1:], None])]


def epub_rows(at: Range, max_entry: int) -> Iterator[dict]:
    with reading(at.uri) as f:
        archive = Archive(f, max_entry)
        meta, chapters = archive.chapters()
        common = {"file_title": meta.get("title"), "author": meta.get("author"), "language": meta.get("language")}
        if not chapters:
            yield common
        for k, (path, name) in enumerate(chapters[at.begin : at.end], at.begin):
            try:
                yield {**common, "chapter_idx": k, "path": path, "html": archive.text(name)}
            except EntryTooLarge as e:
                yield {**common, "chapter_idx": k, "path": path, "parse_error": str(e)}


def mobi_rows(at: Range, max_entry: int) -> Iterator[dict]:
    with reading(at.uri) as f:
        meta, parts = read_mobi_parts(f)
    for k, part in enumerate(parts):
        row = {"file_title": meta.get("title"), "author": meta.get("author"), "language": meta.get("language"), "chapter_idx": k, "path": part.path, "listed_title": part.title}
        yield {**row, "html": part.markup} if len(part.markup) <= max_entry else {**row, "parse_error": f"{part.path} is larger than {max_entry} bytes"}


class BookReader(DataSourceReader):
    def __init__(self, options):
        self.kind = options.get("kind", "epub").lower()
        if self.kind not in ("epub", "mobi"):
            raise ValueError("kind is epub or mobi")
        self.folder = options["path"]
        self.split_bytes, self.max_entry = int(options.get("splitBytes", SPLIT_BYTES)), int(options.get("maxEntryBytes", MAX_ENTRY_BYTES))

    def partitions(self) -> list[Ranges]:
        return plan(listed(self.folder, "." + self.kind), self.kind, self.split_bytes, self.max_entry)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        rows = {"epub": epub_rows, "mobi": mobi_rows}[self.kind]
        out, size = [], 0
        for at in partition.ranges:
            try:
                for row in rows(at, self.max_entry):
                    out.append({"book_id": at.uri, **row})
                    size += len(row.get("html") or "")
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(out, SCHEMA)
                        out, size = [], 0
            except Exception as e:  # any defect of the file makes an error book
                out.append({"book_id": at.uri, "parse_error": f"{type(e).__name__}: {e}"})
        if out:
            yield pa.RecordBatch.from_pylist(out, SCHEMA)


class BookSource(DataSource):
    """One row per chapter file (``schema.CHAPTER_FILES``).

    A file that cannot be read gives a row with an error and no path; an entry
    that is too large one with its path and an error.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return CHAPTER_FILES

    def reader(self, schema) -> BookReader:
        return BookReader(self.options)
