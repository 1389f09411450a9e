"""Rendered documents as a Spark data sink: ``df.write.format("quire_documents").mode("append").save(folder)``.

Each task writes its rows' files into a folder of its own attempt, below a
hidden staging folder of the job, and tells the driver where. Only when all
tasks have ended well does the driver move the files of the attempts that count
to the folder itself and publish the job's lists. What other attempts have
written goes with the staging folder; an abort leaves nothing. The driver holds
one message a task and moves one attempt's files at a time, some at once.

Rows need ``book_id`` and ``document`` (binary); rows that share an identifier
share a file, of which one stays. ``mode("overwrite")`` removes the documents of
earlier jobs. Option: ``suffix``.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..sources.stores import opened

FORMAT = "quire_documents"
DOCUMENTS = "book_id string, path string, n_bytes bigint"
#: Files moved at once.
MOVES = 16
_UNSAFE = re.compile(r"[^A-Za-z0-9_.-]")


def file_name(book) -> str:
    """A plain file name; an identifier that is none gets its digest behind what is left of it, so no two share a file."""
    text = str(book)
    name = _UNSAFE.sub("_", text)
    return name if name == text and 0 < len(name) <= 100 and not name.startswith(".") else f"{name[-100:].lstrip('.')}-{hashlib.sha256(text.encode()).hexdigest()[:32]}"


@dataclass
class Written(WriterCommitMessage):
    partition: int
    attempt: str
    documents: int


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, options, schema, overwrite: bool):
        missing = {"book_id", "document"} - set(schema.names)
        if missing:
            raise ValueError(f"missing columns {sorted(missing)}")
        self.columns = [schema.names.index(c) for c in ("book_id", "document")]
        self.folder, self.suffix, self.overwrite, self.job = options["path"], options.get("suffix", ".pdf"), overwrite, uuid.uuid4().hex

    def _staging(self, base: str) -> str:
        return f"{base}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, base = opened(self.folder)
        attempt, count = uuid.uuid4().hex, 0
        here = f"{self._staging(base)}/{attempt}"
        store.create_dir(f"{here}/documents", recursive=True)
        partition, final = TaskContext.get().partitionId(), self.folder.rstrip("/")
        with store.open_output_stream(f"{here}/list.json") as listing:
            for batch in iterator:
                for book, body in zip(*(batch.column(c) for c in self.columns), strict=True):
                    book, body = book.as_py(), body.as_py() or b""
                    name = file_name(book) + self.suffix
                    with store.open_output_stream(f"{here}/documents/{name}") as f:
                        f.write(body)
                    listing.write(json.dumps({"book_id": None if book is None else str(book), "path": f"{final}/{name}", "n_bytes": len(body)}).encode() + b"\n")
                    count += 1
        return Written(partition, attempt, count)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = opened(self.folder)
        staging, lists = self._staging(base), f"{base}/_lists"
        earlier = [f.path for f in store.get_file_info(fs.FileSelector(lists, allow_not_found=True))] if self.overwrite else []
        store.create_dir(f"{staging}/lists", recursive=True)
        store.create_dir(lists, recursive=True)
        with ThreadPoolExecutor(MOVES) as pool:
            for path in earlier:
                for part in store.get_file_info(fs.FileSelector(path)):
                    with store.open_input_stream(part.path) as f:
                        names = {json.loads(line)["path"].rsplit("/", 1)[1] for line in f.read().splitlines()}
                    gone = [n for n, info in zip(names, store.get_file_info([f"{base}/{n}" for n in names])) if info.type == fs.FileType.File]
                    list(pool.map(lambda n: store.delete_file(f"{base}/{n}"), gone))
            for m in messages:
                if m is not None and m.documents:
                    files = store.get_file_info(fs.FileSelector(f"{staging}/{m.attempt}/documents"))
                    list(pool.map(lambda f: store.move(f.path, f"{base}/{f.base_name}"), files))
                    store.move(f"{staging}/{m.attempt}/list.json", f"{staging}/lists/{m.partition:05d}.json")
        store.move(f"{staging}/lists", f"{lists}/{self.job}")  # from here on the job's documents are listed
        for path in [*earlier, staging]:
            store.delete_dir(path)

    def abort(self, messages: list[Written | None]) -> None:
        store, base = opened(self.folder)
        if store.get_file_info(self._staging(base)).type != fs.FileType.NotFound:
            store.delete_dir(self._staging(base))


class DocumentSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "book_id string, document binary"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options, schema, overwrite)


def save_documents(rendered: DataFrame, folder: str, suffix: str = ".pdf", mode: str = "append") -> None:
    """Write each row's document as a file below a folder that driver and executors share, all or none."""
    rendered.sparkSession.dataSource.register(DocumentSink)
    rendered.select("book_id", "document").write.format(FORMAT).option("suffix", suffix).mode(mode).save(folder)


def listed_documents(spark, folder: str) -> DataFrame:
    """(book_id, path, n_bytes) of all documents that jobs have published in a folder, one row a file."""
    store, base = opened(folder)
    lists = store.get_file_info(fs.FileSelector(f"{base}/_lists", allow_not_found=True))
    jobs = sorted(f.base_name for f in lists if f.type == fs.FileType.Directory)
    if not jobs:
        return spark.createDataFrame([], DOCUMENTS)
    return spark.read.schema(DOCUMENTS).json([f"{folder.rstrip('/')}/_lists/{job}" for job in jobs]).dropDuplicates(["path"])
