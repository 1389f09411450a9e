"""Plumbing shared by the large-corpus operators: tables, the shared folder, skew-safe lookups."""

from __future__ import annotations

import ctypes
import functools
import gc
import mmap
import os
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, work_path  # noqa: F401  (for the operators)

#: Rows up to which a lookup side is broadcast; it is counted first.
BROADCAST_ROWS = 20_000
#: Rows and bytes of an Arrow batch between the JVM and Python, at most (one row may be longer).
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def lookup_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "left", rows: int | None = None) -> DataFrame:
    """Join ``left`` with ``right``, whose keys are unique and which is already materialised.

    ``right`` is broadcast only if its counted rows stay under ``BROADCAST_ROWS``.
    Otherwise both sides go through plain exchanges, so that the adaptive
    skew join can split a key that holds much of ``left``.
    """
    if rows is None:
        rows = right.count()
    if rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, how)
    return left.join(right.hint("merge"), on, how)


def least_hashes(wanted: int, known: int) -> int:
    """The bound below which lie about ``wanted`` of ``known`` evenly spread signed 64-bit hashes, for any numbers; all of them if there are no more."""
    return (1 << 63) - 1 if wanted >= known else (wanted << 64) // known - (1 << 63)


# ---------------------------------------------------------------- files in the shared folder


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


class _Atomic:
    """A file that takes its name only when it is closed without an error."""

    def __init__(self, uri: str):
        self.uri, self.local = uri, _local(uri)
        if self.local is not None:
            os.makedirs(os.path.dirname(self.local), exist_ok=True)
            self.tmp = f"{self.local}.{uuid.uuid4().hex}.tmp"
            self.f = open(self.tmp, "wb")  # noqa: SIM115
        else:
            from pyarrow import fs

            self.fs, self.path = fs.FileSystem.from_uri(uri)
            self.fs.create_dir(os.path.dirname(self.path), recursive=True)
            self.f = self.fs.open_output_stream(self.path)

    def __enter__(self):
        return self.f

    def __exit__(self, kind, *_):
        self.f.close()
        if self.local is not None:
            if kind is None:
                os.replace(self.tmp, self.local)
            else:
                os.unlink(self.tmp)
        elif kind is not None:
            self.fs.delete_file(self.path)


def open_write(uri: str) -> _Atomic:
    """Context manager for writing one file of the shared folder, on an executor."""
    return _Atomic(uri)


def open_read(uri: str):
    """A seekable binary file of the shared folder, on an executor."""
    local = _local(uri)
    if local is not None:
        return open(local, "rb")
    from pyarrow import fs

    found, path = fs.FileSystem.from_uri(uri)
    return found.open_input_file(path)


class Arrays:
    """Arrays in one file of the shared folder, which workers map read-only: one copy a machine, and its pages are the system's to take back.

    Handles are small, to be broadcast. Where a store or its files cannot be
    mapped, each worker reads the file into its own memory.
    """

    def __init__(self, uri: str, arrays: dict):
        """Write the arrays (for a list of equally shaped ones, all of them as one)."""
        self.uri, self.layout, at = uri, {}, 0
        with open_write(uri) as f:
            for name, x in arrays.items():
                parts, shape = (x, (len(x), *x[0].shape) if x else (0,)) if isinstance(x, list) else ([x], x.shape)
                kind, begin = (parts[0].dtype if parts else np.dtype(np.float32)).str, at
                for part in parts:
                    if part.size:
                        f.write(np.ascontiguousarray(part).data.cast("B"))
                        at += part.nbytes
                self.layout[name] = (kind, shape, begin)
                f.write(b"\0" * (-at % 64))
                at += -at % 64
        self.size = at

    def _bytes(self):
        local = _local(self.uri)
        if local is not None:
            with open(local, "rb") as f:
                try:
                    return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
                except OSError:  # no file system for it
                    pass
        with open_read(self.uri) as f:
            return f.read()

    def open(self) -> dict:
        """All arrays by name, not to be written to."""
        data = self._bytes() if self.size else b""
        out = {}
        for name, (kind, shape, begin) in self.layout.items():
            size = int(np.prod(shape))
            out[name] = np.frombuffer(data, kind, size, begin).reshape(shape) if size else np.zeros(shape, kind)
        return out


# ---------------------------------------------------------------- memory of Python workers


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits of Arrow batches to ``BATCH_ROWS`` and ``BATCH_BYTES``, for whole texts: both sides hold a batch at once.

    Limits that are smaller already stay. It changes speed and memory, no result.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(str(spark.conf.get(key)).removesuffix("b"))
        if not 0 < now <= most:
            spark.conf.set(key, most)


def hand_back() -> None:
    """Return to the system what this process no longer uses: garbage, Arrow's spare pages, free pages of the C heap (glibc only)."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run):
    """Wrap a function over a task's batches so that its worker, which Spark keeps for later stages, starts and ends lean.

    At the start a worker still has free pages of the stage before, whose
    broadcasts have just gone; at the end those of the task itself.
    """

    @functools.wraps(run)
    def own(batches):
        hand_back()
        try:
            yield from run(batches)
        finally:
            hand_back()

    return own


# ---------------------------------------------------------------- blocks of Arrow rows


def text_blocks(texts, rows: int = 4000, max_bytes: int = 16 << 20) -> Iterator:
    """Cut an Arrow array of texts into slices of bounded rows and, as far as single rows allow, bounded bytes."""
    at, n = 0, len(texts)
    while at < n:
        take = min(rows, n - at)
        while take > 1 and texts.slice(at, take).nbytes > max_bytes:
            take //= 2
        yield texts.slice(at, take)
        at += take


def arrow_units(texts) -> tuple:
    """Lower-cased pieces between white space, inside Arrow: offsets of documents, places of their pieces, distinct pieces. Nulls count as empty."""
    import pyarrow.compute as pc

    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts.fill_null("")))
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], coded.indices.to_numpy(), coded.dictionary


def split_units(texts) -> tuple:
    """As ``arrow_units``, the distinct pieces as a list."""
    offsets, places, units = arrow_units(texts)
    return offsets, places, units.to_pylist()
