"""Files of any store that Arrow can open: paths, listing, seekable reads, staging folders."""

from __future__ import annotations

from typing import NamedTuple

from pyarrow import fs


class File(NamedTuple):
    uri: str
    size: int


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it; a plain path is local."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _uri(store: fs.FileSystem, folder: str, base: str, path: str) -> str:
    if isinstance(store, fs.LocalFileSystem):
        return f"file:{path}"
    lead = folder[: -len(base)] if base and folder.rstrip("/").endswith(base.rstrip("/")) else f"{store.type_name}://"
    return lead + path


def listed(folder: str, suffix: str) -> list[File]:
    """Files below a folder (or the file itself) by suffix in any case, in order of their names; hidden ones are left out."""
    store, base = opened(folder)
    here = store.get_file_info(base)
    found = [here] if here.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True)) if here.type == fs.FileType.Directory else None
    if found is None:
        raise FileNotFoundError(folder)
    inner = lambda path: path[len(base) :].strip("/").split("/")
    good = [f for f in found if f.type == fs.FileType.File and f.path.lower().endswith(suffix) and (f is here or not any(p.startswith(("_", ".")) for p in inner(f.path)))]
    return sorted(File(_uri(store, folder, base, f.path), f.size) for f in good)


def reading(uri: str):
    """A seekable binary file that reads what is asked for, no more."""
    store, path = opened(uri)
    return store.open_input_file(path)
