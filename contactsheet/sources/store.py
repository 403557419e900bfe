"""Folders and files as tasks see them: by the operating system for local paths, by Arrow's file systems for other URIs.

Every function here runs inside tasks.  A local path must be one that all executors see, such as a shared mount.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from typing import NamedTuple


class Entry(NamedTuple):
    """What a folder holds: `kind` is folder, file, or other (links to folders, broken links, sockets and the like)."""

    kind: str
    path: str


def local(path: str) -> str | None:
    """The path if it is one of the operating system, else None."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


def _remote(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def entries(folder: str) -> Iterator[Entry]:
    """What lies directly in a folder, one at a time; an OSError if it can't be read.

    A link to a file is a file; links to folders aren't followed, so no tree is endless.
    """
    if (at := local(folder)) is not None:
        with os.scandir(at) as listed:
            for e in listed:
                try:
                    kind = "folder" if e.is_dir(follow_symlinks=False) else "file" if e.is_file() else "other"
                except OSError:
                    kind = "other"
                yield Entry(kind, e.path)
        return
    from pyarrow import fs

    store, path = _remote(folder)
    prefix = folder[: len(folder.rstrip("/")) - len(path.rstrip("/"))]
    for e in store.get_file_info(fs.FileSelector(path, recursive=False)):
        yield Entry({fs.FileType.Directory: "folder", fs.FileType.File: "file"}.get(e.type, "other"), prefix + e.path)


def size_and_time(path: str) -> tuple[int, int]:
    """Bytes and microseconds of the last change of a file, of its target if it is a link; an OSError if there is none."""
    if (at := local(path)) is not None:
        s = os.stat(at)
        if not stat.S_ISREG(s.st_mode):
            raise FileNotFoundError(path)
        return s.st_size, s.st_mtime_ns // 1000
    store, at = _remote(path)
    e = store.get_file_info(at)
    if not e.is_file:
        raise FileNotFoundError(path)
    return e.size, (e.mtime_ns or 0) // 1000


def opened(path: str):
    """A file to read from: `read(n)`, `seek(at)`, and a context that closes it."""
    if (at := local(path)) is not None:
        return open(at, "rb")
    store, inner = _remote(path)
    return store.open_input_file(inner)


def put(path: str, data: bytes) -> None:
    """Writes a file whole, with the folders above it."""
    if (at := local(path)) is not None:
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "wb") as f:
            f.write(data)
        return
    store, inner = _remote(path)
    store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(inner) as f:
        f.write(data)
