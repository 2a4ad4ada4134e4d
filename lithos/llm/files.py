"""Files in the shared folder, written and read by tasks through pyarrow's file systems."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_whole(folder: str, name: str, data: bytes) -> str:
    """Write a file under a name of this attempt's own; a retried task leaves no half file that anyone reads."""
    with writer(folder, name) as (out, path):
        out.write(data)
    return path


@contextmanager
def writer(folder: str, name: str):
    """A stream to a file of this attempt's own, and its path."""
    where, base = at(folder)
    where.create_dir(base, recursive=True)
    path = f"{folder}/{name}-{uuid.uuid4().hex[:12]}"
    with where.open_output_stream(f"{base}/{path.rpartition('/')[2]}") as out:
        yield out, path


def reader(path: str):
    where, p = at(path)
    return where.open_input_stream(p)


def read_whole(path: str) -> bytes:
    with reader(path) as f:
        return f.read()
