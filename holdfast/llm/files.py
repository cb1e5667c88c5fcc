"""Binary files below the shared folder, written and read by tasks through the file system of the folder's URI.

A task writes under a name that no other attempt uses and reports it in the rows that it returns; only files named in
those rows, which Spark commits, are ever read, so lost executors and repeated tasks leave nothing behind that counts.
"""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or of an absolute path."""
    if not urlparse(uri).scheme:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def fresh(folder: str, stem: str, ending: str) -> str:
    system, path = place(folder)
    system.create_dir(path, recursive=True)
    return f"{folder}/{stem}-{uuid.uuid4().hex}{ending}"


def writer(uri: str):
    system, path = place(uri)
    return system.open_output_stream(path, compression=None)


def reader(uri: str):
    system, path = place(uri)
    return system.open_input_file(path)
