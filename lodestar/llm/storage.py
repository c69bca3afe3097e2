"""Files that tasks write to and read from the shared store, through pyarrow's file systems."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI or an absolute path."""
    return pafs.FileSystem.from_uri(uri)


def fresh(folder: str, partition: int, suffix: str) -> str:
    """A file name that no other attempt of any task uses: a retried task leaves its first file unreferenced."""
    fs, path = locate(folder)
    fs.create_dir(path, recursive=True)
    return f"{folder}/{partition:06d}-{uuid.uuid4().hex}{suffix}"
