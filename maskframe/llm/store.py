"""Files that tasks write and read by themselves in the shared folder, whatever store it is in."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder given as a path or URI (file, hdfs, s3, gs), and the path in it."""
    return fs.FileSystem.from_uri(folder)


def made(folder: str) -> str:
    files, path = opened(folder)
    files.create_dir(path, recursive=True)
    return folder


def own_name(partition: int, number: int, suffix: str) -> str:
    """A name no other attempt of a task uses: what a lost attempt has left is never listed, so never read."""
    return f"{partition:06d}-{number:04d}-{uuid.uuid4().hex[:12]}{suffix}"
