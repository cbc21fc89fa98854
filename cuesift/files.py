"""Bytes of files on any file system that Arrow knows (local paths, file:, hdfs:, s3: and so on), for drivers and tasks alike."""

from __future__ import annotations

import os

from pyarrow import NativeFile
from pyarrow import fs as arrow_fs


def located(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system that a path or address belongs to, and the path there."""
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), os.path.abspath(path)


def read_bytes(path: str, start: int = 0, end: int | None = None) -> bytes:
    """A file's bytes from start to before end."""
    files, at = located(path)
    with files.open_input_file(at) as f:
        size = f.size()
        stop = size if end is None else min(end, size)
        return f.read_at(max(stop - start, 0), start) if stop > start else b""


def size_of(path: str) -> int:
    files, at = located(path)
    found = files.get_file_info(at)
    if found.type != arrow_fs.FileType.File:
        raise FileNotFoundError(path)
    return found.size


def open_output(path: str) -> NativeFile:
    """A new file, with the folders above it."""
    files, at = located(path)
    files.create_dir(at.rsplit("/", 1)[0], recursive=True)
    return files.open_output_stream(at)


def write_bytes(path: str, data: bytes) -> None:
    with open_output(path) as f:
        f.write(data)


def folders(path: str) -> list[str]:
    """The paths of the folders directly below one, which must be there; links to folders don't count."""
    files, at = located(path)
    if isinstance(files, arrow_fs.LocalFileSystem):
        with os.scandir(os.path.realpath(at, strict=True)) as entries:
            return sorted(e.path for e in entries if e.is_dir(follow_symlinks=False))
    below = files.get_file_info(arrow_fs.FileSelector(at))
    prefix = path.rstrip("/")
    return sorted(f"{prefix}/{x.base_name}" for x in below if x.type == arrow_fs.FileType.Directory)


def entries(path: str) -> list[str]:
    """The paths of everything directly in a folder, which must be there."""
    files, at = located(path)
    if isinstance(files, arrow_fs.LocalFileSystem):
        return [os.path.join(at, name) for name in os.listdir(at)]
    prefix = path.rstrip("/")
    return [f"{prefix}/{x.base_name}" for x in files.get_file_info(arrow_fs.FileSelector(at))]
