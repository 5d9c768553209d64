"""Files that tasks write and read: any URI that pyarrow's file systems open, the shared folder above all."""

from __future__ import annotations

import mmap
import uuid

import numpy as np
from pyarrow import fs


def _located(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Output:
    """A file that gets its name only when it is whole, so that a lost task leaves nothing to read.  Of tasks that write one
    name with the same content the first counts."""

    def __init__(self, uri: str):
        self.system, self.path = _located(uri)
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.stream = self.system.open_output_stream(self.part)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()
        try:
            self.system.move(self.part, self.path)
        except OSError:
            if self.system.get_file_info(self.path).type != fs.FileType.File:
                raise
            self.system.delete_file(self.part)


class Input:
    """Random access to a whole file."""

    def __init__(self, uri: str):
        system, path = _located(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def at(self, offset: int, length: int) -> bytes:
        return self.file.read_at(length, offset)

    def __enter__(self) -> Input:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()


def mapped(uri: str, dtype: str) -> np.ndarray:
    """A file of numbers as an array, empty if there is no such file: memory-mapped where the shared folder is mounted, else read."""
    system, path = _located(uri)
    if not system.get_file_info(path).size:
        return np.zeros(0, dtype)
    if isinstance(system, fs.LocalFileSystem):
        with open(path, "rb") as f:
            return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), dtype)
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)
