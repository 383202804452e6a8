"""Files that executors write: temporary name, then an atomic move; any store that pyarrow can reach."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyarrow import fs


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a folder's URI (or local path)."""
    if "://" not in folder and folder.startswith("file:"):
        folder = "file://" + folder[len("file:") :]
    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


class Pending:
    """A file under a temporary name; commit() moves it to its final one. A retry writes the same bytes again."""

    def __init__(self, folder: str, name: str):
        self.fs, path = store(folder)
        self.fs.create_dir(path, recursive=True)
        self.temporary, self.final = f"{path}/_{name}.{uuid.uuid4().hex}.tmp", f"{path}/{name}"
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.final)

    def drop(self) -> None:
        self.out.close()
        self.fs.delete_file(self.temporary)


def mapped(folder: str, name: str, dtype: str) -> np.ndarray:
    """The numbers of a file: memory-mapped where it is local, else read."""
    where, path = store(folder)
    path = f"{path}/{name}"
    if isinstance(where, fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    with where.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)
