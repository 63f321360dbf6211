"""Plain files in the shared folder, written and read by tasks."""

from __future__ import annotations

import re

import numpy as np
from pyarrow import fs


def place(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path of a folder given as a URI or a local path."""
    if re.match(r"\w+:", folder):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))
    return fs.LocalFileSystem(), folder


class Written:
    """A file that appears under its name only when it is complete; a task that runs again puts the same in its place."""

    def __init__(self, system: fs.FileSystem, path: str, attempt: int) -> None:
        self.system, self.path, self.draft = system, path, f"{path}.{attempt}.draft"
        self.stream, self.size = system.open_output_stream(self.draft, compression=None), 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()
        self.system.move(self.draft, self.path)


def mapped(system: fs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A file of numbers: memory-mapped on a local or mounted disk, else read."""
    if system.get_file_info(path).size == 0:
        return np.zeros(0, dtype)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)
