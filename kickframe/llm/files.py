"""Plain files in the shared folder, written and read by tasks."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class Attempt:
    """A file that gets its name only when it is whole.

    The name holds a token of this attempt, so a repeated task never meets the file
    of a lost one. What counts is the name that Spark commits with the task's rows.
    """

    def __init__(self, folder: str, stem: str, suffix: str):
        self.fs, base = place(folder)
        self.fs.create_dir(base, recursive=True)
        self.name = f"{stem}-{uuid.uuid4().hex[:12]}{suffix}"
        self._temporary, self._final = f"{base}/.{self.name}.tmp", f"{base}/{self.name}"
        self.out = self.fs.open_output_stream(self._temporary, buffer_size=1 << 20)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> str:
        self.out.close()
        self.fs.move(self._temporary, self._final)
        return self.name


@contextmanager
def opened(folder: str, name: str):
    """A committed file, for seeking reads."""
    system, base = place(folder)
    with system.open_input_file(f"{base}/{name}") as f:
        yield f


def put(folder: str, name: str, data: bytes) -> None:
    """A small file under a name that is known beforehand; attempts that write the same leave the same."""
    system, base = place(folder)
    system.create_dir(base, recursive=True)
    temporary = f"{base}/.{name}-{uuid.uuid4().hex[:12]}.tmp"
    with system.open_output_stream(temporary) as out:
        out.write(data)
    system.move(temporary, f"{base}/{name}")
