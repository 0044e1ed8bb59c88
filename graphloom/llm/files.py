"""Files in the shared folder, written whole or not at all."""

from __future__ import annotations

import uuid

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class NewFile:
    """Counts what is written; the file gets its name on ``close`` only.

    A task that runs again writes another file, and only the one whose name the
    task returns is read, so lost or repeated tasks do no harm.
    """

    def __init__(self, folder: str, stem: str, suffix: str) -> None:
        self.fs, base = place(folder)
        self.fs.create_dir(base, recursive=True)
        name = f"{stem}-{uuid.uuid4().hex}{suffix}"
        self.part, self.path, self.uri = f"{base}/.{name}.part", f"{base}/{name}", f"{folder}/{name}"
        self.out = self.fs.open_output_stream(self.part)
        self.at = 0

    def write(self, data: bytes) -> int:
        """Returns the offset at which ``data`` starts."""
        at, self.at = self.at, self.at + len(data)
        self.out.write(data)
        return at

    def close(self) -> str:
        self.out.close()
        self.fs.move(self.part, self.path)
        return self.uri


class Ranges:
    """Byte ranges of one file."""

    def __init__(self, uri: str) -> None:
        filesystem, path = place(uri)
        self.file = filesystem.open_input_file(path)
        self.size = self.file.size()

    def read(self, offset: int, length: int) -> bytes:
        return self.file.read_at(length, offset)

    def close(self) -> None:
        self.file.close()
