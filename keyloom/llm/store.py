"""Files in the shared folder, from driver and executors alike."""

from __future__ import annotations

import uuid


def filesystem(uri: str):
    """(file system, path) of a folder or file URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def own_name(kind: str, suffix: str) -> str:
    """A name that no other attempt of a task takes: files of lost attempts are never named by a result."""
    return f"{kind}-{uuid.uuid4().hex}{suffix}"


class Reader:
    """Range reads that keep the last file open."""

    def __init__(self, folder: str):
        self.fs, self.path = filesystem(folder)
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            if self.file:
                self.file.close()
            self.name, self.file = name, self.fs.open_input_file(f"{self.path}/{name}")
        return self.file.read_at(length, offset)
