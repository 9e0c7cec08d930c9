"""Files in the shared folder, written and read on executors."""

from __future__ import annotations

from collections.abc import Iterable


def opened(uri: str):
    """(file system, path) of a URI, or of a plain local path."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def put(folder: str, name: str, parts: Iterable[bytes]) -> None:
    """Writes a file, part by part, so that it is there in whole or not at all; a task that runs again replaces it."""
    import uuid

    fs, base = opened(folder)
    fs.create_dir(base, recursive=True)
    own = f"{base}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        for part in parts:
            out.write(part)
    fs.move(own, f"{base}/{name}")


def whole(folder: str, name: str) -> bytes:
    """All bytes of a file."""
    fs, base = opened(folder)
    with fs.open_input_stream(f"{base}/{name}") as f:
        return f.read()


class Ranges:
    """Reads ranges of one file after the other."""

    def __init__(self, folder: str):
        self.fs, self.base = opened(folder)
        self.name = self.file = None

    def size(self, name: str) -> int:
        return self._of(name).size()

    def read(self, name: str, start: int, length: int) -> bytes:
        return self._of(name).read_at(length, start)

    def _of(self, name: str):
        if name != self.name:
            if self.file:
                self.file.close()
            self.name, self.file = name, self.fs.open_input_file(f"{self.base}/{name}")
        return self.file
