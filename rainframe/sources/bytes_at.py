"""Bytes of a file at given places, from any file system that pyarrow knows, or from memory."""

from __future__ import annotations

import gzip

import pyarrow.fs


class Bytes:
    """at(offset, n) and size. A packed file (.gz) is unpacked in memory; of others only what is asked for is read."""

    def __init__(self, source: str | bytes):
        self.raw = self.file = None
        if isinstance(source, bytes):
            self.raw = source
        else:
            system, path = pyarrow.fs.FileSystem.from_uri(source) if ":/" in source else (pyarrow.fs.LocalFileSystem(), source)
            self.file = system.open_input_file(path)
            self.size = self.file.size()
            if self.at(0, 2) == b"\x1f\x8b":
                self.raw, self.file = gzip.decompress(self.file.read_at(self.size, 0)), None
        if self.raw is not None:
            self.size = len(self.raw)

    def at(self, offset: int, n: int) -> bytes:
        n = max(0, min(n, self.size - offset))
        return self.raw[offset : offset + n] if self.raw is not None else self.file.read_at(n, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
