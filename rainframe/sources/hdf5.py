"""HDF5 files (NetCDF-4 ones too) decoded from their bytes: groups, attributes, and data sets that are whole, compact or in chunks.

Only the parts of a file that are asked for are read: headers, the index of chunks, and the chunks that hold the steps wanted.
What is not decoded is an error that names it: dense groups and attributes, other layouts than version 3, filters other than deflate,
shuffle and checksums, and element types other than numbers and text."""

from __future__ import annotations

import zlib

import numpy as np

from .bytes_at import Bytes

SIGNATURE = b"\x89HDF\r\n\x1a\n"
#: Numbers of header messages and filters in the format: fixed values.
SPACE, LINK_INFO, KIND, FILL, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUED, TABLE, ATTRIBUTE_INFO = 1, 2, 3, 5, 6, 8, 11, 12, 16, 17, 21
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3


class Part:
    """Little-endian numbers from bytes, one after the other; offsets and lengths have the file's sizes."""

    def __init__(self, raw: bytes, file: File):
        self.raw, self.file, self.at = raw, file, 0

    def take(self, n: int) -> bytes:
        self.at += n
        return self.raw[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def address(self) -> int | None:
        x = self.number(self.file.offset)
        return None if x == (1 << 8 * self.file.offset) - 1 else x + self.file.base

    def length(self) -> int:
        return self.number(self.file.size)


class File:
    """Data sets by path (without the leading stroke), each with its messages."""

    def __init__(self, source: Bytes, name: str = "the file"):
        self.source, self.name, self.offset, self.size, self.base = source, name, 8, 8, 0
        start = 0
        while source.at(start, 8) != SIGNATURE:
            start = max(512, 2 * start)
            if start >= source.size:
                raise ValueError(f"{name} is not an HDF5 file")
        head = Part(source.at(start, 128), self)
        head.at = 8
        version = head.number(1)
        if version < 2:
            head.at = 13
            self.offset, self.size = head.number(1), head.number(1)
            head.at = 24 + 4 * version
        else:
            self.offset, self.size = head.number(1), head.number(1)
            head.at += 1
        self.base = head.number(self.offset)
        head.at += (3 if version < 2 else 2) * self.offset
        if version < 2:
            head.at += self.offset  # the name of the root
        self.sets: dict[str, dict[int, list[bytes]]] = {}
        if (root := head.address()) is None:
            raise ValueError(f"{name} is cut short")
        self._group(root, "", set())

    def part(self, address: int, n: int) -> Part:
        return Part(self.source.at(address, n), self)

    def messages(self, address: int) -> dict[int, list[bytes]]:
        out: dict[int, list[bytes]] = {}
        head = self.part(address, 64)
        if new := head.raw[:4] == b"OHDR":
            head.at = 5
            flags = head.number(1)
            head.at += (16 if flags & 32 else 0) + (4 if flags & 16 else 0)
            n = head.number(1 << (flags & 3))
            blocks = [(address + head.at, n)]
        else:
            head.at = 8
            blocks, flags = [(address + 16, head.number(4))], 0
        while blocks:
            start, n = blocks.pop(0)
            block = self.part(start, n)
            least = (6 if flags & 4 else 4) if new else 8
            while block.at + least <= n:
                kind = block.number(1 if new else 2)
                size, marks = block.number(2), block.number(1)
                block.at += (2 if flags & 4 else 0) if new else 3
                raw = block.take(size)
                if marks & 2 and kind in (SPACE, KIND, LAYOUT, FILTERS):
                    raise ValueError(f"{self.name} shares header messages, which is not decoded")
                if kind == CONTINUED:
                    more = Part(raw, self)
                    at, size = more.address(), more.length()
                    blocks.append((at + 4, size - 8) if new else (at, size))
                out.setdefault(kind, []).append(raw)
        return out

    def _group(self, address: int, path: str, seen: set[int]) -> None:
        if address in seen:
            return
        seen.add(address)
        found = self.messages(address)
        if LAYOUT in found:
            self.sets[path] = found
            return
        for child, at in self._links(found):
            self._group(at, f"{path}/{child}".lstrip("/"), seen)

    def _links(self, found: dict[int, list[bytes]]) -> list[tuple[str, int]]:
        out = []
        for raw in found.get(LINK_INFO, ()):
            part = Part(raw, self)
            part.at = 2 + (8 if raw[1] & 1 else 0)
            if part.address() is not None:
                raise ValueError(f"{self.name} has a dense group, which is not decoded")
        for raw in found.get(LINK, ()):
            part, flags = Part(raw, self), raw[1]
            part.at = 2
            kind = part.number(1) if flags & 8 else 0
            part.at += (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
            child = part.take(part.number(1 << (flags & 3))).decode()
            if kind == 0:
                out.append((child, part.address()))
        for raw in found.get(TABLE, ()):
            part = Part(raw, self)
            tree, heap = part.address(), self.part(part.address(), 8 + 2 * self.size + self.offset)
            heap.at = 8

            size = heap.length()
            heap.at += self.size
            names = self.source.at(heap.address(), size)
            for node in self._leaves(tree, self.size):
                table = self.part(node[1], 8)
                table.at = 6
                n, each = table.number(2), 2 * self.offset + 24
                table = self.part(node[1] + 8, n * each)
                for i in range(n):
                    table.at = i * each
                    begin = table.number(self.offset)
                    out.append((names[begin : names.index(b"\0", begin)].decode(), table.address()))
        return out

    def _leaves(self, address: int | None, key: int) -> list[tuple[bytes, int]]:
        """(key, child) of all leaves of a B-tree of version 1."""
        if address is None:
            return []
        head = self.part(address, 8)
        head.at = 5
        level, n = head.number(1), head.number(2)
        each = key + self.offset
        part = self.part(address + 8 + 2 * self.offset, n * each)
        entries = [(part.take(key), part.address()) for _ in range(n)]
        return entries if level == 0 else [leaf for _, child in entries for leaf in self._leaves(child, key)]

    def kind(self, raw: bytes) -> np.dtype | str | None:
        """The element type: a number's, "text" of variable length, or None."""
        group, size = raw[0] & 15, int.from_bytes(raw[4:8], "little")
        order = ">" if raw[1] & 1 else "<"
        if group == 0:
            return np.dtype(f"{order}{'i' if raw[1] & 8 else 'u'}{size}")
        if group == 1:
            return np.dtype(f"{order}f{size}")
        if group == 3:
            return np.dtype(f"S{size}")
        return "text" if group == 9 and raw[1] & 15 == 1 else None

    def shape(self, raw: bytes) -> tuple[int, ...]:
        part = Part(raw, self)
        part.at = 8 if raw[0] == 1 else 4
        return tuple(part.length() for _ in range(raw[1]))

    def attributes(self, found: dict[int, list[bytes]]) -> dict[str, object]:
        for raw in found.get(ATTRIBUTE_INFO, ()):
            part = Part(raw, self)
            part.at = 2 + (2 if raw[1] & 1 else 0)
            if part.address() is not None:
                raise ValueError(f"{self.name} has dense attributes, which are not decoded")
        out = {}
        for raw in found.get(ATTRIBUTE, ()):
            part = Part(raw, self)
            part.at = 2
            sizes = [part.number(2) for _ in range(3)]
            part.at += raw[0] == 3
            up = (lambda n: -(-n // 8) * 8) if raw[0] == 1 else (lambda n: n)
            name, kind, space = (part.take(up(n))[:n] for n in sizes)
            kind, n = self.kind(kind), int(np.prod(self.shape(space), dtype=np.int64))
            if kind == "text":
                length = part.number(4)
                out[name.rstrip(b"\0").decode()] = self._global(part.address(), part.number(4))[:length].decode(errors="replace")
            elif kind is not None:
                data = np.frombuffer(part.take(n * kind.itemsize), kind)
                out[name.rstrip(b"\0").decode()] = data[0].decode(errors="replace") if kind.kind == "S" and n else data
        return out

    def _global(self, address: int | None, index: int) -> bytes:
        if address is None:
            return b""
        part = self.part(address, 8 + self.size)
        part.at = 8
        part = self.part(address, part.length())
        part.at = 8 + self.size
        while part.at + 8 + self.size <= len(part.raw):
            i = part.number(2)
            part.at += 6
            n = part.length()
            if i == index:
                return part.take(n)
            if not i:
                break
            part.at += -(-n // 8) * 8
        raise ValueError(f"{self.name} has no object {index} in its heap")


class Dataset:
    """A data set of numbers: its shape, element type, attributes, steps of its first axis in a chunk, and read(a, b)."""

    def __init__(self, file: File, path: str):
        found = file.sets[path]
        self.file, self.path = file, path
        self.shape, self.kind = file.shape(found[SPACE][0]), file.kind(found[KIND][0])
        self.layout, self.filters = Part(found[LAYOUT][0], file), self._filters(found.get(FILTERS, [b""])[0])
        self._found = found
        self.steps = 1
        if self.layout.raw[0] == 3 and self.layout.raw[1] == 2 and self.shape:
            self.layout.at = 3 + file.offset
            self.steps = self.layout.number(4)

    @property
    def attributes(self) -> dict[str, object]:
        return self.file.attributes(self._found)

    def _filters(self, raw: bytes) -> list[tuple[int, list[int]]]:
        if not raw:
            return []
        part, out = Part(raw, self.file), []
        part.at = 8 if raw[0] == 1 else 2
        for _ in range(raw[1]):
            number = part.number(2)
            named = part.number(2) if raw[0] == 1 or number >= 256 else 0
            part.at += 2
            n = part.number(2)
            part.at += -(-named // 8) * 8 if raw[0] == 1 else named
            out.append((number, [part.number(4) for _ in range(n)]))
            part.at += 4 if raw[0] == 1 and n % 2 else 0
            if number not in (DEFLATE, SHUFFLE, CHECKSUM):
                raise ValueError(f"filter {number} of {self.path} in {self.file.name} is not decoded")
        return out

    def _fill(self) -> object:
        for raw in self._found.get(FILL, ()):
            at = (2 if raw[1] & 32 else None) if raw[0] == 3 else (4 if raw[0] == 1 or raw[3:4] == b"\1" else None)
            if at is not None and int.from_bytes(raw[at : at + 4], "little") == self.kind.itemsize:
                return np.frombuffer(raw[at + 4 : at + 4 + self.kind.itemsize], self.kind)[0]
        return 0

    def read(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """Steps a to b of the first axis (a scalar whole)."""
        if not isinstance(self.kind, np.dtype) or self.kind.kind == "S":
            raise ValueError(f"{self.path} in {self.file.name} has no numbers")
        rows = self.shape[0] if self.shape else 1
        b = rows if b is None else min(b, rows)
        inner, source = self.shape[1:], self.file.source
        width = int(np.prod(inner, dtype=np.int64)) * self.kind.itemsize
        shape = (b - a, *inner) if self.shape else ()
        part = self.layout
        if part.raw[0] != 3:
            raise ValueError(f"layout version {part.raw[0]} of {self.path} in {self.file.name} is not decoded")
        part.at = 2
        if part.raw[1] == 0:
            return np.frombuffer(part.take(part.number(2)), self.kind, -1)[a * width // self.kind.itemsize :][: int(np.prod(shape, dtype=np.int64))].reshape(shape)
        if part.raw[1] == 1:
            at = part.address()
            if at is None:
                return np.full(shape, self._fill(), self.kind)
            return np.frombuffer(source.at(at + a * width, max(b - a, 0) * width), self.kind).reshape(shape)
        rank = part.number(1) - 1
        tree = part.address()
        chunk = [part.number(4) for _ in range(rank)]
        out = np.full(shape, self._fill(), self.kind)
        for key, at in self.file._leaves(tree, 8 + 8 * (rank + 1)):
            place = [int.from_bytes(key[8 + 8 * i : 16 + 8 * i], "little") for i in range(rank)]
            if place[0] >= b or place[0] + chunk[0] <= a:
                continue
            raw = self._undone(source.at(at, int.from_bytes(key[:4], "little")), int.from_bytes(key[4:8], "little"))
            values = np.frombuffer(raw, self.kind, int(np.prod(chunk, dtype=np.int64))).reshape(chunk)
            begin = [max(place[0], a), *place[1:]]
            end = [min(place[0] + chunk[0], b), *(min(p + c, n) for p, c, n in zip(place[1:], chunk[1:], inner))]
            to = tuple(slice(x - (a if i == 0 else 0), y - (a if i == 0 else 0)) for i, (x, y) in enumerate(zip(begin, end)))
            out[to] = values[tuple(slice(x - p, y - p) for x, y, p in zip(begin, end, place))]
        return out

    def _undone(self, raw: bytes, skipped: int) -> bytes:
        for i, (number, values) in reversed(list(enumerate(self.filters))):
            if skipped >> i & 1:
                continue
            if number == CHECKSUM:
                raw = raw[:-4]
            elif number == DEFLATE:
                raw = zlib.decompress(raw)
            else:
                size = values[0] if values else self.kind.itemsize
                whole = len(raw) // size * size
                raw = np.frombuffer(raw[:whole], np.uint8).reshape(size, -1).T.tobytes() + raw[whole:]
        return raw


def axes_of(shape: tuple[int, ...], lengths: dict[str, int | None]) -> tuple[str, ...] | None:
    """Names of a grid's axes by its shape and the lengths of lat and lon: (time,) lat, lon, or with the last two turned round where only that
    fits. None for other ranks than two and three."""
    if len(shape) not in (2, 3):
        return None
    first = ("time",) if len(shape) == 3 else ()
    lat, lon = lengths.get("lat"), lengths.get("lon")
    turned = shape[-2:] == (lon, lat) and shape[-2:] != (lat, lon)
    return (*first, "lon", "lat") if turned else (*first, "lat", "lon")
