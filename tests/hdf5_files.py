"""HDF5 files by the published layout, for tests: superblock 0 with symbol tables and header version 1, or superblock 2 with links and
header version 2."""

import struct
import zlib

import numpy as np

NONE = 0xFFFFFFFFFFFFFFFF


def kind_of(dtype):
    n, order = dtype.itemsize, int(dtype.byteorder == ">")
    if dtype.kind == "f":
        return struct.pack("<BBBBI", 0x11, order | 0x20, 8 * n - 1, 0, n) + struct.pack("<HHBBBBI", 0, 8 * n, 52 if n == 8 else 23, 11 if n == 8 else 8, 0, 52 if n == 8 else 23, 1023 if n == 8 else 127)
    return struct.pack("<BBBBI", 0x10, order | (8 if dtype.kind == "i" else 0), 0, 0, n) + struct.pack("<HH", 0, 8 * n)


def space(shape):
    return struct.pack("<BBBBI", 1, len(shape), 0, 0, 0) + b"".join(struct.pack("<Q", n) for n in shape)


def up(raw):
    return raw + b"\0" * (-len(raw) % 8)


def attribute(name, value):
    name = name.encode() + b"\0"
    if isinstance(value, str):
        raw = value.encode()
        kind, dims = struct.pack("<BBBBI", 0x13, 0, 0, 0, len(raw)), space(())
    else:
        raw, kind, dims = value.tobytes(), kind_of(value.dtype), space(value.shape)
    return struct.pack("<BBHHH", 1, 0, len(name), len(kind), len(dims)) + up(name) + up(kind) + up(dims) + raw


class Writer:
    def __init__(self, new=False):
        self.new, self.out = new, bytearray(b"\0" * 96)

    def put(self, raw):
        self.out += b"\0" * (-len(self.out) % 8)
        self.out += raw
        return len(self.out) - len(raw)

    def header(self, messages):
        if self.new:
            body = b"".join(struct.pack("<BHB", k, len(m), 0) + m for k, m in messages)
            return self.put(b"OHDR" + struct.pack("<BBI", 2, 2, len(body)) + body + b"\0" * 4)
        first = b"".join(struct.pack("<HHBBBB", k, len(up(m)), 0, 0, 0, 0) + up(m) for k, m in messages[:1])
        rest = b"".join(struct.pack("<HHBBBB", k, len(up(m)), 0, 0, 0, 0) + up(m) for k, m in messages[1:])
        at = self.put(rest)  # the rest goes on in another block
        more = struct.pack("<HHBBBB", 16, 16, 0, 0, 0, 0) + struct.pack("<QQ", at, len(rest))
        return self.put(struct.pack("<BBHIII", 1, 0, len(messages) + 1, 1, len(first + more), 0) + first + more)

    def dataset(self, values, chunk=None, attributes=None, filters=(), fill=None, skip=()):
        messages = [(1, space(values.shape)), (3, kind_of(values.dtype))]
        if fill is not None:
            raw = np.array(fill, values.dtype).tobytes()
            messages.append((5, struct.pack("<BBBBI", 2, 2, 2, 1, len(raw)) + raw))
        if chunk is None:
            messages.append((8, struct.pack("<BBQQ", 3, 1, self.put(values.tobytes()), values.nbytes)))
        else:
            n = values.itemsize
            leaves = []
            for at in np.ndindex(*(-(-s // c) for s, c in zip(values.shape, chunk))):
                place = [i * c for i, c in zip(at, chunk)]
                if tuple(at) in skip:
                    continue
                block = np.zeros(chunk, values.dtype)
                part = values[tuple(slice(p, p + c) for p, c in zip(place, chunk))]
                block[tuple(slice(0, k) for k in part.shape)] = part
                raw = block.tobytes()
                for f in filters:
                    raw = np.frombuffer(raw, np.uint8).reshape(-1, n).T.tobytes() if f == 2 else zlib.compress(raw) if f == 1 else raw + b"sums"
                leaves.append((struct.pack("<II", len(raw), 0) + b"".join(struct.pack("<Q", p) for p in [*place, 0]), self.put(raw)))
            end = struct.pack("<II", 0, 0) + struct.pack("<Q", 0) * (len(chunk) + 1)
            node = lambda level, rows: self.put(b"TREE" + struct.pack("<BBHQQ", 1, level, len(rows), NONE, NONE) + b"".join(k + struct.pack("<Q", a) for k, a in rows) + end)
            half = (len(leaves) + 1) // 2
            parts = [x for x in (leaves[:half], leaves[half:]) if x]
            tree = node(1, [(x[0][0], node(0, x)) for x in parts]) if parts else NONE
            messages.append((8, struct.pack("<BBBQ", 3, 2, len(chunk) + 1, tree) + b"".join(struct.pack("<I", c) for c in [*chunk, n])))
            if filters:
                own = b"".join(struct.pack("<HHHH", f, 0, 0, 1) + struct.pack("<II", n, 0) for f in filters)
                messages.append((11, struct.pack("<BB6x", 1, len(filters)) + own))
        return self.header([*messages, *((12, attribute(k, v)) for k, v in (attributes or {}).items())])

    def group(self, links):
        if self.new:
            return self.header([(2, struct.pack("<BBQQ", 0, 0, NONE, NONE)), *((6, struct.pack("<BBB", 1, 0, len(k)) + k.encode() + struct.pack("<Q", a)) for k, a in links.items())])
        names, where = b"\0" * 8, {}
        for k in links:
            where[k] = len(names)
            names += up(k.encode() + b"\0")
        heap = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), 1, self.put(names)))
        rows = b"".join(struct.pack("<QQII16x", where[k], links[k], 0, 0) for k in sorted(links))
        table = self.put(b"SNOD" + struct.pack("<BBH", 1, 0, len(links)) + rows)
        tree = self.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, NONE, NONE) + struct.pack("<QQQ", 0, table, 0))
        return self.header([(17, struct.pack("<QQ", tree, heap))])

    def done(self, root):
        if self.new:
            head = b"\x89HDF\r\n\x1a\n" + struct.pack("<BBBBQQQQI", 2, 8, 8, 0, 0, NONE, len(self.out), root, 0)
        else:
            head = b"\x89HDF\r\n\x1a\n" + struct.pack("<BBBBBBBBHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0) + struct.pack("<QQQQ", 0, NONE, len(self.out), NONE) + struct.pack("<QQII16x", 0, root, 0, 0)
        self.out[: len(head)] = head
        return bytes(self.out)
