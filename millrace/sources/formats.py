"""The binary formats: index files, and archives as a stream of tagged elements."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from millrace.functions.siphash import siphash

# Fixed values of the formats.
ENTRY = 0x1396FABCEA5BBB51
USER = 0xF453131AAEEACCB3
GROUP = 0x25EB6AC969396A52
XATTR = 0xB8157091F80BC486
ACL_USER = 0x297DC88B2EF12FAF
ACL_GROUP = 0x36F2ACB56CB3DD0B
ACL_GROUP_OBJECT = 0x23047110441F38F3
ACL_DEFAULT = 0xFE3EEDA6823C8CD0
ACL_DEFAULT_USER = 0xBDF03DF9BD010A91
ACL_DEFAULT_GROUP = 0xA0CB1168782D1F51
FCAPS = 0xF7267DB0AFED0629
SELINUX = 0x46FAF0602FD26C59
SYMLINK = 0x664A6FB6830E0D6C
DEVICE = 0xAC3DACE369DFE643
PAYLOAD = 0x8B9E1D93D6DCFFC9
FILENAME = 0x6DBB6EBCB3161F0B
GOODBYE = 0xDFD35C5E8327C403
GOODBYE_TAIL = 0x57446FA533702943
INDEX = 0x96824D9C7B129FF9
TABLE = 0xE75B9E112F17417D
TABLE_TAIL = 0x4B4F050E5549ECD1
NAME_KEY = (0x8574442B0F1D84B3, 0x2736ED30D1C22EC1)
SHA512_256 = 0x2000000000000000
# 32-bit ids, nanosecond times, permissions, symlinks, device nodes, FIFOs, sockets, xattrs, SHA-512/256.
ARCHIVE_FLAGS = 0x2 | 0x20 | 0x100 | 0x200 | 0x400 | 0x800 | 0x1000 | 0x10000000 | SHA512_256

IGNORED = (USER, GROUP, SELINUX, FCAPS, ACL_USER, ACL_GROUP, ACL_GROUP_OBJECT, ACL_DEFAULT, ACL_DEFAULT_USER, ACL_DEFAULT_GROUP)
ENDLESS = (1 << 64) - 1


class FormatError(ValueError):
    pass


def encode_index(chunks: list[tuple[str, int]], least: int, average: int, most: int, flags: int) -> bytes:
    """An index file from (id, size) in order."""
    out = [struct.pack("<6Q", 48, INDEX, flags, least, average, most), struct.pack("<2Q", ENDLESS, TABLE)]
    end = 0
    for id, size in chunks:
        end += size
        out.append(struct.pack("<Q", end) + bytes.fromhex(id))
    return b"".join([*out, struct.pack("<5Q", 0, 0, 48, 16 + 40 * len(chunks) + 40, TABLE_TAIL)])


def decode_index(data: bytes, digest: str | None = None) -> tuple[dict, list[tuple[str, int, int]]]:
    """Header, and (id, start, size) of each chunk. Checks every field the format fixes, and the digest if one is given."""
    if len(data) < 64 or struct.unpack_from("<2Q", data) != (48, INDEX):
        raise FormatError("not an index file")
    flags, least, average, most = struct.unpack_from("<4Q", data, 16)
    if digest and (digest == "sha512_256") != bool(flags & SHA512_256):
        raise FormatError("the index names chunks by another digest")
    if struct.unpack_from("<2Q", data, 48) != (ENDLESS, TABLE):
        raise FormatError("no chunk table")
    chunks, at, last = [], 64, 0
    while True:
        if at + 8 > len(data):
            raise FormatError("the chunk table has no end")
        (end,) = struct.unpack_from("<Q", data, at)
        if end == 0:
            break
        if at + 40 > len(data) or end < last or end - last > most:
            raise FormatError("wrong chunk size")
        chunks.append((data[at + 8 : at + 40].hex(), last, end - last))
        last, at = end, at + 40
    if data[at:] != struct.pack("<5Q", 0, 0, 48, 16 + 40 * len(chunks) + 40, TABLE_TAIL):
        raise FormatError("wrong tail")
    return {"flags": flags, "least": least, "average": average, "most": most}, chunks


@dataclass
class Node:
    """A file, directory, symlink or device; path is relative to the archive, the root is '.'."""

    path: str
    kind: str  # dir, file, link, device
    mode: int = 0
    uid: int = 0
    gid: int = 0
    mtime_ns: int = 0
    xattrs: dict[str, bytes] = field(default_factory=dict)
    data: bytes | None = None
    target: str | None = None
    major: int = 0
    minor: int = 0


def name_hash(name: str) -> int:
    return siphash(*NAME_KEY, name.encode())


def heap_order(items: list) -> list:
    """Sorted items as a complete binary search tree in an array: the children of place k are 2k+1 and 2k+2."""
    out: list = [None] * len(items)
    rest = iter(items)
    stack, at = [], 0
    while stack or at < len(out):
        while at < len(out):
            stack.append(at)
            at = 2 * at + 1
        at = stack.pop()
        out[at] = next(rest)
        at = 2 * at + 2
    return out


def goodbye(items: list[tuple[int, int, int]], at: int) -> bytes:
    """The directory's lookup table from (start, size, hash of the name) of its entries; `at` is where the table begins."""
    ordered = heap_order(sorted(((h, at - start, size) for start, size, h in items)))
    body = b"".join(struct.pack("<3Q", back, size, h) for h, back, size in ordered)
    size = 16 + len(body) + 24
    return struct.pack("<2Q", size, GOODBYE) + body + struct.pack("<3Q", at, size, GOODBYE_TAIL)


def encode_archive(nodes: list[Node]) -> bytes:
    """An archive of a tree; nodes in any order, with the root and every directory among them."""
    children: dict[str, list[Node]] = {}
    for n in nodes:
        if n.path != ".":
            children.setdefault(n.path.rpartition("/")[0] or ".", []).append(n)

    def text(kind: int, s: bytes) -> bytes:
        return struct.pack("<2Q", 16 + len(s) + 1, kind) + s + b"\0"

    def encode(n: Node) -> bytes:
        out = bytearray(struct.pack("<8Q", 64, ENTRY, ARCHIVE_FLAGS, n.mode, 0, n.uid, n.gid, n.mtime_ns))
        for k in sorted(n.xattrs):
            out += text(XATTR, k.encode() + b"\0" + n.xattrs[k])
        if n.kind == "file":
            out += struct.pack("<2Q", 16 + len(n.data or b""), PAYLOAD) + (n.data or b"")
        elif n.kind == "link":
            out += text(SYMLINK, (n.target or "").encode())
        elif n.kind == "device":
            out += struct.pack("<4Q", 32, DEVICE, n.major, n.minor)
        else:
            items = []
            for c in sorted(children.get(n.path, []), key=lambda c: c.path):
                name, start = c.path.rpartition("/")[2], len(out)
                out += text(FILENAME, name.encode()) + encode(c)
                items.append((start, len(out) - start, name_hash(name)))
            out += goodbye(items, len(out))
        return bytes(out)

    return encode(next(n for n in nodes if n.path == "."))


def elements(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(type, body) of each element."""
    at = 0
    while at < len(data):
        if at + 16 > len(data):
            raise FormatError("cut off")
        size, kind = struct.unpack_from("<2Q", data, at)
        if size < 16 or at + size > len(data):
            raise FormatError("wrong element size")
        yield kind, data[at + 16 : at + size]
        at += size


def safe(name: str) -> bool:
    return name not in ("", ".", "..") and "/" not in name and "\\" not in name


def decode_archive(data: bytes) -> list[Node]:
    """The nodes of an archive in order. Names that aren't single path components are an error."""
    out: list[Node] = []
    where = ["."]
    node: Node | None = None

    def close() -> None:
        nonlocal node
        if node:
            out.append(node)
            node = None

    entered = "."
    for kind, body in elements(data):
        if kind == ENTRY:
            close()
            if len(body) != 48:
                raise FormatError("wrong entry")
            _, mode, _, uid, gid, mtime = struct.unpack("<6Q", body)
            node = Node(entered, "dir", mode, uid, gid, mtime)
        elif kind == FILENAME:
            name = text_of(body)
            if not safe(name):
                raise FormatError(f"unsafe name {name!r}")
            if node and node.kind == "dir":
                where.append(node.path)
            close()
            entered = name if where[-1] == "." else f"{where[-1]}/{name}"
        elif kind == XATTR and node:
            k, _, v = body.removesuffix(b"\0").partition(b"\0")
            node.xattrs[k.decode()] = v
        elif kind == PAYLOAD and node:
            node.kind, node.data = "file", body
        elif kind == SYMLINK and node:
            node.kind, node.target = "link", text_of(body)
        elif kind == DEVICE and node:
            node.kind = "device"
            node.major, node.minor = struct.unpack("<2Q", body)
        elif kind == GOODBYE:
            if len(body) < 24 or struct.unpack_from("<Q", body, len(body) - 8)[0] != GOODBYE_TAIL:
                raise FormatError("goodbye without its tail")
            if node and node.kind == "dir":
                where.append(node.path)
            close()
            where.pop()
        elif kind not in IGNORED:
            raise FormatError(f"unknown element {kind:#x}")
    close()
    return out


def text_of(body: bytes) -> str:
    if not body.endswith(b"\0"):
        raise FormatError("a string has no end")
    return body[:-1].decode()
