"""Cabinets with stored or MSZIP folders: folders are held inflated and cut at their files."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

from ..functions.scalars import cab_checksum
from ..model import DecomposeLimits
from .framing import INLINE, LEVELS, In, Out, deflate

HEAD, DICTIONARY, BLOCK = 36, 32_768, 32_768
NONE, MSZIP = 0, 1
RAW, PART, FILE = range(3)


@dataclass
class Folder:
    method: int
    blocks: list[tuple[bytes, int, int, int]] = field(default_factory=list)  # header, offset of the data, packed, plain
    files: list[tuple[int, int, str]] = field(default_factory=list)  # offset in the folder, size, name


def parse(data: bytes) -> tuple[int, list[Folder], int] | None:
    """(start of the data, folders, end of the data), or None where this is not a cabinet of the plain kind."""
    if len(data) < HEAD or data[:4] != b"MSCF":
        return None
    (size,), (files_at,) = struct.unpack_from("<I", data, 8), struct.unpack_from("<I", data, 16)
    folders_n, files_n, flags = struct.unpack_from("<HHH", data, 26)
    if size != len(data) or not folders_n or flags & 3:
        return None
    p, folder_extra, data_extra = HEAD, 0, 0
    if flags & 4:
        head_extra, folder_extra, data_extra = struct.unpack_from("<HBB", data, p)
        p += 4 + head_extra
    folders, starts, counts = [], [], []
    for _ in range(folders_n):
        start, count, method = struct.unpack_from("<IHH", data, p)
        if method & 15 not in (NONE, MSZIP):
            return None
        folders.append(Folder(method & 15))
        starts.append(start)
        counts.append(count)
        p += 8 + folder_extra
    p = files_at
    for _ in range(files_n):
        plain, offset, folder = struct.unpack_from("<IIH", data, p)
        end = data.index(b"\0", p + 16)
        utf8 = struct.unpack_from("<H", data, p + 14)[0] & 0x80
        if folder >= len(folders):
            return None
        folders[folder].files.append((offset, plain, data[p + 16 : end].decode("utf-8" if utf8 else "latin-1", "replace")))
        p = end + 1
    at = starts[0]
    if at < p:
        return None
    for f, start, count in zip(folders, starts, counts):
        if start != at:
            return None
        for _ in range(count):
            packed, plain = struct.unpack_from("<HH", data, at + 4)
            body = at + 8 + data_extra
            if body + packed > len(data):
                return None
            f.blocks.append((data[at:body], body, packed, plain))
            at = body + packed
    return starts[0], folders, at


def _inflate(data: bytes, f: Folder) -> bytes | None:
    out, last = [], b""
    for _, at, packed, plain in f.blocks:
        body = data[at : at + packed]
        if f.method == MSZIP:
            if body[:2] != b"CK":
                return None
            d = zlib.decompressobj(-15, zdict=last) if last else zlib.decompressobj(-15)
            body = d.decompress(body[2:]) + d.flush()
        if len(body) != plain:
            return None
        out.append(body)
        last = body[-DICTIONARY:]
    return b"".join(out)


def _pack(plain: bytes, sizes: list[int], level: int) -> list[bytes]:
    out, at, last = [], 0, b""
    for n in sizes:
        body = plain[at : at + n]
        out.append(b"CK" + deflate(body, level, last))
        at, last = at + n, body[-DICTIONARY:]
    return out


def _level(data: bytes, f: Folder, plain: bytes) -> int | None:
    """The level that makes every block of the folder, each with the one before as its dictionary."""
    for level in LEVELS:
        at, last = 0, b""
        for _, start, packed, n in f.blocks:
            body = plain[at : at + n]
            if b"CK" + deflate(body, level, last) != data[start : start + packed]:
                break
            at, last = at + n, body[-DICTIONARY:]
        else:
            return level
    return None


def _ranges(f: Folder, size: int) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, name): files in order of their offsets and the gaps between; one range where they overlap."""
    out, at = [], 0
    for offset, n, name in sorted(f.files):
        if offset < at or offset + n > size:
            return [(PART, 0, size, "")] if size else []
        if offset > at:
            out.append((RAW if offset - at <= INLINE else PART, at, offset, ""))
        if n:
            out.append((FILE, offset, offset + n, name))
        at = offset + n
    if size > at:
        out.append((RAW if size - at <= INLINE else PART, at, size, ""))
    return out


def decompose(data: bytes, limits: DecomposeLimits = DecomposeLimits()) -> tuple[bytes, list[bytes]] | None:
    try:
        parsed = parse(data)
        if not parsed:
            return None
        first, folders, end = parsed
        meta, parts = Out().bytes(data[:first]).bytes(data[end:]).int(len(folders)), []
        for f in folders:
            plain = _inflate(data, f)
            level = None if plain is None else _level(data, f, plain) if f.method == MSZIP else 0
            if level is None:
                return None
            meta.int(f.method).int(level).int(len(f.blocks))
            for head, _, packed, n in f.blocks:
                meta.bytes(head).int(packed).int(n)
            ranges = _ranges(f, len(plain))
            meta.int(len(ranges))
            for kind, a, b, name in ranges:
                meta.int(kind).bytes(plain[a:b] if kind == RAW else name.encode()).int(b - a)
                if kind != RAW:
                    parts.append(plain[a:b])
        return meta.done(), parts
    except (struct.error, zlib.error, ValueError, IndexError):
        return None


def _folders(m: In):
    for _ in range(m.int()):
        method, level, n = m.int(), m.int(), m.int()
        blocks = [(m.bytes(), m.int(), m.int()) for _ in range(n)]
        yield method, level, blocks, [(m.int(), m.bytes(), m.int()) for _ in range(m.int())]


def rebuild(meta: bytes, parts: list[bytes]) -> bytes:
    m, left = In(meta), iter(parts)
    head, tail = m.bytes(), m.bytes()
    out = [head]
    for method, level, blocks, ranges in _folders(m):
        plain = b"".join(x if kind == RAW else next(left) for kind, x, _ in ranges)
        sizes = [n for _, _, n in blocks]
        if method == MSZIP:
            bodies = _pack(plain, sizes, level)
        else:
            ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
            bodies = [plain[e - n : e] for e, n in zip(ends, sizes)]
        for (header, packed, _), body in zip(blocks, bodies):
            if len(body) != packed:
                raise ValueError("a block of this cabinet can't be made again")
            out += [header, body]
    if next(left, None) is not None:
        raise ValueError("parts are left over")
    return b"".join([*out, tail])


def listing(meta: bytes) -> list[tuple[str, int, int]]:
    """(name, size, part) of each file with bytes."""
    m, part, out = In(meta), 0, []
    m.bytes(), m.bytes()
    for *_, ranges in _folders(m):
        for kind, x, n in ranges:
            if kind == FILE:
                out.append((x.decode(), n, part))
            part += kind != RAW
    return out


def write(entries: list[tuple[str, bytes]], level: int = 6) -> bytes:
    """A cabinet of one MSZIP folder, blocks chained by dictionary, with checksums."""
    plain = b"".join(b for _, b in entries)
    sizes = [len(plain[i : i + BLOCK]) for i in range(0, len(plain), BLOCK)]
    files, at = [], 0
    for name, b in entries:
        files.append(struct.pack("<IIHHHH", len(b), at, 0, 0x58A1, 0, 0x20 | (0 if name.isascii() else 0x80)) + name.encode() + b"\0")
        at += len(b)
    start = HEAD + 8 + sum(map(len, files))
    blocks = []
    for body, n in zip(_pack(plain, sizes, level), sizes):
        sizes_ = struct.pack("<HH", len(body), n)
        blocks.append(struct.pack("<I", cab_checksum(sizes_, cab_checksum(body))) + sizes_ + body)
    total = start + sum(map(len, blocks))
    head = b"MSCF" + struct.pack("<IIIIIBBHHHHH", 0, total, 0, HEAD + 8, 0, 3, 1, 1, len(files), 0, 0x1234, 0)
    return head + struct.pack("<IHH", start, len(blocks), MSZIP) + b"".join(files) + b"".join(blocks)
