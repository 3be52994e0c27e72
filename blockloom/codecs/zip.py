"""ZIP: raw regions and payloads in file order; deflated payloads are held inflated where a level makes them again."""

from __future__ import annotations

import struct
import zlib
from concurrent.futures import ThreadPoolExecutor

from ..model import DecomposeLimits
from .framing import INLINE, In, Out, deflate, probe_level

RAW, PART, DEFLATED, VERBATIM, STORED = range(5)


def central_directory(data: bytes) -> list[tuple[int, int, int, int, int]] | None:
    """(local offset, compressed size, size, method, flags) of each entry; None where the directory is not whole."""
    at = data.rfind(b"PK\x05\x06", max(0, len(data) - 66_000))
    if at < 0 or at + 22 > len(data):
        return None
    count, size, start = struct.unpack_from("<HII", data, at + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (size, start):
        if at < 20 or data[at - 20 : at - 16] != b"PK\x06\x07":
            return None
        (end,) = struct.unpack_from("<Q", data, at - 12)
        if data[end : end + 4] != b"PK\x06\x06" or end + 56 > len(data):
            return None
        count, size, start = struct.unpack_from("<QQQ", data, end + 32)
    if count > 20_000_000 or start + size > len(data):
        return None
    out, p = [], start
    for _ in range(count):
        if data[p : p + 4] != b"PK\x01\x02" or p + 46 > len(data):
            return None
        flags, method = struct.unpack_from("<HH", data, p + 8)
        packed, plain = struct.unpack_from("<II", data, p + 20)
        name, extra, comment = struct.unpack_from("<HHH", data, p + 28)
        (offset,) = struct.unpack_from("<I", data, p + 42)
        q, stop = p + 46 + name, p + 46 + name + extra
        while q + 4 <= stop:  # ZIP64: 64-bit values for the fields that are full, in this order
            tag, n = struct.unpack_from("<HH", data, q)
            if tag == 1:
                wide = [struct.unpack_from("<Q", data, x)[0] for x in range(q + 4, min(stop, q + 4 + n) - 7, 8)]
                if plain == 0xFFFFFFFF and wide:
                    plain = wide.pop(0)
                if packed == 0xFFFFFFFF and wide:
                    packed = wide.pop(0)
                if offset == 0xFFFFFFFF and wide:
                    offset = wide.pop(0)
            q += 4 + n
        out.append((offset, packed, plain, method, flags))
        p = stop + comment
    return out


def _inflate(packed: bytes, size: int) -> bytes | None:
    d = zlib.decompressobj(-15)
    try:
        out = d.decompress(packed) + d.flush()
    except zlib.error:
        return None
    return out if d.eof and not d.unused_data and len(out) == size else None


def decompose(data: bytes, limits: DecomposeLimits = DecomposeLimits()) -> tuple[bytes, list[bytes]] | None:
    entries = central_directory(data)
    if entries is None:
        return None
    segments, parts, pos, level = [], [], 0, None

    def raw(end: int) -> None:
        if end - pos > INLINE:
            segments.append((PART, b"", 0))
            parts.append(data[pos:end])
        elif end > pos:
            segments.append((RAW, data[pos:end], 0))

    for offset, packed, plain, method, flags in sorted(entries):
        if not packed:
            continue
        if data[offset : offset + 4] != b"PK\x03\x04":
            return None
        name, extra = struct.unpack_from("<HH", data, offset + 26)
        start = offset + 30 + name + extra
        if start < pos or start + packed > len(data):
            return None
        raw(start)
        body, pos = data[start : start + packed], start + packed
        inner = _inflate(body, plain) if method == 8 and not flags & 1 else None
        found = probe_level(inner, body, level) if inner is not None else None
        if found:
            level = found
            segments.append((DEFLATED, b"", found))
            parts.append(inner)
        else:
            segments.append((STORED if method == 0 and not flags & 1 else VERBATIM, b"", 0))
            parts.append(body)
    raw(len(data))
    meta = Out().int(len(segments))
    for kind, inline, level in segments:
        meta.int(kind).int(level).bytes(inline)
    return meta.done(), parts


def _segments(meta: bytes):
    m = In(meta)
    for _ in range(m.int()):
        yield m.int(), m.int(), m.bytes()


def deflated_segments(meta: bytes) -> int:
    return sum(kind == DEFLATED for kind, *_ in _segments(meta))


def rebuild(meta: bytes, parts: list[bytes], threads: int = 4) -> bytes:
    """The archive again. Where more than one payload has to be deflated they are so in `threads` threads (zlib runs outside the
    interpreter's lock) and put together in order."""
    segments, left, jobs = list(_segments(meta)), iter(parts), []
    for kind, level, inline in segments:
        part = inline if kind == RAW else next(left, None)
        if part is None:
            raise ValueError("too few parts for this archive")
        jobs.append((part, level if kind == DEFLATED else None))
    if next(left, None) is not None:
        raise ValueError("parts are left over")

    def put(job: tuple) -> bytes:
        return job[0] if job[1] is None else deflate(*job)

    if threads < 2 or deflated_segments(meta) < 2:
        return b"".join(map(put, jobs))
    with ThreadPoolExecutor(threads) as pool:
        return b"".join(pool.map(put, jobs))


def listing(meta: bytes) -> list[tuple[str, int, int]]:
    """(name, -1, part) of the payloads whose local header stands in the meta just before them; a header in a region too
    large for that, and entries without bytes, have no line."""
    out, part, name = [], 0, None
    for kind, _, inline in _segments(meta):
        if kind == RAW:
            name = _local_name(inline)
            continue
        if kind != PART and name is not None:
            out.append((name, -1, part))
        name = None
        part += 1
    return out


def _local_name(raw: bytes) -> str | None:
    at = raw.rfind(b"PK\x03\x04")
    while at >= 0:
        if at + 30 <= len(raw):
            (flags,), (name, extra) = struct.unpack_from("<H", raw, at + 6), struct.unpack_from("<HH", raw, at + 26)
            if at + 30 + name + extra == len(raw):
                return raw[at + 30 : at + 30 + name].decode("utf-8" if flags & 0x800 else "latin-1", "replace")
        at = raw.rfind(b"PK\x03\x04", 0, at)
    return None
