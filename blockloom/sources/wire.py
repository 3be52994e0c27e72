"""Wire formats: frames with a trailer, hash lists, gzip; all integers big endian."""

from __future__ import annotations

import gzip as _gzip
import hashlib
import io
import zlib
from collections.abc import Iterable, Iterator

#: Fixed values of the formats.
FRAME, END, HASH_LIST, MAX_HASHES = b"\x01", b"\x00", b"JDTH1", 50_000_000


def write_frames(blocks: Iterable[tuple[bytes, bytes]], max_block: int) -> Iterator[bytes]:
    """(hash, payload) pairs as frames, then a trailer with their number and bytes. If `blocks` fails there is no trailer,
    so the reader sees that the stream was cut."""
    frames = total = 0
    for hash_, payload in blocks:
        if len(payload) > max_block:
            raise ValueError(f"a block of {len(payload)} bytes, the limit is {max_block}")
        yield FRAME + hash_ + len(payload).to_bytes(4, "big") + payload
        frames += 1
        total += len(payload)
    yield END + frames.to_bytes(8, "big") + total.to_bytes(8, "big")


def _exactly(stream, n: int, what: str) -> bytes:
    parts, left = [], n
    while left:
        data = stream.read(left)
        if not data:
            raise ValueError(f"truncated {what}")
        parts.append(data)
        left -= len(data)
    return b"".join(parts)


def frames(stream, max_block: int) -> Iterator[tuple[bytes, bytes]]:
    """(hash, payload) pairs of a file-like stream, each verified, one held at a time. A stream that ends before its trailer,
    or whose trailer has other counts, fails."""
    count = total = 0
    while (tag := _exactly(stream, 1, "stream: it ends before its trailer")) != END:
        if tag != FRAME:
            raise ValueError(f"unknown tag {tag!r}")
        head = _exactly(stream, 36, "frame")
        n = int.from_bytes(head[32:], "big", signed=True)
        if not 0 <= n <= max_block:
            raise ValueError(f"a block of {n} bytes, the limit is {max_block}")
        payload = _exactly(stream, n, "block")
        if hashlib.sha256(payload).digest() != head[:32]:
            raise ValueError("a block does not match its hash")
        count += 1
        total += n
        yield head[:32], payload
    end = _exactly(stream, 16, "trailer")
    want = int.from_bytes(end[:8], "big"), int.from_bytes(end[8:], "big")
    if want != (count, total):
        raise ValueError(f"the trailer promises {want}")


def read_frames(data: bytes, max_block: int) -> list[tuple[bytes, bytes]]:
    return list(frames(io.BytesIO(data), max_block))


def write_hash_list(hashes: list[bytes]) -> bytes:
    return HASH_LIST + len(hashes).to_bytes(4, "big") + b"".join(hashes)


def read_hash_list(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[5:9], "big", signed=True)
    if data[:5] != HASH_LIST or not 0 <= n <= MAX_HASHES or len(data) != 9 + 32 * n:
        raise ValueError("not a hash list")
    return [data[9 + 32 * i : 41 + 32 * i] for i in range(n)]


def gzip(data: bytes, level: int = 1) -> bytes:
    """Level 0 sends the bytes as they are."""
    return _gzip.compress(data, level, mtime=0) if level else data


def gunzip(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


def gzip_stream(parts: Iterable[bytes], level: int = 1) -> Iterator[bytes]:
    """The parts as one gzip member, sent as it is made; level 0 sends them as they are."""
    if not level:
        yield from parts
        return
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    for p in parts:
        if out := z.compress(p):
            yield out
    yield z.flush()


class Counting:
    """A stream that counts what is read from it, before any decoding."""

    def __init__(self, stream) -> None:
        self.stream, self.count = stream, 0

    def read(self, n: int = -1) -> bytes:
        data = self.stream.read(n)
        self.count += len(data)
        return data


def plain(stream, encoding: str | None):
    """The stream without its content encoding: gzip, or none."""
    if encoding in (None, "", "identity"):
        return stream
    if encoding.lower() != "gzip":
        raise ValueError(f"unknown encoding: {encoding}")
    return _gzip.GzipFile(fileobj=stream)
