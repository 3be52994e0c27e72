"""Length-prefixed fields for codec metas, and deflate levels."""

from __future__ import annotations

import zlib

#: Raw regions up to this size stay in the meta; the order in which deflate levels are tried.
INLINE, LEVELS = 4096, (6, 9, 1, 5, 4, 3, 2, 7, 8)


class Out:
    def __init__(self) -> None:
        self.parts: list[bytes] = []

    def int(self, x: int) -> Out:
        self.parts.append(x.to_bytes(8, "big", signed=True))
        return self

    def bytes(self, b: bytes) -> Out:
        self.int(len(b))
        self.parts.append(b)
        return self

    def done(self) -> bytes:
        return b"".join(self.parts)


class In:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def int(self) -> int:
        self.at += 8
        return int.from_bytes(self.data[self.at - 8 : self.at], "big", signed=True)

    def bytes(self) -> bytes:
        n = self.int()
        self.at += n
        return self.data[self.at - n : self.at]


def deflate(data: bytes, level: int, dictionary: bytes = b"") -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, -15, 8, zlib.Z_DEFAULT_STRATEGY, dictionary) if dictionary else zlib.compressobj(level, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


def probe_level(plain: bytes, packed: bytes, preferred: int | None) -> int | None:
    """The level that makes exactly these bytes; a level is given up at the first stretch that differs."""
    for level in dict.fromkeys([*([preferred] if preferred else []), *LEVELS]):
        c, at, same = zlib.compressobj(level, zlib.DEFLATED, -15), 0, True
        for i in range(0, len(plain) + 1, 65536):
            piece = c.compress(plain[i : i + 65536])
            if packed[at : at + len(piece)] != piece:
                same = False
                break
            at += len(piece)
        if same and packed[at:] == c.flush():
            return level
    return None
