"""Content-defined chunking: where blocks end depends on the bytes alone, so both sides of a transfer cut alike."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..model import ChunkParams

#: Fixed value: the seed of the 256 gear words, drawn from the 48-bit linear congruential generator of java.util.Random.
GEAR_SEED = 0x3F5A7C21D9B4E60E
DEFAULT_PARAMS = ChunkParams.of(64 << 10, 4 << 20)


def java_random(seed: int) -> Iterator[int]:
    """Signed 32-bit outputs of java.util.Random(seed)."""
    state, mask = (seed ^ 0x5DEECE66D) & (1 << 48) - 1, (1 << 48) - 1
    while True:
        state = (state * 0x5DEECE66D + 0xB) & mask
        x = state >> 16
        yield x - (1 << 32) if x >> 31 else x


def java_random_bytes(seed: int, n: int) -> bytes:
    r = java_random(seed)
    return b"".join((next(r) & 0xFFFFFFFF).to_bytes(4, "little") for _ in range(-(-n // 4)))[:n]


def gear_words() -> np.ndarray:
    r = java_random(GEAR_SEED)
    return np.array([((next(r) << 32) + next(r)) & (1 << 64) - 1 for _ in range(256)], np.uint64)


GEAR = gear_words()
_GEAR = GEAR.tolist()


def mask_for(bits: int) -> int:
    bits = min(40, max(2, bits))
    return ((1 << bits) - 1) << (63 - bits)


def masks(params: ChunkParams) -> tuple[int, int]:
    """Strict before the average size, lenient from there."""
    bits = params.avg.bit_length() - 1
    return mask_for(bits + 2), mask_for(bits - 2)


def cut_points(data: bytes, params: ChunkParams = DEFAULT_PARAMS, step: int = 1 << 22) -> list[int]:
    """Ends of the blocks of data. The rolling value forgets a byte after 64 shifts, so it is made for all places at once
    by six doublings; the first 63 places of each block, where it has seen fewer bytes, are followed one by one."""
    n, ends, start = len(data), [], 0
    strict, lenient = masks(params)
    low = high = 0
    hits: tuple[list[int], list[int]] = ([], [])
    while start < n:
        if n - start <= params.min:
            ends.append(n)
            break
        hard, normal = min(n, start + params.max), min(n, start + params.max, start + params.avg)
        if hard > high:  # candidates for the next stretch
            low, high = start, min(n, max(hard, start + step))
            first = max(0, low - 63)
            h = GEAR[np.frombuffer(data, np.uint8, high - first, first)]
            for w in (1, 2, 4, 8, 16, 32):
                shifted = h[:-w] << np.uint64(w)
                h[w:] += shifted
            hits = tuple((np.flatnonzero((h & np.uint64(m)) == 0) + first).tolist() for m in (strict, lenient))
        i, fp, end = start + params.min, 0, hard
        full = i + 63
        while i < min(hard, full):
            fp = ((fp << 1) + _GEAR[data[i]]) & 0xFFFFFFFFFFFFFFFF
            if not fp & (strict if i < normal else lenient):
                end = i
                break
            i += 1
        else:
            for places, a, b in ((hits[0], full, normal), (hits[1], max(full, normal), hard)):
                k = bisect_left(places, a)
                if k < len(places) and places[k] < b:
                    end = places[k]
                    break
        ends.append(end)
        start = end
    return ends


class PushChunker:
    """The same cuts for bytes that arrive in any slices: feed() and close() give finished blocks."""

    def __init__(self, params: ChunkParams = DEFAULT_PARAMS) -> None:
        self.params, self.held = params, bytearray()

    def feed(self, data: bytes) -> list[bytes]:
        self.held += data
        if len(self.held) < 2 * self.params.max:
            return []
        return self._emit(len(self.held) - self.params.max)

    def _emit(self, safe: int) -> list[bytes]:
        """Blocks that start before `safe`: those have all bytes that they may look at."""
        whole, start, out = bytes(self.held), 0, []
        for end in cut_points(whole, self.params):
            if start > safe:
                break
            out.append(whole[start:end])
            start = end
        del self.held[:start]
        return out

    def close(self) -> list[bytes]:
        return self._emit(len(self.held)) if self.held else []


def chunk(payloads: DataFrame, params: ChunkParams = DEFAULT_PARAMS, keys: tuple[str, ...] = ("payload_id",), payload: str = "payload", keep: bool = True) -> DataFrame:
    """keys, seq, length, hash and, if `keep`, the block itself as payload. A null payload is empty and has no block. Each
    payload is cut in one task, payloads are independent; batches stay near 4 MB, whatever the sizes of payloads."""
    schema = payloads.select(*keys).schema.add("seq", T.IntegerType()).add("length", T.IntegerType()).add("hash", T.BinaryType())
    schema = schema.add("payload", T.BinaryType()) if keep else schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            columns = [b.column(k).to_pylist() for k in keys]
            for i in range(b.num_rows):
                data, start = b.column("_payload")[i].as_py() or b"", 0
                for seq, end in enumerate(cut_points(data, params)):
                    part = data[start:end]
                    rows.append((*[c[i] for c in columns], seq, end - start, hashlib.sha256(part).digest(), *([part] if keep else [])))
                    size += len(part) + 64
                    start = end
                    if size > 4_000_000:
                        yield _batch(rows, arrow)
                        rows, size = [], 0
            if rows:
                yield _batch(rows, arrow)

    arrow = to_arrow_schema(schema)
    return payloads.select(*keys, F.col(payload).cast("binary").alias("_payload")).mapInArrow(cut, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
