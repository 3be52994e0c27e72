"""Bounded-space online packing: each partition keeps a fixed number of open windows, places a piece best-fit, emits the
fullest window when none fits, and what is left open is merged at the end."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .tokens import encoder, parts, vocabulary

VOCABULARY, END, WINDOW = "byte_bpe_50k.json", 0, 1024
#: Open windows of a partition; a window with at most SLACK free places is emitted as it is, one with more is first
#: filled with the head of the piece that found no room. MERGE: partitions whose rests meet in one task.
OPEN, SLACK, MERGE = 32, 4, 256
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, rest long, ids binary"
_TYPES = (*[pa.int64()] * 8, pa.binary())
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]

Piece = tuple  # (doc_id, start, ids as bytes, doc_tokens)


class Packer:
    """Windows are lists of pieces; `free` holds (free places, number) of the open ones, ascending."""

    def __init__(self, window: int, most: int, number: int) -> None:
        self.window, self.most, self.number = window, most, number
        self.free: list[tuple[int, int]] = []
        self.open: dict[int, list[Piece]] = {}

    def _new(self) -> tuple[int, int]:
        self.number += 1
        self.open[self.number] = []
        return self.window, self.number

    def _put(self, slot: tuple[int, int], piece: Piece) -> Iterator[tuple[int, list[Piece]]]:
        """Into a window that is in no list of `free`."""
        places, k = slot
        self.open[k].append(piece)
        places -= len(piece[2]) // 4
        if places:
            insort(self.free, (places, k))
        else:
            yield k, self.open.pop(k)

    def add(self, piece: Piece) -> Iterator[tuple[int, list[Piece]]]:
        """Gives the windows that are done."""
        doc, start, ids, tokens = piece
        size, at = len(ids) // 4, 0
        while size - at > self.window:  # whole windows need no search
            yield from self._put(self._new(), (doc, start + at, ids[at * 4 : (at + self.window) * 4], tokens))
            at += self.window
        rest = (doc, start + at, ids[at * 4 :], tokens)
        i = bisect_left(self.free, (size - at, -1))
        if i < len(self.free):
            yield from self._put(self.free.pop(i), rest)
        elif len(self.free) < self.most:
            yield from self._put(self._new(), rest)
        else:
            places, k = self.free.pop(0)  # the fullest
            if places <= SLACK:
                yield k, self.open.pop(k)
                yield from self._put(self._new(), rest)
            else:
                yield from self._put((places, k), (doc, rest[1], rest[2][: places * 4], tokens))
                yield from self.add((doc, rest[1] + places, rest[2][places * 4 :], tokens))

    def close(self) -> Iterator[tuple[int, list[Piece]]]:
        """Fill the fuller windows with the pieces of the emptier ones; at most the last window given is not full."""
        slots = [k for _, k in self.free]
        pieces = [p for k in slots for p in self.open[k]]
        self.free, self.open = [], {}
        k, now, places = None, [], 0
        for doc, start, ids, tokens in pieces:
            at, size = 0, len(ids) // 4
            while at < size:
                if not places:
                    if now:
                        yield k, now
                    self.number += 1
                    k, now, places = self.number, [], self.window
                n = min(places, size - at)
                now.append((doc, start + at, ids[at * 4 : (at + n) * 4], tokens))
                at, places = at + n, places - n
        if now:
            yield k, now


def _rows(k: int, pieces: list[Piece], rest: int | None) -> list[tuple]:
    """Rows of a window; with `rest` (the number of a rest) they keep their ids, to be packed again."""
    out, offset = [], 0
    for doc, start, ids, tokens in pieces:
        out.append((doc, start, len(ids) // 4, zlib.crc32(ids), tokens, k, offset, rest, None if rest is None else ids))
        offset += len(ids) // 4
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def _pack(pieces: Iterable[Piece], window: int, most: int, number: int, rest: int | None) -> Iterator[pa.RecordBatch]:
    """rest: what stays unfilled gets that number and is packed again; None: it is a short last window."""
    p, rows = Packer(window, most, number), []
    for piece in pieces:
        for k, done in p.add(piece):
            rows += _rows(k, done, None)
        if len(rows) > 20_000:
            yield _batch(rows)
            rows = []
    for k, done in p.close():
        rows += _rows(k, done, rest if sum(len(x[2]) for x in done) < window * 4 else None)
    if rows:
        yield _batch(rows)


def _with(f):
    """applyInArrow wants a function of exactly two arguments."""
    return lambda key, t: f(key, t)


def pack(docs: DataFrame, file: str, spaces: str, end: int, window: int = WINDOW, most: int = OPEN, text: str = "text") -> DataFrame:
    """A row for each piece of a document: its place in the document and in its sequence. Nothing but the rests, less
    than a window for each partition, is shuffled; they are merged MERGE partitions at a time until one task has all.
    A null or empty text is its end id alone; equal rows are packed like any others; sequence ids are unique, not dense."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, enc, tail = TaskContext.get().partitionId(), encoder(file, spaces), end.to_bytes(4, "little")

        def pieces() -> Iterator[Piece]:
            for b in batches:
                for part in parts(b):
                    for doc, x in zip(part.column("doc_id").to_pylist(), enc.encode(part.column("text").to_pylist())):
                        yield doc, 0, x + tail, len(x) // 4 + 1

        yield from _pack(pieces(), window, most, here << 36, here)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    done = materialise(rows.mapInArrow(first, SCHEMA), "packed")
    left, turn = 1 + (done.agg(F.max("rest")).first()[0] or 0), 0
    out = done.filter(F.col("rest").isNull())
    rests = done.filter(F.col("rest").isNotNull())
    while True:
        turn += 1
        left = -(-left // MERGE)

        def again(key, t, turn=turn, last=left == 1):
            t = t.sort_by([("rest", "ascending"), ("offset", "ascending")])
            pieces = zip(*(t.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")))
            got = list(_pack(pieces, window, most, (turn << 58) + (key[0].as_py() << 36), None if last else key[0].as_py()))
            return pa.Table.from_batches(got)

        merged = rests.groupBy(F.floor(F.col("rest") / MERGE).alias("group")).applyInArrow(_with(again), SCHEMA)
        if left == 1:
            return out.unionByName(merged).drop("rest", "ids")
        merged = materialise(merged, "packed-rests")
        out = out.unionByName(merged.filter(F.col("rest").isNull()))
        rests = merged.filter(F.col("rest").isNotNull())


def op9(docs: DataFrame, file: str | None = None) -> DataFrame:
    return pack(docs.select("doc_id", "text"), file or vocabulary(VOCABULARY), "kept", END)


def stage(docs: DataFrame) -> DataFrame:
    return op9(docs)
