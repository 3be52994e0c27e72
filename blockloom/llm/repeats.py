"""Suffix-array dedup: common-prefix interval trees over sparse, enhanced suffix arrays.

Only sampled suffixes are sorted. Of every string of LENGTH bytes the least hash of its GRAM-byte pieces marks an anchor,
so equal strings have their anchor at the same place. The consecutive strings that share an anchor form one stretch of
text, its context. Anchors whose piece occurs once are done with; equal contexts are one leaf with a count; the
contexts of a piece are sorted by what follows the anchor (the suffix array), neighbours' common
prefixes are stack-scanned into intervals, and in each interval the reversed texts before the anchor tell how far
its suffixes extend to the left and where they differ. A maximal repeat that is longer than a context comes as a chain of
groups, one for each anchor in it."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, lookup, materialise
from .shingles import _BYTE, _powers, mix64

LENGTH, GRAM = 200, 40
#: Different contexts that are sorted in one task. A piece with more is split by what stands around it: a string has its anchor at
#: one of LENGTH - GRAM + 1 places, and for each of RANGES stretches of places the bytes that all strings with the anchor there
#: must share part the contexts; a part that is still larger is split by whole strings, which are intervals by themselves.
MOST, RANGES = 4096, 4
_CHUNK = (1 << 20) - LENGTH
_LOW = np.uint64((1 << 20) - 1)


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the piece, its place, first and last start of a string) for each anchor; every string belongs to one."""
    out = []
    for c in range(0, max(0, len(data) - length + 1), _CHUNK):
        b = np.frombuffer(data, np.uint8)[c : c + _CHUNK + length - 1]
        power, inverse = _powers(len(b) + 1)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * power[: len(b)], out=total[1:])
        h = mix64((total[gram:] - total[:-gram]) * inverse[: len(b) - gram + 1])
        v = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal hashes is least
        w = length - gram + 1
        rows = -(-len(v) // w)
        p = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
        p[: len(v)] = v
        p = p.reshape(rows, w)
        ahead = np.minimum.accumulate(p, axis=1).reshape(-1)
        back = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        n = len(v) - w + 1
        least = np.minimum(back[:n], ahead[w - 1 : w - 1 + n])
        first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        last = np.append(first[1:], n) - 1
        at = (least[first] & _LOW).astype(np.int64)
        out.append((h[at], at + c, first + c, last + c))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out))


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def interval_scan(entries: list[tuple[bytes, int]], length: int, repeats: list | None = None, times: list[int] | None = None) -> list[tuple[int, int] | None]:
    """entries: different (context, place of the anchor in it). For each the bytes around its anchor, (before, after),
    that lie in a string of `length` which another entry has too; None where there is none. times: how often each context
    occurs; one that occurs more than once is a leaf of several suffixes, an interval by itself.

    Intervals close deepest first. An interval's suffixes agree on `depth` bytes from the anchor; they are kept sorted by
    the reversed text before it, smaller lists going into larger ones, so a suffix's longest left extension within the
    interval is with a neighbour in that order, and neighbours that met deeper down agree on more both ways. repeats:
    gets (left extension, depth, members) of each maximal repeat: the interval makes it maximal to the right, the
    difference of its members before the extension to the left; members are all entries of the interval that have it."""
    order = sorted(range(len(entries)), key=lambda i: entries[i][0][entries[i][1] :])
    after = [entries[i][0][entries[i][1] :] for i in order]
    before = [entries[i][0][: entries[i][1]][::-1] for i in order]
    best: list[tuple[int, int] | None] = [None] * len(entries)
    for i, x in enumerate(order):
        if times and times[x] > 1:
            best[i] = (len(before[i]), len(after[i]))
            if repeats is not None:
                repeats.append((*best[i], [x]))

    def close(depth: int, parts: list[list[int]]) -> list[int]:
        parts.sort(key=len)
        into = parts.pop()
        keys = [before[x] for x in into]
        lefts: set[tuple[int, int]] = set()
        for part in parts:
            for x in part:
                k = bisect_left(keys, before[x])
                for y in ([into[k - 1]] if k else []) + ([into[k]] if k < len(into) else []):
                    left = common_prefix(before[x], before[y])
                    if left + depth >= length:
                        lefts.add((left, x))
                        for z in (x, y):
                            l, r = best[z] or (0, 0)
                            best[z] = (max(l, left), max(r, depth))
                keys.insert(k, before[x])
                into.insert(k, x)
        if repeats is not None:
            seen = set()
            for left, x in lefts:
                i = j = bisect_left(keys, before[x][:left])
                while j < len(keys) and keys[j][:left] == before[x][:left]:
                    j += 1
                if (left, i) not in seen:
                    seen.add((left, i))
                    repeats.append((left, depth, [order[y] for y in into[i:j]]))
        return into

    stack: list[tuple[int, list[list[int]]]] = []  # (depth, parts)
    lcp = [common_prefix(a, b) for a, b in zip(after, after[1:])] + [-1]
    for i, depth in enumerate(lcp):
        part = [i]
        while stack and stack[-1][0] > depth:
            d, parts = stack.pop()
            part = close(d, [*parts, part])
        if depth < 0:
            break
        if stack and stack[-1][0] == depth:
            stack[-1][1].append(part)
        else:
            stack.append((depth, [part]))
    out: list[tuple[int, int] | None] = [None] * len(entries)
    for i, x in zip(order, best):
        out[i] = x
    return out


_ANCHORS = "rid long, dk long, th long, h array<long>, s array<long>, g array<long>"


def _anchor_table(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """A row for each document: rid (unique), and for each anchor h (hash of its piece), s (digest of its context), g
    (start << 16 | place of the anchor in the context << 8 | number of strings - 1)."""
    assert length - gram < 256

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 36
        for b in batches:
            ids, hs, ss, gs = [], [], [], []
            for text in b.column("text").to_pylist():
                data = text.encode("utf-8", "surrogatepass")
                h, at, lo, hi = anchors(data, length, gram)
                ids.append(rid)
                rid += 1
                hs.append(h.view(np.int64))
                ss.append(np.frombuffer(b"".join([hashlib.blake2b(data[x : y + length], digest_size=8).digest() for x, y in zip(lo.tolist(), hi.tolist())]), np.int64))
                gs.append(lo << 16 | (at - lo) << 8 | (hi - lo))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), b.column("dk"), b.column("th"), pa.array(hs, kind), pa.array(ss, kind), pa.array(gs, kind)], ["rid", "dk", "th", "h", "s", "g"])

    return materialise(docs.select(*doc_key(), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(find, _ANCHORS), "anchors")


def _contexts(reps: DataFrame, of: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The bytes of contexts (h, s, n, rid, g, m): (key, h, s, n, m, at, context); key: the piece."""
    to = reps.groupBy("rid").agg(F.collect_list(F.struct("h", "s", "n", "m", "g")).alias("to")).join(of, "rid").select("dk", "th", "to")
    texts = docs.select(*doc_key(), F.coalesce("text", F.lit("")).alias("text")).join(to, ["dk", "th"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, names = (pa.binary(), *[pa.int64()] * 5, pa.binary()), ["key", "h", "s", "n", "m", "at", "context"]
        for b in batches:
            rows = []
            for text, to in zip(b.column("text").to_pylist(), b.column("to").to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                for x in to:
                    lo, at, more = x["g"] >> 16, x["g"] >> 8 & 255, x["g"] & 255
                    rows.append((x["h"].to_bytes(8, "big", signed=True), x["h"], x["s"], x["n"], x["m"], at, data[lo : lo + more + length]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return texts.select("text", "to").mapInArrow(cut, _CONTEXTS).dropDuplicates(["h", "s"])


_CONTEXTS = "key binary, h long, s long, n long, m long, at long, context binary"
_FOUND = "gid binary, h long, s long, first long, last long"
_FOUND_TYPES, _FOUND_NAMES = (pa.binary(), *[pa.int64()] * 4), ["gid", "h", "s", "first", "last"]


def _scan_groups(contexts: DataFrame, length: int, groups: bool) -> DataFrame:
    """Of each context the range of its strings that lie in repeats (gid null), or (groups) a row for each member of each maximal
    repeat: gid, a digest of its bytes, and the range of its strings in the member's context. Parts are read in sorted
    order, one at a time; none has more than MOST entries."""

    def rows(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("key", "h", "s", "n", "at", "context")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, part in groupby(rows(batches), key=lambda r: r[0]):
            part = list(part)
            repeats: list | None = [] if groups else None
            spans = interval_scan([(r[5], r[4]) for r in part], length, repeats, [r[3] for r in part])
            if repeats is None:
                out += [(None, h, s, at - x[0], at + x[1] - length) for (_, h, s, _, at, _), x in zip(part, spans) if x]
            for left, depth, members in repeats or ():
                at, context = part[members[0]][4:]
                gid = hashlib.blake2b(context[at - left : at + depth], digest_size=16).digest()
                out += [(gid, part[k][1], part[k][2], part[k][4] - left, part[k][4] + depth - length) for k in members]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _FOUND_TYPES)], _FOUND_NAMES)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _FOUND_TYPES)], _FOUND_NAMES)

    return contexts.select("key", "h", "s", "n", "at", "context").repartition("key").sortWithinPartitions("key", "h", "s").mapInArrow(scan, _FOUND)


def _split(contexts: DataFrame, length: int, gram: int, ranges: int, keep: bool) -> DataFrame:
    """contexts under new keys: of each range of places that the anchor may have in a string the bytes that such strings share. With a
    range for each place (keep: False) the keys are the strings, and instead of bytes their start comes, in `at`."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = length - gram + 1
        cuts = [(places * k // ranges, places * (k + 1) // ranges - 1) for k in range(ranges)]
        types, names = (pa.binary(), *[pa.int64()] * 5, pa.binary()), ["key", "h", "s", "n", "m", "at", "context"]
        for b in batches:
            for i in range(0, b.num_rows, 500):
                out = []
                for h, s, n, at, context in zip(*(b.column(c).slice(i, 500).to_pylist() for c in ("h", "s", "n", "at", "context"))):
                    for k, (low, high) in enumerate(cuts):
                        if at >= low and len(context) - at >= length - high:
                            key = hashlib.blake2b(context[at - low : at + length - high], digest_size=16, key=(h & (1 << 64) - 1).to_bytes(8, "big") + bytes([k % 256])).digest()
                            out.append((key, h, s, n, 0, at if keep else at - low, context if keep else b""))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return contexts.mapInArrow(split, _CONTEXTS)


def _split_groups(contexts: DataFrame, length: int, gram: int, most: int, groups: bool) -> DataFrame:
    """_scan_groups for the contexts of pieces with over `most` of them."""
    parts = materialise(_split(contexts, length, gram, RANGES, True), "split-pieces")
    sizes = materialise(parts.groupBy("key").agg(F.count("*").alias("w"), F.sum("n").alias("all")).filter("all > 1").select("key", "w", F.col("w").alias("size")), "split-sizes")
    parts = materialise(lookup(parts, sizes, ["key"], "inner", "w", parts.count()), "split-contexts")
    found = _scan_groups(parts.filter(F.col("size") <= most), length, groups)
    rest = parts.filter(F.col("size") > most).select("h", "s", "n", "at", "context").dropDuplicates(["h", "s"])
    strings = materialise(_split(rest, length, gram, length - gram + 1, False).select("key", "h", "s", "n", "at"), "strings")
    twice = materialise(strings.groupBy("key").agg(F.count("*").alias("w"), F.sum("n").alias("all")).filter("all > 1").select("key", "w"), "repeated-strings")
    same = lookup(strings, twice, ["key"], "inner", "w", strings.count())
    return found.unionByName(same.select(F.col("key").alias("gid"), "h", "s", F.col("at").alias("first"), F.col("at").alias("last")))


def _repeats(docs: DataFrame, length: int, gram: int, most: int, groups: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, places, found): rid, dk, th of each document; rid, h, s, g of each anchor of a repeated piece; and what
    _scan_groups gives, over all pieces. A piece with one context, which is there several times, is a tree of one leaf:
    its context is the repeat, and no bytes are read for it."""
    table = _anchor_table(docs, length, gram)
    flat = table.select("rid", F.explode(F.arrays_zip("h", "s", "g")).alias("x")).select("rid", "x.h", "x.s", "x.g")
    pieces = materialise(table.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("w")).filter("w > 1"), "pieces")
    seen = materialise(lookup(flat, pieces, ["h"], "inner", "w", flat.count()), "repeated-anchors")
    entries = materialise(seen.groupBy("h", "s").agg(F.count("*").alias("n"), F.min(F.struct("rid", "g")).alias("of")).select("h", "s", "n", "of.rid", "of.g"), "contexts")
    kinds = materialise(entries.groupBy("h").agg(F.count("*").alias("w")).withColumn("m", F.col("w")), "piece-sizes")
    entries = materialise(lookup(entries, kinds, ["h"], "inner", "w", entries.count()), "sized-contexts")
    documents = table.select("rid", "dk", "th")
    contexts = materialise(_contexts(entries.filter("m > 1"), documents, docs, length), "context-bytes")
    leaf = entries.filter((F.col("n") > 1) & ((F.col("m") == 1) | (F.col("m") > most)))
    gid = F.unhex(F.md5(F.concat(F.col("h").cast("string"), F.lit("/"), F.col("s").cast("string")).cast("binary")))
    found = leaf.select(gid.alias("gid"), "h", "s", F.lit(0).cast("long").alias("first"), F.expr("g & 255").alias("last"))
    found = found.unionByName(_scan_groups(contexts.filter(F.col("m") <= most), length, groups))
    if contexts.filter(F.col("m") > most).head(1):
        found = found.unionByName(_split_groups(contexts.filter(F.col("m") > most), length, gram, most, groups))
    return documents, seen, found


def repeat_groups(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """(gid, dk, th, rid, start, size): the maximal repeats of at least `length` bytes with all of their occurrences: the document
    (common.doc_key; rid tells repeated rows apart), the first byte and the number of bytes. Within what an anchor's context
    shows, no repeat can be extended to either side for all of its members; a longer one comes as a chain of groups. Of a
    part that no split brings under `most` the groups are its strings of `length` bytes. Documents shorter than length,
    null and empty ones have none; repeated rows are occurrences like others."""
    documents, seen, found = _repeats(docs.select("doc_id", "text"), length, gram, most, True)
    found = materialise(found.dropDuplicates(["gid", "h", "s", "first"]), "group-members")
    n = found.groupBy("h", "s").agg(F.collect_list(F.struct("gid", "first", (F.col("last") - F.col("first") + length).alias("size"))).alias("in"))
    n = materialise(n.join(seen.groupBy("h", "s").agg(F.count("*").alias("n")), ["h", "s"]), "grouped-contexts")
    each = lookup(seen, n, ["h", "s"], "inner", "n", seen.count()).select("rid", "g", F.explode("in").alias("x"))
    each = each.select("x.gid", "rid", (F.expr("g >> 16") + F.col("x.first")).alias("start"), "x.size")
    return each.join(documents, "rid").select("gid", "dk", "th", "rid", "start", "size")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """(dk, th, spans): for each document (common.doc_key) that has any, the [start, end) byte ranges that lie in strings
    of `length` bytes which start at another place of the corpus as well; ranges may touch and overlap.

    Exact up to 128-bit digests. Documents shorter than length have none; null is empty. Repeated rows are copies of
    each other, hence repeats. A hot piece costs what its different contexts cost; copies are counted before a shuffle
    and found again by a broadcast of fewer than HOT_PARTS keys."""
    documents, seen, found = _repeats(docs.select("doc_id", "text"), length, gram, most, False)
    # every range holds its anchor, so those of one context are one
    ranges = found.groupBy("h", "s").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    ranges = materialise(ranges.join(seen.groupBy("h", "s").agg(F.count("*").alias("n")), ["h", "s"]), "ranges")
    found = lookup(seen, ranges, ["h", "s"], "inner", "n", seen.count())
    lo = F.expr("g >> 16")
    spans = found.groupBy("rid").agg(F.collect_list(F.struct((lo + F.col("first")).alias("start"), (lo + F.col("last") + length).alias("end"))).alias("spans"))
    return materialise(spans.join(documents, "rid").groupBy("dk", "th").agg(F.first("spans").alias("spans")), "spans")


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept, the bytes that remain."""
    spans = repeated_spans(docs, length, gram)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *doc_key(), F.coalesce("text", F.lit("")).alias("text")).join(spans, ["dk", "th"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                data, at, kept, n = text.encode("utf-8", "surrogatepass"), 0, [], 0
                end = -1
                for x in sorted(spans or (), key=lambda x: x["start"]):
                    if x["start"] > end:
                        kept.append(data[at : x["start"]])
                        n += 1
                    at = end = max(end, x["end"])
                kept = b"".join(kept) + data[at:]
                out.append((len(data), len(data) - len(kept), n, kept))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*out), types)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op6(docs: DataFrame) -> DataFrame:
    """A row for each document: bytes, bytes removed, runs removed, and the digest of what is left. Null texts, empty ones
    and those under LENGTH bytes lose nothing; repeated rows are copies of each other and lose all that has LENGTH bytes; an empty table
    gives no row; other columns don't matter."""
    return cut_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
