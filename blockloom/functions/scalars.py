"""Scalar functions as Spark columns, with plain Python twins where a driver needs them."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import ChunkParams

#: What an unfinished download's name ends with, and the magic numbers of containers.
TRANSIENT = (".part", ".tmp", ".crdownload")
MAGIC = {"ZIP": ("504B0304", "504B0506"), "CAB": ("4D534346",), "SEVEN_Z": ("377ABCAF271C",)}
#: Units of sizes: a letter alone, with b, or with ib; b by itself is bytes.
UNITS = {"": 0, "b": 0} | {f"{letter}{end}": power for power, letter in enumerate("kmgt", 1) for end in ("", "b", "ib")}
_SIZE = r"^\s*(\d+)([.,]\d+)?\s*([a-z]*)\s*$"


def sha256(payload: Column) -> Column:
    return F.unhex(F.sha2(payload, 256))


def parse_hash(hex_: Column) -> Column:
    """Null unless there are exactly 64 hex digits."""
    return F.when(hex_.rlike("^[0-9a-fA-F]{64}$"), F.unhex(hex_))


def hash_hex(h: Column) -> Column:
    return F.lower(F.hex(h))


def version_id(name: Column) -> Column:
    """The name without its last extension; a name that only has one keeps it."""
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1")


def not_transient(name: Column) -> Column:
    low = F.lower(name)
    return ~(F.startswith(low, F.lit(".")) | F.endswith(low, F.lit(TRANSIENT[0])) | F.endswith(low, F.lit(TRANSIENT[1])) | F.endswith(low, F.lit(TRANSIENT[2])))


def sniff(head: Column, length: Column) -> Column:
    """Format by the first bytes, never by the name; under 22 bytes there is none."""
    h = F.hex(F.substring(head, 1, 8))
    out = F.when(length < 22, F.lit(None).cast("string"))
    for name, starts in MAGIC.items():
        for s in starts:
            out = out.when(F.startswith(h, F.lit(s)), name)
    return out


def sniff_bytes(head: bytes, length: int) -> str | None:
    h = head[:8].hex().upper()
    return None if length < 22 else next((name for name, starts in MAGIC.items() if h.startswith(starts)), None)


def sanitise(name: Column) -> Column:
    """A relative path with forward slashes, or null: blank, absolute, with a colon, ending in a slash, or with a segment
    that is empty, . or .. ."""
    n = F.replace(name, F.lit("\\"), F.lit("/"))
    bad = ~n.rlike(r"\S") | n.contains(":") | n.rlike(r"(^|/)(\.\.?)?(/|$)")
    return F.when(~bad, n)


def sanitise_name(name: str | None) -> str | None:
    if name is None or not name.strip():
        return None
    name = name.replace("\\", "/")
    return None if ":" in name or any(p in ("", ".", "..") for p in name.split("/")) else name


def accepts_gzip(header: Column) -> Column:
    return F.coalesce(F.lower(header).contains("gzip"), F.lit(False))


def human(size: Column) -> Column:
    x = size.cast("double")
    out = F.when(size < 1024, F.format_string("%d B", size))
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB")):
        out = out.when(x < 1024.0 ** (power + 1), F.format_string(f"%.2f {unit}", x / 1024.0**power))
    return out.otherwise(F.format_string("%.2f TiB", x / 1024.0**4))


def percent(fraction: Column) -> Column:
    return F.format_string("%.2f%%", fraction * 100)


def seconds(nanos: Column) -> Column:
    return F.format_string("%.1fs", nanos / 1e9)


def parse_bytes(text: Column) -> Column:
    """A number and a binary unit; all units are powers of 1024 and what is left of a byte is cut. Null if it is neither."""
    low = F.lower(text)
    whole, part, unit = (F.regexp_extract(low, _SIZE, k) for k in (1, 2, 3))
    n = F.concat(whole, F.replace(part, F.lit(","), F.lit("."))).try_cast("double")
    factor = F.lit(None).cast("double")
    for power in sorted(set(UNITS.values())):
        factor = F.when(unit.isin([u for u, p in UNITS.items() if p == power]), 1024.0**power).otherwise(factor)
    return F.floor(n * factor)


def parse_size(text: str) -> int:
    m = re.match(_SIZE, text.lower())
    if not m or m[3] not in UNITS:
        raise ValueError(f"not a size: {text}")
    return int(float(m[1] + (m[2] or "").replace(",", ".")) * 1024 ** UNITS[m[3]])


def saved_fraction(moved: Column, size: Column) -> Column:
    return F.when(size == 0, 0.0).otherwise(1.0 - moved / size)


def compression_ratio(wire: Column, blocks: Column) -> Column:
    return F.when(blocks == 0, 1.0).otherwise(wire / blocks)


def framing_overhead(blocks: Column) -> Column:
    """A tag, a hash and a length for each frame, and the trailer."""
    return blocks * 37 + 17


def cache_key(hex_: Column, params: ChunkParams, max_seven_z: int) -> Column:
    return F.concat(F.substring(hex_, 1, 24), F.lit(f"-{params.avg}-{params.max}-7z{max_seven_z}"))


def escape_html(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def java_hash(s: str) -> int:
    """String.hashCode: over UTF-16 units, wrapping at 32 bits."""
    h = 0
    for u in memoryview(s.encode("utf-16-le")).cast("H"):
        h = (31 * h + u) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def name_bucket(name: Column, buckets: int) -> Column:
    """floorMod(String.hashCode, buckets) for names without surrogate pairs, folded in wrapping 32-bit arithmetic."""
    units = F.transform(F.split(name, ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(units, F.lit(0).cast("long"), lambda a, c: (a * 31 + c) % (1 << 32))
    return F.pmod(F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h), F.lit(buckets))


def mix(a: int, b: int, c: int) -> int:
    """A splitmix64 step over three words, wrapping."""
    m = (1 << 64) - 1
    x = (a * 0x9E3779B97F4A7C15 + b * 0xBF58476D1CE4E5B9 + c * 0x94D049BB133111EB) & m
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ x >> shift) * factor) & m
    return x ^ x >> 31


#: Blocks that a revision rewrites, at most.
RUN = 4


def block_revision(file_id: int, revision: int, block: int, blocks: int) -> int:
    """How many revisions of a file have touched one of its blocks: each rewrites a run of 1 to RUN blocks, where one draw says. A
    file without blocks is touched by all of them."""
    if blocks <= 0:
        return revision
    draws = (divmod(mix(file_id, r, blocks), RUN) for r in range(1, revision + 1))
    return sum(0 <= block - place % blocks <= more for place, more in draws)


def cab_checksum(data: bytes, seed: int = 0) -> int:
    """XOR of little-endian 32-bit words; the last 1 to 3 bytes count with the first of them highest."""
    whole = len(data) // 4 * 4
    x = seed ^ int(np.bitwise_xor.reduce(np.frombuffer(data[:whole], "<u4"), initial=0))
    return x ^ int.from_bytes(data[whole:], "big")
