"""Members of a version in another shape: what they are called, a ZIP of stored entries, a directory."""

from __future__ import annotations

import hashlib
import io
import os
import zipfile
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codecs import codec_of
from ..functions.scalars import sanitise, sanitise_name
from ..model import RepackMode


def listing(fmt: int, meta: bytes) -> list[tuple[str, int, int]]:
    return codec_of(fmt).listing(meta)


def is_supported(members: DataFrame, parts: DataFrame, by: str = "version_id") -> DataFrame:
    """by, supported: there is a listing, every part it names is there, every name is sane; one bad line and nothing of
    that version is repacked. members: (by, name, part_index); parts: (by, ordinal)."""
    have = parts.select(by, F.col("ordinal").alias("part_index"), F.lit(True).alias("_there")).distinct()
    m = members.join(have, [by, "part_index"], "left")
    return m.groupBy(by).agg(F.bool_and(F.col("_there").isNotNull() & sanitise(F.col("name")).isNotNull()).alias("supported"))


def plan(members: DataFrame, parts: DataFrame, by: str = "version_id") -> DataFrame:
    """members with the columns of the part they name; only supported versions."""
    ok = is_supported(members, parts, by).filter("supported").select(by)
    return members.join(ok, by).join(parts.withColumnRenamed("ordinal", "part_index"), [by, "part_index"]).withColumn("name", sanitise(F.col("name")))


def write_zip(members: Iterable[tuple[str, bytes]]) -> bytes:
    """Stored entries with CRC-32, in order, with a fixed time."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in members:
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def write_dir(members: Iterable[tuple[str, bytes]], root: str) -> int:
    """A file for each member; a name that would leave root is an error."""
    n, root = 0, os.path.realpath(root)
    for name, data in members:
        path = os.path.realpath(os.path.join(root, sanitise_name(name) or "/"))
        if not path.startswith(root + os.sep):
            raise ValueError(f"not inside the target: {name}")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)
        n += 1
    return n


def repack(members: list[tuple[str, bytes]], mode: RepackMode, target: str) -> dict:
    """Write and read back; members whose bytes differ afterwards are an error."""
    if mode is RepackMode.ZIP:
        data = write_zip(members)
        with open(target, "wb") as f:
            f.write(data)
        with zipfile.ZipFile(target) as z:
            back = {n: z.read(n) for n in z.namelist()}
        size = len(data)
    else:
        write_dir(members, target)
        back = {n: open(os.path.join(target, n), "rb").read() for n, _ in members}
        size = sum(map(len, back.values()))
    for name, data in members:
        if hashlib.sha256(back.get(name, b"")).digest() != hashlib.sha256(data).digest():
            raise ValueError(f"{name} differs after repacking")
    return {"mode": mode.value, "entries": len(members), "content_bytes": sum(len(d) for _, d in members), "output_bytes": size}


def member_equality(a: DataFrame, b: DataFrame, name: str = "name", hash_: str = "hash") -> DataFrame:
    """name, equal: over the names of both sides."""
    left, right = a.select(name, F.col(hash_).alias("_a")), b.select(name, F.col(hash_).alias("_b"))
    return left.join(right, name, "full").select(name, F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("equal"))
