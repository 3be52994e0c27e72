"""7z on the driver: the encoder that can repeat an archive byte for byte is the JVM's, and Python workers have no JVM. An
archive is opened only if writing its entries again gives the same bytes; any other stays a blob."""

from __future__ import annotations

import hashlib
import os
import tempfile

from pyspark.sql import SparkSession

from ..model import DecomposeLimits
from .framing import In, Out

#: Fixed value: methods tried after the declared one.
METHODS = ("LZMA2", "DEFLATE", "COPY", "BZIP2", "LZMA")


def _jvm(spark: SparkSession):
    jvm = spark.sparkContext._jvm
    return jvm, jvm.org.apache.commons.compress.archivers.sevenz


def _read(spark: SparkSession, path: str) -> list[dict]:
    jvm, z = _jvm(spark)
    f, out = z.SevenZFile.builder().setFile(jvm.java.io.File(path)).get(), []
    try:
        for e in f.getEntries():
            methods = list(e.getContentMethods() or ())
            x = {"name": e.getName() or "", "dir": e.isDirectory(), "anti": e.isAntiItem(), "stream": e.hasStream(), "method": str(methods[0].getMethod()) if methods else ""}
            for k in ("LastModifiedDate", "CreationDate", "AccessDate"):
                x[k] = getattr(e, f"get{k}")().getTime() if getattr(e, f"getHas{k}")() else None
            x["attributes"] = e.getWindowsAttributes() if e.getHasWindowsAttributes() else None
            x["data"] = bytes(f.getInputStream(e).readAllBytes()) if e.hasStream() else b""
            out.append(x)
    finally:
        f.close()
    return out


def write(spark: SparkSession, entries: list[dict], method: str, path: str) -> None:
    jvm, z = _jvm(spark)
    out = z.SevenZOutputFile(jvm.java.io.File(path))
    try:
        out.setContentCompression(getattr(z.SevenZMethod, method))
        for x in entries:
            e = z.SevenZArchiveEntry()
            e.setName(x["name"])
            e.setDirectory(x.get("dir", False))
            e.setAntiItem(x.get("anti", False))
            e.setHasStream(x.get("stream", True))
            for k in ("LastModifiedDate", "CreationDate", "AccessDate"):
                if x.get(k) is not None:
                    getattr(e, f"set{k}")(jvm.java.util.Date(x[k]))
            if x.get("attributes") is not None:
                e.setHasWindowsAttributes(True)
                e.setWindowsAttributes(x["attributes"])
            e.setSize(len(x["data"]))
            out.putArchiveEntry(e)
            if x.get("stream", True) and x["data"]:
                out.write(bytearray(x["data"]))
            out.closeArchiveEntry()
    finally:
        out.close()


def _written(spark: SparkSession, entries: list[dict], method: str) -> bytes:
    with tempfile.TemporaryDirectory() as d:
        write(spark, entries, method, os.path.join(d, "x.7z"))
        with open(os.path.join(d, "x.7z"), "rb") as f:
            return f.read()


def decompose(spark: SparkSession, data: bytes, limits: DecomposeLimits = DecomposeLimits()) -> tuple[bytes, list[bytes]] | None:
    from py4j.protocol import Py4JError

    if len(data) > limits.max_seven_z:
        return None
    with tempfile.TemporaryDirectory() as d:
        path = os.path.join(d, "in.7z")
        with open(path, "wb") as f:
            f.write(data)
        try:
            entries = _read(spark, path)
        except Py4JError:  # the JVM can't read it, so it stays closed
            return None
    if not entries:
        return None
    want, declared = hashlib.sha256(data).digest(), [x["method"] for x in entries if x["method"]]
    for method in dict.fromkeys([*[m for m in declared if m in METHODS][:1], *METHODS]):
        try:
            if hashlib.sha256(_written(spark, entries, method)).digest() == want:
                return _meta(entries, method), [x["data"] for x in entries if x["stream"]]
        except Py4JError:
            continue
    return None


def _meta(entries: list[dict], method: str) -> bytes:
    out = Out().bytes(method.encode()).int(len(entries))
    for x in entries:
        out.bytes(x["name"].encode()).int(x["dir"]).int(x["anti"]).int(x["stream"]).int(len(x["data"]))
        for k in ("LastModifiedDate", "CreationDate", "AccessDate", "attributes"):
            out.int(x[k] is not None).int(x[k] or 0)
    return out.done()


def _entries(meta: bytes) -> tuple[str, list[dict]]:
    m = In(meta)
    method, out = m.bytes().decode(), []
    for _ in range(m.int()):
        x = {"name": m.bytes().decode(), "dir": bool(m.int()), "anti": bool(m.int()), "stream": bool(m.int()), "size": m.int()}
        for k in ("LastModifiedDate", "CreationDate", "AccessDate", "attributes"):
            there, value = m.int(), m.int()
            x[k] = value if there else None
        out.append(x)
    return method, out


def rebuild(spark: SparkSession, meta: bytes, parts: list[bytes]) -> bytes:
    method, entries = _entries(meta)
    if len(parts) != sum(x["stream"] for x in entries):
        raise ValueError("parts don't fit this archive")
    left = iter(parts)
    return _written(spark, [x | {"data": next(left) if x["stream"] else b""} for x in entries], method)


def listing(meta: bytes) -> list[tuple[str, int, int]]:
    """(name, size, part) of the entries with a stream, in order."""
    return [(x["name"], x["size"], k) for k, x in enumerate(x for x in _entries(meta)[1] if x["stream"])]
